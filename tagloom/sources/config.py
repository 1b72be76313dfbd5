"""Settings: a YAML or JSON file to plain dataclasses, bad values falling back to defaults; and application paths."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from tagloom.functions.scalar import IMAGE_SUFFIXES
from tagloom.functions.thresholds import DEFAULTS, category_id


@dataclass
class TaggerSettings:
    name: str = "dummy"
    model_path: str | None = None
    tags_csv: str | None = None
    thresholds: dict[int, float] = field(default_factory=lambda: dict(DEFAULTS))
    batch_size: int = 32


@dataclass
class DuplicateSettings:
    hamming: int = 10
    size_ratio: float | None = None
    cosine: float | None = None


@dataclass
class Settings:
    roots: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: list(IMAGE_SUFFIXES))
    top_k: int = 128
    tagger: TaggerSettings = field(default_factory=TaggerSettings)
    duplicates: DuplicateSettings = field(default_factory=DuplicateSettings)


def _coerced(kind: type, given: object):
    out = kind()
    for f in fields(kind):
        if not isinstance(given, dict) or f.name not in given:
            continue
        old, new = getattr(out, f.name), given[f.name]
        try:
            if hasattr(old, "__dataclass_fields__"):
                new = _coerced(type(old), new)
            elif f.name == "thresholds":
                new = {**DEFAULTS, **{k: float(v) for n, v in dict(new).items() if (k := category_id(n)) is not None}}
            elif isinstance(old, bool | int | float) and not isinstance(new, type(old)):
                new = type(old)(new)
            elif isinstance(old, list):
                new = [str(x) for x in ([new] if isinstance(new, str) else new)]
            setattr(out, f.name, new)
        except (TypeError, ValueError):
            continue
    return out


def load(path: str) -> Settings:
    """Settings of a file; defaults where it is missing, unreadable or a value doesn't fit."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        return Settings()
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = _json(text)
    except yaml.YAMLError:
        return Settings()
    return _coerced(Settings, data)


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def save(settings: Settings, path: str) -> None:
    """Written whole: to a file beside it that then takes its name."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    try:
        import yaml

        text = yaml.safe_dump(asdict(settings), sort_keys=True, allow_unicode=True)
    except ImportError:
        text = json.dumps(asdict(settings), indent=1, ensure_ascii=False)
    temp = f"{path}.{os.getpid()}.tmp"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)


def app_dir(environ: dict[str, str] | None = None, name: str = "tagloom") -> str:
    """Where settings live: $TAGLOOM_HOME, else the user's data folder."""
    env = os.environ if environ is None else environ
    return env.get("TAGLOOM_HOME") or os.path.join(env.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), name)
