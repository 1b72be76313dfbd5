"""Timestamps of mixed forms against a pattern and the zone database, odd inputs included."""

import re
from collections import Counter
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import stamps

SCHEMA = "stamp_id bigint, source string, zone string, raw string, kind string, wall int, kept_zone string"
FORM = re.compile(
    r"(20\d\d-\d\d-\d\d|20\d{6}|\d\d\.\d\d\.20\d\d|\d\d (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20\d\d|\d\d/\d\d/20\d\d)"
    r"(?:[T\x20](\d\d):([0-5]\d)(?::([0-5]\d))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-](?:0\d|1[0-4]):?[0-5]\d))?)?",
    re.A,
)


def brute_parse(raw):
    """The dates that a text allows (day first, month first), its time of day and its offset; an int for an epoch; null if bad."""
    if raw is None:
        return None
    raw = raw.strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}|[0-9]{13}", raw):
        return int(raw) * (10**6 if len(raw) == 10 else 1000)
    m = FORM.fullmatch(raw)
    if not m:
        return None
    d, h, minute, sec, half, off = m.groups()
    forms = {"/": ("%d/%m/%Y", "%m/%d/%Y"), "-": ("%Y-%m-%d",), ".": ("%d.%m.%Y",), " ": ("%d %b %Y",)}
    dates = []
    for f in next((v for k, v in forms.items() if k in d), ("%Y%m%d",)):
        try:
            dates.append(datetime.strptime(d, f))
        except ValueError:
            dates.append(None)
    h = int(h or 0)
    if half and not 1 <= h <= 12 or h > 23 or not any(dates):
        return None
    time = timedelta(hours=h % 12 + 12 * (half == "PM") if half else h, minutes=int(minute or 0), seconds=int(sec or 0))
    shift = None if off is None else timedelta(0) if off == "Z" else timedelta(hours=int(off[1:3]), minutes=int(off[-2:])) * (1 if off[0] == "+" else -1)
    return dates, time, shift


def micros(t):
    return round((t.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def brute(rows):
    votes, got = Counter(), []
    held = [(r, brute_parse(r[3])) for r in rows]
    known = lambda z: z in ("UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe")
    held = [(r, None if isinstance(p, tuple) and p[2] is None and not known(r[2]) else p) for r, p in held]
    for r, p in held:
        if isinstance(p, tuple) and len(p[0]) == 2 and not all(p[0]):
            votes[r[1], p[0][0] is not None] += 1
    for (i, source, zone, _), p in held:
        if p is None or isinstance(p, int):
            got.append((i, p, "bad" if p is None else "epoch", False))
            continue
        dates, time, shift = p
        rule, day = "plain", next(d for d in dates if d)
        if len(dates) == 2 and all(dates) and dates[0] != dates[1]:
            d, m = votes[source, True], votes[source, False]
            rule, day = "default" if d == m else "votes", dates[m > d]
        wall, odd = day + time, False
        if shift is None:
            z = ZoneInfo(zone)
            early, late = (wall.replace(tzinfo=z, fold=k).utcoffset() for k in (0, 1))
            odd = early != late
            # A skipped time read with fold 0 has the offset before the change and with fold 1 the one after it.
            shift = late
        got.append((i, micros(wall - shift), rule, odd or rule != "plain"))
    return sorted(got, key=repr)


PLANTED = [
    "2024-02-30", "2024-02-29", "2023-02-29", "20240229T23:59:59Z", "20240229 12:00 AM", "2024-01-01 12:00PM", "2024-01-01 00:30 AM", "2024-01-01 13:00 PM", "2024-01-01 24:00", "2024-01-01 10:60", "2024-01-01 10:10:60",
    "2024-01-01T10:10+14:59", "2024-01-01T10:10+15:00", "2024-01-01T10:10-0830", "2024-01-01T10:10 +08:30", "2024-01-01T10:10 AM Z", "2024-01-01T10:10AM-01:00", "2024-01-01T10:10z", "2024-01-01t10:10", "2024-01-01  10:10", "2024-01-01 10:10  AM",
    "2024-01-01 ", " 2024-01-01", "2024-01-01T", "2024-01-01 1:10", "02 Feb 2024 10:10", "30 Feb 2024", "02 feb 2024", "2 Feb 2024", "02.03.2024", "02.03.24", "1704104923", "1704078484047", "17040784840", "١٧٠٤١٠٤٩٢٣", "2024-01-01T10:10:10.5", "1999-01-01", "2100-01-01", "2099-12-31 23:59",
    None, "", " ", "n/a", "x" * 100_000, "2024-01-01" + "0" * 50_000, "20240101", "2024010", "2024-01-01Z", "\x0b2024-01-01\x0c", " 2024-01-01",
    "2024-03-31 02:00:00", "2024-03-31 02:30:00", "2024-03-31 03:00:00", "2024-03-31 01:59:59", "2024-10-27 02:00:00", "2024-10-27 02:59:59", "2024-10-27 03:00:00", "2024-03-10 02:30", "2024-11-03 01:30", "2024-11-03 02:00", "2024-04-07 01:45", "2024-10-06 02:15", "2099-10-25 02:30",
]
SLASHED = ["13/01/2024 10:00", "01/13/2024", "13/13/2024", "05/05/2024", "05/06/2024 10:00 PM", "31/03/2024 02:30", "03/10/2024 02:30", "02/30/2024", "30/02/2024", "01/02/2024 24:00", "25/12/2024 10:61", "04/05/2024T10:00Z"]


def planted():
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", None, "", "Nowhere/Land", "../UTC"]
    rows = [(i * 10 + k, "a", z, raw) for i, raw in enumerate(PLANTED) for k, z in enumerate(zones)]
    for source, more in (("day", ["13/01/2024"]), ("month", ["01/13/2024"]), ("tie", []), ("none", ["x"]), (None, ["01/13/2024", "01/14/2024"]), ("bad votes", ["01/13/2024 24:00"] * 9)):
        rows += [(9000, source, "Europe/Berlin", t) for t in SLASHED + more]
    rows += [(None, "lone", "UTC", "05/06/2024"), (None, "lone", "UTC", "05/06/2024"), (1, "lone", "UTC", None)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 7, "z") for r in rows], SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def test_stamps_against_brute_force(spark):
    rows = planted()
    want = brute(rows)
    for most in (stamps.MOST_SOURCES, 0):  # verdicts broadcast and joined
        got = stamps.normalise(frame(spark, rows), most_sources=most)
        assert got.columns == ["stamp_id", "utc_us", "rule", "ambiguous"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {w[2] for w in want} == {"bad", "epoch", "votes", "default", "plain"}


def test_stamps_carry_and_empty(spark):
    got = stamps.normalise(frame(spark, planted()[:9]), carry=("raw", "kind", "kept_zone")).collect()
    assert len(got) == 9 and all(r.kept_raw == "2024-02-30" and r.kept_kind == "clash" and r.kept_kept_zone == "z" and r.rule == "bad" for r in got)
    assert stamps.normalise(frame(spark, [])).count() == 0


def test_a_hot_source_is_one_number_a_task(spark):
    rows = [(i, "hot", "UTC", "01/13/2024" if i % 3 else "13/01/2024") for i in range(3000)] + [(9999, "hot", "UTC", "02/03/2024")]
    parsed = frame(spark, rows, 8).select("stamp_id", "source", "zone", "raw").rdd.mapPartitions(stamps.scan)
    assert stamps.votes(parsed, 4).collect() == [("hot", (1000, 2000))]
    assert stamps.normalise(frame(spark, rows)).filter("stamp_id = 9999").first().utc_us == micros(datetime(2024, 2, 3))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="0123456789-/.:T ZAPM+JanFeb", max_size=24), st.sampled_from(PLANTED + SLASHED), st.from_regex(FORM, fullmatch=True)))
def test_scanner_agrees_with_the_pattern(raw):
    want = brute_parse(raw)
    kind, wall, other, offset = stamps.parse(raw)
    if want is None or isinstance(want, int):
        assert (kind, wall) == ((stamps.BAD, None) if want is None else (stamps.EPOCH, want)), raw
        return
    dates, time, shift = want
    times = [micros(d + time) for d in dates if d]
    assert kind != stamps.BAD and [wall, *([] if other is None else [other])] == list(dict.fromkeys(times))
    assert offset == (None if shift is None else shift // timedelta(microseconds=1))


def test_changes_of_a_zone():
    for zone in ("Europe/Berlin", "America/Sao_Paulo", "Africa/Casablanca", "Pacific/Apia", "Australia/Lord_Howe"):
        z = ZoneInfo(zone)
        for k in range(20_000):
            wall = datetime(2000, 1, 1) + timedelta(hours=43.3 * k)
            early, late = (wall.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1))
            assert stamps.in_utc(micros(wall), zone) == (micros(wall - late), early != late), (zone, wall)
    assert stamps.changes("Nowhere/Land") is None and stamps.changes(None) is None
