"""Normalising timestamps of mixed forms: a recursive-descent scanner, votes on the order of slashed dates, zone changes.

``scan`` turns each text into a small tuple inside mapPartitions. Slashed dates that only one order allows vote for it in
their source; reduceByKey counts the votes, adding up within each task first, so that a source of any size is a few numbers
behind the shuffle. Sources are counted first, and their verdicts, one each at most, broadcast if there are ``most_sources`` of
them at most; beyond that they are joined, each verdict dealt to SALTS tasks, so that a large source spreads. Each row is then finished on its own: the order
that won, and a bisection over the changes of its zone, which each worker finds once a zone.

Defined results: null, empty and impossible texts are ``bad`` and have no time; so is a time without an offset whose zone is
null or unknown. A null source is a source of its own. White space at both ends doesn't count; a text of any length is read
only as far as it matches. Repeated rows and ids keep a row each; an empty table gives none; further columns are left out
but for those that ``carry`` names, which come back as ``kept_<name>``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from functools import lru_cache
from itertools import starmap
from operator import ne

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Verdicts that are broadcast at most; a name and a flag each, so some MB.
MOST_SOURCES = 50_000
#: Tasks that the rows of one source are dealt to where verdicts are joined.
SALTS = 64

BAD, EPOCH, PLAIN, DAY_FIRST, MONTH_FIRST, EITHER = range(6)
BLANK = " \t\n\x0b\x0c\r"
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
TWO = {f"{i:02d}": i for i in range(100)}
MONTHS = {m: i for i, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1)}
LENGTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
DIGITS = frozenset("0123456789")


class _NoStamp(Exception):
    pass


class _Scanner:
    """One text and a place in it. Each rule reads what it names and moves on, or raises _NoStamp."""

    __slots__ = ("at", "text")

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def stamp(self) -> tuple[int, int, int | None, int | None]:
        """(kind, wall time, wall time if months come first, offset), times in microseconds since 1970."""
        s = self.text
        if len(s) in (10, 13) and DIGITS.issuperset(s):
            return EPOCH, int(s) * (SECOND if len(s) == 10 else 1000), None, 0
        kind, day, other = self.date()
        time, offset = 0, None
        if self.at < len(s):
            if s[self.at] not in "T ":
                raise _NoStamp
            self.at += 1
            time, offset = self.time()
            if self.at < len(s):
                raise _NoStamp
        return kind, day * DAY + time, None if other is None else other * DAY + time, offset

    def date(self) -> tuple[int, int, int | None]:
        s = self.text
        third = s[2:3]
        if third == ".":
            d, m = self.two(), self.after(".")
            self.literal(".")
            return PLAIN, self.day(self.year(), m, d), None
        if third == " ":
            d = self.two()
            self.literal(" ")
            m = self.month()
            self.literal(" ")
            return PLAIN, self.day(self.year(), m, d), None
        if third == "/":
            a, b = self.two(), self.after("/")
            self.literal("/")
            return self.slashed(self.year(), a, b)
        y = self.year()
        if s[4:5] == "-":
            m = self.after("-")
            return PLAIN, self.day(y, m, self.after("-")), None
        m = self.two()
        return PLAIN, self.day(y, m, self.two()), None

    def slashed(self, y: int, a: int, b: int) -> tuple[int, int, int | None]:
        day_first, month_first = _days(y, b, a), _days(y, a, b)
        if day_first is None:
            if month_first is None:
                raise _NoStamp
            return MONTH_FIRST, month_first, None
        if month_first is None:
            return DAY_FIRST, day_first, None
        return (PLAIN, day_first, None) if day_first == month_first else (EITHER, day_first, month_first)

    def time(self) -> tuple[int, int | None]:
        h, m, sec = self.two(), self.after(":"), 0
        if self.text.startswith(":", self.at):
            sec = self.after(":")
        if m > 59 or sec > 59:
            raise _NoStamp
        half = self.half()
        if half:
            if not 1 <= h <= 12:
                raise _NoStamp
            h = h % 12 + (12 if half == "PM" else 0)
        elif h > 23:
            raise _NoStamp
        return h * HOUR + m * MINUTE + sec * SECOND, self.offset()

    def half(self) -> str:
        start = self.at + self.text.startswith(" ", self.at)
        half = self.text[start : start + 2]
        if half not in ("AM", "PM"):
            return ""
        self.at = start + 2
        return half

    def offset(self) -> int | None:
        s = self.text
        if self.at == len(s):
            return None
        self.at += s.startswith(" ", self.at)
        sign = s[self.at : self.at + 1]
        self.at += 1
        if sign == "Z":
            return 0
        if sign not in ("+", "-"):
            raise _NoStamp
        h = self.two()
        m = self.after(":") if s.startswith(":", self.at) else self.two()
        if h > 14 or m > 59:
            raise _NoStamp
        return (h * HOUR + m * MINUTE) * (1 if sign == "+" else -1)

    def day(self, y: int, m: int, d: int) -> int:
        got = _days(y, m, d)
        if got is None:
            raise _NoStamp
        return got

    def year(self) -> int:
        self.literal("20")
        return 2000 + self.two()

    def month(self) -> int:
        got = MONTHS.get(self.text[self.at : self.at + 3])
        if got is None:
            raise _NoStamp
        self.at += 3
        return got

    def after(self, mark: str) -> int:
        self.literal(mark)
        return self.two()

    def two(self) -> int:
        got = TWO.get(self.text[self.at : self.at + 2])
        if got is None:
            raise _NoStamp
        self.at += 2
        return got

    def literal(self, mark: str) -> None:
        if not self.text.startswith(mark, self.at):
            raise _NoStamp
        self.at += len(mark)


@lru_cache(maxsize=1 << 16)
def _days(y: int, m: int, d: int) -> int | None:
    """Days since 1970 of a date, null if there is none."""
    if not 1 <= m <= 12 or not 1 <= d <= LENGTHS[m - 1] + (m == 2 and y % 4 == 0):  # of 2000 to 2099
        return None
    return datetime(y, m, d, tzinfo=UTC).toordinal() - 719_163


def parse(raw: str | None) -> tuple[int, int | None, int | None, int | None]:
    """(kind, wall time, other wall time, offset) of a text."""
    if raw is None:
        return BAD, None, None, None
    try:
        return _Scanner(raw.strip(BLANK)).stamp()
    except _NoStamp:
        return BAD, None, None, None


@lru_cache(maxsize=1024)
def changes(zone: str | None) -> tuple[list[int], list[int], list[int]] | None:
    """The offsets of a zone by wall time: from starts[i] on offsets[i] holds, and until ends[i] the time is skipped or repeated.

    Offsets are looked at day by day from 2000 to 2099 and each change found to the second. Null if there is no such zone.
    """
    from zoneinfo import ZoneInfo

    try:
        tz = ZoneInfo(zone)
    except (KeyError, OSError, TypeError, ValueError):
        return None
    of = lambda t: round(datetime.fromtimestamp(t, tz).utcoffset().total_seconds())
    first, last = 946_684_800 - 3 * 86_400, 4_102_444_800 + 3 * 86_400
    now = of(first)
    starts, ends, offsets = [-(1 << 62)], [-(1 << 62)], [now * SECOND]
    for t in range(first, last, 86_400):
        then = of(t + 86_400)
        if then != now:
            low, high = t, t + 86_400
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if of(middle) == then else (middle, high)
            starts.append((high + min(now, then)) * SECOND)
            ends.append((high + max(now, then)) * SECOND)
            offsets.append(then * SECOND)
            now = then
    return starts, ends, offsets


def in_utc(wall: int, zone: str | None) -> tuple[int | None, bool]:
    """The time of a wall time of a zone, and whether the zone skips or repeats it; then the offset after the change holds."""
    found = changes(zone)
    if found is None:
        return None, False
    starts, ends, offsets = found
    i = bisect_right(starts, wall) - 1
    return wall - offsets[i], wall < ends[i]


def scan(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(kind, wall time, other wall time, offset) behind the columns of each row, whose first three are id, source and zone."""
    for row in rows:
        kind, wall, other, offset = parse(row[3])
        if kind != BAD and offset is None and changes(row[2]) is None:
            kind, wall, other = BAD, None, None
        yield (*row[:3], *row[4:], kind, wall, other, offset)


def votes(parsed: RDD, parts: int) -> RDD:
    """(source, (votes for day first, votes for month first)) of each source that has any."""
    cast = parsed.filter(lambda r: r[-4] in (DAY_FIRST, MONTH_FIRST)).map(lambda r: (r[1], (int(r[-4] == DAY_FIRST), int(r[-4] == MONTH_FIRST))))
    return cast.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), parts)


def finish(row: tuple, day_first: bool | None) -> tuple:
    """The result's columns of a scanned row; day_first: the verdict of its source, null if none order has more votes."""
    kind, wall, other, offset = row[-4:]
    if kind == BAD:
        return (row[0], None, "bad", False, *row[3:-4])
    rule = {EPOCH: "epoch", EITHER: "default" if day_first is None else "votes"}.get(kind, "plain")
    if kind == EITHER and day_first is False:
        wall = other
    utc, odd = (wall - offset, False) if offset is not None else in_utc(wall, row[2])
    return (row[0], utc, rule, odd or kind == EITHER, *row[3:-4])


def normalise(stamps: DataFrame, *, most_sources: int = MOST_SOURCES, carry: tuple[str, ...] = ()) -> DataFrame:
    """stamp_id, utc_us, rule and ambiguous of each row of (stamp_id, source, zone, raw)."""
    spark = stamps.sparkSession
    common.ship(spark)
    frame = stamps.select(F.col("stamp_id").cast("bigint"), F.col("source").cast("string"), F.col("zone").cast("string"), F.col("raw").cast("string"), *(F.col(c).alias(f"kept_{c}") for c in carry))
    kept = frame.schema.fields[4:]
    narrow = T.StructType([*frame.schema.fields[:3], *kept, T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("wall", "other", "offset"))])
    few = frame.select("source").distinct().count() <= most_sources
    parsed = common.written(spark.createDataFrame(frame.rdd.mapPartitions(scan), narrow, verifySchema=False), "stamps")
    rows = parsed.rdd
    counted = votes(rows, common.shuffle_partitions(spark)).filter(lambda v: ne(*v[1])).mapValues(lambda v: v[0] > v[1])
    if few:
        told = spark.sparkContext.broadcast(counted.collectAsMap())
        done = rows.mapPartitions(lambda part: (finish(r, told.value.get(r[1])) for r in part))
    else:
        verdicts = spark.createDataFrame(counted, "voter string, day_first boolean").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = parsed.withColumn("__salt", F.when(F.col("kind") == EITHER, F.pmod(F.xxhash64("stamp_id", "wall"), F.lit(SALTS)).cast("int")))
        joined = salted.join(verdicts, F.col("source").eqNullSafe(F.col("voter")) & (F.col("__salt") == F.col("salt")), "left")
        done = joined.select(F.struct(*(F.col(f"`{c}`") for c in parsed.columns)), "day_first").rdd.mapPartitions(lambda part: starmap(finish, part))
    schema = T.StructType([narrow.fields[0], T.StructField("utc_us", T.LongType()), T.StructField("rule", T.StringType()), T.StructField("ambiguous", T.BooleanType()), *kept])
    return spark.createDataFrame(done, schema, verifySchema=False)
