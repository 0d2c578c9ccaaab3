"""Operator 12: mixed timestamp normalisation.

A hand-written recursive-descent scanner reads each stamp inside mapPartitions
and emits a tuple of what it found.  Slashed dates that are possible in one
order only vote for that order in their source; ``reduceByKey`` counts the
votes, adding up inside each partition first, so that a source with a third of
all rows sends one pair from each task.  A second pass, in Arrow batches, scans
every stamp (scanning again costs less than writing the tuples and reading them
back; the first pass reads only rows with a slash) and finishes each row with
the verdict on its source and a bisection over the transitions of its zone.

What reaches the driver and the broadcast is the map of verdicts while there
are at most ``MOST_SOURCES`` sources with one; beyond that it stays a table and
is joined on the source, by a join whose hot keys Spark can split.  Transitions
are computed in the workers, for the zones that they meet.

Grammar, after stripping ``[\\x20\\x09-\\x0D]`` at both ends::

    stamp  = digits{10} | digits{13} | date [time]
    date   = y-m-d | ymd | d.m.y | d b y | a/b/y
    time   = ("T" | " ") h:m [":" s] [[" "] ("A" | "P") "M"] [[" "] zone]
    zone   = "Z" | ("+" | "-") h [":"] m

Defined results: null, empty, impossible or other stamps are ``bad`` with a null
``utc_us``, and so is a stamp without an offset whose zone is null or unknown;
bad stamps never vote.  Rows with a null source vote together, as one source.
Repeated rows each give a row, and vote each.  Other columns are ignored,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"

MONTHS = {b: i + 1 for i, b in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))}

#: Verdicts on so many sources are broadcast; more are joined as a table.
MOST_SOURCES = 20_000

#: A century's transitions are looked for day by day, then to the second.
FIRST, LAST = datetime(1999, 12, 25, tzinfo=UTC), datetime(2100, 1, 8, tzinfo=UTC)

_DAY_0 = date(1970, 1, 1).toordinal()

BAD, EPOCH, DATED = 0, 1, 2


class Unreadable(Exception):
    """The stamp departs from the grammar or names no possible time."""


class Scanner:
    """One stamp, read from left to right; every rule moves ``at`` behind what
    it has read or raises Unreadable."""

    __slots__ = ("text", "at", "end")

    def __init__(self, text: str):
        self.text, self.at, self.end = text, 0, len(text)

    def peek(self, n: int = 0) -> str:
        return self.text[self.at + n] if self.at + n < self.end else ""

    def take(self, wanted: str) -> str:
        """One of the characters ``wanted``."""
        c = self.peek()
        if not c or c not in wanted:
            raise Unreadable
        self.at += 1
        return c

    def number(self, digits: int) -> int:
        part = self.text[self.at : self.at + digits]
        if len(part) != digits or not (part.isascii() and part.isdigit()):
            raise Unreadable
        self.at += digits
        return int(part)

    def year(self) -> int:
        y = self.number(4)
        if not 2000 <= y <= 2099:
            raise Unreadable
        return y

    def month_name(self) -> int:
        m = MONTHS.get(self.text[self.at : self.at + 3])
        if m is None:
            raise Unreadable
        self.at += 3
        return m

    def digits_ahead(self) -> int:
        n = self.at
        while n < self.end and "0" <= self.text[n] <= "9":
            n += 1
        return n - self.at

    def stamp(self) -> tuple:
        """(kind, first, second, seconds, offset): for EPOCH first is in
        microseconds; for DATED first is the day with the day of month in front
        (or the only order), second the day with the month in front, both
        counted from 1970, None where impossible or not asked."""
        run = self.digits_ahead()
        if run in (10, 13) and run == self.end:
            return (EPOCH, self.number(run) * (1_000_000 if run == 10 else 1000), None, 0, None)
        first, second = self.date(run)
        seconds, offset = self.time() if self.at < self.end else (0, None)
        if self.at < self.end or (first is None and second is None):
            raise Unreadable
        return (DATED, first, second, seconds, offset)

    def date(self, run: int) -> tuple[int | None, int | None]:
        if run == 4:
            y = self.year()
            self.take("-")
            m = self.number(2)
            self.take("-")
            return day(y, m, self.number(2)), None
        if run == 8:
            return day(self.year(), self.number(2), self.number(2)), None
        if run != 2:
            raise Unreadable
        a = self.number(2)
        sign = self.take("./ ")
        b = self.month_name() if sign == " " else self.number(2)
        self.take(sign)
        y = self.year()
        return day(y, b, a), day(y, a, b) if sign == "/" else None

    def time(self) -> tuple[int, int | None]:
        self.take("T ")
        h = self.number(2)
        self.take(":")
        m, s = self.number(2), 0
        if self.peek() == ":":
            self.at += 1
            s = self.number(2)
        blank = self.peek() == " "
        half = self.peek(blank)
        if half and half in "AP":
            self.at += blank + 1
            self.take("M")
            if not 1 <= h <= 12:
                raise Unreadable
            h = h % 12 + 12 * (half == "P")
        if h > 23 or m > 59 or s > 59:
            raise Unreadable
        return 3600 * h + 60 * m + s, self.offset() if self.at < self.end else None

    def offset(self) -> int:
        if self.peek() == " ":
            self.at += 1
        sign = self.take("Z+-")
        if sign == "Z":
            return 0
        h = self.number(2)
        if self.peek() == ":":
            self.at += 1
        m = self.number(2)
        if h > 14 or m > 59:
            raise Unreadable
        return (3600 * h + 60 * m) * (1 if sign == "+" else -1)


def day(y: int, m: int, d: int) -> int | None:
    """Days from 1970, None for a day that no calendar has."""
    try:
        return date(y, m, d).toordinal() - _DAY_0
    except ValueError:
        return None


def scan(raw: str | None, zone: str | None) -> tuple:
    """The scanner's tuple, (BAD, ...) where it has none."""
    if raw is not None:
        try:
            found = Scanner(raw.strip(BLANK)).stamp()
            if found[0] == EPOCH or found[4] is not None or transitions(zone) is not None:
                return found
        except Unreadable:
            pass
    return (BAD, None, None, 0, None)


@lru_cache(maxsize=4096)
def transitions(zone: str | None) -> tuple[list, list, int] | None:
    """(starts, changes, offset at first) of a zone from 2000 to 2099, None for
    a name that is no zone.  ``starts``: the first wall second that a change of
    offset skips or repeats; ``changes``: (first wall second after those, offset
    before, offset after)."""
    if not zone:
        return None
    try:
        tz = ZoneInfo(zone)
    except (OSError, ValueError, LookupError):
        return None

    def offset(t: datetime) -> int:
        return int(t.astimezone(tz).utcoffset().total_seconds())

    starts, changes = [], []
    t, before = FIRST, offset(FIRST)
    first = before
    while t < LAST:
        after = offset(up := t + timedelta(days=1))
        if after != before:
            low, high = 0, 86400  # seconds behind t with the old and the new offset
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(t + timedelta(seconds=mid)) == before else (low, mid)
            at = int(t.timestamp()) + high
            starts.append(at + min(before, after))
            changes.append((at + max(before, after), before, after))
        t, before = up, after
    return starts, changes, first


def to_utc(wall: int, zone: str) -> tuple[int, bool]:
    """Seconds of UTC for a wall time, and whether the zone skips or repeats
    it; such times take the offset before the change."""
    starts, changes, first = transitions(zone)
    k = bisect_right(starts, wall) - 1
    if k < 0:
        return wall - first, False
    until, before, after = changes[k]
    return (wall - before, True) if wall < until else (wall - after, False)


def finish(found: tuple, zone: str | None, day_first: bool | None) -> tuple[int | None, str, bool]:
    """(utc_us, rule, ambiguous) of a scanned stamp; ``day_first``: the verdict
    on its source, None without one."""
    kind, first, second, seconds, offset = found
    if kind == BAD:
        return None, "bad", False
    if kind == EPOCH:
        return first, "epoch", False
    rule, chosen = "plain", first if first is not None else second
    if first is not None and second is not None and first != second:
        rule, chosen = ("default", second) if day_first is None else ("votes", first if day_first else second)
    wall = chosen * 86400 + seconds
    utc, odd = (wall - offset, False) if offset is not None else to_utc(wall, zone)
    return utc * 1_000_000, rule, odd or rule != "plain"


def votes(stamps: DataFrame, source_col: str, zone_col: str, raw_col: str):
    """RDD of (source, (votes for the day first, votes for the month first))."""

    def count(rows):
        for source, zone, raw in rows:
            kind, first, second, _, _ = scan(raw, zone)
            if kind == DATED and (first is None) != (second is None):
                yield source, (int(second is None), int(first is None))

    # every readable stamp with a slash is a slashed date
    slashed = stamps.where(F.col(raw_col).contains("/")).select(source_col, zone_col, raw_col)
    parts = int(stamps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slashed.rdd.mapPartitions(count).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), parts)


def normalise(stamps: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw", most_sources: int = MOST_SOURCES) -> DataFrame:
    """One row per stamp: id, utc_us (microseconds, null where bad), rule (bad,
    epoch, votes, default, plain) and ambiguous."""
    spark = stamps.sparkSession
    rows = stamps.select(F.col(id_col), F.col(source_col).cast("string").alias("source_"), F.col(zone_col).cast("string").alias("zone_"), F.col(raw_col).cast("string").alias("raw_"))
    verdicts = votes(rows, "source_", "zone_", "raw_").filter(lambda x: x[1][0] != x[1][1]).mapValues(lambda n: n[0] > n[1])
    few = verdicts.take(most_sources + 1)
    if len(few) <= most_sources:
        known = spark.sparkContext.broadcast(dict(few))
        given = rows
    else:
        known = None
        table = spark.createDataFrame(verdicts, "of_ string, day_first_ boolean")
        given = rows.join(table, F.col("source_").eqNullSafe(F.col("of_")), "left").select(*rows.columns, "day_first_")

    def run(batches):
        for b in batches:
            source, zone, raw = (b.column(c).to_pylist() for c in ("source_", "zone_", "raw_"))
            first = map(known.value.get, source) if known else b.column("day_first_").to_pylist()
            done = [finish(scan(t, z), z, f) for t, z, f in zip(raw, zone, first, strict=True)]
            utc, rule, odd = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(utc, pa.int64()), pa.array(rule, pa.string()), pa.array(odd, pa.bool_())], names=[id_col, "utc_us", "rule", "ambiguous"])

    schema = T.StructType([rows.schema[0], T.StructField("utc_us", T.LongType()), T.StructField("rule", T.StringType()), T.StructField("ambiguous", T.BooleanType())])
    return given.mapInArrow(run, schema)
