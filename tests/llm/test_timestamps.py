"""Operator 12 against a second reading of the grammar, by expressions and zoneinfo."""

import re
from collections import Counter
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from insightloom.llm import timestamps

TIME = r"(?:[T\x20](\d\d):(\d\d)(?::(\d\d))?(?:\x20?([AP])M)?(?:\x20?(Z|[+-]\d\d:?\d\d))?)?"
MON = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
FORMS = {
    "ymd": re.compile(r"(20\d\d)-(\d\d)-(\d\d)" + TIME, re.A), "ymd8": re.compile(r"(20\d\d)(\d\d)(\d\d)" + TIME, re.A), "dmy": re.compile(r"(\d\d)[.](\d\d)[.](20\d\d)" + TIME, re.A),
    "dby": re.compile(rf"(\d\d) ({'|'.join(MON)}) (20\d\d)" + TIME, re.A), "slash": re.compile(r"(\d\d)/(\d\d)/(20\d\d)" + TIME, re.A),
}


def _date(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def _read(raw):
    """None, an int of microseconds, or (day first or only, month first, seconds, offset)."""
    t = (raw or "").strip(timestamps.BLANK)
    if re.fullmatch("[0-9]{10}|[0-9]{13}", t):
        return int(t) * (10**6 if len(t) == 10 else 1000)
    for name, form in FORMS.items():
        if m := form.fullmatch(t):
            a, b, c, h, mi, s, half, off = m.groups()
            one, two = {"ymd": (_date(a, b, c), None), "ymd8": (_date(a, b, c), None), "dmy": (_date(c, b, a), None), "dby": (_date(c, MON.index(b) + 1 if b in MON else 0, a), None), "slash": (_date(c, b, a), _date(c, a, b))}[name]
            h, mi, s = int(h or 0), int(mi or 0), int(s or 0)
            if (one or two) is None or mi > 59 or s > 59 or h > 23 or (half and not 1 <= h <= 12):
                return None
            if half:
                h = h % 12 + (12 if half == "P" else 0)
            if off and off != "Z":
                d = off[1:].replace(":", "")
                if d[:2] > "14" or d[2:] > "59":
                    return None
                off = (int(d[:2]) * 60 + int(d[2:])) * (60 if off[0] == "+" else -60)
            elif off:
                off = 0
            return one, two, h * 3600 + mi * 60 + s, off
    return None


def _local(wall, zone):
    tz = ZoneInfo(zone)
    early, late = (wall.replace(tzinfo=tz, fold=f).utcoffset() for f in (0, 1))  # fold 0 has the offset before a change
    us = (wall.replace(tzinfo=timezone.utc) - early - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return us, early != late


def _whole(rows):
    votes = Counter()
    read = []
    for _, source, zone, raw in rows:
        f = _read(raw)
        if isinstance(f, tuple) and f[3] is None:
            try:
                ZoneInfo(zone or "")
            except (ValueError, OSError, LookupError):
                f = None
        read.append(f)
        if isinstance(f, tuple) and "/" in raw and (f[0] is None) != (f[1] is None):
            votes[source, f[1] is None] += 1
    out = []
    for (key, source, zone, _), f in zip(rows, read, strict=True):
        if f is None:
            out.append((key, None, "bad", False))
        elif isinstance(f, int):
            out.append((key, f, "epoch", False))
        else:
            one, two, sec, off = f
            rule, chosen = "plain", one or two
            if one and two and one != two:
                d, m = votes[source, True], votes[source, False]
                rule, chosen = ("votes", one if d > m else two) if d != m else ("default", two)
            wall = datetime(chosen.year, chosen.month, chosen.day) + timedelta(seconds=sec)
            us, odd = _local(wall, zone) if off is None else ((wall - datetime(1970, 1, 1)) // timedelta(microseconds=1) - off * 10**6, False)
            out.append((key, us, rule, odd or rule != "plain"))
    return out


def _run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")
    return [tuple(r) for r in timestamps.normalise(df, **settings).collect()]


def _sorted(rows):
    return sorted(rows, key=repr)


CASES = [
    "1704068528", "1704078484047", "0000000000", "170406852", "17040685288", " \t2024-01-01\n", "20240229", "20230229", "2024-02-30", "1999-01-01", "2100-01-01", "2099-12-31 23:59:59", "2000-01-01",
    "2024-01-01T10:11", "2024-01-01T10:11:12", "2024-01-01 24:00", "2024-01-01 10:60", "2024-01-01 10:10:60", "2024-01-01 12:00 AM", "2024-01-01 12:00PM", "2024-01-01 00:30 AM", "2024-01-01 13:00 PM", "2024-01-01 11:59:59 PM +0530",
    "2024-01-01T10:11Z", "2024-01-01T10:11 Z", "2024-01-01T10:11+14:59", "2024-01-01T10:11+15:00", "2024-01-01T10:11-0860", "2024-01-01T10:11 +05:30", "2024-01-01T10:11  Z", "2024-01-01t10:11", "2024-01-01T10:11z", "2024-01-01T1:11",
    "05 Mar 2024", "05 mar 2024", "31 Apr 2024", "05  Mar 2024", "05 Mar 2024 03:04 PM Z", "05.06.2024", "05.13.2024", "05.06/2024", "05/06/2024", "06/06/2024", "13/06/2024", "06/13/2024", "13/13/2024", "31/04/2024", "02/30/2024", "05/06/2024 10:00Z",
    "2024-03-10 02:30", "2024-03-10 03:00", "2024-11-03 01:30", "2024-11-03 02:00", "2024-03-31 02:30:00", "2024-10-27 02:59:59", "2024-10-27 03:00", "2024-10-27 01:59:59", "", None, "n/a", "٢٠٢٤-٠١-٠١", "2024-01-01T10:11:1", "2024-1-01", "x" * 100_000, "1" * 100_000,
]


def test_every_form_in_every_zone(spark):
    zones = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "Nowhere/City", "", None, "../etc"]
    rows = [(i * 100 + k, f"s{k % 3}" if k % 4 else None, z, c) for k, z in enumerate(zones) for i, c in enumerate(CASES)]
    rows += rows[:50]  # repeated rows each vote and each give a row
    assert _sorted(_run(spark, rows)) == _sorted(_whole(rows))


def test_votes_ties_and_a_hot_source(spark):
    rows = [(i, "hot", "UTC", "13/02/2024" if i % 5 else "02/13/2024") for i in range(3000)] + [(10_000, "hot", "UTC", "03/04/2024")]
    rows += [(20_000, "tie", "UTC", "13/02/2024"), (20_001, "tie", "UTC", "02/13/2024"), (20_002, "tie", "UTC", "03/04/2024"), (20_003, "none", "UTC", "03/04/2024")]
    rows += [(30_000, "month", "UTC", "02/13/2024"), (30_001, "month", "UTC", "03/04/2024"), (30_002, "month", "UTC", "13/02/2024 25:00"), (30_003, "month", "UTC", "13/02/2024 24:00"), (30_004, "month", "Nowhere", "13/02/2024")]
    want = _whole(rows)
    assert _sorted(_run(spark, rows)) == _sorted(want)
    assert {r[0]: r[2] for r in want if r[0] in (10_000, 20_002, 20_003, 30_001)} == {10_000: "votes", 20_002: "default", 20_003: "default", 30_001: "votes"}
    # more sources than may be broadcast: the verdicts are joined
    assert _sorted(_run(spark, rows, most_sources=1)) == _sorted(want)


def test_empty_tables_and_other_columns(spark):
    assert _run(spark, []) == []
    df = spark.createDataFrame([("a", "s", "UTC", "2024-01-01", 1, "x")], "id string, of string, tz string, t string, rule int, utc_us string")
    out = timestamps.normalise(df, "id", "of", "tz", "t")
    assert out.columns == ["id", "utc_us", "rule", "ambiguous"] and [tuple(r) for r in out.collect()] == [("a", 1704067200000000, "plain", False)]
    nulls = spark.createDataFrame([(None, None, None, None), (None, None, None, "1704067200")], "stamp_id long, source string, zone string, raw string")
    assert _sorted(tuple(r) for r in timestamps.normalise(nulls).collect()) == [(None, 1704067200000000, "epoch", False), (None, None, "bad", False)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789:/.-+ TAPMZJan", max_size=28) | st.from_regex(r"\A(20\d\d-[01]\d-[0-3]\d|[0-3]\d/[0-3]\d/20\d\d)([T ][0-2]\d:[0-6]\d(:[0-6]\d)?( ?[AP]M)?( ?(Z|[+-][01]\d:?[0-6]\d))?)?\Z"))
def test_scanner_against_expressions(raw):
    want, got = _read(raw), timestamps.scan(raw, "UTC")
    if want is None:
        assert got[0] == timestamps.BAD
    elif isinstance(want, int):
        assert got[:2] == (timestamps.EPOCH, want)
    else:
        days = [None if d is None else (d - date(1970, 1, 1)).days for d in want[:2]]
        assert got == (timestamps.DATED, *days, want[2], want[3])


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Africa/Casablanca", "Australia/Lord_Howe", "Pacific/Apia", "Asia/Kolkata"])
def test_walls_around_every_change(zone):
    starts, changes, _ = timestamps.transitions(zone)
    for a, (b, _, _) in zip(starts[:120], changes, strict=False):
        for wall in (a - 1, a, (a + b) // 2, b - 1, b, a - 86400, b + 86400):
            us, odd = _local(datetime(1970, 1, 1) + timedelta(seconds=wall), zone)
            assert timestamps.to_utc(wall, zone) == (us // 10**6, odd), (zone, wall)
