"""Problem 6: mixed timestamp notations and time zones to one instant.

Every value gets an array of all its valid readings (day first, month first).  The reading is then chosen by a
Viterbi pass over each source's records in the order they were fetched: a change of the source's day/month order
costs ``switch_cost``, a step back in time and a distance from the fetch time cost a little.  With two orders the
recursion is a product of 2x2 (min,+) matrices, which is associative: range partitions reduce their stretch of a
source to one matrix, the matrices are chained per source, and every stretch then takes the path of its ends.  So
a source that holds a third of all rows is spread over many tasks.

Defined results: null, blank, unknown words, impossible dates, local times skipped by a clock change and zone-less
values of a source without a known zone denote nothing; records without a source form one source of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import cut

# Month names by number, in the languages of the items (lower case).
MONTHS = {
    1: "january jan januar janvier enero ocak января январь يناير ژانویه",
    2: "february feb februar février fevrier febrero şubat февраля февраль فبراير فوریه",
    3: "march mar märz mars marzo mart марта март مارس",
    4: "april apr avril abril nisan апреля апрель أبريل إبريل آوریل",
    5: "may mai mayo mayıs мая май مايو مه",
    6: "june jun juni juin junio haziran июня июнь يونيو ژوئن",
    7: "july jul juli juillet julio temmuz июля июль يوليو ژوئیه",
    8: "august aug août aout agosto ağustos августа август أغسطس اوت",
    9: "september sep sept septembre septiembre eylül сентября сентябрь سبتمبر سپتامبر",
    10: "october oct oktober octobre octubre ekim октября октябрь أكتوبر اکتبر",
    11: "november nov novembre noviembre kasım ноября ноябрь نوفمبر نوامبر",
    12: "december dec dezember décembre decembre diciembre aralık декабря декабрь ديسمبر دسامبر",
}
# Zone abbreviations in minutes east of UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120,
    "eest": 180, "msk": 180, "trt": 180, "irst": 210, "gst": 240, "ist": 330, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
_MONTH = {name: n for n, names in MONTHS.items() for name in names.split()}
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_ZONE = r"(?: ?(?P<z>(?:utc|gmt)?[+-]\d{2}:?\d{2}|" + "|".join(sorted(ZONES, key=len, reverse=True)) + r"))?"
_TAIL = rf"(?: ?(?P<half>[ap])\.?m\.?)?{_ZONE}$"
#: The notations that are read.  a and b are day and month, in an order that is the source's.
NOTATIONS = [
    re.compile(rf"(?P<y>\d{{4}})[-/](?P<mo>\d{{1,2}})[-/](?P<d>\d{{1,2}})(?:[t ]{_CLOCK}{_TAIL}|$)"),
    re.compile(rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})(?:t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?{_ZONE}$|$)"),
    re.compile(rf"(?P<a>\d{{1,2}})[/.-](?P<b>\d{{1,2}})[/.-](?P<y>\d{{4}}|\d{{2}})(?:,? {_CLOCK}{_TAIL}|$)"),
    re.compile(rf"(?:[^\W\d]+\.?,? )?(?P<d>\d{{1,2}})(?:\.? |-)(?:de )?(?P<name>[^\W\d]+)\.?(?: de)?[ -](?P<y>\d{{4}}),?(?: {_CLOCK}{_TAIL}|$)"),
    re.compile(rf"(?:[^\W\d]+\.?, )?(?P<name>[^\W\d]+)\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>\d{{4}}),?(?: at)?(?: {_CLOCK}{_TAIL}|$)"),
]
_EPOCH = {10: 1_000_000, 13: 1_000, 16: 1}
_START = datetime(1970, 1, 1)
_TICK = timedelta(microseconds=1)


@cache
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _instant(m: re.Match, order: int, zone: ZoneInfo | None) -> int | None:
    """Microseconds of one match, its first number being the day (order 0) or the month (order 1)."""
    g = m.groupdict()
    year = int(g["y"])
    if g.get("a"):
        day, month = (g["a"], g["b"]) if order == 0 else (g["b"], g["a"])
        year += (2000 if year < 70 else 1900) if len(g["y"]) == 2 else 0
    else:
        day, month = g["d"], g.get("mo") or _MONTH.get(g["name"], 0)
    hour = int(g.get("h") or 0)
    if g.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["half"] == "p")
    try:
        wall = datetime(year, int(month), int(day), hour, int(g.get("mi") or 0), int(g.get("s") or 0), int((g.get("f") or "0")[:6].ljust(6, "0")))
    except ValueError:
        return None
    local = (wall - _START) // _TICK
    mark = g.get("z")
    if mark:
        if mark in ZONES:
            return local - ZONES[mark] * 60_000_000
        away = int(mark[-5:].replace(":", "")[-4:-2]) * 60 + int(mark[-2:])
        return local - (-away if "-" in mark else away) * 60_000_000
    if zone is None:
        return None
    out = local - zone.utcoffset(wall) // _TICK  # fold 0: the first of two equal local times
    if g.get("h"):  # a skipped local time denotes nothing; a day whose midnight is skipped begins right after it
        back = (_START + timedelta(microseconds=out)).replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
        if back != wall:
            return None
    return out


def readings(value: str | None, zone: str | None) -> list[int | None]:
    """All valid readings of ``value``: its instant with the day first and with the month first, in microseconds.

    A notation that leaves no choice of order gives the same instant twice; an order that doesn't read it gives None.
    """
    text = " ".join((value or "").translate(_DIGITS).replace("\u200f", "").replace("\u200e", "").lower().split())
    if text.isascii() and text.isdigit() and len(text) in _EPOCH:
        return [int(text) * _EPOCH[len(text)]] * 2
    for notation in NOTATIONS:
        if m := notation.match(text):
            one = _instant(m, 0, _zone(zone))
            return [one, _instant(m, 1, _zone(zone)) if m.groupdict().get("a") else one]
    return [None, None]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        both = [readings(v, z) for v, z in zip(b["published_at"], b["time_zone"])]
        half = b["published_at"].str.contains(r"[ap]\.?m\.?\s*$", case=False, regex=True)
        out = b[["row_key", "source", "fetched_us"]].assign(half_day=half.fillna(False).astype(bool), us_d=pd.array([x for x, _ in both], "Int64"), us_m=pd.array([y for _, y in both], "Int64"))
        yield out[out["us_d"].notna() | out["us_m"].notna()]


_DAY = 86_400_000_000.0
_STRETCH = "row_key string, us_d long, us_m long, picks int, part long, source long, first_d double, first_m double, last_d double, last_m double, c00 double, c01 double, c10 double, c11 double"


def _back(a: float, b: float) -> float:
    """Cost of a step from instant a to b."""
    return float(np.log1p((a - b) / _DAY)) if b < a else 0.0


def _reduce_stretches(switch_cost: float):
    """Each stretch of a source within a partition to its cost matrix; each record with its pick for every entry and exit."""

    def solve(part: int, source: int, keys: list, d: np.ndarray, m: np.ndarray, fetched: np.ndarray, half: np.ndarray) -> list[tuple]:
        n = len(keys)
        have_d, have_m = ~np.isnan(d), ~np.isnan(m)
        at = np.stack([d, m], axis=1)
        far = np.abs(at - fetched[:, None]) / _DAY
        own = np.where(np.isnan(far), 0.0, 0.1 * np.log1p(np.nan_to_num(far)))
        own += np.where(np.isnan(at), switch_cost, 0.0)  # that order does not read this value
        own[:, 0] += np.where(half & have_d & have_m & (d != m), 1e-3, 0.0)
        at = np.where(np.isnan(at), np.where(have_d, d, m)[:, None], at)
        # Where both orders give the same instant the pick does not matter, and away from other records such a record
        # adds the same to every path: only the rest and their neighbours enter the recursion.
        open_ = at[:, 0] != at[:, 1]
        near = open_ | np.isnan(d) | np.isnan(m)
        near[1:] |= near[:-1].copy()
        near[:-1] |= near[1:].copy()
        near[[0, -1]] = True
        kept = np.flatnonzero(near)
        jump = np.log1p(np.maximum(at[kept[:-1], :, None] - at[kept[1:], None, :], 0.0) / _DAY)
        steps, owns = jump.tolist(), own[kept].tolist()
        came: list[tuple[int, int, int, int]] = [(0, 1, 0, 1)]
        inf = float("inf")
        dd, dm, md, mm = owns[0][0], inf, inf, owns[0][1]  # cost by entry order and order now
        for step, (cd, cm) in zip(steps, owns[1:]):
            (j00, j01), (j10, j11) = step
            j01, j10 = j01 + switch_cost, j10 + switch_cost
            a0, a1, b0, b1 = dd + j00, dm + j10, dd + j01, dm + j11
            e0, e1, f0, f1 = md + j00, mm + j10, md + j01, mm + j11
            came.append((int(a1 < a0), int(b1 <= b0), int(e1 < e0), int(f1 <= f0)))
            dd, dm, md, mm = min(a0, a1) + cd, min(b0, b1) + cm, min(e0, e1) + cd, min(f0, f1) + cm
        cost = np.array([[dd, dm], [md, mm]])
        picks = np.zeros(n, dtype=np.int32)
        for entry in (0, 1):
            for leave in (0, 1):
                now, path = leave, []
                for back in reversed(came):
                    path.append(now)
                    now = back[2 * entry + now]
                picks[kept] |= np.array(path[::-1], dtype=np.int32) << (2 * entry + leave)
        whole = lambda xs: [None if np.isnan(x) else int(x) for x in xs]
        out = [(k, x, y, int(p), part, source, *[None] * 8) for k, x, y, p in zip(keys, whole(d), whole(m), picks)]
        ends = [float(v) if np.isfinite(v) else 1e300 for v in (*at[0], *at[-1], *cost.ravel())]
        out[-1] = (*out[-1][:6], *ends)
        return out

    names = [c.split()[0] for c in _STRETCH.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # pieces of the stretch that is still open
        stretch, rows, now = 0, 0, None

        def flush() -> list[tuple]:
            nonlocal stretch
            stretch += 1
            keys = [k for piece in held for k in piece[1]]
            return solve(held[0][0] * 1_000_000 + stretch, now, keys, *(np.concatenate([piece[i] for piece in held]) for i in (2, 3, 4, 5)))

        def frame(out: list[tuple]) -> pd.DataFrame:
            f = pd.DataFrame(out, columns=names)
            return f.astype({"us_d": "Int64", "us_m": "Int64"})

        for b in batches:
            if not len(b):
                continue
            out: list[tuple] = []
            source = b["source"].to_numpy()
            cuts = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1), len(source)]
            keys, part = b["row_key"].tolist(), int(b["part"].iloc[0])
            d, m = (b[c].astype("Float64").to_numpy("float64", na_value=np.nan) for c in ("us_d", "us_m"))
            fetched, half = b["fetched_us"].to_numpy("float64"), b["half_day"].to_numpy(bool)
            for i, j in zip(cuts, cuts[1:]):
                if held and (source[i] != now or rows > 200_000):
                    out += flush()
                    held, rows = [], 0
                now = int(source[i])
                held.append((part, keys[i:j], d[i:j], m[i:j], fetched[i:j], half[i:j]))
                rows += j - i
            if out:
                yield frame(out)
        if held:
            yield frame(flush())

    return run


def _chain(switch_cost: float):
    """Per source: the stretches' matrices multiplied in order, then each stretch's entry and exit order."""

    def chain(rows: list[tuple]) -> list[tuple]:
        cost, links, last = np.zeros(2), [], (0.0, 0.0)
        for i, (_, _, f0, f1, l0, l1, c00, c01, c10, c11) in enumerate(rows):
            first, inner = (f0, f1), np.array([[c00, c01], [c10, c11]])
            if i:
                jump = np.array([[_back(last[a], first[b]) + switch_cost * (a != b) for b in (0, 1)] for a in (0, 1)])
            else:
                jump = np.array([[0.0, np.inf], [np.inf, 0.0]])
            total = cost[:, None, None] + jump[:, :, None] + inner[None]  # [order before, entry, exit]
            links.append(total)
            cost, last = total.min(axis=(0, 1)), (l0, l1)
        choice, now = [], int(cost.argmin())
        for total in reversed(links):
            before, entry = np.unravel_index(total[:, :, now].argmin(), (2, 2))
            choice.append(2 * int(entry) + now)
            now = int(before)
        return [(r[0], r[1], way) for r, way in zip(rows, reversed(choice))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # one source's stretches: as many as there are ranges it lies in
        for b in batches:
            out: list[tuple] = []
            for row in b.itertuples(index=False, name=None):
                if held and row[0] != held[0][0]:
                    out += chain(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["source", "part", "way"])
        if held:
            yield pd.DataFrame(chain(held), columns=["source", "part", "way"])

    return run


def resolve_instants(records: DataFrame, switch_cost: float = 1e6) -> DataFrame:
    """``row_key`` and ``instant_us`` of every record whose value denotes an instant.

    ``records``: row_key string (unique), source_id, time_zone, fetched_at, published_at.  Extra columns are ignored.
    """
    asked = records.select(
        "row_key", F.coalesce(F.col("source_id").cast("long"), F.lit(-1)).alias("source"),
        F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(0)).alias("fetched_us"), "published_at", "time_zone",
    )
    rows = asked.mapInPandas(_read, "row_key string, source long, fetched_us long, half_day boolean, us_d long, us_m long")
    spark = records.sparkSession
    # A fixed number of ranges: adaptive execution would join small ones, although each takes Python time.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(ranges, "source", "fetched_us", "row_key").sortWithinPartitions("source", "fetched_us", "row_key").withColumn("part", F.spark_partition_id())
    paths = cut(ordered.mapInPandas(_reduce_stretches(switch_cost), _STRETCH))
    ends = paths.where(F.col("c00").isNotNull()).select("source", "part", "first_d", "first_m", "last_d", "last_m", "c00", "c01", "c10", "c11")
    chained = ends.repartition("source").sortWithinPartitions("source", "part").mapInPandas(_chain(switch_cost), "source long, part long, way int")
    chosen = paths.select("row_key", "us_d", "us_m", "picks", "part", "source").join(chained, ["part", "source"])
    month_first = F.expr("shiftright(picks, way) & 1") == 1
    return chosen.select("row_key", F.when(month_first, F.coalesce("us_m", "us_d")).otherwise(F.coalesce("us_d", "us_m")).alias("instant_us"))
