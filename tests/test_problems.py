"""Problems 1, 5 and 6 against plain versions, and with nulls, ties, repeats, empty tables and extra columns."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.operators.asof import LEVELS, as_known, dyadic_cover
from tidewatch.operators.history import GONE, build_history, canonical_label, canonical_numbers
from tidewatch.operators.instants import readings, resolve_instants

US = 1_000_000
RECORD = "row_key string, source_id int, time_zone string, fetched_at timestamp, published_at string, us_d string, extra string"


def us(*parts):
    return int((datetime(*parts) - datetime(1970, 1, 1)).total_seconds() * US)


@pytest.mark.parametrize(
    ("value", "zone", "want"),
    [
        ("2025-01-01T01:57:37Z", None, us(2025, 1, 1, 1, 57, 37)),
        ("2025-06-01 12:00:00.5+03:30", None, us(2025, 6, 1, 8, 30) + US // 2),
        ("20250103T044842-0500", None, us(2025, 1, 3, 9, 48, 42)),
        ("13-DEC-2024 15:49:45 UTC+03:00", None, us(2024, 12, 13, 12, 49, 45)),
        ("Wed, 01 Jan 2025 17:15:19 CET", None, us(2025, 1, 1, 16, 15, 19)),
        ("January 10, 2025 at 4:04 pm", "Asia/Kolkata", us(2025, 1, 10, 10, 34)),
        ("٣٠ نوفمبر ٢٠٢٤ ١٩:٥٣", "Asia/Aden", us(2024, 11, 30, 16, 53)),
        ("30 Dezember 2024 05:16", "Europe/Berlin", us(2024, 12, 30, 4, 16)),
        ("1735802454", None, 1735802454 * US),
        ("1735786833000", None, 1735786833 * US),
        ("2025-01-02", "Asia/Kolkata", us(2025, 1, 1, 18, 30)),
        ("2025-10-26 02:30", "Europe/Berlin", us(2025, 10, 26, 0, 30)),  # twice: the first
        ("2025-03-30 02:30", "Europe/Berlin", None),  # never
        ("2025-02-30 10:00", "Europe/Berlin", None),
        ("0000-00-00 00:00:00", "Europe/Berlin", None),
        ("2025-01-02 10:00", "Mars/Base", None),
        ("recently", "Europe/Berlin", None),
        ("", "Europe/Berlin", None),
        (None, "Europe/Berlin", None),
        ("x" * 100_000, "Europe/Berlin", None),
    ],
)
def test_readings(value, zone, want):
    assert readings(value, zone) == [want, want]


def test_order_is_the_sources(spark):
    at = lambda d: datetime(2025, d, 5, 12)
    data = [(f"m{i}", 1, "America/New_York", at(i), f"{i:02}/04/2025 9:00 AM", None, "x") for i in range(1, 12)]
    data += [("m99", 1, "America/New_York", datetime(2025, 12, 25), "12/24/2025 9:00 AM", None, "x")]
    data += [(f"d{i}", 2, "Europe/Paris", at(i), f"04/{i:02}/2025 09:00", None, "x") for i in range(1, 12)]
    data += [("n1", None, None, None, "2025-01-01T00:00:00Z", None, None), ("n2", 1, None, None, None, None, None)]
    got = dict(rows(resolve_instants(spark.createDataFrame(data, RECORD)), "row_key", "instant_us"))
    assert got["m2"] == us(2025, 2, 4, 14) and got["m99"] == us(2025, 12, 24, 14)
    assert got["d2"] == us(2025, 2, 4, 8)
    assert got["n1"] == us(2025, 1, 1) and "n2" not in got
    assert len(got) == 24
    assert resolve_instants(spark.createDataFrame([], RECORD)).count() == 0


def test_order_survives_many_stretches(spark):
    """The same decision when a source is spread over partitions."""
    data = []
    for i in range(600):
        m, d = i % 12 + 1, i % 9 + 1
        data.append((f"k{i:04}", 7, "UTC", datetime(2025, m, d, 13), f"{m:02}/{d:02}/2025 12:00", None, None))
    data.append(("last", 7, "UTC", datetime(2025, 12, 31), "12/30/2025 12:00", None, None))
    got = dict(rows(resolve_instants(spark.createDataFrame(data, RECORD).repartition(8)), "row_key", "instant_us"))
    assert all(got[f"k{i:04}"] == us(2025, i % 12 + 1, i % 9 + 1, 12) for i in range(600))


def test_dyadic_cover():
    for _ in range(300):
        a, b = sorted(random.Random(_).sample(range(1 << LEVELS), 2))
        days = [d for level, node in dyadic_cover(a, b) for d in (node << level, ((node + 1) << level) - 1)]
        assert min(days) == a and max(days) == b
        assert sum(1 << level for level, _ in dyadic_cover(a, b)) == b - a + 1
    assert len(dyadic_cover(1, (1 << LEVELS) - 2)) <= 2 * LEVELS


def test_as_known(spark):
    r = random.Random(5)
    day = 86_400 * US
    history = []
    for v in range(300):
        start = r.randrange(0, 20_000) * day // 2
        history.append((v, r.choice([1, 1, 1, 2, None]), start, r.choice([None, start + r.randrange(-5, 4_000) * day // 3]), r.randrange(50), "x"))
    history += history[:20]
    events = [(e, r.choice([1, 2, 3, None]), r.choice([None, *[r.randrange(0, 25_000) * day // 2] * 9]), "y") for e in range(500)]
    h = spark.createDataFrame(history, "version_id long, entity_id int, start_us long, end_us long, recorded_us long, salt string")
    e = spark.createDataFrame(events, "event_id long, entity_id int, instant_us long, node string")
    want = {}
    for i, who, t, _ in events:
        fits = [(rec, v) for v, w, a, b, rec, _ in history if w is not None and w == who and t is not None and a <= t and (b is None or t < b)]
        if fits:
            want[i] = max(fits)[1]
    assert dict(rows(as_known(e, h), "event_id", "version_id")) == want
    assert as_known(e.limit(0), h).count() == 0 and as_known(e, h.limit(0)).count() == 0


def _deliveries(spark, data):
    df = spark.createDataFrame(data, "entity_id int, day date, loaded_at timestamp, label string, numbers string, gone boolean, payload_ string")
    return df.select("entity_id", "day", "loaded_at", canonical_label(F.col("label")).alias("label"), F.when(F.col("gone"), F.lit(GONE)).otherwise(F.concat_ws("\t", canonical_label(F.col("label")), canonical_numbers(F.col("numbers")))).alias("payload"))


def test_history(spark):
    at = lambda m, d=1: (date(2026, m, d), datetime(2026, m, d, 5))
    data = [
        (1, *at(1), "A ", '{"x": 0.30, "y": 1}', False, ""), (1, *at(2), "a", '{"y": 1.0, "x": 0.3}', False, ""), (1, *at(3), None, "{}", False, ""), (1, *at(4), " ", "{}", False, ""),
        (1, *at(5), "a", "{}", True, ""), (1, *at(6), None, "{}", False, ""), (1, date(2026, 7, 1), datetime(2026, 7, 9), "b", None, False, ""), (1, date(2026, 7, 1), datetime(2026, 7, 2), "c", None, False, ""),
        (2, *at(3), "a", "broken", False, ""), (2, *at(3), "a", "broken", False, ""), (None, *at(3), "a", "{}", False, ""), (3, None, datetime(2026, 1, 1), "a", "{}", False, ""), (4, *at(3), "a", "{}", True, ""),
    ]
    got = rows(build_history(_deliveries(spark, data)), "entity_id", "valid_from", "valid_to", "label")
    assert got == [
        (1, "2026-01-01", "2026-03-01", "a"), (1, "2026-03-01", "2026-05-01", "unknown"), (1, "2026-06-01", "2026-07-01", "unknown"), (1, "2026-07-01", "", "b"), (2, "2026-03-01", "", "a"),
    ]
    assert build_history(_deliveries(spark, data).limit(0)).count() == 0


def test_history_of_one_entity_over_ranges(spark):
    r = random.Random(3)
    data = [(9, date.fromordinal(739_000 + i), datetime(2026, 1, 1), r.choice("ab"), "{}", r.random() < 0.1, "") for i in range(2_000)]
    want, now = 0, None
    for _, _, _, label, _, gone, _ in data:
        payload = None if gone else label
        want += payload is not None and payload != now
        now = payload
    assert build_history(_deliveries(spark, data).repartition(8)).count() == want


def test_p1_reads_dates_as_p6_does(spark, tmp_path):
    """Only the raw items of the source tell that its days come first."""
    from tidewatch.plans.problems import p1_found, p6_found

    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("sources", [(1, "UTC")], "source_id int, time_zone string")
    write("raw_items", [(n, 1, "2025-06-01 00:00:00", f"{12 + n}/03/2025 10:00") for n in range(1, 9)], "item_id int, source_id int, fetched_at string, published_at string")
    write("articles", [(1, 1, "2025-06-01 00:00:00", "04/03/2025 10:00")], "article_id int, source_id int, fetched_at string, published_at string")
    write("source_orientation", [(7, 1, "2025-01-01", "2025-03-20", "2025-01-01", "2025-03-20"), (8, 1, "2025-03-20", None, "2025-03-20", None)], "orientation_id int, source_id int, valid_from string, valid_to string, created_at string, closed_at string")
    got = {r["row_id"]: r["instant_us"] for r in p6_found(spark, str(tmp_path)).where("table_name = 'articles'").collect()}
    assert got == {1: 1741082400000000}  # 4 March
    assert [tuple(r) for r in p1_found(spark, str(tmp_path)).select("article_id", "orientation_id").collect()] == [(1, 7)]
