from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quern.operators import instants, skew

HOSTS = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("in", "Asia/Kolkata", "dmy"), ("jp", "Asia/Tokyo", "ymd")]


def us(*args, zone="UTC", micro=0, fold=0):
    return int(datetime(*args, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-10-21T22:02:37.025Z", "ny", us(2024, 10, 21, 22, 2, 37, micro=25_000)),
    ("2025-01-24T17:13:54", "in", us(2025, 1, 24, 17, 13, 54, zone="Asia/Kolkata")),
    ("2024-12-28T06:03:05.142040+01:00", "ny", us(2024, 12, 28, 5, 3, 5, micro=142_040)),
    ("20240609T123226Z", "ny", us(2024, 6, 9, 12, 32, 26)),
    ("21.06.2024 07:29:12", "ny", us(2024, 6, 21, 7, 29, 12, zone="America/New_York")),
    ("Wed, 17 Jul 2024 08:32:41 GMT", "be", us(2024, 7, 17, 8, 32, 41)),
    ("Tue, 24 Dec 2024 13:04:33 +0100", "be", us(2024, 12, 24, 12, 4, 33)),
    ("2024-10-02 13:57:56,374", "be", us(2024, 10, 2, 13, 57, 56, zone="Europe/Berlin", micro=374_000)),
    ("08/11/2024 15:16:17", "be", us(2024, 11, 8, 15, 16, 17, zone="Europe/Berlin")),
    ("08/11/2024 15:16:17", "ny", us(2024, 8, 11, 15, 16, 17, zone="America/New_York")),
    ("2024/09/06 6:39:07 PM", "jp", us(2024, 9, 6, 18, 39, 7, zone="Asia/Tokyo")),
    ("07/13/2024 12:08:20 AM", "ny", us(2024, 7, 13, 0, 8, 20, zone="America/New_York")),
    ("2024-09-07T00:02:20.729+02:00[Europe/Berlin]", "be", us(2024, 9, 6, 22, 2, 20, micro=729_000)),
    ("2024-11-03 01:14:01 EST", "ny", us(2024, 11, 3, 6, 14, 1)),
    ("2024-11-03 01:14:01 EDT", "ny", us(2024, 11, 3, 5, 14, 1)),
    ("2025-01-27 15:26:33 IST", "in", us(2025, 1, 27, 9, 56, 33)),
    ("1719087158.826", "ny", 1719087158_826_000),
    ("1723095585698", "ny", 1723095585_698_000),
    ("1731807057307933", "ny", 1731807057307933),
    ("1719117795555486417", "ny", 1719117795555486),
    ("1727604592", "ny", 1727604592_000_000),
    ("2024-06-09T10:47:01.042869083Z", "ny", us(2024, 6, 9, 10, 47, 1, micro=42_869)),
    # a local time that occurs twice is the first, one that is skipped has the offset before the change
    ("2024-11-03T01:30:00", "ny", us(2024, 11, 3, 5, 30, 0)),
    ("2024-03-10T02:30:00", "ny", us(2024, 3, 10, 7, 30, 0)),
    ("2025-03-30 02:26:49", "be", us(2025, 3, 30, 1, 26, 49)),
    ("  2024-10-21 22:02:37Z ", "ny", us(2024, 10, 21, 22, 2, 37)),
    *[(bad, "ny", None) for bad in ("", "n/a", "pending", "null", "2025-0", "2025-13-41 25:61:00", "0000-00-00T00:00:00Z", "2024-02-30T00:00:00Z", "0", "-5", "2024-01-01 10:00:00 CEST", None)],
    ("2024-10-21 22:02:37", "unknown", None),
    ("2024-10-21 22:02:37Z", None, us(2024, 10, 21, 22, 2, 37)),
]


def test_every_notation(spark):
    hosts = spark.createDataFrame(HOSTS, "hostname string, zone_name string, date_order string")
    rows = spark.createDataFrame([(str(i), raw, host) for i, (raw, host, _) in enumerate(CASES)], "record_key string, raw string, hostname string")
    got = {int(r.record_key): r.utc_us for r in instants.normalise(rows, hosts).collect()}
    wrong = [(CASES[i], got.get(i)) for i in range(len(CASES)) if got.get(i) != CASES[i][2]]
    assert not wrong


def test_dictionary_grows_only_by_new_values(spark, tmp_path):
    hosts = spark.createDataFrame(HOSTS, "hostname string, zone_name string, date_order string")
    d = instants.InstantDictionary(spark, str(tmp_path / "dict"))
    rows = spark.createDataFrame([("1", "1727604592", "ny"), ("2", "1727604592", "ny"), ("3", "junk", "ny")], "record_key string, raw string, hostname string")
    assert d.update(rows, hosts) == 2
    assert d.update(rows, hosts) == 0
    known = {r.record_key: r.utc_us for r in instants.normalise(rows, hosts, d).collect()}
    assert known == {"1": 1727604592_000_000, "2": 1727604592_000_000, "3": None}
    again = instants.InstantDictionary(spark.newSession(), str(tmp_path / "dict"))
    assert again.update(rows, hosts) == 0 and again.read().count() == 2
    assert instants.InstantDictionary.of(hosts).path != instants.InstantDictionary.of(hosts.limit(1)).path


@pytest.mark.parametrize("empty", [True, False])
def test_archive_tables(spark, empty):
    m = spark.createDataFrame([] if empty else [(1, "1727604592", "ny", "x"), (2, "bad", "ny", "y")], "delivery_id bigint, timestamp string, hostname string, utc_us string")
    s = spark.createDataFrame([] if empty else [("a", "1727604592", "ny"), ("a", "1727604592000", "ny"), ("a", "1727604593", "ny"), (None, "1727604593", "ny")], "id string, created_at string, hostname string")
    h = spark.createDataFrame([] if empty else [(7, 1727604592), (8, 0), (9, None)], "entry_id bigint, source_ts bigint")
    hosts = spark.createDataFrame(HOSTS, "hostname string, zone_name string, date_order string")
    got = sorted(tuple(r) for r in instants.archive_instants(m, s, h, hosts).collect())
    t = 1727604592_000_000
    assert got == ([] if empty else [("head_entries", "7", t), ("messages", "1", t), ("sessions", "a", t), ("sessions", "a", t + 1_000_000)])


def test_a_hot_string_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 500)
    hosts = spark.createDataFrame(HOSTS, "hostname string, zone_name string, date_order string")
    rows = spark.range(2000).select(F.col("id").cast("string").alias("record_key"), F.when(F.col("id") < 1500, "1727604592").otherwise(F.col("id").cast("string")).alias("raw"), F.lit("ny").alias("hostname"))
    got = instants.normalise(rows, hosts)
    assert got.count() == 2000 and got.where("utc_us = 1727604592000000").count() == 1500 and got.where("utc_us is null").count() == 0
    assert datetime.fromtimestamp(1727604592, timezone.utc).year == 2024
