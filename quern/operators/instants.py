"""Mixed timestamp notations to one instant (UTC microseconds).

``normalise`` follows the dictionary method: raw strings are reduced to distinct
(raw, host) values, each distinct value is parsed exactly once by an exhaustive list of
notations, and the instants are joined back to the rows. ``InstantDictionary`` keeps the
parsed values in the shared folder, so a later run only parses strings it has not seen.

Everything runs as Catalyst expressions; no Python touches a row. A raw string that a
third of all rows share does not form a hot group: it is one row before any shuffle, and its
rows take their instant from a broadcast of the few hot strings.

Defined results
* NULL, blank, truncated or impossible values (month 13, hour 25, 30 February) -> NULL.
* Bare numbers count from 1970-01-01 UTC; the unit is read off the magnitude
  (below 1e11 seconds, 1e14 milliseconds, 1e17 microseconds, else nanoseconds). Zero and
  negative numbers are unreadable.
* Digits beyond microseconds are cut.
* No zone: local time of the host. A local time that occurs twice is the first of the two,
  one that is skipped is read with the offset before the change (java.time semantics).
* A zone abbreviation is one of the host's own; an abbreviation the host never uses, or a
  zone-less value of an unknown host, is unreadable. Offsets, ``Z``, ``UTC`` and ``GMT`` need no host.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import opaque, squeeze
from quern.ledger import Ledger
from quern.operators.skew import hot_keys, join_on
from quern.session import cut, drop_path, shared_dir

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])[Mm])?"
_ZONE = r"\s*(Z|z|[A-Za-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?(?:\[[A-Za-z0-9_+\-/]+\])?"
#: Every notation with a clock: the order its host must have in slashed dates (None: any), the
#: pattern, and which groups are year, month and day. Groups 4-7 are hour, minute, second and
#: fraction, 8 the letter of am or pm, 9 the zone. A date alone is midnight.
NOTATIONS = (
    (None, rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:[Tt]|\s+){_TIME}{_ZONE})?$", (1, 2, 3)),
    (None, rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (3, 2, 1)),
    (None, rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:,?\s+{_TIME}{_ZONE})?$", (1, 2, 3)),
    ("mdy", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (3, 1, 2)),
    ("dmy", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (3, 2, 1)),
    (None, rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?\s+(\d{{4}})\s+{_TIME}{_ZONE}$", (3, 2, 1)),
    (None, rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?(){_ZONE}$", (1, 2, 3)),
)
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def epoch_us(col: Column) -> Column:
    """A number of unknown unit since 1970 to microseconds; zero or less is NULL."""
    v = col.cast("decimal(38,9)")
    us = F.when(v < F.lit(10**11), v * 1_000_000).when(v < F.lit(10**14), v * 1000).when(v < F.lit(10**17), v).otherwise(v / 1000)
    return F.when(v > 0, F.floor(us).cast("bigint"))


def _fields(s: Column, order: Column) -> Column:
    """Year, month, day, hour, minute, second, fraction, am/pm and zone as written; a number alone; NULL where nothing fits."""
    found = F.when(s.rlike(r"^\d+(\.\d*)?$"), s)
    for wanted, pattern, date in NOTATIONS:
        fits = s.rlike(pattern) if wanted is None else s.rlike(pattern) & (order == wanted)
        found = found.when(fits, F.regexp_replace(s, pattern, "\u001f".join(f"${i}" for i in (*date, 4, 5, 6, 7, 8, 9))))
    return F.split(found, "\u001f")


def with_parsed(df: DataFrame, raw: str, zone: str, order: str, abbreviations: str, out: str) -> DataFrame:
    """Add ``out``, the UTC microseconds of ``raw``, NULL where it is unreadable.

    ``zone`` holds the IANA name of the row's host, ``order`` its order in slashed dates
    (mdy, dmy, ymd), ``abbreviations`` a map from zone abbreviation to offset. The steps are
    separate projections on purpose: one expression would be too large to compile.
    """
    df = df.withColumn("__f", _fields(squeeze(raw), F.col(order)))
    g = lambda i: F.get("__f", F.lit(i))
    or_zero = lambda c: F.when(c == "", F.lit("0")).otherwise(c)
    month = F.coalesce(g(1).try_cast("int"), ((F.instr(F.lit(_MONTHS.lower()), F.lower(F.substring(g(1), 1, 3))) + 2) / 3).cast("int"))
    half = F.lower(g(7))
    second = F.concat(or_zero(g(5)), F.lit("."), F.rpad(F.substring(g(6), 1, 6), 6, "0"))
    clock = F.struct(
        g(0).try_cast("int").alias("y"), month.alias("mo"), g(2).try_cast("int").alias("d"), or_zero(g(3)).try_cast("int").alias("h"), or_zero(g(4)).try_cast("int").alias("mi"),
        second.try_cast("decimal(16,6)").alias("s"), half.alias("half"), F.upper(g(8)).alias("mark"), g(0).try_cast("decimal(38,9)").alias("n"),
    )
    df = df.withColumn("__number", F.size("__f") == 1).withColumn("__c", F.when(F.col("__f").isNotNull(), clock))
    c = lambda k: F.col("__c")[k]
    mark = c("mark")
    offset = F.when(F.length(mark) == 3, F.concat(mark, F.lit(":00"))).when(F.length(mark) == 5, F.concat(F.substring(mark, 1, 3), F.lit(":"), F.substring(mark, 4, 2))).otherwise(mark)
    where = (
        F.when(mark == "", F.col(zone))
        .when(mark.isin("Z", "UTC", "GMT", "UT"), F.lit("UTC"))
        .when(mark.startswith("+") | mark.startswith("-"), F.when(offset.rlike(r"^[+-](0\d|1[0-7]):[0-5]\d$|^[+-]18:00$"), offset))
        .otherwise(F.element_at(F.col(abbreviations), mark))
    )
    hour = F.when(c("half") == "", c("h")).when(c("h").between(1, 12), c("h") % 12 + F.when(c("half") == "p", 12).otherwise(0))
    df = df.withColumn("__w", F.when(~F.col("__number"), where)).withColumn("__h", hour)
    valid = c("y").between(1, 9999) & F.col("__w").isNotNull() & (F.col("__h") < 24) & (c("s") < 60)
    clocked = F.when(valid, F.unix_micros(F.try_make_timestamp(c("y"), c("mo"), c("d"), F.col("__h"), c("mi"), c("s"), F.col("__w"))))
    return df.withColumn(out, opaque(F.when(F.col("__number"), epoch_us(c("n"))).otherwise(clocked))).drop("__f", "__w", "__c", "__h", "__number")


def _zone_abbreviations(zone_name: str | None) -> dict[str, str]:
    """Abbreviation -> offset as the zone has used them since 1970, and will by its present rules, the latest use winning.

    A look a week finds every period of an offset: none is shorter.
    """
    out: dict[str, str] = {}
    try:
        zone = ZoneInfo(zone_name or "")
    except (KeyError, ValueError, OSError):
        return out
    at, end = datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc)
    while at < end:
        local = at.astimezone(zone)
        name, shift = local.tzname(), int(local.utcoffset().total_seconds()) // 60
        if name and name[0].isalpha():
            out[name.upper()] = f"{'-' if shift < 0 else '+'}{abs(shift) // 60:02d}:{abs(shift) % 60:02d}"
        at += timedelta(days=7)
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def zone_abbreviations(names: pd.Series) -> pd.Series:
    return names.map(_zone_abbreviations)


def host_zones(hosts: DataFrame) -> DataFrame:
    """(hostname, zone_name, date_order, abbreviations), one row per host; the registry of hosts is fixed and small."""
    one = hosts.groupBy("hostname").agg(F.min("zone_name").alias("zone_name"), F.min(F.lower("date_order")).alias("date_order"))
    return one.withColumn("abbreviations", zone_abbreviations("zone_name"))


def parse_dictionary(values: DataFrame, hosts: DataFrame) -> DataFrame:
    """``values`` (raw, hostname, ...) with ``utc_us`` added; hosts is broadcast (a fixed registry)."""
    zones = F.broadcast(host_zones(hosts))
    joined = values.join(zones, "hostname", "left")
    return with_parsed(joined, "raw", "zone_name", "date_order", "abbreviations", "utc_us").drop("zone_name", "date_order", "abbreviations")


def with_instant(df: DataFrame, raw: str, hosts: DataFrame, out: str = "utc_us") -> DataFrame:
    """Parse in place, without a dictionary: for rows whose strings hardly repeat."""
    zones = F.broadcast(host_zones(hosts).withColumnsRenamed({"zone_name": "__zone", "date_order": "__order", "abbreviations": "__abbr"}))
    return with_parsed(df.join(zones, "hostname", "left"), raw, "__zone", "__order", "__abbr", out).drop("__zone", "__order", "__abbr")


def distinct_values(rows: DataFrame) -> DataFrame:
    """(raw, hostname, n): each distinct string of each host with its rows, counted before the shuffle. NULL in raw has no row."""
    return rows.where(F.col("raw").isNotNull()).groupBy("raw", F.coalesce("hostname", F.lit("")).alias("hostname")).agg(F.count("*").alias("n"))


def attach(rows: DataFrame, known: DataFrame, few: DataFrame | None) -> DataFrame:
    """Rows with ``utc_us`` from the dictionary; strings that a large part of the rows share (``few``) are joined by broadcast."""
    with_host = rows.withColumn("hostname", F.coalesce("hostname", F.lit("")))
    return join_on(with_host, known.select("raw", "hostname", "utc_us"), ["raw", "hostname"], few)


def normalise(rows: DataFrame, hosts: DataFrame, dictionary: InstantDictionary | None = None) -> DataFrame:
    """Add ``utc_us`` to rows of (raw, hostname, ...).

    1. distinct (raw, hostname) with map-side combine;
    2. values the dictionary does not hold yet are parsed, each once, and added to it;
    3. the dictionary is joined back. Without one, the values are parsed for this call only.
    """
    values = cut(distinct_values(rows), "values")
    few = hot_keys(values, ["raw", "hostname"], "n")[2]
    if dictionary is None:
        known = cut(parse_dictionary(values.drop("n"), hosts), "parsed")
    else:
        dictionary.update(values, hosts)
        known = dictionary.read()
    return attach(rows, known, few)


#: Changes whenever a notation is read in another way, so that old dictionaries are not used any more.
EDITION = 2


class InstantDictionary:
    """Persistent dictionary of (raw, hostname) -> utc_us, grown run by run.

    ``update`` appends only values it has not seen; running it twice on the same rows adds
    nothing. Unreadable values are kept with NULL, so they are not parsed again either. A manifest
    names the folders that count; of two writers with the same new values one plans again.
    """

    SCHEMA = "raw string, hostname string, utc_us bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ledger = Ledger(spark, self.path)

    @staticmethod
    def of(hosts: DataFrame) -> InstantDictionary:
        """The dictionary in the shared folder that belongs to this registry of hosts: zones decide what a string means."""
        spark = hosts.sparkSession
        rows = sorted((r[0] or "", r[1] or "", r[2] or "") for r in hosts.groupBy("hostname").agg(F.min("zone_name"), F.min(F.lower("date_order"))).collect())
        mark = hashlib.sha256(repr((EDITION, rows)).encode()).hexdigest()[:24]
        return InstantDictionary(spark, f"{shared_dir(spark)}/quern-instants-{mark}")

    def _folders(self, value: dict | None) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in (value or {}).get("folders", [])]
        return self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)

    def read(self) -> DataFrame:
        at = self.ledger.version()
        return self._folders(self.ledger.read(at) if at else None)

    def update(self, values: DataFrame, hosts: DataFrame) -> int:
        """Parse and keep what is new of (raw, hostname[, ..]), or of the distinct values of rows; returns how many."""
        once = values.where(F.col("raw").isNotNull()).select("raw", F.coalesce("hostname", F.lit("")).alias("hostname")).distinct()
        added = 0

        def plan(old: dict | None) -> dict | None:
            nonlocal added
            folder = f"data-{uuid.uuid4().hex}"
            new = once.join(self._folders(old), ["raw", "hostname"], "left_anti") if old else once
            parse_dictionary(new, hosts).select("raw", "hostname", "utc_us").write.parquet(f"{self.path}/{folder}")
            added = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{folder}").count()
            if not added:
                drop_path(self.spark, f"{self.path}/{folder}")
                return None
            return {"folders": [*(old or {"folders": []})["folders"], folder]}

        self.ledger.change(plan)
        return added


def archive_instants(messages: DataFrame, sessions: DataFrame, head_entries: DataFrame, hosts: DataFrame) -> DataFrame:
    """(table_name, record_key, utc_us) of every readable time in the three tables, without repeats."""
    columns = ["table_name", "record_key", "utc_us"]

    def raw(df: DataFrame, name: str, key: str, text: str) -> DataFrame:
        rows = df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_key"), F.col(text).alias("raw"), "hostname")
        return rows.where("raw is not null and record_key is not null")

    own, from_messages = raw(sessions, "sessions", "id", "created_at"), raw(messages, "messages", "delivery_id", "timestamp")
    values = cut(distinct_values(own.unionByName(from_messages)), "values")
    few = hot_keys(values, ["raw", "hostname"], "n")[2]
    dictionary = InstantDictionary.of(hosts)
    dictionary.update(values, hosts)
    known = dictionary.read()
    heads = head_entries.select(F.lit("head_entries").alias("table_name"), F.col("entry_id").cast("string").alias("record_key"), epoch_us(F.col("source_ts")).alias("utc_us"))
    read = lambda rows: attach(rows, known, few).where("utc_us is not null").select(columns)
    # Only sessions repeat an id; rows of the other two are unique by key.
    return read(from_messages).unionByName(heads.where("utc_us is not null and record_key is not null")).unionByName(read(own).distinct())
