"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.llm.common import free_name, row_key, small_side
from episcope.session import durable

#: Days of one join bucket: intervals and captures of a value meet only within such a span of time.
SPAN_DAYS = 32
# Kinds of entries, from the least to the most specific.
KINDS = ("domain", "host", "prefix")
_KEYS = "array<struct<kind:string,value:string,weight:int>>"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute address, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def segments_of(url: Column) -> Column:
    """The path's parts, without empty ones, query and fragment."""
    return F.filter(F.split(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")


def keys_of(url: Column) -> Column:
    """What entries may name to match an address: every domain it lies in, its host, every prefix of its path."""
    host, parts = host_of(url), segments_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value"),
        (F.size(labels) - i + 1).cast("int").alias("weight")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(1_000).alias("weight")))
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("value"),
        (i + 1_000_000).cast("int").alias("weight")))
    return F.when(host.isNotNull(), F.concat(domains, own, prefixes)).otherwise(F.array().cast(_KEYS))


def intervals(entries: DataFrame) -> DataFrame:
    """``(kind, value, verdict, valid_from, valid_to)`` from entries ``(entry_id, kind, value, action, verdict, day)``.

    ``add`` puts a value on the list from its day on, ``remove`` takes it off, another ``add`` changes the verdict; each
    holds until the value's next entry. Of several entries of a value on one day the one with the largest id counts
    (ties: ``add`` before ``remove``, then the verdict that comes first by name). Entries with a null value, kind or day
    are ignored. After that a value has one entry a day at most, so the window is bounded by the calendar.
    """
    last = F.max(F.struct("entry_id", (F.col("action") == "add").alias("on"), F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allow")))
    daily = (entries.where("kind is not null and value is not null and day is not null")
             .groupBy("kind", "value", "day").agg(last.alias("e")))
    following = F.lead("day").over(Window.partitionBy("kind", "value").orderBy("day"))
    return (daily.withColumn("valid_to", following).where("e.on")
            .select("kind", "value", F.when(F.col("e.allow") == 1, "allow").otherwise("block").alias("verdict"),
                    F.col("day").alias("valid_from"), "valid_to"))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """The captures with ``verdict`` (``block``, ``allow`` or ``none``), ``kind`` and ``value`` of the deciding entry and
    its ``valid_from`` and ``valid_to``.

    An entry decides if it is active on the day of the fetch: valid_from <= day < valid_to, open-ended if there is no next
    entry. The most specific active entry wins: the longest path prefix, then the host, then the closest domain. Captures
    without address, host or fetch day get ``none``. Equal rows stay as many as they were. Added columns replace columns
    of the same name.
    """
    added = ["verdict", "kind", "value", "valid_from", "valid_to"]
    base = captures.drop(*[c for c in captures.columns if c.lower() in added])
    key = free_name(base, "__row")
    rows = base.withColumn(key, row_key(base, base.columns))
    asked = rows.select(F.col(key).alias("k"), F.to_date(F.col(f"`{fetched}`")).alias("day"), F.col(f"`{url}`").alias("url"))
    days = asked.agg(F.min("day").alias("a"), F.max("day").alias("b")).head()
    spans = intervals(entries)
    number = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / SPAN_DAYS)
    # An interval goes to each span of time in which there are captures and it is valid: bounded by the calendar.
    low, high = (F.lit(days[c]).cast("date") for c in ("a", "b"))
    spans = (spans.withColumn("from", F.greatest("valid_from", low))
             .withColumn("to", F.least(F.coalesce(F.date_sub("valid_to", 1), high), high)).where(F.col("from") <= F.col("to"))
             .withColumn("span", F.explode(F.sequence(number(F.col("from")), number(F.col("to")))))
             .drop("from", "to"))
    asked = (asked.dropDuplicates(["k"]).where("day is not null")
             .select("k", "day", number(F.col("day")).alias("span"), F.explode(keys_of(F.col("url"))).alias("x"))
             .select("k", "day", "span", "x.*"))
    met = (asked.join(small_side(durable(spans)), ["kind", "value", "span"])
           .where((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))))
    best = met.groupBy("k").agg(F.max(F.struct("weight", "kind", "value", "verdict", "valid_from", "valid_to")).alias("best"))
    return (rows.join(best, rows[key] == best["k"], "left").drop("k", key)
            .withColumn("verdict", F.coalesce("best.verdict", F.lit("none")))
            .withColumns({c: F.col(f"best.{c}") for c in added[1:]}).drop("best"))
