"""URL lists that change over time: each capture is judged by the entries of its day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.rows import neutral

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)"
NEVER = 2_000_000_000
KEY = ("list", "scope", "entry")


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def prefix_of(url: Column) -> Column:
    """Host and first path segment."""
    return F.concat(host_of(url), F.regexp_extract(url, SEGMENT, 1))


def keys_of(url: Column) -> Column:
    """Entries that could list a URL: its host, every domain above or at it, and its prefix."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(labels, i, n), ".").alias("entry")),
    )
    own = F.array(
        F.struct(F.lit("host").alias("scope"), host_of(url).alias("entry")),
        F.struct(F.lit("prefix").alias("scope"), prefix_of(url).alias("entry")),
    )
    return F.when(url.isNotNull() & (host_of(url) != ""), F.concat(own, domains)).otherwise(F.slice(own, 1, 0))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, scope, entry, since, until): days on which an entry is active, ``until`` excluded.

    ``entries`` has (list, scope, entry, action, day) with action ``add`` or
    ``remove``. Of several events on a day, an addition wins. An event with a
    null in any column is ignored, repeated events count once, removals
    without an addition do nothing, and consecutive additions are one interval.
    """
    days = (
        entries.select(*KEY, "day", (F.col("action") == "add").alias("on")).dropna()
        .groupBy(*KEY, "day").agg(F.max("on").alias("on"))
    )
    line = Window.partitionBy(*KEY).orderBy("day")
    turns = days.withColumn("was", F.lag("on").over(line)).where(F.coalesce(F.col("was") != F.col("on"), F.col("on")))
    turns = turns.withColumn("until", F.coalesce(F.lead("day").over(line), F.lit(NEVER)))
    return turns.where("on").select(*KEY, F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """Captures with ``blocked`` and ``lists``, the names of the lists active at fetch time.

    Captures of one URL on one day are judged once, and each of their keys is
    probed once a day: the as-of join sorts intervals and probe days of an
    entry together and carries the last interval forward, so an entry costs
    its days, not its captures. The verdicts of URLs that are listed are then
    joined back by URL and day, which spreads a busy host over its days and
    pages. A null URL or day, or a URL without host, is never listed; repeated
    captures are all returned; empty lists block nothing.
    """
    own, when, given = "_url", "_day", [c for c in captures.columns if c not in ("blocked", "lists")]
    captures, names = neutral(captures.select(*[F.col(f"`{c}`") for c in given]))
    url, day = names[url], names[day]
    seen = captures.select(F.col(url).alias(own), F.col(day).alias(when)).dropna().distinct()
    probes = seen.select(own, when, F.explode(keys_of(F.col(own))).alias("k")).select(own, when, "k.scope", "k.entry")
    spans = intervals(entries)
    listed = spans.select(*KEY).distinct()
    asked = probes.select("scope", "entry", F.col(when).alias("at")).distinct().join(listed, ["scope", "entry"])
    line = Window.partitionBy(*KEY).orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    merged = spans.select(*KEY, F.col("since").alias("at"), F.lit(0).alias("probe"), "until").union(
        asked.select(*KEY, "at", F.lit(1).alias("probe"), F.lit(None).cast("int").alias("until"))
    )
    active = (
        merged.withColumn("until", F.last("until", ignorenulls=True).over(line))
        .where((F.col("probe") == 1) & (F.col("until") > F.col("at")))
        .select("scope", "entry", "list", F.col("at").alias(when))
    )
    hits = probes.join(active, ["scope", "entry", when]).groupBy(own, when).agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("_lists")
    )
    back = captures.join(hits, (captures[url] == hits[own]) & (captures[day] == hits[when]), "left")
    verdict = [F.col("_lists").isNotNull().alias("blocked"), F.coalesce("_lists", F.lit("")).alias("lists")]
    return back.select(*[captures[c] for c in captures.columns], *verdict).toDF(*given, "blocked", "lists")
