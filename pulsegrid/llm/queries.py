"""The registered queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import centroids, credentials, fingerprints, jaccard, language, lines, mixing, packing, rules, tokens, toxicity, trie, urls

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(parts: int) -> Column:
    """Remainder of the checksum of the id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query()
def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned outside fold 2 of 4."""
    docs = table(spark, sf, "documents")
    model = language.fit_language(docs.where(fold(4) != 2))
    keep = {"doc_id": F.col("doc_id"), "held_out": F.coalesce(fold(4) == 2, F.lit(False))}
    return language.predict_language(docs, model, keep=keep)


@query()
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document, learned outside fold 0 of 5."""
    docs = table(spark, sf, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf, "labels"), learn=fold(5) != 0)
    keep = {"doc_id": F.col("doc_id"), "held_out": F.coalesce(fold(5) == 0, F.lit(False))}
    return toxicity.score_toxicity(docs, model, keep=keep)


def number(text: str | Column) -> Column:
    """A fixed number below 2**32 for a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


FIRST_DAY, DAYS = 19_723, 730


def dated_entries(pages: DataFrame) -> DataFrame:
    """List events drawn from the hosts of the pages by their digests.

    One host in five is added to `spam`, half of those are removed up to 200
    days later and a quarter comes back; one parent domain in eleven is on
    `parked`, one prefix in seven on `sections`.
    """
    url = F.col("url")
    named = pages.select(
        urls.host_of(url).alias("host"), urls.prefix_of(url).alias("prefix"),
        F.regexp_extract(urls.host_of(url), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain"),
    ).where("host != ''")
    drawn = [("spam", "host", "host", 5), ("parked", "domain", "domain", 11), ("sections", "prefix", "prefix", 7)]
    out = None
    for name, scope, column, share in drawn:
        entry = F.col("entry")
        keys = named.select(F.col(column).alias("entry")).where("entry != ''").distinct().where(number(entry) % share == 0)
        add = (FIRST_DAY + number(F.concat(F.lit("a"), entry)) % DAYS).cast("int")
        span = (1 + number(F.concat(F.lit("r"), entry)) % 200).cast("int")
        removed = number(F.concat(F.lit("q"), entry)) % 4
        event = lambda action, day: F.struct(F.lit(action).alias("action"), day.alias("day"))
        events = F.when(removed == 0, F.array(event("add", add))).when(removed == 1, F.array(event("add", add), event("remove", add + span), event("add", add + 2 * span))).otherwise(
            F.array(event("add", add), event("remove", add + span))
        )
        rows = keys.select(F.lit(name).alias("list"), F.lit(scope).alias("scope"), "entry", F.explode(events).alias("e")).select("list", "scope", "entry", "e.*")
        out = rows if out is None else out.union(rows)
    return out


URL_SQL = rf"""
WITH c AS (SELECT page_id, url, ({FIRST_DAY} + ('0x' || substr(md5('f' || page_id::VARCHAR), 1, 8))::BIGINT % {DAYS})::INTEGER AS fetch_day,
    lower(regexp_extract(url, '{urls.HOST}', 1)) AS host, regexp_extract(url, '{urls.SEGMENT}', 1) AS seg FROM pages),
k AS (SELECT 'spam' AS list, 'host' AS scope, host AS entry, 5 AS share FROM c UNION
    SELECT 'parked', 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), 11 FROM c UNION
    SELECT 'sections', 'prefix', host || seg, 7 FROM c WHERE host != ''),
n AS (SELECT *, ({FIRST_DAY} + ('0x' || substr(md5('a' || entry), 1, 8))::BIGINT % {DAYS})::INTEGER AS d,
    (1 + ('0x' || substr(md5('r' || entry), 1, 8))::BIGINT % 200)::INTEGER AS s, ('0x' || substr(md5('q' || entry), 1, 8))::BIGINT % 4 AS q
    FROM k WHERE entry != '' AND ('0x' || substr(md5(entry), 1, 8))::BIGINT % share = 0),
i AS (SELECT list, scope, entry, d AS since, CASE WHEN q = 0 THEN 2000000000 ELSE d + s END AS until FROM n UNION ALL
    SELECT list, scope, entry, d + 2 * s, 2000000000 FROM n WHERE q = 1),
h AS (SELECT c.page_id, c.url, c.fetch_day, string_agg(DISTINCT i.list, ',' ORDER BY i.list) AS lists FROM c JOIN i
    ON i.since <= c.fetch_day AND c.fetch_day < i.until AND (
        (i.scope = 'host' AND i.entry = c.host) OR (i.scope = 'prefix' AND i.entry = c.host || c.seg)
        OR (i.scope = 'domain' AND (c.host = i.entry OR ends_with(c.host, '.' || i.entry))))
    GROUP BY ALL)
SELECT c.page_id, c.fetch_day, h.lists IS NOT NULL AS blocked, coalesce(h.lists, '') AS lists
FROM c LEFT JOIN h ON c.page_id = h.page_id AND c.url = h.url AND c.fetch_day = h.fetch_day"""


@query(URL_SQL)
def op3_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every page against the list entries of its day; days and entries come from the pages' digests."""
    pages = table(spark, sf, "pages")
    day = (FIRST_DAY + number(F.concat(F.lit("f"), F.col("page_id").cast("string"))) % DAYS).cast("int")
    captures = pages.select("page_id", "url", day.alias("fetch_day"))
    return urls.judge(captures, dated_entries(pages)).select("page_id", "fetch_day", "blocked", "lists")


@query()
def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Sketch of every document, of its edited text, and its likeness to the next one."""
    return fingerprints.compare_neighbours(table(spark, sf, "documents"))


@query()
def op5_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every document after line deduplication: lines lost and a digest of what is left."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    left = lines.dedupe_lines(docs, count="n_lost")
    return left.select(
        "doc_id", "n_lost", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("left_sha256")
    )


@query(mixing.mix_sql())
def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(table(spark, sf, "documents"))


@query()
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    return packing.pack(table(spark, sf, "documents"))


@query()
def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document, weak parts only where they complete each other."""
    return credentials.find_secrets(table(spark, sf, "documents"))


@query()
def op9_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return jaccard.near_components(table(spark, sf, "documents"))


@query()
def op10_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query(trie.trie_sql())
def op11_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf, "conversations"))


@query(centroids.cluster_sql())
def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster, distance and inertia of every vector of 64 finite components."""
    return centroids.cluster_vectors(table(spark, sf, "embeddings"))


@query()
def op13_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is above 4,096 tokens."""
    return tokens.count_tokens(table(spark, sf, "documents"))


@query()
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
