"""Exact Jaccard self-join of word shingle sets by grouped prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.graph import components
from pulsegrid.llm.hashing import as_bytes, batches, shingle_sets
from pulsegrid.llm.rows import add_columns
from pulsegrid.llm.rows import neutral
from pulsegrid.session import cut

WIDTH = 5
PERCENT = 80
BITS = 18
BLOCKS = 64
SMALL_IDS = 2_000_000
WORDS = 8


def needed(size, percent: int = PERCENT):
    """Smallest overlap with any set that is similar enough, from the set's size."""
    return -(-percent * size // 100)


def similar(shared: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return shared > 0 and 100 * shared >= percent * (a + b - shared)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, key, text): a row is known by a hash of its key and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.col(key), body).alias("rid"), F.col(key).alias("key"), body.alias("text"))


def _sets(frames: Iterator[pd.DataFrame], width: int):
    """(frame rows, sets) of about a megabyte of text at a time."""
    for frame in frames:
        data = [as_bytes(t) for t in frame["text"]]
        for first, last in batches(data):
            yield frame.iloc[first:last], shingle_sets(data[first:last], width)


def shingle_counts(texts: DataFrame, width: int = WIDTH) -> np.ndarray:
    """In how many texts the shingles of each of 2**18 hash ranges occur, over all texts.

    Partitions add up first and send blocks of counters, so the shuffle has
    one table of fixed size per partition and the driver gets one in all.
    """

    def count(frames):
        cells = np.zeros(1 << BITS, dtype=np.int64)
        for _, sets in _sets(frames, width):
            for s in sets:
                np.add.at(cells, s >> np.uint64(64 - BITS), 1)
        for block, part in enumerate(cells.reshape(BLOCKS, -1)):
            if part.any():
                yield pd.DataFrame({"block": [block], "cells": [part.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(c, dtype=np.int64) for c in frame["cells"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "cells": [whole.tobytes()]})

    parts = texts.select("text").mapInPandas(count, "block int, cells binary")
    out = np.zeros((BLOCKS, (1 << BITS) // BLOCKS), dtype=np.int64)
    for row in parts.groupBy("block").applyInPandas(add, "block int, cells binary").collect():
        out[row.block] = np.frombuffer(row.cells, dtype=np.int64)
    return out.ravel()


def _prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Rarest shingles of a set, enough of them to meet any similar set."""
    keep = len(s) - needed(len(s), percent) + 1
    return s[np.lexsort((s, counts[s >> np.uint64(64 - BITS)]))[:keep]]


def _digest(prefix: np.ndarray, size: int) -> np.int64:
    raw = hashlib.blake2b(prefix.tobytes() + size.to_bytes(8, "little"), digest_size=8).digest()
    return np.frombuffer(raw, dtype=np.int64)[0]


def _parities(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def describe(texts: DataFrame, counts, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(rid, key, n, unit, gid, bits): set size, digest of the set, group of equal prefix and size, parities.

    ``bits`` holds 512 parities, each of the number of shingles in its hash
    class; sets differ in at least as many shingles as in parities. Texts
    without words have n = 0 and null digests.
    """

    def work(bodies):
        sets = shingle_sets([as_bytes(t) for t in bodies], width)
        return {
            "n": [len(s) for s in sets],
            "unit": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "gid": [int(_digest(_prefix(s, counts.value, percent), len(s))) if len(s) else None for s in sets],
            "bits": [_parities(s).tolist() for s in sets],
        }

    keep = {"rid": F.col("rid"), "key": F.col("key")}
    return add_columns(texts, F.col("text"), keep, "n long, unit binary, gid long, bits array<long>", work)


def prefix_tokens(texts: DataFrame, counts, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(token, gid, n, place) for the prefix of every group a partition holds.

    A partition sends a group once, so copies are combined before the shuffle.
    """

    def run(frames):
        seen: set[int] = set()
        for _, sets in _sets(frames, width):
            tokens, gids, sizes, places = [], [], [], []
            for s in sets:
                if not len(s):
                    continue
                prefix = _prefix(s, counts.value, percent)
                gid = int(_digest(prefix, len(s)))
                if gid in seen:
                    continue
                seen.add(gid)
                tokens.append(prefix.view(np.int64))
                gids.append(np.full(len(prefix), gid))
                sizes.append(np.full(len(prefix), len(s), dtype=np.int32))
                places.append(np.arange(len(prefix), dtype=np.int32))
            if tokens:
                yield pd.DataFrame(
                    {"token": np.concatenate(tokens), "gid": np.concatenate(gids), "n": np.concatenate(sizes), "place": np.concatenate(places)}
                )

    return texts.select("text").mapInPandas(run, "token long, gid long, n int, place int")


def verify(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, rid_a, rid_b) of units whose sets are similar, from their whole texts.

    Only texts named by a pair are moved. Their ids filter the scan from a
    broadcast if there are at most two million of them, by a join otherwise.
    """
    pairs = cut(pairs)
    ids = pairs.select(F.col("rid_a").alias("rid")).union(pairs.select(F.col("rid_b").alias("rid"))).distinct()
    ids = cut(ids)
    few = ids.count() <= SMALL_IDS
    named = texts.join(F.broadcast(ids) if few else ids, "rid", "left_semi").select("rid", "text").dropDuplicates(["rid"])
    left = named.select(F.col("rid").alias("rid_a"), F.col("text").alias("text_a"))
    right = named.select(F.col("rid").alias("rid_b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "rid_a").join(right, "rid_b").select("a", "b", "text_a", "text_b")

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                bodies = list(dict.fromkeys([*part["text_a"], *part["text_b"]]))
                sets = dict(zip(bodies, shingle_sets([as_bytes(t) for t in bodies], width)))
                good = []
                for x, y in zip(part["text_a"], part["text_b"]):
                    s, t = sets[x], sets[y]
                    good.append(similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent))
                yield part.loc[good, ["a", "b"]]

    return both.mapInPandas(run, "a binary, b binary")


def fits(a: str, b: str, percent: int = PERCENT):
    """Sizes that can reach the threshold, in whole numbers."""
    return (100 * F.least(a, b).cast("long") >= percent * F.greatest(a, b))


def classes(docs: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rid, key, n, unit, gid) of every row, and (unit, low, root): component and smallest key of each unit.

    Shingles are ordered by how many texts hold their hash range, rarest
    first, and the prefix of that order must meet the prefix of any similar
    set. Texts with equal sets form a unit, units with equal prefix and size a
    group. First every group is paired with one leader per prefix token; the
    pairs that hold join most of a cluster of copies with few comparisons.
    Then only tokens that still touch different components are joined on
    themselves, for pairs across components, so no link between different
    components is missed and a cluster is not paired with itself.
    """
    spark = docs.sparkSession
    texts = _texts(docs, key, text)
    counts = spark.sparkContext.broadcast(shingle_counts(texts, width))
    rows = cut(describe(texts, counts, width, percent))
    units = cut(
        rows.where("n > 0").groupBy("unit", "n", "gid", "bits").agg(F.min("rid").alias("rid"), F.min("key").alias("low"))
    )
    tokens = prefix_tokens(texts, counts, width, percent)
    shared = (
        tokens.groupBy("token").agg(F.min("gid").alias("lead"), F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1").select("token", "lead")
    )
    met = cut(tokens.join(shared, "token"))

    heads = cut(units.groupBy("gid").agg(F.min(F.struct("unit", "rid", "n", "bits")).alias("h")).select("gid", "h.*"))
    lead = heads.select(
        F.col("gid").alias("lead"), F.col("unit").alias("b"), F.col("rid").alias("rid_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")
    )
    own = heads.select("gid", F.col("unit").alias("a"), F.col("rid").alias("rid_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    possible = fits("n_a", "n_b", percent) & close("bits_a", "bits_b", "n_a", "n_b", percent)
    stars = met.where("gid != lead").select("gid", "lead").distinct().join(own, "gid").join(lead, "lead").where(possible)
    inner = units.select("gid", F.col("unit").alias("a"), F.col("rid").alias("rid_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    inner = inner.join(lead.withColumnRenamed("lead", "gid"), "gid").where((F.col("a") != F.col("b")) & possible)
    pair = ["a", "b", "rid_a", "rid_b"]
    tried = cut(stars.select(*pair).union(inner.select(*pair)))
    first = cut(verify(tried, texts, width, percent))
    roots = components(first)

    # Second look: prefix tokens, and groups, that touch more than one component.
    placed = cut(
        units.join(roots, units["unit"] == roots["node"], "left").select(
            "unit", "rid", "gid", F.coalesce("root", "unit").alias("root"), F.col("n").alias("size"), "bits"
        )
    )
    ends = placed.groupBy("gid").agg(F.min("root").alias("_a"), F.max("root").alias("_b"))
    open_ = met.select("token", "gid").join(ends, "gid").groupBy("token").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    open_ = cut(open_.where("_a != _b").select("token"))
    body = ["unit", "rid", "root", "bits"]
    spread = met.join(open_, "token").select("token", "gid", "n", "place").distinct().join(placed.select("gid", *body), "gid")
    mixed = ends.where("_a != _b").select("gid")
    alone = placed.join(mixed, "gid").select(F.col("gid").alias("token"), F.col("size").cast("int").alias("n"), F.lit(0).alias("place"), *body)
    left = cut(
        spread.select(F.lit(0).alias("kind"), "token", "n", "place", *body).union(alone.select(F.lit(1).alias("kind"), "token", "n", "place", *body))
    )
    sides = [left.select("kind", "token", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "place", *body)]) for x in "ab"]
    # For the first common token at least this overlap can still follow.
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")).cast("long")
    reach = (100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b"))
    across = sides[0].join(sides[1], ["kind", "token"]).where((F.col("root_a") < F.col("root_b")) & reach & possible)
    across = across.select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"), "rid_a", "rid_b").distinct()
    done = tried.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).distinct()
    across = across.join(done, (F.least("a", "b") == F.col("_x")) & (F.greatest("a", "b") == F.col("_y")), "left_anti")
    second = cut(verify(across, texts, width, percent))
    if second.limit(1).count():
        roots = components(first.union(second))

    final = units.join(roots, units["unit"] == roots["node"], "left").select("unit", "low", F.coalesce("root", "unit").alias("root"))
    return rows, final


def close(a: str, b: str, n_a: str, n_b: str, percent: int = PERCENT):
    """Parities that still allow the threshold: at most n_a + n_b - 2 x the needed overlap may differ."""
    differing = sum((F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(WORDS)), F.lit(0))
    both = F.col(n_a).cast("long") + F.col(n_b).cast("long")
    return (100 + percent) * differing <= (100 - percent) * both


def near_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(key, n_shingles, component_id) for every row.

    Two texts are linked when their sets of ``width``-word shingles reach the
    Jaccard similarity; ``component_id`` is the smallest key reachable. Words
    are separated by white space, A-Z count as a-z, and a text with fewer
    words is its own single shingle. Texts without words (null, empty) have
    size 0 and are linked with nothing. Rows with a null key take part; a
    component of such rows only has a null id. Repeated rows are equal texts
    and share a component.
    """
    rows, units = classes(docs, key, text, width, percent)
    smallest = units.groupBy("root").agg(F.min("low").alias("component_id"))
    named = units.join(smallest, "root").select(F.col("unit").alias("_unit"), "component_id")
    out = rows.join(named, rows["unit"] == named["_unit"], "left")
    component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that of the smallest key (null keys last), then of the smallest hash.

    Rows without words all stay, since they are linked with nothing. Only ids
    of rows that go are joined with the documents; they are broadcast if there
    are at most two million.
    """
    docs, given = neutral(docs), docs.columns
    docs, key, text = docs[0], docs[1][key], docs[1][text]
    rows, units = classes(docs, key, text, width, percent)
    placed = cut(rows.where("n > 0").join(units.select("unit", "root"), "unit").select("rid", "key", "root"))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "rid")
    keepers = placed.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.rid").alias("rid"))
    copies = placed.groupBy("rid").agg(F.count(F.lit(1)).alias("copies"))
    gone = copies.join(keepers, "rid", "left_anti").select(F.col("rid").alias("_gone"))
    twice = copies.where("copies > 1").join(keepers, "rid", "left_semi").select(F.col("rid").alias("_gone"))
    gone, twice = cut(gone), cut(twice)
    body = F.coalesce(F.col(text), F.lit(""))
    tagged = docs.withColumn("_rid", F.xxhash64(F.col(key), body))

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= SMALL_IDS else ids

    single = tagged.join(small(gone.union(twice)), F.col("_rid") == F.col("_gone"), "left_anti")
    repeated = tagged.join(small(twice), F.col("_rid") == F.col("_gone"), "left_semi").dropDuplicates(["_rid"])
    return single.union(repeated).drop("_rid").toDF(*given)
