"""Bottom-k sketches of word shingles, mergeable across parts of a corpus."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.hashing import as_bytes, shingle_sets
from pulsegrid.llm.rows import add_columns

K = 128
WIDTH = 5
BITS = 48


def sketches(data: Sequence[bytes], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The ``k`` smallest 48-bit shingle hashes of each text, ascending.

    A text with fewer words than ``width`` has one shingle, an empty one none.
    """
    return [np.unique(s >> np.uint64(64 - BITS))[:k] for s in shingle_sets(data, width)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / float(a[-1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty and a full one are not."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that lies in the second; 1 if the first is empty."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def encode(a: np.ndarray) -> str:
    """A sketch as text: six big-endian bytes per hash, in base 64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").astype(np.uint64).ravel()


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(key, fingerprint) of every whole text; null and empty texts give the empty sketch.

    Equal texts get equal fingerprints; repeated rows stay repeated.
    """
    work = lambda texts: {"fingerprint": [encode(s) for s in sketches([as_bytes(t) for t in texts], k)]}
    return add_columns(docs, F.col(text), {key: F.col(key)}, "fingerprint string", work)


def merge_fingerprints(prints: DataFrame, by: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """Sketch and estimated distinct shingles of each group of documents.

    Every partition first merges what it holds of a group, so a group of any
    size sends one sketch per partition on. Null sketches count as empty.
    """
    rows = prints.select(F.col(by).alias("by"), F.col(column).alias("print"))
    kind = rows.schema["by"].dataType.simpleString()

    def join(values) -> np.ndarray:
        parts = [decode(v) for v in values if isinstance(v, str)]
        return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, dtype=np.uint64)

    def partial(frames):
        for frame in frames:
            for group, part in frame.groupby("by", dropna=False):
                yield pd.DataFrame({"by": [part["by"].iloc[0]], "print": [encode(join(part["print"]))]})

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        whole = join(frame["print"])
        return pd.DataFrame({"by": frame["by"].iloc[:1], "fingerprint": [encode(whole)], "n_distinct": [distinct_count(whole, k)]})

    return (
        rows.mapInPandas(partial, f"by {kind}, print string")
        .groupBy("by")
        .applyInPandas(final, f"by {kind}, fingerprint string, n_distinct double")
        .withColumnRenamed("by", by)
    )


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of another one."""
    take = len(text) // 4
    return text[: len(text) - take] + following[:take]


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprint of each text and of its edited form, and its likeness to both neighbours.

    Documents follow each other by ascending key (after the last comes the
    first, null keys stand last, rows of one key follow by text). Keys are
    dealt into ranges near quantiles; the smallest key of each range is known
    in advance, and its rows are sent to the range before as well. A range is sorted and read as a stream holding one row back.
    Null texts are empty; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    low, cuts = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, 20 * parts)).first()

    def lane(cuts: np.ndarray):
        @F.pandas_udf("int")
        def place(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, ids.to_numpy(dtype=np.int64), side="right").astype(np.int32))

        return place(F.coalesce("doc_id", F.lit((1 << 63) - 1)))

    # Quantiles are rounded for very large keys; the smallest key of each range is exact.
    known = rows.where(F.col("doc_id").isNotNull()).select("doc_id")
    rough = np.array(sorted(set(cuts or [])), dtype=np.int64)
    firsts = known.groupBy(lane(rough).alias("lane")).agg(F.min("doc_id").alias("first")).collect()
    cuts = np.array(sorted(r.first for r in firsts)[1:], dtype=np.int64)
    border = [int(c) for c in cuts]
    own = F.struct(F.col("lane"), F.lit(0).alias("tail"))
    before = F.struct((F.col("lane") - 1).alias("lane"), F.lit(1).alias("tail"))
    round_ = F.struct(F.lit(len(cuts)).alias("lane"), F.lit(2).alias("tail"))
    first = F.col("doc_id").isNull() if low is None else F.col("doc_id") == F.lit(low)
    is_border = F.col("doc_id").isin(border) if border else F.lit(False)
    # Null keys are last of all; they take part in the last range.
    places = F.when(first, F.array(own, round_)).when(is_border, F.array(own, before)).otherwise(F.array(own))
    dealt = (
        rows.withColumn("lane", lane(cuts))
        .withColumn("at", F.explode(places))
        .select("doc_id", "text", F.col("at.lane").alias("lane"), F.col("at.tail").alias("tail"))
        .withColumn("name", F.col("doc_id").cast("string"))
        .repartitionById(len(cuts) + 1, F.col("lane"))
        .sortWithinPartitions("lane", "tail", F.col("doc_id").asc_nulls_last(), "text")
    )

    def run(frames):
        held = None  # (lane, doc_id, text, sketch)
        for frame in frames:
            texts = frame["text"].tolist()
            items = list(zip(frame["lane"].tolist(), frame["tail"].tolist(), frame["name"].tolist(), texts, sketches([as_bytes(t) for t in texts], k)))
            pairs = []
            for lane_, tail, doc, body, found in items:
                if held is not None and held[0] == lane_:
                    pairs.append((held[1], held[2], held[3], body, found))
                held = None if tail else (lane_, doc, body, found)
            changed = [edited(body, following) for _, body, _, following, _ in pairs]
            again = sketches([as_bytes(t) for t in changed], k)
            yield pd.DataFrame(
                {
                    "name": pd.Series([p[0] for p in pairs], dtype=object),
                    "n_chars": [len(p[1]) for p in pairs],
                    "edited_sha256": [hashlib.sha256(as_bytes(t)).hexdigest() for t in changed],
                    "fingerprint": [encode(p[2]) for p in pairs],
                    "edited_fingerprint": [encode(s) for s in again],
                    "near_edited": [resemblance(p[2], s, k) for p, s in zip(pairs, again)],
                    "near_next": [resemblance(p[2], p[4], k) for p in pairs],
                }
            )

    found = dealt.drop("doc_id").mapInPandas(
        run,
        "name string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    return found.select(F.col("name").cast("long").alias(key), *[c for c in found.columns if c != "name"])
