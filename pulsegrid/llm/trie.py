"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of what may be shared."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.session import cut

FAMILY, HEADS = 20, 4
SLICE_BITS = 12  # turns of one conversation that a task scans in one piece: 4,096
CELLS_A_ROW = 4
LEAST_BITS, MOST_BITS = 16, 26
CHUNK = 1 << 16
IDS_A_CHUNK = 500
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["p1", "p2", "depth"]


def scan(rows: DataFrame, order: list[Column], values: Mapping[str, Column], add, long_only: Column | None = None) -> DataFrame:
    """Running ``add`` (F.sum, F.bit_xor) of the values, current row included, per conversation ``c``.

    Conversations are scanned in the slices of column ``s``, whose numbers
    follow the order; the slices before a slice are added to its rows. Rows
    for which ``long_only`` is false lie in conversations of one slice.
    """
    lane = Window.partitionBy("c", "s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: add(v).over(lane) for n, v in values.items()})
    parts = (rows if long_only is None else rows.where(long_only)).groupBy("c", "s").agg(*[add(v).alias(f"_{n}") for n, v in values.items()])
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select("c", "s", *[add(f"_{n}").over(before).alias(f"_{n}") for n in values])
    earlier = earlier.where(" or ".join(f"_{n} is not null" for n in values))
    zero = F.lit(0).cast("long")
    joined = local.join(earlier, ["c", "s"], "left")

    def both(n: str) -> Column:
        ahead = F.coalesce(f"_{n}", zero)
        return F.col(n) + ahead if add is F.sum else F.col(n).bitwiseXOR(ahead)

    return joined.select(*rows.columns, *[both(n).alias(n) for n in values])


def numbered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, t1, t2, w): place, digest and words of every turn; the texts are left behind here."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"),
        F.coalesce(F.shiftright(F.col(turn).cast("long"), SLICE_BITS), F.lit(-(1 << 62))).alias("s"),
        F.xxhash64(role_, text_).alias("t1"), F.xxhash64(F.lit(1), role_, text_).alias("t2"),
        F.regexp_count(text_, F.lit(WORD)).cast("int").alias("w"),
    )
    one = F.lit(1).cast("long")
    placed = scan(turns, [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], {"pos": one}, F.sum)
    return placed.select("c", (F.col("pos") - 1).alias("pos"), "t1", "t2", "w")


def rebuilt_conversations(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, size) of every conversation, and (c, pos, t1, t2, w, size) of its turns after rebuilding.

    A conversation takes the first turns of the head of its family, at most
    three, and goes on with its own. A family has at most twice ``FAMILY``
    members, so the heads multiply by a constant only.
    """
    known = numbered.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    known = known.withColumns({"h": F.crc32(F.col("c").cast("string")) % HEADS, "base": F.col("c") - F.col("c") % FAMILY})
    heads = known.where("c % 20 = 0".replace("20", str(FAMILY))).select(F.col("c").alias("base"), F.col("n").alias("of"))
    taken = F.least("h", F.coalesce("of", F.lit(0).cast("long")))
    plans = known.join(heads, "base", "left").select(
        "c", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("size")
    )
    first = numbered.where((F.col("c") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("c", "base")
    front = plans.join(first, "base").where("pos < h").select("c", "pos", "t1", "t2", "w", "size")
    own = numbered.join(plans, "c").where("pos >= h").select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "t1", "t2", "w", "size")
    return plans.select("c", "size"), front.union(own)


def prefix_rows(plans: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, depth, p1, p2, q1, q2, w, size): digest of every prefix and of the one before it, the empty one included.

    A prefix is the exclusive or of 128-bit hashes of its turns with their
    places, so long conversations can be scanned in slices.
    """
    hashed = turns.select(
        "c", F.shiftright("pos", SLICE_BITS).alias("s"), (F.col("pos") + 1).alias("depth"), "w", "size",
        F.xxhash64("pos", "t1").alias("h1"), F.xxhash64(F.lit(7), "pos", "t2").alias("h2"),
    )
    done = scan(hashed, [F.col("depth")], {"p1": F.col("h1"), "p2": F.col("h2")}, F.bit_xor, F.col("size") > (1 << SLICE_BITS))
    rows = done.select(
        "c", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), "w", "size"
    )
    zero = F.lit(0).cast("long")
    roots = plans.select("c", zero.alias("depth"), *[zero.alias(n) for n in ("p1", "p2", "q1", "q2")], F.lit(0).alias("w"), "size")
    return roots.union(rows)


def _cells(bits: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A prefix' cell in each of the two rows of the sketch."""
    mask = np.uint64((1 << bits) - 1)
    return (one.view(np.uint64) & mask).astype(np.int64), (two.view(np.uint64) & mask).astype(np.int64) + (1 << bits)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist())


def screen(prefixes: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """Bits of a count-min row, and one bit per cell: does it count two or more?

    Every task counts into its own two rows of cells, up to two, and sends the
    parts of them that are not empty. Parts of one place are added while they
    stream by. A row has four cells per prefix, 2**26 at most; beyond that the
    estimates grow weaker, and more prefixes are grouped exactly than need be.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (CELLS_A_ROW * rows).bit_length()))
    names = ["chunk", "cells"]

    def record(items: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        packed = [zlib.compress(cells.tobytes(), 1) for _, cells in items]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in items], pa.int32()), pa.array(packed, pa.binary())], names=names)

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            one, two = (batch.column(n).to_numpy() for n in ("p1", "p2"))
            for cells in _cells(bits, one, two):
                cells, times = np.unique(cells, return_counts=True)
                at, begin = np.unique(cells // CHUNK, return_index=True)
                for chunk, lo, hi in zip(at.tolist(), begin, [*begin[1:], len(cells)]):
                    part = held.setdefault(chunk, np.zeros(CHUNK, dtype=np.uint8))
                    inside = cells[lo:hi] % CHUNK
                    part[inside] = np.minimum(part[inside] + np.minimum(times[lo:hi], 2), 2)
        for chunk in sorted(held):
            yield record([(chunk, held[chunk])])

    def add(batches):
        last, total = None, None
        for chunk, packed in _grouped(batches):
            cells = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            if chunk != last:
                if last is not None:
                    yield record([(last, total)])
                last, total = chunk, np.zeros(CHUNK, dtype=np.uint8)
            total = np.minimum(total + cells, 2)
        if last is not None:
            yield record([(last, total)])

    schema = "chunk int, cells binary"
    parts = prefixes.where("depth > 0").select("p1", "p2").mapInArrow(count, schema)
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, schema)
    shared = np.zeros(2 << bits, dtype=bool)
    for chunk, packed in _grouped(merged.toArrow().to_batches()):  # at most 2**27 cells
        shared[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8) > 1
    return bits, np.packbits(shared, bitorder="little")


def mark(prefixes: DataFrame, bits: int, shared: np.ndarray) -> DataFrame:
    """Add ``kind``: 0 possibly shared, 1 surely single after one that may be shared, 2 surely single after such a one.

    A prefix below a single one is single too, yet its own estimate may say two: it is then grouped, to a group of one.
    """
    bitmap = prefixes.sparkSession.sparkContext.broadcast(shared)

    def crowded(one: np.ndarray, two: np.ndarray, depth: np.ndarray) -> np.ndarray:
        table, found = bitmap.value, depth <= 0
        hits = [(table[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 for cells in _cells(bits, one, two)]
        return found | ((hits[0] & hits[1]) == 1)

    def run(batches):
        for batch in batches:
            p1, p2, q1, q2, depth = (batch.column(n).to_numpy() for n in ("p1", "p2", "q1", "q2", "depth"))
            own = ~crowded(p1, p2, depth)
            kind = own.astype(np.int32) + (own & ~crowded(q1, q2, depth - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.int32())], names=[*batch.schema.names, "kind"])

    return prefixes.mapInArrow(run, StructType([*prefixes.schema, *StructType.fromDDL("kind int")]))


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256): digest of the ids that end in a node, in ascending order.

    ``ends`` has (p1, p2, depth, c). Nodes and ids are sorted in ranges, so a
    node with very many ids lies in several tasks. What is whole within a
    task is digested there; the first and last node of a task may go on in its
    neighbours and are sent on as lines of some hundred ids, which one task
    per node reads in order, one at a time.
    """
    schema = "p1 long, p2 long, depth long, first long, ids string, digest string"
    names = ["p1", "p2", "depth", "first", "ids", "digest"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def runs(batches) -> Iterator[tuple[tuple, list[int]]]:
        """Nodes with some of their ids, in order."""
        node, held = None, []
        for batch in batches:
            for p1, p2, depth, c in zip(*(batch.column(n).to_pylist() for n in ("p1", "p2", "depth", "c"))):
                if node != (p1, p2, depth) or len(held) == IDS_A_CHUNK:
                    if node is not None:
                        yield node, held
                    node, held = (p1, p2, depth), []
                held.append(c)
        if node is not None:
            yield node, held

    def digest(batches):
        place, node, single, out = -1, None, None, []
        for found, ids in runs(batches):
            line = (*found, ids[0], ",".join(map(str, ids)), None)
            if found != node:
                if single is not None:
                    out.append((*single[:4], None, hashlib.sha256(single[4].encode()).hexdigest()) if place > 0 else single)
                place, node, single = place + 1, found, line
            else:
                out.extend(x for x in (single, line) if x is not None)
                single = None
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if single is not None:  # the last node here
            out.append(single)
        if out:
            yield batch_of(out)

    def finish(batches):
        node, sha, out = None, None, []
        for batch in batches:
            for p1, p2, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("p1", "p2", "depth", "ids"))):
                if node == (p1, p2, depth):
                    sha.update(b",")
                else:
                    if node is not None:
                        out.append((*node, None, None, sha.hexdigest()))
                    node, sha = (p1, p2, depth), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield batch_of(out)
                out = []
        if node is not None:
            yield batch_of([(*node, None, None, sha.hexdigest())])

    placed = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
    lines = cut(placed.mapInArrow(digest, schema))
    rest = lines.where("digest is null").repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(finish, schema)
    return lines.where("digest is not null").union(rest).select(*NODE, F.col("digest").alias("ends_sha256"))


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Turns are in order of
    ``turn`` (null first; equal ones by digests of role and text, so repeated
    rows are turns of their own). Null roles and texts are empty; rows without
    a conversation are left out; an empty table has no root. Conversations and
    texts may have any length; other columns are not read.

    Only prefixes that the sketch cannot prove single are shuffled, as
    digests. Sums over subtrees need no levels: a node's words and a leaf
    count at its smallest member, a conversation adds what lies at or below
    each of its prefixes, and a node adds that up over its members.
    """
    numbered = cut(numbered_turns(rows, conv, turn, role, text))
    prefixes = cut(prefix_rows(*rebuilt_conversations(numbered)))
    facts = prefixes.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("top")).first()
    marked = cut(mark(prefixes, *screen(prefixes, facts["n"])))
    maybe = marked.where("kind = 0")
    alone = F.col("size") == F.col("depth")
    grouped = maybe.groupBy(*NODE).agg(
        F.min("c").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.max("q1").alias("q1"), F.max("q2").alias("q2")
    )
    grouped = cut(grouped)
    tops = marked.where("kind = 1")
    parent = [F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")]
    below = grouped.where("depth > 0").select(*parent).union(tops.select(*parent)).groupBy(*NODE).agg(F.count(F.lit(1)).alias("children"))
    nodes = cut(grouped.join(below, NODE, "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    none = F.lit(None).cast("long")
    gain = (F.col("n") - 1) * F.col("w")
    terms = nodes.where((gain > 0) | (F.col("children") == 0)).select(
        F.col("rep").alias("c"), "depth", none.alias("p1"), none.alias("p2"), gain.alias("gain"), (F.col("children") == 0).cast("long").alias("leaf")
    )
    # A conversation has one end, in a node of its own or in a grouped one.
    terms = terms.union(marked.where((F.col("kind") > 0) & alone).select("c", "depth", none, none, zero, one))
    spread = terms.union(maybe.select("c", "depth", "p1", "p2", zero, zero)).withColumn("s", -F.shiftright("depth", SLICE_BITS))
    # Terms come before the prefix of their depth, which counts them.
    running = scan(spread, [F.col("depth").desc(), F.col("p1").asc_nulls_first()], {"saved": F.col("gain"), "leaves": F.col("leaf")}, F.sum)
    sums = running.where("p1 is not null").groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    digests = end_digests(maybe.where(alone))
    whole = nodes.join(sums, NODE).join(digests, NODE, "left")

    columns = ["depth", "q1", "q2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = whole.select(
        "depth", "q1", "q2", F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )

    def tail(found: DataFrame) -> DataFrame:
        end = F.when(alone, F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(EMPTY))
        return found.select(
            "depth", "q1", "q2", F.col("c").alias("conv_id"), one.alias("n_convs"), F.when(alone, zero).otherwise(one).alias("n_children"),
            one.alias("n_leaves"), zero.alias("saved_tokens"), end.alias("ends_sha256"),
        )

    known = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"))
    deep = shared.where("depth > 1").union(tail(tops.where("depth > 1"))).join(known.where("depth > 1"), ["q1", "q2", "depth"], "left")
    deep = deep.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))  # not grouped: single
    # The root, a parent of very many, is one number.
    root = F.when(F.col("depth") == 1, F.lit(facts["top"]).cast("long"))
    flat = shared.where("depth <= 1").union(tail(tops.where("depth = 1"))).withColumn("parent_conv_id", root)
    inner = tail(marked.where("kind = 2")).withColumn("parent_conv_id", F.col("conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", *columns[4:]]
    return deep.select(*out).union(flat.select(*out)).union(inner.select(*out))


def trie_sql() -> str:
    """The query on ``conversations`` for a SQL engine, with the checksum spelled out."""
    steps = "flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: {shift}), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS turns, {crc} % {HEADS} AS h FROM t GROUP BY conv_id),
r AS (SELECT k.conv_id AS c, list_concat(list_slice(coalesce(b.turns, []), 1, k.h), list_slice(k.turns, k.h + 1, len(k.turns))) AS turns
    FROM k LEFT JOIN k AS b ON b.conv_id = k.conv_id - k.conv_id % {FAMILY}),
p AS (SELECT c, d, list_slice(turns, 1, d) AS pre, d = len(turns) AS ends FROM r, LATERAL unnest(range(0, len(turns) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(coalesce(pre[d].t, ''), '{WORD}')) AS gain,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY pre, d),
q AS (SELECT a.pre, count(b.pre) AS n_children FROM n AS a LEFT JOIN n AS b ON b.d = a.d + 1 AND list_slice(b.pre, 1, a.d) = a.pre GROUP BY a.pre),
s AS (SELECT a.pre, sum(b.gain)::BIGINT AS saved_tokens, count(*) FILTER (WHERE z.n_children = 0) AS n_leaves
    FROM n AS a JOIN n AS b ON b.d >= a.d AND list_slice(b.pre, 1, a.d) = a.pre JOIN q AS z ON z.pre = b.pre GROUP BY a.pre)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, q.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN q ON q.pre = n.pre JOIN s ON s.pre = n.pre LEFT JOIN n AS m ON m.d = n.d - 1 AND m.pre = list_slice(n.pre, 1, n.d - 1)"""
