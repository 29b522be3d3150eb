"""Prefix trie, centroid clustering and token counts on odd rows, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import centroids, tokens, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "c long, p1 long, depth string, kind int, size long, id int, v string, near double, cluster int, n long, task int, words string, `a.b` int"
CLASH = (5, 6, "x", 7, 8, 9, "y", 0.5, 1, 2, 3, "z", 4)


# --- trie ---------------------------------------------------------------------


def brute_trie(rows):
    """Nodes by building every prefix of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        return [node] + [x for child in children[node] for x in below(child)]

    out = {}
    for node, convs in members.items():
        tree = below(node)
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in tree if x)
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out[convs[0], len(node)] = (
            parent, len(convs), len(children[node]), sum(not children[x] for x in tree), saved, hashlib.sha256(ends.encode()).hexdigest()
        )
    return out


def trie_rows(spark, rows, clash=True):
    schema = "conv_id long, turn long, role string, text string"
    if clash:
        return spark.createDataFrame([(*r, *CLASH) for r in rows], f"{schema}, {EXTRA}").repartition(3)
    return spark.createDataFrame(rows, schema).repartition(3)


def check_trie(found, rows):
    got = {}
    for r in found.collect():
        key = (r.conv_id, r.depth)
        assert key not in got
        got[key] = (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
    assert got == brute_trie(rows)


def talk():
    rng = random.Random(3)
    rows = []
    for c in range(0, 130):
        if c in (20, 41, 43):  # a family without its head
            continue
        first = ("user", "Hello there, a common start") if c % 3 else ("user", f"own start {c}")
        body = [first] + [(("assistant", "user")[k % 2], rng.choice(["yes", "no no", "a b c", f"only {c} {k}"])) for k in range(rng.randrange(0, 6))]
        rows += [(c, k, *turn) for k, turn in enumerate(body)]
    for c in range(1000, 1060):  # copies, with heads of their own family
        rows += [(c, k, "user", f"copy {k}") for k in range(5)]
    rows += [(2000, None, None, None), (2000, 3, None, ""), (2000, 3, "user", None), (2001, None, "user", "null turn first"), (2001, -5, "user", "negative")]
    rows += [(2002, 1, "user", "twice"), (2002, 1, "user", "twice"), (2003, 0, "user", "  \n\t "), (None, 0, "user", "no conversation")]
    rows += [(3_000_000_000_000, k, "user", "word " * 2000) for k in range(3)] + [(3_000_000_000_001, k, "user", "word " * 2000) for k in range(2)]
    return rows


def test_trie_against_brute_force(spark):
    rows = talk()
    check_trie(trie.prefix_trie(trie_rows(spark, rows)), rows)


def test_trie_of_nothing(spark):
    empty = trie.prefix_trie(trie_rows(spark, [], clash=False))
    assert empty.count() == 0
    lone = [(None, 0, "user", "x")]
    assert trie.prefix_trie(trie_rows(spark, lone)).count() == 0


def test_trie_where_the_sketch_proves_nothing(spark, monkeypatch):
    """All cells crowded: everything is grouped exactly, with the same result."""
    monkeypatch.setattr(trie, "LEAST_BITS", 2)
    monkeypatch.setattr(trie, "MOST_BITS", 2)
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = talk()
    check_trie(trie.prefix_trie(trie_rows(spark, rows)), rows)


@pytest.mark.parametrize("bits", [5, 7])
def test_trie_where_the_sketch_errs_at_some_depths(spark, monkeypatch, bits):
    monkeypatch.setattr(trie, "LEAST_BITS", bits)
    monkeypatch.setattr(trie, "MOST_BITS", bits)
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = talk()
    check_trie(trie.prefix_trie(trie_rows(spark, rows)), rows)


def test_trie_of_long_conversations_in_slices(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE_BITS", 2)
    rows = [(c, k, "user", f"turn {k}" if c % 2 else f"turn {k} {c}") for c in range(20, 60) for k in range(30 + c % 5)]
    check_trie(trie.prefix_trie(trie_rows(spark, rows)), rows)


def test_ends_of_one_node_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_A_CHUNK", 7)
    ids = list(range(5, 3000, 2))
    rows = [(1, 1, 1, c) for c in ids] + [(2, 2, 1, c) for c in range(30)] + [(3, n, 2, n) for n in range(40)]
    frame = spark.createDataFrame(rows, "p1 long, p2 long, depth long, c long").repartition(5)
    got = {(r.p1, r.p2, r.depth): r.ends_sha256 for r in trie.end_digests(frame).collect()}
    want = defaultdict(list)
    for p1, p2, depth, c in sorted(rows):
        want[p1, p2, depth].append(str(c))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_sketch_never_counts_too_low(spark):
    rng = random.Random(1)
    pool = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(3000)]
    drawn = pool + [pool[i] for i in range(0, 3000, 3)]
    frame = spark.createDataFrame([(1, a, b) for a, b in drawn], "depth long, p1 long, p2 long").repartition(4)
    bits, shared = trie.screen(frame, 200)
    one, two = (np.array([p[i] for p in pool[::3]]) for i in (0, 1))
    for cells in trie._cells(bits, one, two):
        assert ((shared[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all()


# --- centroids ----------------------------------------------------------------


def brute_clusters(rows, k=40, rounds=5):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((key, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    digest = lambda key: hashlib.sha256(f"2:{key}".encode()).hexdigest() if key is not None else "~"
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if groups[i] else c for i, c in enumerate(centres)]
    out = [(key, *nearest(v)[::-1]) for key, v in kept]
    inertia = defaultdict(int)
    for _, c, d in out:
        inertia[c] += d
    total = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((key, c, d, inertia[c], total, names[c]) for key, c, d in out), key=str)


def vectors():
    rng = random.Random(4)
    near = [[rng.gauss(0, 3) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in near[i % 9]]) for i in range(180)]
    rows += [(500 + i, list(near[0])) for i in range(12)] + [(7, rows[7][1])] * 2  # ties and repeated rows
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63]
    return rows + [(900 + i, v) for i, v in enumerate(bad)] + [(None, list(near[1])), (-3, [-50_000.25] * 64)]


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"vec_id long, embedding array<float>, {EXTRA}").repartition(3)


@pytest.mark.parametrize("take", [None, 5])
def test_clusters_against_brute_force(spark, take):
    rows = vectors()[:take]
    found = centroids.cluster_vectors(vector_table(spark, rows))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows)


def test_clusters_of_nothing_and_too_large_components(spark):
    assert centroids.cluster_vectors(vector_table(spark, [(1, [1.0])])).count() == 0
    with pytest.raises(Exception, match="above"):
        centroids.cluster_vectors(vector_table(spark, [(1, [1e9] * 64)])).count()


def test_ptolemaic_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    for spread in (1, 1000, 1 << 26):
        near = rng.integers(-spread, spread + 1, (12, 64))
        x = near[rng.integers(0, 12, 400)] + rng.integers(-1, 2, (400, 64))
        pivots = centroids.spread_pivots(near)
        centres = centroids.Centres.of(near, pivots)
        bounds = centres.lower_bounds(centroids.pivot_distances(x, pivots))
        exact = np.stack([centroids.squared(x, c[None, :]) for c in near], axis=1)
        assert (bounds <= exact).all()
        cluster, distance, computed = centres.assign(x, centroids.pivot_distances(x, pivots))
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        assert spread == 1 or computed < exact.size / 2


def test_equal_pivots_give_no_bounds():
    same = np.ones((3, 64), dtype=np.int64)
    pivots = centroids.spread_pivots(same)
    assert len(pivots) == 1
    cluster, distance, _ = centroids.Centres.of(same, pivots).assign(same, centroids.pivot_distances(same, pivots))
    assert cluster.tolist() == [0, 0, 0] and distance.tolist() == [0, 0, 0]


# --- token counts ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokens.default_vocabulary())


def texts():
    rng = random.Random(6)
    signs = " \n\t▁abthe éü漢字\x00\r　<s>.,1😀ﬁ"
    drawn = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 16))) for _ in range(1500)]
    words = ["the", "token", "Größe", "naïve", "x" * 90, "</s>", "<unk>", "a▁b"]
    long = " ".join(rng.choice(words) for _ in range(300_000))
    return [None, "", " ", "  ", "\n", "\n\n", " \n ", "▁", "a" * 70_000, long, long.replace(" ", "\n  "), *drawn]


def test_token_counts_against_the_library(spark, library):
    rows = [(i if i % 50 else None, t, *CLASH) for i, t in enumerate(texts())] + [(1, "again", *CLASH)] * 2
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(4)
    found = tokens.count_tokens(frame, entries=64)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_token_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(empty).count() == 0


def test_frequent_parts_keep_the_heaviest(spark):
    rows = [(f"often w{i}" if i % 2 else f"often common x{i}",) for i in range(4000)]
    frame = spark.createDataFrame(rows, "text string").repartition(40)
    found = tokens.frequent_parts(frame, "text", tokens.default_vocabulary(), entries=16)
    assert found[:2] == ["often", "common"] and len(found) <= 16


def test_lightened_counts_stay_below_the_true_ones():
    counts = {str(i): i % 7 + 1 for i in range(100)} | {"top": 500}
    light = tokens.lighten(counts, 10)
    assert len(light) <= 10 and max(light, key=light.get) == "top"
    assert all(counts[w] - 7 <= n <= counts[w] for w, n in light.items())


def test_other_vocabularies_are_read_whole(library):
    tool = tokens.PieceTokenizer(tokens.default_vocabulary())
    tool.divisible = False
    assert tool.parts("a  b") == ("a  b",) and tool.counts(["a  b"]) == [len(library.encode("a  b"))]
    with pytest.raises(ValueError):
        tokens.PieceTokenizer("words.json")
