"""Best-fit packing of tokenised documents by exact complements."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.session import cut

CAPACITY = 4096
END = 1
WORDS, CORES, LONGEST = 300_000, 500_000, 64
SLICE_ROWS = 5_000
_WORDS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


def default_vocabulary() -> str:
    """Path of the public word-end vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for later code points."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Recent(dict):
    """Values made on demand and kept while they are used.

    Two generations of at most ``most`` entries: when the young one is full it
    becomes the old one, and what is asked for again comes back from there.
    Keys above ``LONGEST`` characters are not kept.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
            if len(key) > LONGEST:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordTokenizer:
    """Token ids of whole texts, remembered word by word.

    White space separates words before any merge in this vocabulary, so the
    ids of a text are those of its words in a row. A word of plain letters,
    with or without a closing mark, needs no more than lower case before the
    merges; any other word goes through the whole tokenizer. Ids are kept as
    16-bit numbers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("more than 65,536 ids")
        self.model = self.tokenizer.model
        self.alphabet = _byte_letters()
        self.words = Recent(self._word, WORDS)
        self.cores = Recent(self._core, CORES)
        self.marks = {m: self._core(m) for m in ".,;:!?"}

    def _core(self, core: str) -> bytes:
        spelled = core if core.isascii() else core.encode().decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        low, cores = word.lower(), self.cores
        if low in cores:
            return dict.__getitem__(cores, low)
        mark = self.marks.get(low[-1])
        if mark and low[:-1] in cores:
            return dict.__getitem__(cores, low[:-1]) + mark
        simple = _SIMPLE.fullmatch(word)
        if simple is None:
            return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        core = cores[simple[1].lower()]
        return core + mark if simple[2] else core

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        # Unlike the vocabulary's white space, that of split() has four control signs.
        words = text.split() if _CONTROLS.search(text) is None else _WORDS.findall(text)
        narrow = b"".join(map(self.words.__getitem__, words))
        return np.frombuffer(narrow, dtype=np.uint16).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so words stay known from task to task."""
    return WordTokenizer(path)


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, ids.

    A document is its ids and the end id; a null text is empty, so it is the
    end id alone. Documents above ``capacity`` are cut into full pieces and a
    last, shorter one. ``ids`` holds little-endian 32-bit ids; select it away
    where only lengths are needed. Repeated rows give repeated pieces.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}

    def run(batches):
        tool = _tokenizer(vocabulary or default_vocabulary())
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part_ = batch.slice(at, 256)
                home, out = [], defaultdict(list)
                for row, text_ in enumerate(part_.column("_text").to_pylist()):
                    whole = tool.encode(text_) + end
                    for piece, start in enumerate(range(0, len(whole) // 4, capacity)):
                        ids = whole[4 * start : 4 * (start + capacity)]
                        home.append(row)
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(len(ids) // 4)
                        out["ids_crc32"].append(zlib.crc32(ids))
                        out["ids"].append(ids)
                names = part_.column("_key").take(pa.array(home, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([names] + [pa.array(out[n], type=k) for n, k in kinds.items()], names=["_key", *kinds])

    fields = StructType([rows.schema["_key"], *StructType.fromDDL("piece int, start long, length long, ids_crc32 long, ids binary")])
    return rows.mapInArrow(run, fields).withColumnRenamed("_key", key)


@dataclass(frozen=True)
class Slots:
    """Places for pieces by length: sorted by length, then by the first rank they take."""

    length: np.ndarray
    first: np.ndarray
    run: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def _pair(bits: int, total: int, counts: list[int], most: int, flipped: int, width: int) -> tuple[int, int] | None:
    """Largest a <= most with an available b = total - a, b <= a."""
    # Bit a of `mirror` is bit total - a of `bits`.
    mirror = flipped >> (width - total) if total <= width else 0
    low = (total + 1) // 2
    both = bits & mirror & ((1 << (min(most, total - 1) + 1)) - 1)
    both = both >> low << low
    while both:
        a = both.bit_length() - 1
        if 2 * a != total or counts[a] >= 2:
            return a, total - a
        both ^= 1 << a
    return None


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Recipes ([(length, how often)], number of sequences) that use up all counts.

    The largest length first: its gap is closed exactly by one length, by a
    pair or by a triple of available lengths, as often as all of them last.
    Available lengths are bits of one integer, so a sum is looked up by
    shifting its mirror image. What finds no exact complement is placed by
    best fit, longest first, bins of equal gap being handled together. The
    work depends on the number of lengths, not on the number of pieces.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left[length] += n
    recipes: list[tuple[list[tuple[int, int]], int]] = []
    bits = sum(1 << i for i in range(1, capacity + 1) if left[i])
    flipped = sum(1 << (capacity - i) for i in range(1, capacity + 1) if left[i])

    def take(parts: list[int]) -> None:
        nonlocal bits, flipped
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        times = min(left[p] // n for p, n in need.items())
        recipes.append((sorted(need.items(), reverse=True), times))
        for p, n in need.items():
            left[p] -= n * times
            if not left[p]:
                bits &= ~(1 << p)
                flipped &= ~(1 << (capacity - p))

    if left[capacity]:
        take([capacity])
    open_: dict[int, list] = defaultdict(list)  # gap -> [(parts, bins)]
    for big in range(capacity - 1, 0, -1):
        gap = capacity - big
        while left[big]:
            left[big] -= 1  # its own piece is not available to fill its gap
            if not left[big]:
                bits &= ~(1 << big)
                flipped &= ~(1 << (capacity - big))
            found = None
            if gap <= big and left[gap]:
                found = [gap]
            elif pair := _pair(bits, gap, left, big, flipped, capacity):
                found = list(pair)
            else:
                rest = bits & ((1 << min(big + 1, gap)) - 1)
                while rest and found is None:
                    a = rest.bit_length() - 1
                    rest ^= 1 << a
                    if 3 * a < gap:
                        break
                    left[a] -= 1
                    gone = 0 if left[a] else 1
                    pair = _pair(bits & ~(gone << a), gap - a, left, a, flipped & ~(gone << (capacity - a)), capacity)
                    left[a] += 1
                    if pair:
                        found = [a, *pair]
            left[big] += 1
            bits |= 1 << big
            flipped |= 1 << (capacity - big)
            if found is None:
                break
            take([big, *found])
    for length in range(capacity, 0, -1):
        n = left[length]
        while n:
            gap = min((g for g, bins in open_.items() if g >= length and bins), default=None)
            parts, bins = open_[gap].pop() if gap is not None else ([], n)
            room = capacity if gap is None else gap
            each = min(room // length, n)
            used = min(bins, n // each)
            if gap is not None and used < bins:
                open_[gap].append((parts, bins - used))
            open_[room - each * length].append(([*parts, (length, each)], used))
            n -= used * each
        for gap in [g for g, bins in open_.items() if not bins]:
            del open_[gap]
    for groups in open_.values():
        recipes.extend((parts, bins) for parts, bins in groups)
    return recipes


def slots_of(recipes: list[tuple[list[tuple[int, int]], int]]) -> Slots:
    """Lay the recipes out: consecutive sequence numbers, ranks per length, offsets without gaps."""
    rows, taken, sequence = [], defaultdict(int), 0
    for parts, bins in recipes:
        offset = 0
        for length, n in parts:
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += n * bins
            offset += n * length
        sequence += bins
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return Slots(*columns, sequences=sequence)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece, given its ``length``.

    Pieces are counted by length (at most ``capacity`` counts reach the
    driver), planned, and numbered within their length: rows are dealt to
    slices of about 5,000 by a hash, slice counts give the first number of a
    slice, so a common length is numbered by many tasks. The number finds its
    place in the broadcast plan, whose size depends on the number of lengths
    alone. ``pieces`` is read twice and must not change in between.
    """
    spark = pieces.sparkSession
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    slots = spark.sparkContext.broadcast(slots_of(plan_sequences(counts, capacity)))
    lanes = max(1, -(-max(counts.values(), default=1) // SLICE_ROWS))
    names = pieces.columns
    dealt = pieces.withColumn("_lane", F.pmod(F.xxhash64(*names), F.lit(lanes)))
    ahead = Window.partitionBy("length").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "_lane").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "_lane", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    )
    order = Window.partitionBy("length", "_lane").orderBy(*names)
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - 1).join(starts, ["length", "_lane"])
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_ahead")).cast("long").alias("_rank"))

    fields = [f for f in ranked.schema if f.name != "_rank"]

    def run(batches):
        plan = slots.value
        lengths, counted = np.unique(plan.length, return_counts=True)
        begin = np.concatenate(([0], np.cumsum(counted)))
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            length = batch.column("length").to_numpy()
            at = np.zeros(len(rank), dtype=np.int64)
            group = np.searchsorted(lengths, length)
            for g in np.unique(group):
                own = group == g
                at[own] = begin[g] + np.searchsorted(plan.first[begin[g] : begin[g + 1]], rank[own], side="right") - 1
            inside = rank - plan.first[at]
            sequence = plan.sequence[at] + inside // plan.run[at]
            offset = plan.offset[at] + inside % plan.run[at] * length
            arrays = [batch.column(f.name) for f in fields] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields] + ["sequence_id", "offset"])

    return ranked.mapInArrow(run, StructType(fields + list(StructType.fromDDL("sequence_id long, offset long"))))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenise all documents and place every piece; an empty table gives no rows."""
    pieces = cut(tokenise(docs, key, text, capacity, vocabulary).drop("ids"))
    return place(pieces, capacity)


def sequences(docs: DataFrame, placed: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(sequence_id, ids): the token ids of every packed sequence, as 32-bit little-endian bytes."""
    found = tokenise(docs, key, text, capacity, vocabulary).select(F.col(key).alias("_key"), "piece", "ids_crc32", "ids").dropDuplicates(["_key", "piece", "ids_crc32"])
    rows = placed.select(F.col(key).alias("_key"), "piece", "ids_crc32", "sequence_id", "offset")
    same = rows["_key"].eqNullSafe(found["_key"]) & (rows["piece"] == found["piece"]) & (rows["ids_crc32"] == found["ids_crc32"])
    joined = rows.join(found, same).select("sequence_id", "offset", "ids")
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.array_join(F.transform(in_order, lambda x: F.hex(x["ids"])), "").alias("hex")).select(
        "sequence_id", F.unhex("hex").alias("ids")
    )
