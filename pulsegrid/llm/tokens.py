"""Token counts: a broadcast table of frequent pre-token lengths, worker caches for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.rows import add_columns
from pulsegrid.session import cut

LIMIT = 4096
ENTRIES = 1 << 16
FAN_IN = 32
CACHE, LONGEST = 500_000, 64
LONG_TEXT = 1 << 20
SPACE = "▁"
_PARTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
_PROBE = "ﬁ ①  Ａ́ é　x\tY"


def default_vocabulary() -> str:
    """Path of the public piece vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTokenizer:
    """A piece model and its pre-tokens: parts of a text that no merge crosses.

    White space becomes a mark at the head of a word. Where no piece has the
    mark after another sign and none holds a line end, merges stay within a
    run of marks with the word behind it, so the tokens of a text are those of
    its parts. This is read from the vocabulary; for any other vocabulary, or
    one that rewrites characters, the whole text is the only part.

    A part is written as the word alone if one mark stands before it, with
    all its marks if there are several, and after two line ends if it follows
    a line end, which belongs to it then.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        if not path.endswith(".model"):
            raise ValueError("token counts need a sentencepiece .model file")
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_byte(i)]
        crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.divisible = not crossing and self.model.normalize(_PROBE) == SPACE + _PROBE.replace(" ", SPACE)
        self.mark = len(self.model.encode("\n")) - len(self.model.encode("\n\n")) + len(self.model.encode("\n"))

    def parts(self, text: str) -> Iterable[str]:
        """Pre-tokens of a text; those of a very long text come one by one."""
        if not text:
            return ()
        if not self.divisible:
            return (text,)
        if len(text) > LONG_TEXT or "  " in text or SPACE in text or text[0] == " ":
            found = (m[0] for m in _PARTS.finditer(SPACE + text.replace(" ", SPACE)))
            return ("\n" + p if p[0] == "\n" else p if p[1:2] == SPACE else p[1:] for p in found)
        return text.replace("\n", " \n\n").split(" ")

    def counts(self, parts: list[str]) -> list[int]:
        """Tokens of every pre-token at its place in a text."""
        if not self.divisible:
            return [len(x) for x in self.model.encode(parts, num_threads=1)]
        # The library puts one mark before what it encodes.
        bare = [p[1:] if p[:1] in ("\n", SPACE) else p for p in parts]
        sizes = [len(x) for x in self.model.encode(bare, num_threads=1)]
        return [self.mark if not p else n - self.mark if p[0] == "\n" else n for p, n in zip(parts, sizes)]


@lru_cache(maxsize=2)
def _tool(path: str) -> PieceTokenizer:
    """One per worker process."""
    return PieceTokenizer(path)


class LengthTable(dict):
    """Pre-token -> number of tokens; what it lacks is encoded and kept in the worker's cache.

    It travels as one block of text bytes, offsets and 16-bit lengths, and is
    hashed when a worker first reads it. The cache holds at most ``CACHE``
    short pre-tokens and starts anew when full.
    """

    def __init__(self, path: str, words: list[str], lengths: list[int]):
        super().__init__(zip(words, lengths))
        self.path, self.late = path, {}

    def __reduce__(self):
        return _load, (self.path, pa.array(self.keys(), pa.string()), np.fromiter(self.values(), dtype=np.uint16))

    def learn(self, parts: Iterable[str]) -> None:
        """Encode what neither tier knows, all at once."""
        rare = [p for p in parts if p not in self]
        if len(self.late) + len(rare) > CACHE:
            self.late.clear()
        new = [p for p in rare if p not in self.late]
        self.late.update(zip(new, _tool(self.path).counts(new)))

    def __missing__(self, part: str) -> int:
        n = self.late.get(part)
        return _tool(self.path).counts([part])[0] if n is None else n

    def totals(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of every text; very long ones are read part by part."""
        tool = _tool(self.path)
        parts = [tool.parts(t or "") for t in texts]
        self.learn({p for found in parts if isinstance(found, list) for p in found if len(p) <= LONGEST})
        return [sum(map(self.__getitem__, found)) for found in parts]


def _load(path: str, words: pa.Array, lengths: np.ndarray) -> LengthTable:
    return LengthTable(path, words.to_pylist(), lengths.tolist())


def lighten(counts: dict[str, int], most: int) -> dict[str, int]:
    """At most ``most`` entries: the count that follows them is taken off all, and what is left of none goes.

    Counts so lowered can be added up again; a word above 1/``most`` of all
    occurrences is never lost.
    """
    if len(counts) <= most:
        return counts
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    off = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
    return {w: n - off for w, n in counts.items() if n > off}


def frequent_parts(docs: DataFrame, text: str, path: str, entries: int = ENTRIES) -> list[str]:
    """The most frequent pre-tokens of all texts, heaviest first.

    Every task counts its own texts in a summary of ``entries`` words, and
    summaries are merged ``FAN_IN`` at a time. Pre-tokens themselves are never
    shuffled and no task holds more than ``FAN_IN`` summaries. The result only
    decides what is looked up first, never a count.
    """

    def summarise(batches: Iterator[pa.RecordBatch]):
        tool, held = _tool(path), Counter()
        for batch in batches:
            for body in batch.column(0):
                held.update(p for p in tool.parts(body.as_py() or "") if len(p) <= LONGEST)
                if len(held) > 4 * entries:
                    held = Counter(lighten(held, entries))
        yield pack(TaskContext.get().partitionId(), lighten(held, entries))

    def pack(task: int, counts: Mapping[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int32()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))],
            names=["task", "words", "counts"],
        )

    def merge(group: pa.Table) -> pa.Table:
        held = Counter()
        for words, counts in zip(group["words"], group["counts"]):
            for word, n in zip(words.as_py(), counts.as_py()):
                held[word] += n
        return pa.Table.from_batches([pack(group["task"][0].as_py(), lighten(held, entries))])

    schema = "task int, words array<string>, counts array<bigint>"
    found = cut(docs.select(F.col(text).alias("text")).mapInArrow(summarise, schema))
    left = (found.agg(F.max("task")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN_IN)
        found = found.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("task").applyInArrow(merge, schema)
    total = Counter()
    for row in found.collect():  # one summary
        total.update(dict(zip(row["words"], row["counts"])))
    return [w for w, _ in total.most_common(entries)]


def count_tokens(
    docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None, limit: int = LIMIT,
    vocabulary: str | None = None, entries: int = ENTRIES,
) -> DataFrame:
    """The ``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``) of every text.

    The count is that of the library for the whole text without begin and end
    tokens; names of special tokens inside a text are ordinary text. A null
    text is empty: 0 bytes, 0 tokens. Texts of any length are read whole,
    repeated rows each get their row, an empty table gives none, and columns
    not in ``keep`` are left out whatever their names. ``docs`` is read twice.
    """
    path = vocabulary or default_vocabulary()
    tool = _tool(path)
    words = frequent_parts(docs, text, path, entries)
    shared = docs.sparkSession.sparkContext.broadcast(LengthTable(path, words, tool.counts(words)))

    def work(texts):
        return {"n_tokens": shared.value.totals(texts)}

    keep = {"doc_id": F.col("doc_id")} if keep is None else dict(keep)
    body = F.coalesce(F.col(text), F.lit(""))
    size = {"n_bytes": F.octet_length(body).cast("long")}
    out = add_columns(docs, body, {**keep, **size}, "n_tokens long", work)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
