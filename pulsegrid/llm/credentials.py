"""Secret scan that links the parts of multipart credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.rows import add_columns

# The base patterns. The group of `assign` is the assigned value.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Parts that count only together with others.
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "weak")
SHORTEST, ENTROPY, REACH = 6, 3.0, 200


def entropy(text: str) -> float:
    """Bits per character of a token."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the assigned, access and hexadecimal spans, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= SHORTEST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that are reported only beside complementary parts."""
    found = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)]
    taken = base + found
    for m in OPAQUE.finditer(text):
        if entropy(m[0]) >= ENTROPY and not any(s < m.end() and m.start() < e for s, _, e in taken):
            found.append((m.start(), 5, m.end()))
    return found


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text with its base counts and digest, and its parts in scopes.

    A scope is a paragraph, the text between blank lines; its number goes with
    every part. Texts without any part keep one row; null texts are empty.
    ``rid`` identifies a row by its key and text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keep = {"rid": F.xxhash64(F.col(key), body), "doc_id": F.col(key)}
    blank = re.compile(r"\n[ \t]*\n")

    def parts_of(body: str, base):
        weak = weak_parts(body, base)
        if not weak:
            return [(s, k, e, 0) for s, k, e in base]
        ends, scope, out = [m.start() for m in blank.finditer(body)], 0, []
        for s, k, e in sorted(base + weak):
            while scope < len(ends) and ends[scope] < s:
                scope += 1
            out.append((s, k, e, scope))
        return out

    def run(texts):
        base = [base_spans(t) for t in texts]
        return {
            "n_assign": [sum(k == 0 for _, k, _ in b) for b in base],
            "n_access": [sum(k == 1 for _, k, _ in b) for b in base],
            "n_hex": [sum(k == 2 for _, k, _ in b) for b in base],
            "base_sha256": [hashlib.sha256(spell(b).encode()).hexdigest() for b in base],
            "parts": [[{"start": s, "kind": k, "end": e, "scope": c} for s, k, e, c in parts_of(t, b)] for t, b in zip(texts, base)],
        }

    schema = (
        "n_assign long, n_access long, n_hex long, base_sha256 string, "
        "parts array<struct<start:long,kind:int,end:long,scope:int>>"
    )
    return add_columns(docs, body, keep, schema, run)


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Keep base parts, and weak ones whose complement is within ``reach`` of them.

    ``parts`` has (rid, scope, start, end, kind). Parts of a scope meet when
    their intervals, widened by ``reach``, overlap: the largest end before and
    the smallest start after a part decide, so a scope is sorted once and no
    pair is formed. An identifier needs a secret (assigned, hexadecimal or
    opaque), an opaque token needs an identifier or access id, an endpoint
    needs one of each.
    """
    earlier = Window.partitionBy("rid", "scope").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("rid", "scope").orderBy("start", "kind", "end").rowsBetween(1, Window.unboundedFollowing)
    names = F.col("kind").isin(1, 3)
    secret = F.col("kind").isin(0, 2, 5)

    def near(kinds):
        before = F.max(F.when(kinds, F.col("end"))).over(earlier) >= F.col("start") - reach
        after = F.min(F.when(kinds, F.col("start"))).over(later) <= F.col("end") + reach
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    marked = parts.withColumns({"_named": near(names), "_secret": near(secret)})
    kind = F.col("kind")
    held = (kind < 3) | ((kind == 3) & F.col("_secret")) | ((kind == 4) & F.col("_named") & F.col("_secret")) | ((kind == 5) & F.col("_named"))
    return marked.withColumn("reported", F.coalesce(held, F.lit(False))).drop("_named", "_secret")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Base counts, the digest of the base spans and all reported spans of every text.

    Spans are ``kind:start:end`` in code points, by start and then kind. Null
    and empty texts have none; repeated rows give repeated results.
    """
    found = scan(docs, key, text)
    head = [c for c in found.columns if c not in ("rid", "parts")]
    parts = found.select(
        "rid", *head, F.posexplode_outer("parts").alias("place", "part")
    ).select("rid", *head, (F.coalesce("place", F.lit(0)) == 0).alias("first"), "part.*")
    dealt = parts.repartition("rid")
    marked = link(dealt, reach)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    label = F.concat_ws(":", F.element_at(kinds, F.col("kind") + 1), F.col("start"), F.col("end"))
    span = F.when(F.col("reported"), F.struct("start", "kind", "end", label.alias("label")))
    whole = marked.groupBy("rid", *head).agg(
        F.sum(F.col("first").cast("int")).alias("copies"), F.array_sort(F.collect_set(span)).alias("spans")
    )
    return whole.select(
        F.col("doc_id").alias(key), *head[1:], F.array_join(F.col("spans.label"), ",").alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
