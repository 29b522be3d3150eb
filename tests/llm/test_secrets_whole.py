"""Secret scan on texts that a shortcut skipped."""

import hashlib

from pulsegrid.llm import credentials


def test_hexadecimal_without_digit_and_a(spark):
    texts = ["id " + "f" * 24, "id " + "bcdef" * 6, "id " + "f" * 23, "g" * 30, None]
    got = {r.doc_id: r for r in credentials.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = ["hex:3:27", "hex:3:33", "", "", ""]
    assert [got[i].n_hex for i in range(5)] == [1, 1, 0, 0, 0]
    assert [got[i].spans for i in range(5)] == want
    assert [got[i].base_sha256 for i in range(5)] == [hashlib.sha256(w.encode()).hexdigest() for w in want]
