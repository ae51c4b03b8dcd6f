"""Discovery of unseen identifiers among the test table's documents: how many planted ones are found, and what else is."""

import os

import pyarrow.parquet as pq
import pytest

from keelson.llm import personal

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def planted(text, inner):
    """The text with something in the middle, between words."""
    words = (text or "").split(" ")
    k = len(words) // 2
    return " ".join([*words[:k], inner, *words[k:]])


def test_planted_identifiers_are_found_and_little_else(spark):
    """Seeds teach two contexts; identifiers of another form are found there, and strings of a third form in a third context aren't."""
    if not os.path.exists(DOCUMENTS):
        pytest.skip("no test tables")
    texts = [t or "" for t in pq.read_table(DOCUMENTS, columns=["text"]).column("text").to_pylist()]
    kinds, codes = {}, {}
    for i in range(0, 900, 3):
        kind = ("seed", "unseen", "decoy")[0 if i % 2 else 1 + (i // 6) % 2]
        kinds[i] = kind
        code = f"build{10_000 + i}.{i % 89}z" if kind == "decoy" else f"member-{7000 + i}-x{i % 89}"
        codes[i] = code
        context = ("reach me at {} any day", "written by {} for us")[i // 12 % 2]
        inner = {"seed": context.format(f"user{i}@mail{i % 17}.example.org"), "unseen": context.format(code), "decoy": f"built from {code} last"}[kind]
        texts[i] = planted(texts[i], inner)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    redacted = {r["doc_id"]: r["text"] for r in personal.redact(frame).collect()}
    gone = {i: codes[i] not in redacted[i] for i, k in kinds.items() if k != "seed"}
    unseen, decoys = ([i for i in gone if kinds[i] == k] for k in ("unseen", "decoy"))
    assert len(unseen) > 60 and len(decoys) > 60
    assert sum(gone[i] for i in unseen) >= 0.95 * len(unseen)
    assert sum(gone[i] for i in decoys) <= 0.02 * len(decoys)
    others = sum(redacted[i].count("[ID]") for i in range(len(texts)) if i not in kinds)
    assert others <= 10  # numbers of the seeds' own shape
    assert all(f"user{i}@mail" not in redacted[i] for i, k in kinds.items() if k == "seed")
