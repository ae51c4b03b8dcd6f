"""Byte-level BPE: what a task holds, dictionaries that are begun anew, and what the fold and the cutting cost."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from keelson.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture
def documents(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(30)) + "x" * (i % 7 * 60)) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    yield spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents_follow_their_pieces(spark, documents):
    """A task holds a batch of documents: each goes out before the next one's pieces."""
    common = spark.sparkContext.broadcast([" a", " b"])
    rows = bpe._cut(documents, public_tokenizers.PATTERN, common, most_own=1000).collect()
    kinds = "".join("p" if r["pieces"] is not None else "d" if r["doc_ids"] else "e" for r in rows)
    assert kinds.count("d") == 10 and "dpdp" in kinds and "pp" not in kinds
    assert [i for r in rows for i in r["doc_ids"] or []] == list(range(200))
    held = 0
    for r in rows:
        held = held + len(r["pieces"]) if r["pieces"] is not None else held if r["doc_ids"] else 0
        assert held < 2000
    assert kinds.count("e") >= 3


@pytest.mark.parametrize("most_own", [1, 500, bpe.OWN_PIECES])
def test_dictionaries_begun_anew(documents, most_own):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(documents, PATH, documents_read=50, most=100, most_own=most_own).collect()}
    assert got == {r["doc_id"]: library.encode_ordinary(r["text"]) for r in documents.collect()}


def test_fold_finds_places_without_a_search_that_throws(spark):
    """array_position leaves its loop by an exception, which is most of its cost: 125 of 222 stack samples of the fold lay in it."""
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(5)
    pieces = ["", "a", "é", *("a" * n for n in range(2, 257, 23)), *("".join(rng.choice("abAB é日'") for _ in range(rng.randint(1, 80))) for _ in range(300))]
    df = spark.createDataFrame([([p.encode().decode("latin-1") for p in pieces],)], "pieces array<string>").select(bpe.encode_pieces(F.col("pieces"), ranks).alias("ids"))
    assert [list(x) for x in df.first()["ids"]] == [bpe.merge_long(p.encode(), ranks) if p else [] for p in pieces]
    assert "array_position" not in df._jdf.queryExecution().analyzed().toString()


def test_plain_cutting_is_the_patterns():
    """All characters that leave a text plain, alone and in random texts."""
    chars = [c for c in map(chr, range(0x2100)) if not bpe._ODD.search(c)]
    full = regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(7)
    texts = [*chars, *(f"a{c} {c}1" for c in chars), *("".join(rng.choice(rng.choice((chars, "'strevmld ", " \n\t", "ab1 ,_"))) for _ in range(rng.randint(1, 40))) for _ in range(20_000))]
    assert [bpe._PLAIN.findall(x) for x in texts] == [full(x) for x in texts]


@pytest.mark.parametrize("digested", [1, 64, bpe.DIGESTED])
def test_digests_of_documents_put_together(spark, documents, digested):
    """Empty documents between others, batches of empty ones only, and a few documents at a time."""
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    rows = [(r["doc_id"], "" if r["doc_id"] < 40 or r["doc_id"] % 3 == 0 else r["text"]) for r in documents.collect()]
    df = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in bpe.encode_documents(df, PATH, documents_read=50, most=100, keep_ids=False, digested=digested).collect()}
    want = {}
    for doc_id, text in [*rows, (1000, "")]:
        ids = library.encode_ordinary(text)
        want[doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), None)
    assert got == want
