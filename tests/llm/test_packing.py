"""Best-fit packing against the tokenizers library and a packing of one sequence after the other."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keelson.llm import packing

VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string, length int, part int, number long, piece string, n int, alike int"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def one_by_one(counts, size):
    """Fills of the sequences, packed one after the other over single pieces."""
    items, out = sorted(x for x, n in counts.items() for _ in range(n)), []
    while items:
        filled, gap = [], size
        for x in sorted(items, reverse=True):
            if x <= gap:
                filled.append(x)
                gap -= x
        for x in filled:
            items.remove(x)
        sums = [(a + b, a, b) for i, a in enumerate(items) for b in items[i + 1 :] if min(filled) < a + b <= min(filled) + gap]
        if sums:
            best = max(sums, key=lambda s: s[0])
            items.append(min(filled))
            filled.remove(min(filled))
            filled += best[1:]
            for x in best[1:]:
                items.remove(x)
        out.append(sum(filled))
    return sorted(out)


def test_plan_equals_packing_one_by_one():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.choice([10, 20, 64])
        counts = {rng.randint(1, size - 1): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        plan = packing.best_two_fit(counts, size)
        fills = sorted(sum(x * n for x, n in used.items()) for alike, used in plan for _ in range(alike))
        assert fills == one_by_one(counts, size)
        used = Counter()
        for alike, of in plan:
            used.update({x: alike * n for x, n in of.items()})
        assert used == counts


def test_plan_is_no_worse_than_greedy_and_stays_small(monkeypatch):
    rng = random.Random(2)
    counts = {x: rng.randint(1, 10**9) for x in range(1, packing.SIZE)}
    plan = packing.best_two_fit(counts)
    assert len(packing.places(plan)) < 10 * packing.SIZE
    monkeypatch.setattr(packing, "_two", lambda *_: None)
    assert sum(a for a, _ in plan) <= sum(a for a, _ in packing.best_two_fit(counts))


def test_ids_equal_the_library(library):
    rng, ids_of = random.Random(3), packing.encoder(public_tokenizers.path(VOCABULARY))
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "a", "word", "'s", "'ll", "12", "é", "漢字", "🙂", "́", ".", "--", "<|endoftext|>", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(ids_of(text), np.uint32).tolist() == library(text), repr(text)


def held(rows, size, want):
    """Rows cover want (documents as id lists, by doc_id) and fill sequences without a gap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    for doc_id, documents in want.items():
        expected = []
        for ids in documents:
            at, first = 0, (len(ids) - 1) % size + 1
            for piece in range(-(-len(ids) // size)):
                until = first + piece * size
                expected.append((piece, at, until - at, zlib.crc32(np.array(ids[at:until], "<u4").tobytes())))
                at = until
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id]) == sorted(expected)
    assert by_doc.keys() == want.keys()
    return len(by_sequence)


@pytest.mark.parametrize("size", [8, 1024])
def test_pack(spark, library, size):
    rng = random.Random(4)
    texts = [None, "", " ", "x", "x", "word " * 5000, *(" ".join(rng.choice(["the", "cat", "sät", "über", "9"]) for _ in range(rng.randint(0, 40))) for _ in range(60)), *["same text of a copy"] * 40]
    rows = [(None if i in (3, 9) else i // 2 if i > 80 else i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, 1, 2, 3, "p", 4, 5) for r in rows], SCHEMA).repartition(5)
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append([*library(text or ""), packing.END])
    got = packing.pack(frame, public_tokenizers.path(VOCABULARY), size).collect()
    n = held(got, size, want)
    counts = Counter((len(ids) - 1) % size + 1 for documents in want.values() for ids in documents)
    full = counts.pop(size, 0) + sum((len(ids) - 1) // size for documents in want.values() for ids in documents)
    assert n == full + len(one_by_one(counts, size))


def test_pack_edges(spark):
    path = public_tokenizers.path(VOCABULARY)
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).count() == 0
    for text in ("a " * 1023, "a " * 512, "a" * 3):  # about a whole sequence, and a single short piece
        ids = [*np.frombuffer(packing.encoder(path)(text), np.uint32).tolist(), packing.END]
        held(packing.pack(spark.createDataFrame([(1, text, *[None] * 6)], SCHEMA), path).collect(), packing.SIZE, {1: [ids]})


def test_whole_table(spark):
    """Every document of the table, in hardly more sequences than its ids would fill."""
    got = packing.query(spark, "/root/testdata/sf0.01").collect()
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    ids_of = packing.encoder(public_tokenizers.path(VOCABULARY))
    want = defaultdict(list)
    for d in documents:
        want[d["doc_id"]].append([*np.frombuffer(ids_of(d["text"] or ""), np.uint32).tolist(), packing.END])
    n, total = held(got, packing.SIZE, want), sum(len(x) for v in want.values() for x in v)
    assert n <= -(-total // packing.SIZE) + 5
