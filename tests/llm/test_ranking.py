"""Ranked lexical search against adding everything up, one document after the other."""

import math
import random
import re
from collections import Counter

import pytest

from keelson.llm import ranking

DOCS = "doc_id long, text string, item_id long, shard long, n int, terms string, score double, rank int"
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return _TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def by_brute_force(documents, items, k=20):
    """Sets of (item, text) with the k best scores, and those of the documents."""
    found = [(d, terms(t)) for d, t in documents]
    found = [(d, Counter(w), len(w)) for d, w in found if w]
    n, total = len(found), sum(x for _, _, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in set(items):
        rows = []
        for doc_id, counts, size in found:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def frames(spark, documents, items):
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "t", 0.5, 4) for d, t in documents], DOCS)
    return docs, spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id long, bundle string")


def got(spark, documents, items, **more):
    docs, asked = frames(spark, documents, items)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranking.search(docs.repartition(3), asked, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "of", "The", "ÄÖ", "äö", "naïve", "x1", "42", "漢字", "rare", "  ", "don't"] + [f"w{i}" for i in range(60)]
    weights = [60, 50, 20, 5, 5, 5, 5, 5, 3, 1, 2, 4] + [2] * 60
    text = lambda n: rng.choice([" ", "\n", ", ", "-"]).join(rng.choices(vocabulary, weights, k=n))
    documents = [(i, text(rng.randint(1, 60))) for i in range(150)]
    documents += [(500 + i, documents[3][1]) for i in range(30)] + [(700, None), (701, ""), (702, " .,\x00 "), (None, documents[4][1]), (None, "rare rare"), (5, documents[5][1]), (5, documents[5][1]), (900, "rare " * 20_000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(45)] + [(100, None), (101, ""), (102, "absent"), (3, "the the rare"), (3, "w1"), (7, "W2 w2"), (7, "W2 w2"), (None, "the of")]
    return documents, items


@pytest.mark.parametrize("shard,bundle,owners,k", [(8192, 32, 4, 20), (7, 4, 3, 3), (16, 5, 1, 1), (40, 32, 6, 20)])
def test_search_by_brute_force(spark, corpus, monkeypatch, shard, bundle, owners, k):
    """Small shards drop documents between the stages, and lose none of the best."""
    documents, items = corpus
    monkeypatch.setattr(ranking, "SHARD", shard)
    monkeypatch.setattr(ranking, "BUNDLE", bundle)
    assert got(spark, documents, items, k=k, owners=owners) == by_brute_force(documents, items, k)


def test_blocks_of_items(spark, corpus):
    documents, items = corpus
    assert got(spark, documents, items[:9], block_items=4) == by_brute_force(documents, items[:9])


def test_edges(spark, corpus):
    documents, items = corpus
    assert got(spark, [(1, "a"), (2, "b a"), (3, "A"), (1, "a")], [(0, "a"), (1, "b b")]) == by_brute_force([(1, "a"), (2, "b a"), (3, "A"), (1, "a")], [(0, "a"), (1, "b b")])
    assert got(spark, [(1, None), (2, "")], items[:3]) == []
    assert got(spark, documents[:3], [(1, None)]) == []
    docs, asked = frames(spark, documents, items)
    for a, b in ((docs.limit(0), asked), (docs, asked.limit(0))):
        assert ranking.search(a, b).collect() == []


def test_accumulators_shrink():
    """After the owner of the rare terms few documents can be among the best any more."""
    items = ranking.Items.of([b"rare common"])
    route = ranking.Route(items, 10_000, {0: (30, 2), 1: (9_000, 3)}, 2)
    assert route.weights[0][0] and route.weights[1][0] and route.rest[0][0] < 1000 * 10**6 and route.rest[1][0] == 0
