"""The corpus pipeline's rows against plain Python, stage by stage, with columns whose names clash with internal ones."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import regex
import tiktoken

import corpus_pipeline
from keelson.llm import bpe, near_copies, personal, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, d int, g string, more string, seen string, size int, key int, tie string, root int, node int, digest string, copies int, ids string"
EXTRA = (-5.0, 1, "g", "m", "s", 2, 3, "t", 4, 5, "x", 6, "i")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéghilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus():
    """Good texts with personal data, near and exact copies of some, bad texts, and odd ones. doc_id to (text, source)."""
    rng = random.Random(77)
    rows = []
    for i in range(70):
        text = f"{words(rng, rng.randint(20, 60))} mail user{i}@mail{i}.org now {words(rng, 20)}"
        if i % 6 == 0:
            text += f" mail acct-{i:03d}77{i}x now {words(rng, 3)} +1 (212) 555-01{i:02d}, 4111 1111 1111 1111 or 10.0.0.{i}"
        rows.append((text, "abc"[i % 3]))
    rows += [(rows[3][0].encode().upper().decode(), "a"), (rows[4][0] + " end", "b"), (rows[4][0] + " end", "c"), (rows[5][0], None)]
    rows += [("#$% 00 " * rng.randint(8, 30) + words(rng, 2), "b") for _ in range(25)] + [(None, "a"), ("", "c")]
    return {i + 10: r for i, r in enumerate(rows)}


def scores(table, labels):
    """Each text's score, a node at a time."""
    import numpy as np

    known = [(i, q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1 and q is not None]
    forest = quality.fit(np.array([quality.statistics(table[i][0] or "") for i, _ in known]), np.array([float(q) for _, q in known]))
    out = {}
    for i, (text, _) in table.items():
        x, total = quality.statistics(text or ""), forest.base
        for t in range(len(forest.feature)):
            node = 0
            while forest.feature[t][node] >= 0:
                node = forest.left[t][node] if x[forest.feature[t][node]] <= forest.threshold[t][node] else forest.right[t][node]
            total += forest.value[t][node]
        out[i] = 1 / (1 + math.exp(-total))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()  # A to Z only
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def once(table):
    """The least doc_id of each class of similarity 0.8, by all pairs."""
    ids, sets, root = sorted(table), {i: shingles(t) for i, (t, _) in table.items()}, {i: i for i in table}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {x: new if r == old else r for x, r in root.items()}
    return {i: table[i] for i in ids if root[i] == i}


def redacted(table):
    """Base spans by the patterns themselves, and found instances by a graph in dictionaries."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) < 256 for p in s.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and personal.luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    base = {i: sorted((*m.span(), kind) for kind, p, fits in kinds for m in re.finditer(p, t or "") if fits(m[0])) for i, (t, _) in table.items()}
    edges, seeds, places = {}, set(), {}
    for i, (t, _) in table.items():
        taken = sorted((b, e) for b, e, _ in base[i])
        more = personal.candidates(t or "", taken)
        for (b, e), patterns in zip([*taken, *more], personal.contexts(t or "", [*taken, *more]), strict=True):
            for p in patterns:
                edges[t[b:e], p] = edges.get((t[b:e], p), 0) + 1
        seeds |= {t[b:e] for b, e in taken}
        for b, e in more:
            places.setdefault(t[b:e], []).append((i, b, e))
    score = {x: float(x in seeds) for x, _ in edges}
    for _ in range(personal.ROUNDS):
        by = {}
        for (x, p), n in edges.items():
            total, count, support = by.get(p, (0.0, 0, 0))
            by[p] = (total + n * score[x], count + n, support + (score[x] >= personal.THRESHOLD))
        worth = {p: total / (count + personal.SMOOTHING) for p, (total, count, support) in by.items() if support >= personal.SUPPORT}
        score = {x: 1.0 if x in seeds else max([worth[p] for y, p in edges if y == x and p in worth], default=0.0) for x in score}
    found = {x for x, s in score.items() if x not in seeds and s >= personal.THRESHOLD}
    out = {}
    for i, (t, source) in table.items():
        spans = sorted([*base[i], *((b, e, "id") for x in found for j, b, e in places.get(x, []) if j == i)])
        text, at = "", 0
        for b, e, kind in spans:
            if b >= at:
                text += t[at:b] + f"[{kind.upper()}]"
            at = max(at, e)
        out[i] = (None if t is None else text + t[at:], source)
    return out, len(found)


def copies(table):
    """How often each document is taken: shares by weight with the excess reshared, then keys in order."""
    size = {i: len((t or "").split()) for i, (t, _) in table.items()}
    names = sorted({s for _, s in table.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in table if table[i][1] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        goal |= share if not over else {s: 2 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ = open_ - set(over) if over else set()
    out = {}
    for s in names:
        letters = lambda t: len(regex.findall(r"\p{L}", t)) / max(1, len(t))
        draw = lambda i: (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        mine = sorted((-math.log(draw(i)) / (letters(t or "") ** 2 + 0.05), i) for i, (t, x) in table.items() if x == s)
        epochs = math.floor(goal[s] / total[s]) if total[s] else 0
        prefix, budget = 0, goal[s] - epochs * total[s]
        for _, i in mine:
            out[i] = (epochs + (prefix + size[i] / 2 < budget)) * (size[i] > 0)
            prefix += size[i]
    return out


@pytest.fixture
def folder(spark, tmp_path):
    table = corpus()
    rows = [(i, t, "en", s, len(t or ""), *EXTRA) for i, (t, s) in table.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = {i: None if i % 17 == 0 else int(not (t or "#").startswith("#")) for i, (t, _) in table.items()}
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), table, labels


def test_every_stage_by_brute_force(spark, folder):
    where, table, labels = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns

    def after(stage, frame):
        out = stage(spark, frame, where)
        assert out.columns == columns
        rows = out.collect()
        assert all(tuple(r[5:]) == EXTRA for r in rows)
        return out, sorted((r["doc_id"], r["text"], r["source"]) for r in rows)

    listed = lambda t: sorted((i, *r) for i, r in t.items())
    score = scores(table, labels)
    table = {i: r for i, r in table.items() if score[i] >= 0.5}
    docs, rows = after(corpus_pipeline.keep_good, docs)
    assert rows == listed(table) and 60 < len(rows) < 80
    table = once(table)
    docs, rows = after(corpus_pipeline.drop_near_copies, docs)
    assert rows == listed(table) and len(rows) == 70
    table, found = redacted(table)
    docs, rows = after(corpus_pipeline.redact_personal_data, docs)
    assert rows == listed(table) and found >= 10
    assert {r["n_chars"] for r in docs.collect()} == {len(t) for t, _ in table.values()}
    times = copies(table)
    docs, rows = after(corpus_pipeline.mix_sources, docs)
    assert rows == sorted((i, *table[i]) for i, n in times.items() for _ in range(n))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((i, library.encode_ordinary(t)) for i, t, _ in rows)
    assert sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.encode(spark, docs, where).collect()) == want
    assert sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, where).collect()) == want


def test_copies_by_fingerprint_alone(spark):
    """SimHash counts repeats, so texts that differ in rare words have one fingerprint, though half of their shingle sets differ. Links of both kinds make one class."""
    chorus = "one two three four five " * 80
    texts = {1: chorus + "ab cd ef gh", 2: chorus + "ij kl mn op", 3: chorus + "ij kl mn op qr", 4: "some other text of its own", 5: None, 6: ""}
    assert simhash.simhash(texts[1]) == simhash.simhash(texts[2]) and 5 * len(shingles(texts[1]) & shingles(texts[2])) < 4 * len(shingles(texts[1]) | shingles(texts[2]))
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 4, 5]
    found = {r["doc_id"]: r["root"] for r in near_copies.near_duplicates(docs, prints=True).collect()}
    assert found[1] == found[2] == found[3] and found[5] == found[6] and len(set(found.values())) == 3
    by_prints = {r["doc_id"]: r["root"] for r in simhash.near_duplicates(docs).collect()}
    for i in texts:
        for j in texts:
            assert by_prints[i] != by_prints[j] or found[i] == found[j]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
