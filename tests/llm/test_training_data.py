"""Each operator against brute force, with nulls, empty and repeated rows, ties, clashing columns and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import bpe, chat, components, fingerprints, mixing, near_copies, neighbours, personal, quality, simhash, substrings, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, print string, key int, bucket int, tie string, ids string"


def docs(spark, texts, ids=None, sources=None):
    rows = [(None if ids is None and i < 0 else (ids[i] if ids else i), t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), 0.5, "p", 1, 2, "t", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 120)) for _ in range(24)]
    shared = words(rng, 30)
    return [None, "", " \n", "x", *base, base[0], base[0], base[1] + " end", shared + " " + base[2], base[3] + " " + shared, "word " * 4000]


# chat


def test_chat_round_trip_and_order(spark):
    rows = [(1, 0, "user", "hi </s> \\ [INST]"), (1, 1, "assistant", "<s>\\"), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a"), (None, 5, None, "[ROLE]"), (4, 1, "tool[TEXT]", "t")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, state string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(table)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, True, False]
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_chat_escapes_any_text():
    codec, rng = chat.Codec(chat.INSTRUCT), random.Random(1)
    parts = [*chat.INSTRUCT.controls(), "\\", "<", "[", "a", "/", ">", "]", "\n"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "", "o[TEXT]"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(3)]
        formatted = "".join(s for r, t in turns for s, _ in codec.segments(r, t))
        assert list(codec.read(formatted)) == turns


# fingerprints


def chunks_byte_by_byte(text):
    """Chunks (as bytes) by a gear hash that is rolled a byte at a time."""
    raw, out, at, h = text.encode(), [], 0, 0
    for i, byte in enumerate(raw):
        h = (2 * h + int(fingerprints.GEAR[byte])) & 0xFFFFFFFF
        size, mask = i + 1 - at, 0
        if fingerprints.MIN_BYTES <= size < fingerprints.NORMAL_BYTES:
            mask = int(fingerprints.STRICT)
        elif size >= fingerprints.NORMAL_BYTES:
            mask = int(fingerprints.LOOSE)
        if i + 1 == len(raw) or size == fingerprints.MAX_BYTES or (mask and h & mask == 0 and len(raw) - at > fingerprints.MIN_BYTES):
            out.append(raw[at : i + 1])
            at = i + 1
    return out


def print_of(text):
    import xxhash

    return ",".join(sorted({f"{xxhash.xxh64_intdigest(c, 7) >> 16:012x}{len(c):03x}" for c in chunks_byte_by_byte(text)}))


def likeness_of(a, b):
    a, b = ({f: int(f[-3:], 16) for f in x.split(",") if f} for x in (a, b))
    least = min(sum(a.values()), sum(b.values()))
    return sum(v for f, v in a.items() if f in b) / least if least else float(not a and not b)


def test_fingerprints_by_brute_force(spark, texts):
    rng = random.Random(31)
    rows = [*texts, *(edited(rng, texts[9] + " " + texts[10], 2) for _ in range(3)), words(rng, 3000)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        t, nxt = t or "", (rows[i - 1] if i else rows[-1]) or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), print_of(t), print_of(new))
        assert (got[i]["n_chars"], got[i]["edited_sha256"], got[i]["fingerprint"], got[i]["edited_fingerprint"]) == want
        assert abs(got[i]["near_edited"] - likeness_of(want[2], want[3])) < 1e-12 and abs(got[i]["near_next"] - likeness_of(want[2], print_of(nxt))) < 1e-12


def test_successors_of_hot_and_null_ids(spark):
    """Half of the rows have one doc_id and a third have none: they are cut into several buckets, and the order still holds."""
    ids = [7] * 60 + [None] * 40 + list(range(20)) + [3, 3]
    texts_ = [f"text {i * 7 % 61} " * 3 for i in range(len(ids))]
    table = docs(spark, texts_, ids=ids)
    dealt = fingerprints.with_successor(table)
    sizes = {}
    for r in dealt.where("ahead = 0").collect():
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
    assert max(sizes.values()) < 50
    marks = {r["text"]: r["m"] for r in table.select("text", F.xxhash64("text").alias("m")).collect()}
    order = sorted(zip(ids, texts_), key=lambda r: (r[0] is None, -(r[0] or 0), marks[r[1]], r[1]))
    want = sorted(((i, t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]) for k, (i, t) in enumerate(order)), key=str)
    got = fingerprints.fingerprint_documents(table).select("doc_id", "edited_sha256").collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(((i, hashlib.sha256(e.encode()).hexdigest()) for i, e in want), key=str)
    assert fingerprints.fingerprint_documents(table.limit(0)).count() == 0
    same = fingerprints.fingerprint_documents(docs(spark, ["abc"] * 3, ids=[7, 7, None])).collect()
    assert len(same) == 3 and {r["near_next"] for r in same} == {1.0}


def test_chunks_resist_shifts_and_blocks(monkeypatch):
    rng = random.Random(5)
    text = words(rng, 4000)
    a, b = fingerprints.chunk_set(text), fingerprints.chunk_set("new start " + text)
    assert fingerprints.likeness(a, b) > 0.98
    monkeypatch.setattr(fingerprints, "BLOCK", 100)
    assert fingerprints.chunk_set(text) == a


# quality


def test_quality(spark):
    rng = random.Random(2)
    good = [words(rng, 60) for _ in range(200)]
    bad = ["#$% " * 30 + words(rng, 3) for _ in range(60)]
    table = docs(spark, [*good, *bad, None, ""], ids=[*range(260), None, 261])
    labels = spark.createDataFrame([(i, int(i < 200), None) for i in range(260)] + [(None, 1, None), (5, None, None)], "doc_id long, quality int, text string")
    forest = quality.learn(table, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(table, forest).collect()}
    held = [i for i in range(260) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.5) == (i < 200) for i in held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 262
    nothing = quality.learn(table, labels.limit(0))
    assert {r["score"] for r in quality.score(table, nothing).collect()} == {0.5}
    assert quality.score(table.limit(0), forest).count() == 0


# exact substrings


def brute_repeats(rows, length=50):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for key, raw in order:
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], (key is None, key or 0))
    for key, raw in rows:
        cover = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < (key is None, key or 0):
                cover[k : k + length] = b"\1" * length
        out.append((key, sum(cover), bytes(c for c, v in zip(raw, cover) if not v)))
    return sorted(out, key=str)


def test_substrings(spark, texts):
    ids = [*range(len(texts) - 3), None, 5, 5]
    want = brute_repeats([(i, (t or "").encode()) for i, t in zip(ids, texts)])
    for options in ({}, {"bucket_bytes": 3000}, {"bucket_bytes": 3000, "hot": 2}):
        got = substrings.remove_repeats(docs(spark, texts, ids=ids), **options).collect()
        assert sorted([(r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in got], key=str) == want
    assert substrings.remove_repeats(docs(spark, texts).limit(0)).count() == 0


def test_substrings_of_common_phrases(spark):
    """One phrase in many surroundings, near copies and a very long text: many contexts an anchor, and chains of them."""
    rng = random.Random(14)
    phrase, base = words(rng, 9), words(rng, 80)
    rows = [f"{words(rng, rng.randint(0, 9))} {phrase[rng.randint(0, 9) :]} {words(rng, rng.randint(0, 9))}" for _ in range(60)]
    rows += [edited(rng, base, rng.randint(0, 4)) for _ in range(30)] + [" ".join(rows[:20]) * 3]
    rng.shuffle(rows)
    want = brute_repeats([(i, t.encode()) for i, t in enumerate(rows)])
    for options in ({}, {"hot": 5, "bucket_bytes": 2000}):
        got = substrings.remove_repeats(docs(spark, rows), **options).collect()
        assert sorted([(r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in got], key=str) == want


def matrix_of(strings):
    sizes = np.array([len(x) for x in strings])
    matrix = np.zeros((len(strings), sizes.max() + 1), np.int32)
    for i, x in enumerate(strings):
        matrix[i, : len(x)] = np.frombuffer(x, np.uint8)
    return matrix, sizes


def test_run_length_index_statistics():
    """Strings that aren't in the index: the sampled place has the longest match, and `occurs` is what is in the text."""
    rng = np.random.default_rng(4)
    draw = lambda n: [bytes(rng.integers(1, 4, rng.integers(12, 30)).astype(np.uint8)) for _ in range(n)]
    strings, others = draw(200), draw(150)
    index = substrings.RunLengthIndex(*matrix_of(strings))
    assert len(index.head) < index.rows and len(index.sample_first) == len(index.sample_last) == len(index.head)
    places = index.matching_statistics(*matrix_of(others), 10)
    got = index.occurs(*matrix_of(others), 10)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for i, x in enumerate(others):
        for k in range(len(x)):
            best = max(common(x[k : k + 10], y[j:]) for y in strings for j in range(len(y)))
            at = places[i, k]
            assert min(10, common(x[k:], strings[at // index.width][at % index.width :])) == best
            assert got[i, k] == (best == 10)


def test_masks_of_windows_that_occur_earlier(monkeypatch):
    """Parts of a few strings each, and anchors of many contexts, against all pairs."""
    rng = np.random.default_rng(6)
    kmer, length = b"kkkk", 10
    strings = sorted({bytes(rng.integers(97, 99, rng.integers(0, 7)).astype(np.uint8)) + kmer + bytes(rng.integers(97, 99, 6).astype(np.uint8)) for _ in range(200)})
    least, place = rng.integers(0, 60, len(strings)), np.array([x.index(kmer) for x in strings])
    anchor = rng.integers(0, 3, len(strings))
    want = [sum(1 << k for k in range(len(x) - length + 1) if any(least[j] < least[i] and anchor[i] == anchor[j] and x[k : k + length] in y for j, y in enumerate(strings))) for i, x in enumerate(strings)]
    want = [w & ((1 << place[i] + 1) - 1) for i, w in enumerate(want)]
    for part in (1 << 14, 5):
        monkeypatch.setattr(substrings, "PART", part)
        got = substrings.occurs_earlier(strings, anchor, place, least, length, 4)
        assert [int(g) & ((1 << place[i] + 1) - 1) for i, g in enumerate(got)] == want


def test_each_two_contexts_are_compared_once():
    rng = np.random.default_rng(3)
    anchor, least = rng.integers(0, 6, 90), rng.integers(0, 20, 90)
    context, tag, later = substrings.comparisons(anchor, least)
    met = sorted((int(a), int(b)) for t in set(tag.tolist()) for a in context[(tag == t) & ~later] for b in context[(tag == t) & later])
    assert met == sorted((i, j) for i in range(90) for j in range(90) if anchor[i] == anchor[j] and least[i] < least[j])


def test_anchor_blocks(monkeypatch):
    raw = words(random.Random(9), 900).encode()
    whole = substrings.anchors(raw)
    assert whole[1][0] == 0 and whole[2][-1] == len(raw) - 49 and (whole[1][1:] == whole[2][:-1]).all()
    monkeypatch.setattr(substrings, "BLOCK", 64)
    cut = substrings.anchors(raw)
    owner = lambda x: np.repeat(x[0], x[2] - x[1])
    assert (owner(cut) == owner(whole)).all()


def test_anchors_of_joined_texts(monkeypatch):
    """Texts that are joined have the stretches that each has on its own, however blocks cut them, and none has a window in two."""
    rng = random.Random(10)
    raws = [t.encode() for t in (*(words(rng, rng.randint(0, 60)) for _ in range(40)), "", words(rng, 900), "x" * 49, "y" * 50, "")]
    starts = np.r_[0, np.cumsum([len(x) for x in raws])]
    each = [substrings.anchors(x) for x in raws]
    for block in (1 << 15, 64):
        monkeypatch.setattr(substrings, "BLOCK", block)
        got = substrings.anchors(b"".join(raws), ends=starts[1:])
        assert (got[0] == np.concatenate([x[0] for x in each])).all()
        for i in (1, 2, 3):
            assert (got[i] == np.concatenate([x[i] + a for x, a in zip(each, starts)])).all()


def test_a_group_within_another_is_compared_once():
    """Near copies have both sides of their anchor in common, which makes no second comparison of them; strings of one side have a group each."""
    length, kmer = 50, 24
    near = [b"a" * 26 + b"k" * kmer + b"b" * 25 + bytes([99 + i]) for i in range(4)]
    left, right = b"a" * 26 + b"k" * kmer + b"z" * 9, b"y" * 8 + b"k" * kmer + b"b" * 26
    strings = [*near, left, right]
    matrix, sizes = matrix_of(strings)
    place = np.array([x.index(b"k") for x in strings])
    for n, want in ((4, [[0, 1, 2, 3]]), (6, [[0, 1, 2, 3, 4], [0, 1, 2, 3, 5]])):
        context, group = substrings._sides(matrix[:n], sizes[:n], np.zeros(n, np.int64), place[:n], length, kmer)
        assert sorted(sorted(context[group == g].tolist()) for g in set(group.tolist())) == want


def test_anchors_of_one_hash_and_other_bytes():
    """What is around an anchor is no match where the anchor's own bytes differ."""
    strings = [b"a" * 9 + k + b"b" * 9 for k in (b"kkkk", b"kkxk", b"kkkk")] + [b"a" * 9 + b"kkxk" + b"b" * 8 + b"c"]
    got = substrings.occurs_earlier(strings, np.zeros(4, np.int64), np.full(4, 9), np.arange(4), 12, 4)
    every = sum(1 << k for k in range(11))
    assert [int(g) & (1 << 10) - 1 for g in got] == [0, 0, every & (1 << 10) - 1, sum(1 << k for k in range(10))]


# SimHash


def test_simhash_components(spark, texts):
    ids = [*range(len(texts) - 1), 3]
    got = simhash.near_duplicates(docs(spark, texts, ids=ids)).collect()
    prints = [(i, simhash.simhash(t or "") & (1 << 64) - 1) for i, t in zip(ids, texts)]
    label = {p: p for _, p in prints}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if bin(a ^ b).count("1") <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for i, p in prints:
        least[label[p]] = min(least.get(label[p], i), i)
    assert sorted((r["doc_id"], r["print"] & (1 << 64) - 1, r["component_id"]) for r in got) == sorted((i, p, least[label[p]]) for i, p in prints)
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_grid_loses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False)) for b in base.tolist() for _ in range(4)]
    all_ = np.unique(np.array([*base.tolist(), *near], dtype=np.uint64))
    grids = [simhash.cell_keys(all_, 3, chosen) for chosen in simhash.GROUPS]
    for i in range(len(all_)):
        for j in np.flatnonzero(np.bitwise_count(all_ ^ all_[i]) <= 3):
            assert all((keys[i] == keys[j]).any() for keys in grids)
            assert simhash.manhattan(simhash.embed(all_[i : i + 1]), simhash.embed(all_[j : j + 1]))[0] <= 3
    want = components_of(all_)
    frame = spark.createDataFrame([(int(x),) for x in all_.view(np.int64)], "print long")
    for cell, pairwise, up_to in ((2048, 48, simhash.UP_TO), (3, 2, simhash.UP_TO), (1, 2, (9, 1 << 31))):  # hot cells are dealt anew
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "UP_TO", up_to)
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        roots = {r["node"]: r["root"] for r in components.components(simhash.link(frame)).collect()}
        groups = {}
        for x in all_.view(np.int64).tolist():
            groups.setdefault(roots.get(x, x), set()).add(x)
        assert {frozenset(g) for g in groups.values()} == want


def test_cells_are_cut_where_they_are_large():
    import pyarrow as pa

    keys = np.sort(np.repeat(np.arange(9), [1, 5, 40, 2, 3, 30, 1, 1, 7]))
    for step in (1, 4, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(np.arange(len(keys))[i : i + step])], names=["cell", "print"]) for i in range(0, len(keys), step)]
        parts = list(simhash._cells(iter(batches), 10))
        assert np.concatenate([p for _, p, _ in parts]).tolist() == list(range(len(keys)))
        whole = [k for ks, _, over in parts if not over for k in set(ks.tolist())]
        assert len(whole) == len(set(whole)) and not {k for ks, _, over in parts if over for k in ks.tolist()} & set(whole)
        assert step > 10 or max(len(k) for k, _, over in parts if over) <= 10 + step


def components_of(all_):
    rest, out = set(range(len(all_))), set()
    while rest:
        queue = [rest.pop()]
        group = set(queue)
        while queue:
            near = set(np.flatnonzero(np.bitwise_count(all_ ^ all_[queue.pop()]) <= 3).tolist()) & rest
            rest -= near
            group |= near
            queue += near
        out.add(frozenset(all_.view(np.int64)[sorted(group)].tolist()))
    return out


def test_keep_first(spark, texts):
    kept = simhash.keep_first(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    classes = {r["component_id"] for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


# pages


def test_pages(spark):
    page = lambda body, extra="": f"<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; line</h1>{body}<aside>side</aside><section class='comments'><p>me too</p></section></article>{extra}<footer>foot</footer></body></html>"
    rows = [(i, "http://h.example/a", page("".join(f"<p>par  {i}\n<b>bold</b>ly {k}</p>" for k in range(i)))) for i in range(1, 7)]
    rows += [(10, None, None), (11, "http://h.example/b", ""), (12, "http://h.example/c", page("<p>cut <script>x<y</script>here")[:180]), (13, "odd", "just text <b"), (1, "http://h.example/a", rows[0][2])]
    table = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, wrapper string")
    got = wrappers.extract_pages(table).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i in range(1, 7):
        assert by[i]["text"] == "\n".join(["Head & line", *[f"par {i} boldly {k}" for k in range(i)]])
    assert by[10]["text"] == by[11]["text"] == "" and by[13]["text"] == "just text"
    assert by[12]["text"].startswith("Head & line\ncut")
    assert any(r["found_by"] == "wrapper" for r in got)
    assert wrappers.extract_pages(table.limit(0)).count() == 0


def test_alignment_generalises():
    a, b = ["x", "p", "#", "/p", "y"], ["x", "p", "#", "/p", "p", "#", "/p", "z", "y"]
    wrapper = wrappers.fit([["article", *a, "/article"], ["article", *b, "/article"]])
    matcher = wrappers.Matcher(wrapper)
    assert matcher.zone(["article", *a, "/article"]) == (0, 7) and matcher.zone(["article", *b, "/article"]) == (0, 11)


def test_long_groups_fold():
    row = ["tr", *(x for i in range(20) for x in ("td", f"=x{i}", "br", "#", "/td")), "/tr"]
    assert wrappers.fold(["table", *row * 7, "/table"]) == ["table", ("+", tuple(row)), "/table"]


def div_page(rng, i, paragraphs, odd=False):
    """A page without article or main elements and without telling class words: menu, teaser and legal boxes around the text."""
    texts = [words(rng, 30) for _ in range(paragraphs)]
    extra = "<div class='c9'><span>Special of the week</span></div>" if odd else ""
    return texts, f"<html><body><div class='c1'><ul><li>Home</li><li>Products</li><li>Contact us</li></ul></div>{extra}<div class='c2'><div class='c3'><h1>Title {i}</h1></div><div class='c4'>{''.join(f'<p>{t}</p>' for t in texts)}<p>Read more on our site</p></div></div><div class='c5'><p>Buy our fine new teapots today, they are cheap</p><p>{words(rng, 3)}</p></div><div class='c6'>All rights reserved by Example</div></body></html>"


def test_wrapper_finds_text_of_div_layouts(spark):
    """The wrapper decides: with it boilerplate goes, without it the page comes out whole."""
    rng = random.Random(21)
    made = [div_page(rng, i, rng.randint(1, 9), odd=i % 5 == 4) for i in range(40)]
    want = ["\n".join([f"Title {i}", *texts]) for i, (texts, _) in enumerate(made)]
    table = spark.createDataFrame([(i, "https://div.example/x", page) for i, (_, page) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["found_by"]) for r in wrappers.extract_pages(table).collect()}
    assert [got[i][0] for i in range(40)] == want
    assert {how for _, how in got.values()} <= {"wrapper", "generalised"}
    alone = [wrappers.extract(page, None)[0] for _, page in made]
    assert all(a != w and "All rights reserved" in a for a, w in zip(alone, want))


def test_large_page_is_whole(spark):
    page = "<body><article>" + "".join(f"<p>par {i}</p>" for i in range(60_000)) + "</article></body>"
    assert wrappers.extract(page, wrappers.fitted(["<body><article><p>a</p></article></body>", page]))[0].count("\n") == 59_999


# neighbours


def nearest_by_brute_force(x, ids, q, k):
    score = (x * x[q]).sum(axis=1)
    score[q] = -np.inf
    best = np.lexsort((ids, -score))[:k]
    return ids[best].tolist(), score[best]


@pytest.mark.parametrize("kind", ["embeddings", "clusters", "blocks"])
def test_recall_at_twenty(spark, kind):
    """Recall of the registered query's parameters, and the share of vectors that is scored exactly."""
    if kind == "clusters":
        rng = np.random.default_rng(2)
        x = rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 24))
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    else:
        table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
        x = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()], dtype=np.float64)
    ids, block = np.arange(len(x)), 500 if kind == "blocks" else neighbours.BLOCK
    got = {}
    for r in neighbours.search(table, every=20, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = [len({*got[q]} & {*nearest_by_brute_force(x, ids, q, 20)[0]}) / 20 for q in range(0, len(x), 20)]
    n_blocks = -(-len(x) // block)
    share = neighbours.candidates_of_block(len(x), n_blocks, 20, neighbours.GROWTH) * n_blocks / len(x)
    print(f"{kind}: recall {np.mean(hits):.3f}, share scored exactly {share:.3f}")
    assert np.mean(hits) >= 0.9 and share <= 0.2


def test_neighbours_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:160] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [1.0, None], 0), (5004, [1.0], 0), (None, x[0].tolist(), 0), (20, x[20].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.search(table, every=20, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    wide = x.astype(np.float64)
    assert sorted(got) == list(range(0, 3000, 20))
    for q, found in got.items():
        assert len(found) == 10 and all(abs((wide[i] * wide[q]).sum() - s) < 1e-12 for i, s in found)
    assert [i for i, _ in got[140]] == [7, *range(100, 109)]
    assert neighbours.search(table.limit(0), every=20).count() == 0
    assert neighbours.search(table.limit(5), every=1).count() == 20


# mixing


def test_mixing_targets_and_amounts(spark):
    rng = random.Random(6)
    sizes = {"a": 40, "b": 3, "c": 200, "d": 60, None: 20}
    texts, sources = zip(*[(words(rng, rng.randint(1, 40)) if k % 9 else None, s) for s, n in sizes.items() for k in range(n)])
    table = docs(spark, list(texts), sources=list(sources))
    got = mixing.mix(mixing.size_and_weigh(table)).collect()
    names = ["a", "b", "c", "d", None]
    total = {s: sum(len((t or "").split()) for t, x in zip(texts, sources) if x == s) for s in names}
    weight = dict(zip(names, [3, 1, 2, 3, 1]))
    goal, open_ = {}, set(names)
    left = 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s], left = 2 * total[s], left - 2 * total[s]
            open_.discard(s)
    for r in got:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 and r["source_size"] == total[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    for s in names:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - goal[s]) <= 40
    again = mixing.mix(mixing.size_and_weigh(table.repartition(7))).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(mixing.size_and_weigh(table.limit(0))).count() == 0
    copies = mixing.repeat_mixed(table)
    assert copies.columns == table.columns
    assert copies.count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_ranges_stay_even_with_low_weights(spark):
    """Texts of digits have weights near 0.05, others near 1; no range holds much of a source, and prefix sums are those of one sort."""
    import math

    texts = ["1234 567 89" if i % 2 else words(random.Random(i), 5) for i in range(4000)]
    sized = mixing.size_and_weigh(docs(spark, texts, ids=[None if i % 50 == 0 else i for i in range(4000)]))
    rows = [(r["doc_id"], r["tie"], r["size"], r["quality"]) for r in sized.collect()]
    draw = lambda i, tie: (int(hashlib.md5(f"17:{tie if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    keyed = sorted((-math.log(draw(i, tie)) / q, i is None, i or 0, n, tie) for i, tie, n, q in rows)
    ranges = [math.floor(mixing.RANGES * math.log2(k[0])) for k in keyed]
    assert max(map(ranges.count, set(ranges))) < 40
    total = sum(k[3] for k in keyed)
    prefix, taken = 0, {}
    for _, null, i, n, tie in keyed:
        taken.setdefault((None if null else i, tie), []).append(n + n * (prefix + n / 2 < total * 0.5))
        prefix += n
    got = {}
    for r in mixing.mix(sized).collect():
        got.setdefault((r["doc_id"], r["tie"]), []).append(r["taken"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in taken.items()}


# personal data


def test_base_spans_are_the_patterns():
    import re

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and personal.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("12 -.+@a()0255%_x") for _ in range(rng.randint(0, 70))) + rng.choice(["", " 4111 1111 1111 1111", "a@b.c"])
        assert personal.base_spans(text) == {k: [m.span() for m in re.finditer(p, text) if fits[k](m[0])] for k, p in kinds.items()}
    assert personal.base_spans("a" * 300_000)["email"] == []


def test_bootstrap_finds_unseen(spark):
    rng = random.Random(12)
    texts = [f"{words(rng, 5)} mail bob{i}@ex{i}.com now {words(rng, 5)}" for i in range(40)]
    texts += [f"{words(rng, 5)} mail account-77{i}99x now {words(rng, 4)}" for i in range(3)]
    texts += ["plain year 1984 text", None, "", texts[0]]
    table = docs(spark, texts).withColumns({"d": F.lit(1), "g": F.lit("g"), "more": F.lit("m"), "seen": F.lit(2)})
    scanned, more = personal.find(table)
    found = {r["__doc"]: [tuple(x) for x in r["__more"]] for r in more.collect()}
    assert sorted(found) == [40, 41, 42]
    redacted = {r["doc_id"]: r["text"] for r in personal.redact(table).collect()}
    assert "[ID]" in redacted[40] and "[EMAIL]" in redacted[0] and redacted[43] == texts[43] and redacted[44] is None
    assert personal.redact(table.limit(0)).count() == 0


def test_bootstrap_finds_spaced_numbers_and_names(spark):
    rng = random.Random(3)
    texts = [f"{words(rng, 4)} phone +1 (212) 555-01{i} today {words(rng, 4)}" for i in range(10, 40)] + [f"{words(rng, 4)} mail bob{i}@ex{i}.com please {words(rng, 3)}" for i in range(20)]
    texts += ["see phone (017) 555 7713 today", "or mail Bob_Miller please now", "it is StreamReader here"]
    redacted = {r["doc_id"]: r["text"] for r in personal.redact(docs(spark, texts)).collect()}
    n = len(texts)
    assert redacted[n - 3] == "see phone [ID] today" and redacted[n - 2] == "or mail [ID] please now" and redacted[n - 1] == texts[-1]


@pytest.mark.parametrize("make", [lambda n: "1" * n + "...", lambda n: "1." * n, lambda n: "a@" * n, lambda n: "x1x2x3x4x5@a.b," * (n // 15), lambda n: "1234567890 " * (n // 11), lambda n: "Ab_12345678," * (n // 12), lambda n: "+1 " * (n // 3)])
def test_scans_are_linear(make):
    import time

    def scan(text):
        began = time.process_time()
        taken = sorted(s for x in personal.base_spans(text).values() for s in x)
        found = [*taken, *personal.candidates(text, taken)]
        assert len(personal.contexts(text, found)) == len(found)
        return time.process_time() - began

    assert scan(make(1 << 20)) < 20 * scan(make(1 << 17)) + 2


# byte-level BPE


def test_bpe_equals_the_library(spark, texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    odd = ["<|endoftext|> 'tis  two\n\n ½ ²x ª \x1c \x85 日本語 🙂", "z" * 3000, "".join(chr(rng.choice([*range(32, 600), 8232, 0x3000])) for _ in range(800))]
    rows = [*texts, *odd]
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, rows), path, documents_read=8, most=50).collect()}
    for i, t in enumerate(rows):
        ids = library.encode_ordinary(t or "")
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, rows).limit(0), path).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{where}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, table, where)
    assert good.columns == table.columns
    once = corpus_pipeline.drop_near_copies(spark, good, where)
    prints = [simhash.simhash(r["text"]) & (1 << 64) - 1 for r in once.collect()]
    assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert once.columns == table.columns and corpus_pipeline.redact_personal_data(spark, once, where).count() == once.count()
    assert corpus_pipeline.run(spark, where).where(F.col("ids").isNull()).count() == 0


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def alike_classes(texts):
    """Classes of Jaccard similarity 0.8 by all pairs, as the least place of each."""
    sets = [five_words(t) for t in texts]
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (5 * len(a & b) >= 4 * len(a | b)) and least[i] != least[j]:
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    return least


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.mark.parametrize("part", [256, 8])
def test_near_copies_by_all_pairs(spark, texts, monkeypatch, part):
    monkeypatch.setattr(near_copies, "PART", part)
    rng = random.Random(11)
    rows = list(texts)
    for n in (12, 60, 150, 400):
        base = words(rng, n)
        rows += [base.upper(), *(edited(rng, base, rng.randint(0, 1 + n // 25)) for _ in range(25))]
    rng.shuffle(rows)
    want = sorted(set(alike_classes(rows)))
    got = near_copies.keep_first(docs(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert got.columns == docs(spark, rows).columns
    assert near_copies.keep_first(docs(spark, rows).limit(0)).count() == 0
    same = docs(spark, ["a b", "a  B", None, " "], ids=[None, None, None, 3])
    assert near_copies.keep_first(same).count() == 2


def test_pipeline_drops_near_copies_at_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(5)
    base = [words(rng, 200) for _ in range(12)]
    rows = base + [edited(rng, t, 3) for t in base]
    assert 5 * len(five_words(base[0]) & five_words(rows[12])) >= 4 * len(five_words(base[0]) | five_words(rows[12]))
    kept = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(12))


@pytest.mark.parametrize("tag", ['article class="post has-sidebar"', 'article id="comments-12"', 'main role="main" class="search"'])
def test_hint_words_of_the_main_element_keep_its_text(tag):
    name = tag.split()[0]
    page = f'<body><nav>menu</nav><{tag}><p>one</p><section class="header-offset"><p>two</p></section><div class="cookie-notice">no</div></{name}></body>'
    assert wrappers.extract(page, None)[0] == "one\ntwo"


def test_long_instances_differ_past_their_prefix():
    long = "1234567890" * 30
    assert personal.instance(long + "a") != personal.instance(long + "b")
    assert personal.instance("ACC-123456") == "ACC-123456"
