"""Wrappers on the test table's pages, without the elements and names that tell an article from what is around it."""

import os
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from keelson.llm import wrappers

PAGES = "/root/testdata/sf0.1/pages.parquet"


def bare(page):
    page = re.sub(r"<(/?)(?:article|main|nav|footer|header|aside)\b", r"<\1div", page)
    return re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_pages_without_telling_elements():
    """What the article element tells is the truth: at least 99 of 100 texts are the same without it, and none loses a block."""
    if not os.path.exists(PAGES):
        pytest.skip("no test tables")
    hosts = defaultdict(list)
    for r in pq.read_table(PAGES).to_pylist():
        hosts[re.sub(r"^https?://([^/]*).*", r"\1", r["url"] or "")].append(r["html"] or "")
    same = n = 0
    for pages in hosts.values():
        wrapper = wrappers.fitted([bare(p) for p in pages[: wrappers.FIT_PAGES]])
        for page in pages:
            want, got = wrappers.extract(page, None)[0], wrappers.extract(bare(page), wrapper)[0]
            n += 1
            same += want == got
            assert not Counter(want.split("\n")) - Counter(got.split("\n"))
    assert n > 2000 and same >= 0.99 * n


def page(*blocks):
    return "<html><body><div>Home</div><div>Our paper of today</div><div>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div><div>All rights</div></body></html>"


def texts(*pages):
    return wrappers.template_texts([wrappers.tokens(p) for p in pages])


def test_near_copies_are_one_page():
    """What two copies share isn't the host's template."""
    a, b = "one long paragraph", "another paragraph"
    around = {"Home", "Our paper of today", "All rights"}
    assert texts(page(a, b, "x"), page(a, b, "y"), page("c", "d")) == around
    assert texts(page(a, b), page(a, b)) == frozenset() == texts(page(a)) == texts()
    assert texts(page("c", "d", "e", "f"), page("g", "h", "i", "j")) == around


def test_passages_that_articles_share_stay():
    passage, notice = "a passage of more than eight words that two of the pages share", "this site uses small files to work as well as it can"
    got = texts(page(passage, notice, "a"), page(passage, notice, "b", "c"), page(notice, "d", "e", "f"), page(notice, "g", "h"))
    assert got == {"Home", "Our paper of today", "All rights", notice}


def test_wrappers_of_all_pages(spark):
    """A box that one page of sixty has is in its host's wrapper, and a text that most pages have is a template text though a sample may say otherwise."""
    made = []
    for i in range(60):
        extra = f"<table><tr><td>rare {i}</td></tr></table>" if i == 7 else ""
        shared = "<div>Seen often</div>" if i % 5 else ""
        made.append((i, f"<html><body><div>Home</div>{extra}{shared}<div><h1>Title {i}</h1>" + "".join(f"<p>paragraph {k} of page {i}, which is its own</p>" for k in range(1 + i % 9)) + "<p>Seen often</p></div><div>All rights</div></body></html>"))
    pages = spark.createDataFrame([(i, f"http://many.example/{i}", p) for i, p in made], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["found_by"]) for r in wrappers.extract_pages(pages).collect()}
    want = {i: "\n".join([f"Title {i}", *(f"paragraph {k} of page {i}, which is its own" for k in range(1 + i % 9))]) for i, _ in made}
    assert got == {i: (text, "wrapper") for i, text in want.items()}


def test_wrappers_are_aligned_like_pages():
    """What is optional in either wrapper is optional in both's, and a part of an optional group may come without the rest."""
    a = wrappers.align(["x", "y"], ["x", "u", "v", "y"])
    b = wrappers.align(["x", "w", "y"], ["x", "u", "y"])
    regex = wrappers.Matcher(wrappers.align(a, b), (0, 1))
    for page in (["x", "y"], ["x", "u", "v", "y"], ["x", "w", "y"], ["x", "u", "y"]):
        assert regex.zone(page) is not None


def test_texts_by_code():
    codes = wrappers.Codes(map(wrappers.code, ["Home", "one two three four five six seven eight"]))
    assert "Home" in codes and "home" not in codes and {c & 1 for c in codes} == {0, 1}


def test_long_pages_have_wrappers(spark):
    """Pages of more than 5,000 items that don't fold decide where the text is, as shorter ones do."""
    rng = random.Random(5)
    kinds = rng.choices([f"x{k}" for k in range(60)], k=3000)

    def long(i):
        blocks = [f"block {k} of page {i}, which is its own" for k in range(len(kinds))]
        body = "".join(f"<{kind}>{b}</{kind}>" for kind, b in zip(kinds, blocks, strict=True))
        extra = f"<h6>note {i}</h6>" if i % 2 else ""
        want = "\n".join([f"Title {i}", *([f"note {i}"] if extra else []), *blocks])
        return f"<html><body><div><p>Seen by reader {i}</p></div><div><h1>Title {i}</h1>{extra}{body}</div></body></html>", want

    made = [long(i) for i in range(4)]
    assert all(len(wrappers.fold(wrappers.shape(wrappers.tokens(p))[0])) > 5000 for p, _ in made)
    pages = spark.createDataFrame([(i, "http://long.example/", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["found_by"]) for r in wrappers.extract_pages(pages).collect()}
    assert got == {i: (text, "wrapper") for i, (_, text) in enumerate(made)}
    short = wrappers.fitted([f"<html><body><div><p>Seen by reader {i}</p></div><div><h1>Title {i}</h1>" + f"<p>text of page {i}</p>" * (i + 1) + "</div></body></html>" for i in range(3)])
    assert wrappers.extract(made[0][0], short) == (made[0][1], "generalised")


def test_long_lists_are_cut_at_a_longest_common_subsequence():
    rng = random.Random(6)
    for turn in range(150):
        a, b = (rng.choices("abcdef"[: rng.randint(1, 6)], k=rng.randint(0, 40)) for _ in range(2))
        if turn % 3 == 0:
            b = a[: rng.randint(0, 9)] + b + a[-rng.randint(1, 9) :]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
            row = new
        codes = wrappers.opcodes(a, b, whole=0, most=1)
        assert sum(j - i for kind, i, j, _, _ in codes if kind == "equal") == row[-1]
        assert all(a[i:j] == b[k:m] for kind, i, j, k, m in codes if kind == "equal")
        assert all((x == "equal") != (y == "equal") for (x, *_), (y, *_) in zip(codes, codes[1:], strict=False))
        assert [x for kind, i, j, k, m in codes for x in b[k:m]] == b and [x for kind, i, j, k, m in codes for x in a[i:j]] == a


def test_pages_of_few_kinds_in_any_order():
    """Groups give back what they took where a page needs it, so all of a host's pages are matched and weighed, and the box with the most text is the zone though each of its slots has little."""
    for n, kinds, pages in ((60, 7, 40), (300, 3, 8)):
        made = []
        for i in range(pages):
            rng = random.Random(i)
            blocks = [(f"x{rng.randrange(kinds)}", f"block {k} of page {i}") for k in range(rng.randint(n // 2, n))]
            body = "".join(f"<{kind}>{text}</{kind}>" for kind, text in blocks)
            made.append((f"<html><body><div><p>Seen by reader {i}</p></div><div><h1>Title {i}</h1>{body}</div></body></html>", "\n".join([f"Title {i}", *(t for _, t in blocks)])))
        wrapper = wrappers.fitted([p for p, _ in made])
        assert [wrappers.extract(p, wrapper) for p, _ in made] == [(want, "wrapper") for _, want in made]


def test_places_in_a_wrapper():
    matcher = wrappers.Matcher([("+", ("a", "b")), ("+", ("a",)), ("?", ("c", "d")), "c", "b"], (0, 1))
    assert matcher.regex.fullmatch(matcher.line(["a", "b", "a", "c", "b"])) and not matcher.regex.fullmatch(matcher.line(["a", "b", "a", "a", "c", "d", "b"]))
    assert matcher.places(["a", "b", "a", "c", "b"]) == [0, 0, 1, 4, 5]
    assert matcher.places(["a", "b", "a", "b", "a", "a", "c", "d", "c", "b"]) == [0, 0, 0, 0, 1, 1, 2, 3, 4, 5]
    assert matcher.places(["a", "b", "a", "c", "d", "b"]) is None and matcher.places(["a", "b"]) is None and matcher.places([]) is None
    back = wrappers.Matcher([("+", ("a", "b")), "a", "b", "c"], (0, 2))
    assert back.places(["a", "b", "a", "b", "a", "b", "c"]) == [0, 0, 0, 0, 1, 2, 3] and back.zone(["a", "b", "a", "b", "c"]) == (0, 3)
