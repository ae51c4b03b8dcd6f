"""Decision tokens, prompts, protocols, direct scores, functions in SQL and permutation nulls against plain Python."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import prompts, registry, text, tokens
from keelson.operators import allocate, permute, resample
from keelson.plans.registry import QUERIES

T = lambda token, logprob, *top: (token, logprob, [*top])


@pytest.mark.parametrize("own", ["missing", "greatest"])
def test_decision_tokens(spark, own):
    cases = [
        ([T("the", -0.1), T(" yes", -0.3, ("YES", -0.2), ("yes", -9.0), (" No ", -2.0), ("x", 0.0))], (1, -0.2, -2.0, None)),
        ([T("NO", -0.5, ("YES", -3.0))], (0, -3.0, -0.5, None)),  # its own word is missing among the likeliest
        ([T("<think>", 0.0), T("YES", -1.0, ("NO", -1.0)), T("a</think>", 0.0), T("Skip\n", -0.1, ("NO", -4.0), ("SKIP", -0.6))], (3, None, -4.0, -0.6 if own == "missing" else -0.1)),
        ([T("YES", -1.0), T("</think>", 0.0)], (-2, None, None, None)),
        ([T("maybe", -1.0, ("YES", -1.0))], (-1, None, None, None)),
        ([], (-1, None, None, None)),
        ([T("YES", None), T("NO", -0.4)], (1, None, -0.4, None)),  # nothing known at the first
        ([T(None, None), ("yes", -0.5, None)], (1, -0.5, None, None)),
    ]
    frame = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, t {tokens.TOKENS}")
    got = {r["i"]: tuple(r["d"]) for r in frame.select("i", tokens.decision_logprobs(F.col("t"), own).alias("d")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert spark.createDataFrame([(None,)], f"t {tokens.TOKENS}").select(tokens.decision_logprobs(F.col("t"))).first()[0] is None


def test_token_confidence(spark):
    yes_no = lambda y, n, s=None: [T("YES", y, ("YES", y), ("NO", n), *([("SKIP", s)] if s is not None else []))]
    p = 1 / (1 + math.exp(-1.0))
    cases = [
        ("YES", 0.9, yes_no(-1.0, -2.0), (p, None, "tokens")),
        ("NO", 0.9, yes_no(-1.0, -2.0, -1.0), (p, math.exp(-1) / (2 * math.exp(-1) + math.exp(-2)), "tokens")),
        ("YES", 0.9, yes_no(-9.0, -1.0), (0.9, None, "anomaly")),
        ("NO", 0.9, yes_no(-1.0, -9.0), (0.0, None, "anomaly")),
        ("SKIP", 0.9, [T("SKIP", -1.0)], (0.0, 1.0, "partial")),
        ("YES", 0.7, None, (0.7, None, "no_tokens")),
        (None, 0.7, [], (0.0, 1.0, "no_tokens")),
        ("NO", 0.7, [T("x", 0.0)], (0.0, None, "no_decision")),
        ("YES", 0.6, [T("YES", 0.0), T("</think>", 0.0)], (0.6, None, "thought_only")),
        ("YES", 0.6, yes_no(-1.0, -500.0), (1 / (1 + math.exp(-100)), None, "tokens")),
    ]
    frame = spark.createDataFrame([(i, d, c, t) for i, (d, c, t, _) in enumerate(cases)], f"i int, d string, c double, t {tokens.TOKENS}")
    got = {r["i"]: r["x"] for r in frame.select("i", tokens.token_confidence(F.col("d"), F.col("c"), F.col("t")).alias("x")).collect()}
    for i, (*_, want) in enumerate(cases):
        assert (got[i]["logit_confidence"], got[i]["logit_p_skip"], got[i]["source"]) == (pytest.approx(want[0]), want[1] if want[1] is None else pytest.approx(want[1]), want[2]), i


def test_prompts(spark):
    template = "{a} and {b}: {{not a name}} {a}{c}"
    assert prompts.template_names(template) == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, {"a": "x", "b": "{c}", "c": ""}), (2, {"a": None, "b": "y"}), (3, {}), (4, None)], "i int, m map<string,string>")
    got = {r["i"]: (r["p"]["text"], r["p"]["missing"]) for r in rows.select("i", prompts.render(template, F.col("m")).alias("p")).collect()}
    bare = ("{a} and {b}: {not a name} {a}{c}", ["a", "b", "c"])
    assert got == {1: ("x and {c}: {not a name} x", []), 2: ("{a} and y: {not a name} {a}{c}", ["a", "c"]), 3: bare, 4: bare}
    kinds = [("ssv2", '["a cup", "b"]', None), ("SSv2 ", "", ('["other"]', "new label")), ("ssv2", None, None), ("k400", None, None), ("diving48", None, None), ("charades", None, None), (None, None, None)]
    frame = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, kind string, given string, found struct<placeholders:string,label:string>")
    for direct in (False, True):
        got = {r["i"]: r["c"] for r in frame.select("i", prompts.context(F.col("kind"), F.lit("label"), F.col("given"), F.col("found"), direct).alias("c")).collect()}
        way = "direct_scoring" if direct else "mss_verification"
        assert got[0] == {"action_template": "label", "placeholders": "a cup, b", "prompt_template_id": f"{way}_ssv2"}
        assert got[1] == {"action_template": "new label", "placeholders": "other", "prompt_template_id": f"{way}_ssv2"} and got[2]["placeholders"] == "unknown"
        assert got[3] == {"action_label": "label", "prompt_template_id": f"{way}_k400"}
        assert got[4] == ({"action_label": "label", "prompt_template_id": "direct_scoring_diving48"} if direct else None)
        assert got[5] == got[6] == ({"action_label": "label", "prompt_template_id": "direct_scoring"} if direct else None)


def test_protocols(spark):
    def by_hand(kept, total, fps, n, protocol):
        if total <= 0 or protocol not in allocate.PROTOCOLS:
            return None
        whole = np.linspace(0, total - 1, n).round().astype(int).tolist()
        if kept is None:
            return whole, [False] * n
        pool = sorted({i for s, e in kept for i in range(max(0, round(s * fps)), min(total - 1, round(e * fps)) + 1)})
        if protocol == "mask":
            return whole, [i not in pool for i in whole]
        return ([pool[i] for i in np.linspace(0, len(pool) - 1, n).round().astype(int)] if pool else whole), [False] * n

    cases = [(k, total, fps, p) for k in (None, [], [(0.0, 1.0)], [(2.0, 2.5), (0.5, 1.0)], [(90.0, 99.0)]) for total in (0, 1, 30) for fps in (1.0, 12.5) for p in (*allocate.PROTOCOLS, "other")]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kept array<struct<start_s:double,end_s:double>>, total int, fps double, p string")
    got = {r["i"]: r["x"] and (r["x"]["frames"], r["x"]["blank"]) for r in frame.select("i", allocate.protocol_frames(F.col("kept"), F.col("total"), F.col("fps"), 8, F.col("p")).alias("x")).collect()}
    for i, (kept, total, fps, p) in enumerate(cases):
        assert got[i] == by_hand(kept, total, fps, 8, p), cases[i]


def test_direct_scores(spark):
    cases = [
        ('{"segments": [{"segment_id": 1, "importance": 80}, {"segment_id": 3, "importance": 20}], "minimum_sufficient_set": [3, 1, 9]}', 3, ([0.8, 0.5, 0.2], [0, 2])),
        ('<think>{"segments": [{"segment_id": 1, "importance": 1}]}</think>{"segments": [{"segment_id": 2, "importance": 60}]}', 3, ([0.6, 0.6, 0.6], [0, 1, 2])),
        ('{"segments": [{"segment_id": 1, "importance": 10}, {"segment_id": 1, "importance": 90}]}', 1, ([0.9], [0])),
        ('{"segments": [{"segment_id": 1, "importance": 10}]}', 1, None),  # nothing is kept
        ('{"segments": [{"segment_id": 7}], "minimum_sufficient_set": [1]}', 2, ([0.0, 0.0], [0])),
        ('{"segments": []}', 2, None), ("none", 2, None), (None, 2, None), ('{"segments": [{"segment_id": 1, "importance": 90}]}', 0, None),
        ('{"segments": [{"segment_id": 1, "importance": 90}], "minimum_sufficient_set": [5]}', 2, None),
    ]
    frame = spark.createDataFrame([(i, raw, n) for i, (raw, n, _) in enumerate(cases)], "i int, raw string, n int")
    got = {r["i"]: r["x"] for r in frame.select("i", text.direct_scores(F.col("raw"), F.col("n")).alias("x")).collect()}
    for i, (*_, want) in enumerate(cases):
        assert (got[i] is None) == (want is None), cases[i]
        if want is not None:
            assert got[i]["weights"] == pytest.approx(want[0]) and got[i]["kept"] == want[1]


def test_functions_in_sql(spark):
    registry.register(spark)
    rows = spark.createDataFrame([("a", 5.0), ("b", 0.0), ("c", None), ("d", 4.0)], "v string, dur double")
    got = sorted(map(tuple, spark.sql("SELECT v, s.* FROM {rows}, LATERAL segments(dur, 2.0) s", rows=rows).collect()))
    want = allocate.fixed_segments(rows.withColumnRenamed("v", "video_id"), "dur", 2.0)
    assert got == sorted(map(tuple, want.collect())) and len(got) == 5
    for wrong in ("'x', 2.0", "5.0, 0.0", "5.0, dur", "5.0, 'x'"):
        with pytest.raises(Exception, match="segments: "):
            spark.sql(f"SELECT s.* FROM {{rows}}, LATERAL segments({wrong}) s", rows=rows).collect()
    points = spark.createDataFrame([("a", 2.0, 1.0), ("a", 0.0, 0.0), ("a", None, 9.0), ("b", 1.0, 5.0), ("c", None, 1.0)], "k string, x double, y double")
    assert {r[0]: r[1] for r in spark.sql("SELECT k, area(x, y) FROM {points} GROUP BY k", points=points).collect()} == {"a": 1.0, "b": 0.0, "c": None}


def test_recognisers(spark):
    known = registry.Recognisers()
    known.add("two", "keelson.functions.registry:centroids", means=[[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    rows = spark.createDataFrame([([2.0, 1.0],), ([0.0, 3.0],)], "v array<double>")
    got = [(r[0]["top_ids"], r[0]["top_scores"]) for r in rows.select(known.column("two", F.col("v"), 2)).collect()]
    assert got == [([0, 2], [2.0, 2.0]), ([1, 0], [3.0, 0.0])]
    near = spark.createDataFrame([([1.0000001, 1.0000004],), ([1.0, 1.0000006],)], "v array<double>")
    got = [(r[0]["top_ids"], r[0]["top_scores"]) for r in near.select(known.column("two", F.col("v"), 1, digits=6)).collect()]
    assert got == [([0], [1.0]), ([1], [1.000001])]
    with pytest.raises(KeyError, match="there are two"):
        known.column("three", F.col("v"))
    with pytest.raises(ValueError):
        known.add("bad", "module")


def test_labels_equal_to_six_digits(spark, tmp_path):
    """Both labels' scores of vector 3 are 0 to six digits, and label 2's is greater beyond them."""
    rows = [(1, 1, [1.0, 0.0]), (2, 2, [1.0, 4e-7]), (3, 1, [0.0, 1.0]), (4, 1, [0.0, -1.0]), (5, 2, [0.0, 0.0]), (6, 2, [0.5, 0.0]), (7, None, [-1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["label"], r["score"]) for r in QUERIES["recogniser_registry"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 0.5), 2: (2, 0.5), 3: (1, 0.0), 4: (1, 0.0), 5: (1, 0.0), 6: (2, 0.25), 7: (1, 1.0)}


def test_now(spark):
    before = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    got = dt.datetime.fromisoformat(spark.range(1).select(text.now_iso()).first()[0])
    assert before - dt.timedelta(seconds=1) <= got <= dt.datetime.now(dt.UTC).replace(tzinfo=None)


def mixed(x):
    for shift, factor in resample.MIX:
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFF
    return x


def test_permutation_null_by_brute_force(spark):
    rng, trials = random.Random(9), 30
    videos = [(f"v{i}", [rng.choice([0.1, 0.5, 0.7, 0.9]) for _ in range(n)], [rng.choice([0.1, 0.4, 0.8]) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 5, 5, 5, 7, 7, 4])]
    rows = [(v, a, b, [x >= 0.5 for x in a], [x >= 0.4 for x in b]) for v, a, b in videos]
    odd = [("short", [1.0], [1.0, 2.0], [True], [True, False]), ("empty", [], [], [], []), ("null", None, [1.0], None, [True])]
    frame = spark.createDataFrame(rows + odd, "v string, a array<double>, b array<double>, kept_a array<boolean>, kept_b array<boolean>").repartition(3)
    got = {r["trial"]: r for r in permute.null_by_trial(frame, "v", trials, 5).collect()}

    def ranks(x):
        return [sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x]

    def rho(a, b):
        ra, rb = np.array(ranks(a)), np.array(ranks(b))
        d = math.sqrt(((ra - ra.mean()) ** 2).sum() * ((rb - rb.mean()) ** 2).sum())
        return None if d == 0 else ((ra - ra.mean()) * (rb - rb.mean())).sum() / d

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    for trial in range(-1, trials):
        rhos, jaccards = [], []
        for v, a, b, ka, kb in rows:
            kept = {i for i, x in enumerate(ka) if x}
            if trial >= 0:
                d = hashlib.md5(f"5|{v}".encode()).hexdigest()
                base = int(d[8:16], 16) ^ mixed((int(d[:8], 16) + (trial + 1) * resample.STRIDE) & 0xFFFFFFFF)
                order = sorted(range(len(a)), key=lambda i: (mixed((base + i * resample.STRIDE) & 0xFFFFFFFF), i))
                a = [a[i] for i in order]
                kept = set(sorted(range(len(a)), key=lambda i: -a[i])[: len(kept)])
            rhos.append(rho(a, b))
            jaccards.append(jaccard(kept, {i for i, x in enumerate(kb) if x}))
        defined = [x for x in rhos if x is not None]
        assert got[trial]["n"] == len(rows) and got[trial]["rho"] == pytest.approx(sum(defined) / len(defined)) and got[trial]["jaccard"] == pytest.approx(sum(jaccards) / len(jaccards))
    by_trial = permute.null_by_trial(frame, "v", trials, 5)
    s = by_trial.agg(*permute.null_summary("rho"), *permute.null_summary("jaccard")).first()
    for c in ("rho", "jaccard"):
        nulls = sorted(round(got[t][c], 9) for t in range(trials))
        assert s[f"{c}_p95"] == nulls[int(0.95 * (trials - 1))] and s[f"{c}_p"] == pytest.approx((sum(x >= round(got[-1][c], 9) for x in nulls) + 1) / (trials + 1))
    assert permute.null_by_trial(frame.limit(0), "v", trials, 5).count() == 0


def test_sums_without_sorting():
    """Both ways give the same sums; videos whose kept weights equal some that aren't kept, or with many places, are left to sorting."""
    rng, trials = np.random.default_rng(11), 25
    for n in (1, 2, 3, 6, 9, 16):
        a, b = rng.integers(0, 5, (40, n)) / 10, rng.integers(0, 3, (40, n)) / 10
        kept_a, kept_b = a >= rng.choice([0.0, 0.2, 0.3, 0.9], (40, 1)), rng.random((40, n)) < 0.5
        high, low = rng.integers(0, 1 << 32, (2, 40), dtype=np.uint32)
        high[:20] = low[:20] = 0
        assert permute._plain(a, b, kept_a).all()
        one, other = np.zeros((trials + 1, 4)), np.zeros((trials + 1, 4))
        permute._add_sorted(one, high, low, a, b, kept_a, kept_b, trials)
        permute._add_compared(other, high, low, a, b, kept_a, kept_b, trials)
        np.testing.assert_allclose(one, other, rtol=1e-12, atol=1e-12)
    a = np.array([[0.5, 0.5, 0.1], [0.5, 0.5, 0.1], [0.5, np.nan, 0.1], [0.1, 0.1, 0.1]])
    kept = np.array([[True, False, False], [True, True, False], [True, False, False], [False, False, False]])
    assert permute._plain(a, np.zeros((4, 3)), kept).tolist() == [False, True, False, True]
    assert not permute._plain(np.zeros((2, 17)), np.zeros((2, 17)), np.ones((2, 17), bool)).any()


def test_equal_weights_parted_and_many_places(spark):
    """The rows of both ways together: one video is parted, one has 20 places, two are plain."""
    rows = [("p", [0.5, 0.5, 0.1], [1.0, 2.0, 3.0], [True, False, False], [True, False, True]), ("m", [i % 7 / 7 for i in range(20)], [float(i) for i in range(20)], [i % 7 > 4 for i in range(20)], [i < 9 for i in range(20)])]
    rows += [("x", [0.9, 0.1], [1.0, 2.0], [True, False], [True, False]), ("y", [0.9, 0.1], [1.0, 2.0], [False, False], [False, False])]
    schema = "v string, a array<double>, b array<double>, kept_a array<boolean>, kept_b array<boolean>"
    by = lambda r: {x["trial"]: x for x in permute.null_by_trial(spark.createDataFrame(r, schema), "v", 20, 3).collect()}
    got, one = by(rows), [by([r]) for r in rows]
    for trial in range(-1, 20):
        assert got[trial]["n"] == 4
        assert got[trial]["rho"] == pytest.approx(sum(o[trial]["rho"] for o in one) / 4) and got[trial]["jaccard"] == pytest.approx(sum(o[trial]["jaccard"] for o in one) / 4)


def test_permutations_are_uniform():
    rng = np.random.default_rng(10)
    order = permute.permutations(*rng.integers(0, 1 << 32, (2, 300), dtype=np.uint32), 4, 40)
    counts = np.stack([(order == i).mean(axis=(0, 1)) for i in range(4)])
    assert abs(counts - 0.25).max() < 0.015
