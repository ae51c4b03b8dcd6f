"""Resampling weights, intervals and p-values against plain Python; global order without one task."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import order, paired, resample

M = (1 << 32) - 1


def mixed(x):
    for shift, factor in resample.MIX:
        x = ((x ^ (x >> shift)) * factor) & M
    return x


def count(seed, key, r):
    """A row's count in a replicate, one number at a time."""
    d = hashlib.md5(f"{seed}|{key}".encode()).hexdigest()
    u = mixed(int(d[8:16], 16) ^ mixed((int(d[:8], 16) + (r + 1) * resample.STRIDE) & M))
    return sum(u >= t for t in resample.REACHED)


def test_replicates_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"k{i % 40}", rng.choice("ab"), rng.random(), None if i == 7 else rng.gauss(0, 1)) for i in range(60)]
    frame = spark.createDataFrame(rows, "key string, g string, x double, y double").repartition(3)
    got = {(r["g"], r["r"]): r for r in resample.replicate_sums(frame, ["key"], {"x": F.col("x"), "y": F.col("y")}, 20, 9, ["g"]).collect()}
    assert len(got) == 2 * 21
    for g in "ab":
        own = [r for r in rows if r[1] == g and r[3] is not None]
        for r in range(-1, 20):
            w = [1 if r < 0 else count(9, k, r) for k, _, _, _ in own]
            want = [sum(w), sum(a * row[2] for a, row in zip(w, own, strict=True)), sum(a * row[3] for a, row in zip(w, own, strict=True))]
            assert [got[g, r]["n"], got[g, r]["x"], got[g, r]["y"]] == pytest.approx(want, abs=1e-9)
    assert resample.replicate_sums(frame.limit(0), ["key"], {"x": F.col("x")}, 20, 9).count() == 0


def test_weights_are_poisson_and_independent():
    rng = np.random.default_rng(2)
    w = resample.weights(*rng.integers(0, 1 << 32, (2, 2000), dtype=np.uint32), 500)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs((w == 0).mean() - math.exp(-1)) < 0.002
    by_row, by_replicate = np.corrcoef(w[:60]), np.corrcoef(w[:, :60].T)
    for c in (by_row, by_replicate):
        assert abs(c[~np.eye(60, dtype=bool)]).mean() < 0.05


def test_a_hundred_thousand_different_values(spark):
    """No bound on different values, and the spread of the replicates is the standard error."""
    n, b = 100_000, 1000
    x = F.sin(F.col("id").cast("double")) + F.col("id") * 1e-9
    rows = spark.range(n).select("id", x.alias("x"), (x * 0.3 + F.cos(F.col("id") * 1.7)).alias("y"))
    s = resample.collected(resample.replicate_means(rows, ["id"], ["x"], b, 3), ["x"]).first()
    values = np.sin(np.arange(n)) + np.arange(n) * 1e-9
    assert len(s["x_s"]) == b and s["n"] == n and s["x"] == pytest.approx(values.mean(), abs=1e-9)
    assert np.std(s["x_s"]) == pytest.approx(values.std() / math.sqrt(n), rel=0.1)
    r = resample.collected(resample.replicate_pearson(rows, ["id"], "x", "y", b, 4), ["value"]).first()
    rho = np.corrcoef(values, values * 0.3 + np.cos(np.arange(n) * 1.7))[0, 1]
    assert r["value"] == pytest.approx(rho, abs=1e-6) and r["value_s"][25] < rho < r["value_s"][975]


def test_rules_of_intervals_and_p(spark):
    rng = random.Random(4)
    s = sorted(round(rng.gauss(0.4, 1), 9) for _ in range(101))
    frame = spark.createDataFrame([(s, 0.4), ([1.0, 2.0], -0.5), ([], None), ([0.0] * 4, 0.0)], "s array<double>, o double")
    rules = [resample.linear(F.col("s"), 0.975), resample.at_share(F.col("s"), 0.975), resample.at_share(F.col("s"), 0.975, 1), resample.centred_p(F.col("s"), F.col("o")), resample.sign_p(F.col("s"), F.col("o"))]
    got = frame.select(*[c.alias(f"c{i}") for i, c in enumerate(rules)]).collect()
    a = np.array(s)
    assert got[0][0] == pytest.approx(np.percentile(a, 97.5)) and got[0][1] == s[int(0.975 * 101)] and got[0][2] == s[int(0.975 * 101) - 1]
    assert got[0][3] == pytest.approx(min(1, max(1 / 101, 2 * min((a - 0.4 >= 0.4).mean(), (a - 0.4 <= -0.4).mean()))))
    assert got[0][4] == pytest.approx(min(1, 2 * (a <= 0).mean()))
    assert got[1][3] == pytest.approx(0.5) and got[1][4] == 1.0  # clamped from below; all replicates on the other side
    assert list(got[2]) == [None] * 5 and got[3][3] == 1.0


def test_degenerate_resamples_are_left_out(spark):
    rows = spark.createDataFrame([(i, float(i == 0), float(i)) for i in range(4)], "k int, x double, y double")
    s = resample.collected(resample.replicate_pearson(rows, ["k"], "x", "y", 400, 5), ["value"]).first()
    assert 0 < len(s["value_s"]) < 400 and all(-1 - 1e-9 <= v <= 1 + 1e-9 for v in s["value_s"])


@pytest.mark.parametrize("parts", [None, 5])
def test_numbered(spark, parts):
    rng = random.Random(6)
    values = [rng.choice([1, 1, 1, rng.randint(0, 999), None]) for _ in range(800)]  # a hot value, and nulls first
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(6)
    got = sorted(order.numbered(frame, [F.col("v")], parts).select("position", "v", "i").collect())
    assert [r["position"] for r in got] == list(range(800)) and {r["i"] for r in got} == set(range(800))
    assert [r["v"] for r in got] == sorted(values, key=lambda v: (v is not None, v or 0))
    plan = order.numbered(frame, [F.col("v")], parts)._jdf.queryExecution().executedPlan().toString()
    gathered = plan.split("Exchange SinglePartition")[1:]
    assert gathered and all(re.match(r"[^\n]*\n[^\n]*HashAggregate", g) for g in gathered)  # only counts by partition


def test_order_statistics_and_first_of(spark):
    values = [5.0, 1.0, None, 3.0, 3.0, 9.0, 7.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    got = order.order_statistics(frame, "v", {"a": (1, 3), "b": (2, 3), "least": (0, 1)}).first()
    assert (got["a"], got["b"], got["least"]) == (known[2], known[4], known[0])
    assert order.order_statistics(frame.limit(0), "v", {"a": (1, 2)}).first()["a"] is None
    assert sorted(r["v"] for r in order.first_of(frame.dropna(), [F.col("v")], 1, 2, descending=True).collect()) == [5.0, 7.0, 9.0]


def test_index_strata(spark):
    values = [None, *[float(i) for i in range(9)]]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["s"] for r in frame.withColumn("s", paired.index_strata(frame, "v", ["low", "medium", "high"])).collect()}
    assert got == {None: "unknown", **{float(i): ["low", "medium", "high"][i // 3] for i in range(9)}}


def test_plain_local_session_has_a_folder_for_tables(tmp_path):
    """Without any defaults of the machine's, and what was written can be released."""
    code = "from keelson.session import *; s = local_session(cores='2'); d = materialize(s.range(5), 'x'); assert d.count() == 5; f = d.inputFiles(); release(d); import os; assert not any(os.path.exists(p.removeprefix('file://')) for p in f); print('fine')"
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, timeout=200)
    assert "fine" in out.stdout, out.stderr[-2000:]
