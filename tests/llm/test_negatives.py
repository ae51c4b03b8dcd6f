"""Hard-negative mining against all scores."""

import math
import random

import numpy as np
import pytest

from keelson.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, block int, score double, x string, positives int, place int"


def by_brute_force(rows, every=100):
    rows = {(i, tuple(v), label) for i, v, label in rows if i is not None and v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v)}
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v], int(math.fmod(label + 1, 10)) if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for a_id, a, a_label in rows:
        if a_id % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, b)), b_id, label) for b_id, b, label in rows]  # noqa: B905
        near = sorted((s, i) for s, i, label in scored if label == a_label and i != a_id)[: negatives.POSITIVES]
        for s, positive in near:
            p = -s
            met = sorted((t, i) for t, i, label in scored if label != a_label and 30 * p <= -100 * t <= 90 * p)[: negatives.NEGATIVES]
            out += [(a_id, positive, rank + 1, i, p, -t) for rank, (t, i) in enumerate(met)]
    return sorted(out)


def got(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, 0.5, "x", 2, 3) for r in rows], SCHEMA)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in negatives.mine(frame, **more).collect())


def cloud(rng, n, dims, labels=4, spread=0.5):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    given = [rng.randrange(labels) for _ in range(n)]
    return [(i, [float(np.float32(c + spread * rng.gauss(0, 1))) for c in centres[label]], label) for i, label in enumerate(given)]


@pytest.mark.parametrize("block,anchors,step", [(16_384, 128, 8), (50, 2, 3)])
def test_mine_by_brute_force(spark, monkeypatch, block, anchors, step):
    monkeypatch.setattr(negatives, "STEP", step)
    rng = random.Random(6)
    rows = cloud(rng, 400, 12) + [(1000 + i, [0.25] * 12, i % 3) for i in range(40)]  # ties
    assert got(spark, rows, every=20, block=block, anchors=anchors) == by_brute_force(rows, 20)


def test_rows_that_take_no_part_and_odd_ones(spark):
    rng = random.Random(7)
    rows = cloud(rng, 120, 4)
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 4, 1), (100, None, 1), (101, [1.0, None, 1.0, 1.0], 1), (102, [nan] * 4, 1), (103, [inf] * 4, 0), (104, [1.0] * 4, None), (105, [], 1), (106, [1.0], 1), (107, [1.0] * 6, 2), (-100, [0.0] * 4, 1), (-7, [1.0] * 4, -3), (0, rows[0][1], rows[0][2]), (20, [1.0] * 4, 1)]
    assert got(spark, rows + odd, every=10) == by_brute_force(rows + odd, 10)


def test_edges(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0], 1)]) == []
    assert got(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []  # no positive
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []  # no anchor
    assert got(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.95], 2)]) == [(100, 1, 1, 2, 65536, 32768)]


def test_scan_drops_candidates_and_reads_all_dimensions_of_the_rest(monkeypatch):
    """Bounds hold at each step, and the bitmap shrinks before the last one."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(2000, 32)) * np.geomspace(256, 4, 32)).astype(np.int32)
    block = negatives.Block({"ids": np.arange(2000).tobytes(), "labels": np.zeros(2000, np.int64).tobytes(), "columns": [np.ascontiguousarray(x[:, d]).tobytes() for d in range(32)]})
    anchor, left, true = x[5].astype(np.int64), [], x.astype(np.int64) @ x[5].astype(np.int64)

    def keep(rows, lower, upper):
        assert (lower <= true[rows]).all() and (upper >= true[rows]).all()
        left.append(len(rows))
        return upper >= negatives._kth(lower, 5)

    rows, scores = block.scan(anchor, np.arange(2000), keep)
    assert (scores == true[rows]).all() and set(np.argsort(-true, kind="stable")[:5]) <= set(rows)
    assert left[0] == 2000 and left[-1] < 400
