"""The quality classifier on documents that it hasn't learned from."""

import os

import pytest

from keelson.llm import quality
from keelson.session import table

WHERE = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    """Every third labelled document is held out: nearly all are told apart, and ranked by their scores."""
    if not os.path.isdir(WHERE):
        pytest.skip("no test tables")
    labels = table(spark, WHERE, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    rows = quality.query(spark, WHERE).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 1000 and len(bad) > 150
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) >= 0.99
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.98
