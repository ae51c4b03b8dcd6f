"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts alone. Trees are grown on binned features with logistic loss and flattened
into arrays (feature, threshold, left, right, value by node), which numpy traverses for a batch at a time. Labels
are learnt only from rows whose crc32(doc_id as text) mod `FOLDS` isn't `HELD_OUT`, from at most `SAMPLE` of them, by
a hash of doc_id; that bound is what the driver holds. All documents are scored, in one pass without a shuffle.

Defined cases: null text is empty and gets a score like any other; a null doc_id isn't held out and never learnt
from; null labels are ignored; repeated rows are scored each; without labels of both kinds every score is the
smoothed share of label 1 (0.5 without any); an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keelson.llm.common import map_batches, small_batches, table

FOLDS, HELD_OUT = 3, 1
#: Most labelled rows to learn from.
SAMPLE = 20_000

_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~<>{}[]\\=+_/", bytes(range(128, 256)))
_CLASS = np.zeros((256, len(_KINDS)))
for _k, _bytes in enumerate(_KINDS):
    _CLASS[list(_bytes), _k] = 1.0

FEATURES = ("log_bytes", "log_words", "bytes_a_word", "lower", "upper", "digit", "space", "newline", "stop", "comma", "mark", "bar", "symbol", "wide", "distinct_words", "top_word", "repeated_next", "distinct_triples", "distinct_lines", "words_a_line", "short_words", "once_words")


def statistics(text: str) -> list[float]:
    """The features of a text, independent of language."""
    raw = text.encode()
    n = len(raw)
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / max(n, 1)).tolist()
    words = raw.split()
    m = len(words)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    most = max(counts.values(), default=0)
    once = sum(1 for x in counts.values() if x == 1)
    return [
        np.log1p(n), np.log1p(m), n / max(m, 1), *shares,
        len(counts) / max(m, 1), most / max(m, 1), sum(map(eq, words, words[1:])) / max(m - 1, 1),
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(m - 2, 1), len(set(lines)) / max(len(lines), 1), m / max(len(lines), 1),
        sum(1 for x in words if len(x) <= 3) / max(m, 1), once / max(m, 1),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees by array: node k of tree t has a feature (-1: leaf), a threshold (at most: left), children and a value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = self.feature[t][node]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[rows, np.where(inner, f, 0)] <= self.threshold[t][node]
                node = np.where(inner, np.where(goes, self.left[t][node], self.right[t][node]), node)
            total += self.value[t][node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 5) -> Forest:
    """Histogram boosting with logistic loss; levels are grown breadth-first."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1.0 - share)))
    size = 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    feature, left, right = (np.full((trees, size), -1, dtype=np.int64) for _ in range(3))
    threshold, value = np.zeros((trees, size)), np.zeros((trees, size))
    if not trees:
        return Forest(base, feature, threshold, left, right, value)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = y - p, p * (1.0 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth + 1):
            first, wide = 2**level - 1, 2**level
            at = node - first
            here = at >= 0
            sums = np.bincount(at[here], g[here], wide), np.bincount(at[here], h[here], wide)
            value[t, first : first + wide] = rate * sums[0] / (sums[1] + ridge)
            if level == depth or not here.any():
                break
            best = np.full(wide, 1e-6)
            for f in range(x.shape[1]):
                slot = at[here] * bins + binned[here, f]
                gl, hl, nl = (np.cumsum(np.bincount(slot, w, wide * bins).reshape(wide, bins), axis=1) for w in (g[here], h[here], None))
                gr, hr, nr = sums[0][:, None] - gl, sums[1][:, None] - hl, nl[:, -1:] - nl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (sums[0] ** 2 / (sums[1] + ridge))[:, None]
                gain[(nl < least) | (nr < least)] = -1.0
                gain[:, len(cuts[f]) :] = -1.0
                k = gain.argmax(axis=1)
                better = gain[np.arange(wide), k] > best
                best = np.where(better, gain[np.arange(wide), k], best)
                for i in np.flatnonzero(better):
                    feature[t, first + i], threshold[t, first + i] = f, cuts[f][k[i]]
            for i in np.flatnonzero(feature[t, first : first + wide] >= 0):
                left[t, first + i], right[t, first + i] = 2 * (first + i) + 1, 2 * (first + i) + 2
            split = here & (feature[t][node] >= 0)
            goes = x[np.arange(len(y)), np.where(split, feature[t][node], 0)] <= threshold[t][node]
            node = np.where(split, np.where(goes, left[t][node], right[t][node]), -1)
            leaf = here & ~split
            total[leaf] += value[t, (at + first)[leaf]]
        done = node >= 0
        total[done] += value[t, node[done]]
    return Forest(base, feature, threshold, left, right, value)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fits on a bounded sample of labelled rows; only those texts are read for their statistics."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("quality")).dropna()
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = map_batches(
        texts.select("doc_id", "text", "quality"),
        lambda b: {"doc_id": b["doc_id"], "x": [statistics(t or "") for t in b["text"]], "y": b["quality"]},
        "doc_id long, x array<double>, y double",
    ).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).toArrow()  # repeated ids are within the bound too
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, (np.array(rows.column("y").to_pylist(), dtype=np.float64) >= 0.5).astype(np.float64))


def score(documents: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """All columns of documents and the score under a name (a column of that name is replaced)."""
    documents = documents.drop(name)
    small_batches(documents.sparkSession)
    kind = StructType([*documents.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(x))], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    forest = learn(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, forest)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
