"""Near-duplicates by the Jaccard similarity of five-word shingle sets, 4/5 or more.

A text's words are its lower-cased runs without white space; a text of fewer than SHINGLE words has one shingle of all of them.
Texts of equal shingle sets are one node. Candidates share a cell: one of BANDS fingerprints of ROWS least hashes each, so
that a pair of similarity 0.8 shares none with probability (1 - 0.8**5)**28, about 1.5e-5, and a closer pair more rarely.
Every link is verified on the whole shingle sets, so no pair below the similarity is linked.

The pipeline's stage is SimHash's: fingerprints and their links are those of simhash.py, and the similarity adds what SimHash misses,
mostly short texts with a few words changed. A class is what links of either kind connect; SimHash's come first, so cells needn't find them again.

In a cell each node is compared with the least and the greatest one first. What a class of links already connects needs no more
comparing; in cells that still hold several classes, each node outside of the largest one is compared with all nodes of other
classes. A cell's nodes are dealt to parts of about PART, to each of which the nodes outside of the largest class go.

Defined cases: null text is empty; texts without words are one class; a null doc_id counts for no class id; repeated rows are
rows of their own in one class; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import simhash
from keelson.llm.common import map_batches, materialize, small_batches
from keelson.llm.components import components

SEED, SHINGLE = 42, 5
#: The least similarity, as a fraction.
ALIKE, OF = 4, 5
BANDS, ROWS = 28, 5
#: Parts that a hub's pairs, and that a cell's nodes, are dealt to; nodes in a part where cells are compared in full.
SALTS, CELL_SALTS, PART = 64, 16, 256

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93), (32, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def shingles(text: str) -> np.ndarray:
    """The set of shingle digests, in order."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digests = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    wide = min(SHINGLE, len(words))
    n = len(words) - wide + 1
    out = np.full(n, wide, dtype=np.uint64)
    for i in range(wide):
        out = _mix(out ^ digests[i : i + n])
    return np.unique(out)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the similarity; two empty ones have."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * ALIKE:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= (len(a) + len(b) - both) * ALIKE


def cells(found: np.ndarray) -> np.ndarray:
    """A set's cell keys, one a band."""
    least = np.full(BANDS * ROWS, _NONE)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * _ODD).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mix(keys ^ row)
    return keys.view(np.int64)


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), text.alias("text"))


def nodes(documents: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), node (of its shingle set), cells, print (the SimHash fingerprint)."""

    def run(x: dict[str, list]) -> dict[str, list]:
        sets = list(map(shingles, x["text"]))
        return {"doc_id": x["doc_id"], "digest": x["digest"], "node": list(map(_node, sets)), "cells": [cells(s) for s in sets], "print": list(map(simhash.simhash, x["text"]))}

    return map_batches(_texts(documents), run, "doc_id long, digest long, node long, cells array<long>, print long")


def _sets(documents: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, found: the shingle sets of the wanted nodes, each from one of its documents."""
    one = F.min(F.struct("doc_id", "digest")).alias("x")
    of = rows.join(wanted, "node", "left_semi").groupBy("node").agg(one).select(F.col("x.doc_id").alias("d"), F.col("x.digest").alias("g"))
    texts = _texts(documents).join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left_semi").select("text")

    def run(x: dict[str, list]) -> dict[str, list]:
        sets = list(map(shingles, x["text"]))
        return {"node": list(map(_node, sets)), "found": [s.tobytes() for s in sets]}

    return map_batches(texts, run, "node long, found binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked. A hub's set goes only to the parts that its pairs are dealt to."""
    small_batches(pairs.sparkSession)
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    hubs = pairs.select("b", "part").distinct().join(sets, F.col("b") == F.col("node")).select(F.col("b").alias("hub"), F.col("part").alias("of"), F.col("found").alias("y"))
    met = pairs.join(sets.select("node", F.col("found").alias("x")), F.col("a") == F.col("node")).join(hubs, (F.col("b") == F.col("hub")) & (F.col("part") == F.col("of")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("x"), batch.column("y"), strict=True)
            linked = [alike(*(np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in side)) for side in sides]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _met_by_cell(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Members with what is chosen for their cell; a large cell's members are dealt to parts."""
    chosen = chosen.withColumnRenamed("cell", "c").withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(CELL_SALTS - 1))))
    part = F.pmod(F.xxhash64("node"), F.lit(CELL_SALTS))
    return members.join(chosen, (F.col("cell") == F.col("c")) & (part == F.col("of"))).drop("c", "of")


def _with_root(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("cell", "node", F.coalesce("root", "node").alias("root"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple[bool, int, int, np.ndarray]]]]:
    """(cell, part) and its rows: outer, node, root, set."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "outer", "node", "root", "found")), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:2]):
        yield key, ((outer, node, root, np.frombuffer(found, dtype=np.uint64)) for _, _, outer, node, root, found in group)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: a link of each outer node to each class it is linked with in its part; a part's own nodes come before the outer ones."""
    for _, rows in _groups(batches):
        own: list[tuple[int, int, np.ndarray]] = []
        out: list[tuple[int, int]] = []
        words = None
        for outer, node, root, found in rows:
            if not outer:
                own.append((node, root, found))
                continue
            if not own:
                continue
            if words is None:
                names, roots = (np.array([o[i] for o in own], dtype=np.int64) for i in (0, 1))
                sizes = np.array([len(o[2]) for o in own])
                full = np.flatnonzero(sizes)
                words, at = np.unique(np.concatenate([o[2] for o in own]), return_inverse=True)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
            both = np.zeros(len(own), dtype=np.int64)
            if len(words) and len(found):
                held = np.zeros(len(words), dtype=np.int32)
                place = np.minimum(np.searchsorted(words, found), len(words) - 1)
                held[place[words[place] == found]] = 1
                both[full] = np.add.reduceat(held[at], starts)
            hit = np.flatnonzero((both * OF >= (sizes + len(found) - both) * ALIKE) & (roots != root))
            out += [(node, int(names[hit[i]])) for i in np.unique(roots[hit], return_index=True)[1]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _links_across(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: what links the classes of each cell that holds several."""
    small_batches(members.sparkSession)
    rooted = _with_root(members, roots)
    classes = rooted.groupBy("cell", "root").agg(F.count("*").alias("k"))
    largest = F.max_by("root", F.struct("k", "root")).alias("largest")
    shared = classes.groupBy("cell").agg(F.sum("k").alias("n"), F.count("*").alias("classes"), largest).where("classes > 1")
    met = _met_by_cell(rooted, shared).withColumn("parts", F.ceil(F.col("n") / PART))
    met = materialize(met.select("cell", "node", "root", "parts", (F.col("root") != F.col("largest")).alias("far")), "open")
    own = met.select("cell", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(False).alias("outer"), "node", "root")
    outer = met.where("far").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("outer"), "node", "root")
    rows = own.unionByName(outer).join(sets.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).drop("n")
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "outer", "node").mapInArrow(_compared, "a long, b long")


def linked_by_print(rows: DataFrame) -> DataFrame:
    """a, b: what links the nodes of each SimHash class, which is simhash's: fingerprints that links of RADIUS bits or fewer connect."""
    roots = components(simhash.link(rows.select("print").distinct())).withColumnRenamed("node", "p")
    classes = rows.select("node", "print").distinct().join(roots, F.col("print") == F.col("p"), "left").select("node", F.coalesce("root", "print").alias("class")).distinct()
    least = classes.groupBy("class").agg(F.min("node").alias("b")).withColumnRenamed("class", "c")
    return classes.join(least, F.col("class") == F.col("c")).where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")


def link(documents: DataFrame, rows: DataFrame, by_print: DataFrame | None = None) -> DataFrame:
    """node, root: the classes of linked nodes, for nodes other than roots. by_print: links by fingerprint, which count as those found here do."""
    spread = rows.select("node", "cells").dropDuplicates(["node"]).select(F.explode("cells").alias("cell"), "node")
    shared = spread.groupBy("cell").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = materialize(_met_by_cell(spread, shared), "members")
    sets = materialize(_sets(documents, rows, members.select("node").distinct()), "sets")
    hubs = [members.where(F.col("node") != F.col(hub)).select(F.greatest("node", hub).alias("a"), F.least("node", hub).alias("b"), F.col(hub).alias("hub")) for hub in ("least", "most")]
    pairs = hubs[0].unionByName(hubs[1]).groupBy("a", "b").agg(F.min("hub").alias("hub"))
    pairs = pairs.select(F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("hub").alias("b"))
    links = _verified(pairs, sets).where("linked").select("a", "b")
    links = materialize(links if by_print is None else links.unionByName(by_print), "links")
    across = materialize(_links_across(members.select("cell", "node"), components(links), sets), "links")
    return components(links.unionByName(across))


def near_duplicates(documents: DataFrame, prints: bool = False) -> DataFrame:
    """Per document: doc_id, digest, node, root (of its class). With prints SimHash links documents too."""
    rows = materialize(nodes(documents), "nodes")
    roots = link(documents, rows, linked_by_print(rows) if prints else None).withColumnRenamed("node", "n")
    return rows.join(roots, F.col("node") == F.col("n"), "left").select("doc_id", "digest", "node", F.coalesce("root", "node").alias("root"))


def keep_first(documents: DataFrame, prints: bool = False) -> DataFrame:
    """The documents without near-duplicates, with prints those by SimHash too: one of each class, chosen as simhash.keep_first chooses. All columns stay."""
    return simhash.first_of_class(documents, near_duplicates(documents, prints))
