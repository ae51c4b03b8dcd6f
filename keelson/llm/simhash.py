"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints are mapped to the bit counts of SEGMENTS two-bit segments. The Manhattan distance of two such vectors
is a lower bound of their Hamming distance, so fingerprints that differ in `radius` bits lie within `radius` there.
The range join is over grid cells: the segments form radius + chosen groups, of which a pair within the radius shares at least
`chosen`, so each choice of that many groups with their counts is a cell key, and every linked pair shares a cell. Inside a
cell candidates are those within the Manhattan radius, and each is verified by its exact Hamming distance.

The more fingerprints, the more groups are chosen, so that a cell holds few of them: three give 2**24 cells or so, five 2**30,
seven 2**33. Fingerprints of cells over CELL are dealt anew with two groups more, which loses no link and breaks up hot cells, until GROUPS[-1].
A cell of that last grid may be of any size: it holds fingerprints that agree in the bit counts of 22 given segments.

Only different fingerprints are joined. A cell up to PAIRWISE of them is compared in pairs, a larger one by a
search that follows links and takes what it reaches out of the rest, so that a cell gives a spanning forest and never all
its pairs. Cells stream through a task in order; of one over CELL no more than CELL are held before it is passed on.

Defined cases: null text is empty; fingerprint zero (no words) links like any other; a null doc_id counts for no
class id (null where all are null); repeated rows are rows of their own in one class; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import map_batches, materialize, table
from keelson.llm.components import components

SEED, SHINGLE, RADIUS, SEGMENTS = 42, 3, 3, 32
PAIRWISE, CELL = 48, 2048
#: Groups that are chosen for a cell, and different fingerprints up to which a number of groups is taken first.
GROUPS, UP_TO = (3, 5, 7), (1 << 24, 1 << 31)
_LANES = 0x5555555555555555


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint, as a signed long."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) >= shingle else [b" ".join(words)]
    digests = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), 65536):
        part = digests[at : at + 65536].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(digests))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def embed(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, side by side in a word."""
    lanes = np.uint64(_LANES)
    return (prints & lanes) + ((prints >> np.uint64(1)) & lanes)


#: By 16 bits of four lanes that hold 4 + difference: the sum of absolute differences.
_ABS = sum(np.abs(((np.arange(1 << 16) >> s) & 15) - 4) for s in (0, 4, 8, 12)).astype(np.uint8)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, four = np.uint64(0x3333333333333333), np.uint64(0x4444444444444444)
    total = np.zeros(np.broadcast(a, b).shape, dtype=np.uint16)
    for shift in (np.uint64(0), np.uint64(2)):
        d = (((a >> shift) & low) | four) - ((b >> shift) & low)
        for k in (0, 16, 32, 48):
            total += _ABS[(d >> np.uint64(k)) & np.uint64(0xFFFF)]
    return total


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Within the Manhattan radius of the embedding, then verified by the Hamming distance."""
    near = manhattan(embed(a), embed(b)) <= radius
    near[near] = np.bitwise_count((a ^ b)[near]) <= radius
    return near


def _masks(groups: int, chosen: int) -> list[int]:
    """Masks of each choice of groups of segments."""
    parts = [sum(3 << (int(u) * 2) for u in g) for g in np.array_split(np.arange(SEGMENTS), groups)]
    return [sum(c) for c in combinations(parts, chosen)]


def cell_keys(prints: np.ndarray, radius: int, chosen: int) -> np.ndarray:
    """A row of cell keys for each fingerprint."""
    masks = np.array(_masks(radius + chosen, chosen), dtype=np.uint64)
    keys = (embed(prints)[:, None] & masks[None, :]) ^ (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93), (32, 1)):
        keys = (keys ^ (keys >> np.uint64(shift))) * np.uint64(factor)
    return keys


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of one cell: each fingerprint reached leaves the rest at once."""
    out, rest = [], prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            now = queue.pop()
            near = linked(np.full(1, now), rest, radius)
            for x in rest[near]:
                out.append((now, x))
                queue.append(x)
            rest = rest[~near]
    return out


def _cells(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Keys and fingerprints in sorted order, cut between cells, or (True) part of a cell that is over `most`."""
    keys = prints = np.zeros(0, dtype=np.int64)
    over = None
    for batch in batches:
        keys = np.concatenate([keys, batch.column("cell").to_numpy()])
        prints = np.concatenate([prints, batch.column("print").to_numpy()])
        if over is not None and (cut := int(np.searchsorted(keys, over, side="right"))):
            yield keys[:cut], prints[:cut], True
            keys, prints = keys[cut:], prints[cut:]
        if len(keys) and (cut := int(np.searchsorted(keys, keys[-1]))):
            yield keys[:cut], prints[:cut], False
            keys, prints = keys[cut:], prints[cut:]
        if most is not None and len(keys) > most:
            over = keys[0]
            yield keys, prints, True
            keys, prints = keys[:0], prints[:0]
    if len(keys):
        yield keys, prints, False


def _links(cells: DataFrame, radius: int, most: int | None) -> DataFrame:
    """a, b: links that connect each cell; a with a null b: a fingerprint of a cell over `most`, to be dealt anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, signed, over in _cells(batches, most):
            prints = signed.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            size_of = np.repeat(sizes, sizes)
            large = size_of > most if most is not None else np.zeros(len(keys), dtype=bool)
            if over:
                large[:] = True
            a, b = [], []
            small = (size_of <= PAIRWISE) & ~large
            for step in range(1, min(PAIRWISE, int(sizes.max()))):
                i = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
                if not len(i):
                    break
                i = i[linked(prints[i], prints[i + step], radius)]
                a.append(signed[i])
                b.append(signed[i + step])
            for s, n in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
                if not large[s]:
                    found = np.array(forest(prints[s : s + n], radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
                    a.append(found[:, 0])
                    b.append(found[:, 1])
            again = pa.array(signed[large])
            left, right = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(left), again]), pa.concat_arrays([pa.array(right), pa.nulls(len(again), pa.int64())])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _dealt(prints: DataFrame, radius: int, chosen: int) -> DataFrame:
    """cell, print: each fingerprint in each of its cells, cells together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("print").to_numpy()
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                keys = cell_keys(part.view(np.uint64), radius, chosen)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part, keys.shape[1]))], names=["cell", "print"])

    return prints.mapInArrow(run, "cell long, print long").repartition("cell").sortWithinPartitions("cell", "print")


def link(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Different fingerprints (print) within the radius of each other: a, b, enough of the links to connect all that any do."""
    n = prints.count()
    grids = GROUPS[sum(n > x for x in UP_TO) :]
    links = None
    for chosen in grids:
        last = chosen == grids[-1]
        found = materialize(_links(_dealt(prints, radius, chosen), radius, None if last else CELL), "links")
        own = found.where(F.col("b").isNotNull())
        links = own if links is None else links.unionByName(own)
        prints = found.where(F.col("b").isNull()).select(F.col("a").alias("print")).distinct()
        if last or prints.isEmpty():
            return links.distinct()
    raise AssertionError


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest (of the text, to tell rows of one doc_id apart), print."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return map_batches(rows, lambda x: {"doc_id": x["doc_id"], "digest": x["digest"], "print": [simhash(t, shingle) for t in x["text"]]}, "doc_id long, digest long, print long")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, digest, print, root (of its class), component_id (the least doc_id that links lead to)."""
    rows = materialize(fingerprints(documents, shingle), "prints")
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = components(link(classes.select("print"), radius))
    rooted = classes.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("print", "root").join(least, "root").select(F.col("print").alias("p"), "root", "component_id")
    return rows.join(named, F.col("print") == F.col("p")).select("doc_id", "digest", "print", "root", "component_id")


def keep_first(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the least doc_id (nulls last), then the least
    text digest, and one of rows that share both. All columns stay."""
    return first_of_class(documents, near_duplicates(documents, radius, shingle))


def first_of_class(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that come first in their class; found has doc_id, digest and root."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    first = found.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.digest").alias("__digest"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = documents.withColumn("__of", F.xxhash64(text)).join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__digest")), "left_semi")
    return met.dropDuplicates(["doc_id", "__of"]).drop("__of")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
