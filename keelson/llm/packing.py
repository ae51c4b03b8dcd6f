"""Best-two-fit packing of documents into sequences of at most SIZE tokens.

A document is its ids and the id END. Documents longer than SIZE are cut into pieces of SIZE, of which only the first may be shorter, so
a document has one piece at most that doesn't fill a sequence alone.

What a piece adds to a packing is its length, and there are SIZE lengths: the packing is planned on the number of pieces of each length (SIZE
numbers, whatever the table's size), and pieces of the same length take the plan's places in the order of their numbers. Best-two-fit
fills a sequence greedily with the longest piece that fits, again and again, and then replaces the shortest of them with two unpacked pieces
that fit the gap it leaves more tightly: the two with the largest sum. Sequences that come out alike are planned together, as
many as the pieces last for, which gives what packing one sequence after the other gives.

A piece's number among those of its length is its number within its part of the table, as written, and the number of such pieces in the parts
before it; no task sees more than a part, and pieces that fill a sequence aren't numbered.

Ids are those of the byte-level vocabulary. A text is cut before each space that precedes another character than white space, which is always a
border of the pattern's matches; what lies between is encoded once and kept while there is room (CACHED strings of a worker).

Defined cases: null and empty texts are END alone; a null doc_id is kept; repeated rows and repeated doc_ids are documents of their own; pieces of the same
length are interchangeable, so which of them shares a sequence with which may change where the table's files change; an empty table gives no row;
extra columns are ignored; the texts of special tokens are plain text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.bpe import load_ranks
from keelson.llm.common import arrow_schema, give_back, materialize, small_batches, table, text_or_empty

SIZE, END = 1024, 2
#: Strings whose ids a worker keeps, and the longest of them.
CACHED, CACHED_CHARS = 500_000, 64
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, number long"
PLAN = "length int, first long, n long, alike long, sequence long, place int"

_words = re.compile(r" (?=\S)").split


class _Ids(dict):
    """The ids of a string, as bytes of unsigned 32-bit little-endian numbers, encoded when they are first asked for."""

    def __init__(self, encode, before: str) -> None:
        self.encode, self.before = encode, before

    def __missing__(self, text: str) -> bytes:
        ids = array("I", self.encode(self.before + text)).tobytes()
        if len(self) < CACHED and len(text) <= CACHED_CHARS:
            self[text] = ids
        return ids


@cache
def encoder(path: str, pattern: str = public_tokenizers.PATTERN):
    """Text to the bytes of its ids, by the ranks in a file. One a worker, with its strings."""
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
    if pattern != public_tokenizers.PATTERN:  # other patterns may have matches with a space inside
        return lambda text: array("I", encode(text)).tobytes()
    after_space = _Ids(encode, " ").__getitem__

    def ids_of(text: str) -> bytes:
        first, *rest = _words(text)
        return array("I", encode(first)).tobytes() + b"".join(map(after_space, rest))

    return ids_of


def pieces(documents: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The pieces of all documents, each with its part of the table and its number among those of its length there. No shuffle."""
    small_batches(documents.sparkSession)
    schema, last = arrow_schema(documents.sparkSession, PIECES), array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, part = encoder(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(ids_of(text.as_py()) + last)
                total = len(ids) // 4
                ends = range((total - 1) % size + 1, total + 1, size)
                for piece, until in enumerate(ends):
                    start = ends[piece - 1] if piece else 0
                    length = until - start
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * until]), part, seen[length]))
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text")).mapInArrow(run, PIECES)


def _greedy(lengths: list[int], left: dict[int, int], size: int) -> tuple[Counter, int]:
    """The longest piece that fits, again and again; lengths ascend. Also the gap."""
    taken, gap, at = Counter(), size, len(lengths)
    while at := bisect_right(lengths, gap, 0, at):
        length = lengths[at - 1]
        taken[length] = min(left[length], gap // length)
        gap -= length * taken[length]
        at -= 1
    return taken, gap


def _two(lengths: list[int], left: dict[int, int], taken: Counter, above: int, most: int) -> tuple[int, int] | None:
    """The unpacked two with the largest sum over `above` and up to `most`."""
    free = [x for x in lengths if left[x] > taken[x] and x < most]
    best, i, j = None, 0, len(free) - 1
    while i <= j:
        both = free[i] + free[j]
        if both > most or (i == j and left[free[i]] - taken[free[i]] < 2):
            j -= 1
            continue
        if both > above:
            best, above = (free[i], free[j]), both
        i += 1
    return best


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """Packs counts[length] pieces of each length up to size: sequences as (how many alike, pieces of each length)."""
    left, plan = {x: n for x, n in counts.items() if n}, []
    lengths = sorted(left)
    while lengths:
        taken, gap = _greedy(lengths, left, size)
        use, asked = Counter(taken), Counter(taken)
        shortest = min(taken)
        if gap and (two := _two(lengths, left, taken, shortest, shortest + gap)):
            use[shortest] -= 1
            use.update(two)
            asked.update(two)
        # the next sequence comes out the same while all that this one looked for is there
        alike = min([(left[x] - n) // use[x] + 1 for x, n in asked.items() if use[x]])
        plan.append((alike, {x: n for x, n in sorted(use.items(), reverse=True) if n}))
        for x, n in use.items():
            left[x] -= alike * n
        lengths = [x for x in lengths if left[x]]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple]:
    """Rows of PLAN: pieces number first to first + n of a length go to `alike` sequences in turn, from `place` on in each."""
    rows, met, sequence = [], Counter(), 0
    for alike, used in plan:
        place = 0
        for length, n in used.items():
            rows.append((length, met[length], n * alike, alike, sequence, place))
            met[length] += n * alike
            place += n * length
        sequence += alike
    return rows


def pack(documents: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. Sequences with one whole piece have negative numbers."""
    spark = documents.sparkSession
    cut = materialize(pieces(documents, path, size, end), "pieces")
    short = cut.where(F.col("length") < size)
    by_part = short.groupBy("part", "length").agg(F.count("*").alias("__n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = by_part.select("part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length, fewer than size
    plan = F.broadcast(spark.createDataFrame(places(best_two_fit(counts, size)), PLAN))  # its rows follow from the lengths, not from the table
    numbered = short.join(firsts, ["part", "length"]).withColumn("number", F.col("number") + F.col("__before"))
    into = F.col("number") - F.col("first")
    met = numbered.join(plan, "length").where((into >= 0) & (into < F.col("n")))
    shared = met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + into % F.col("alike")).alias("sequence_id"), (F.col("place") + F.floor(into / F.col("alike")) * F.col("length")).alias("offset"))
    alone = cut.where(F.col("length") == size)
    alone = alone.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.shiftleft(F.col("part").cast("long"), 40) - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone).withColumn("length", F.col("length").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
