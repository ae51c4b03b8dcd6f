"""Document fingerprints by content-defined chunking.

A 32-bit gear hash rolls over the UTF-8 bytes (each byte's table value shifted out after 32 steps), so a
boundary depends on the 32 bytes before it only. Normalised chunking: past MIN_BYTES a boundary needs seven
zero bits until NORMAL_BYTES and five zero bits from there; MAX_BYTES ends a chunk at the latest. A fingerprint is the sorted set
of (48-bit XXH64 digest, length) of the chunks, as text: fifteen hexadecimal digits a chunk, joined by commas. An
insertion or deletion moves boundaries only near itself. Likeness is containment weighted by length: bytes in
shared chunks over the bytes of the smaller set.

Defined cases: null text is empty; two empty sets are alike (1), an empty and another aren't (0); the next
document is by descending doc_id, nulls last, ties by a hash of the text, then by text, and the first follows the last; repeated rows are rows
of their own; an empty table gives no row; extra columns are ignored; texts of any length are hashed in blocks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import arrow_schema, count_below, shuffle_partitions, small_batches, table

MIN_BYTES, NORMAL_BYTES, MAX_BYTES = 16, 64, 256
STRICT, LOOSE = np.uint32((1 << 7) - 1 << 20), np.uint32((1 << 5) - 1 << 20)
#: Gear values by rule: 32 bits of the XXH64 of each byte.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)
BLOCK = 1 << 21


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window five times."""
    h = GEAR[data]
    for span in (1, 2, 4, 8, 16):
        if len(h) > span:
            h[span:] = h[span:] + (h[:-span] << np.uint32(span))
    return h


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks."""
    data, n = np.frombuffer(raw, dtype=np.uint8), len(raw)
    strict: list[int] = []
    loose: list[int] = []
    for start in range(0, n, BLOCK):
        before = max(0, start - 31)
        h = gear_hashes(data[before : start + BLOCK])[start - before :]
        near = np.flatnonzero((h & LOOSE) == 0)
        loose += (near + (start + 1)).tolist()
        strict += (near[(h[near] & STRICT) == 0] + (start + 1)).tolist()
    ends, at = [], 0
    while n - at > MIN_BYTES:
        k = bisect_left(strict, at + MIN_BYTES)
        if k < len(strict) and strict[k] < at + NORMAL_BYTES:
            at = strict[k]
        else:
            k = bisect_left(loose, at + NORMAL_BYTES)
            at = min(loose[k] if k < len(loose) else n, at + MAX_BYTES, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """Digest to length of each different chunk; a digest holds the chunk's length in its low bits."""
    raw = text.encode()
    found, at, digest = {}, 0, xxhash.xxh64_intdigest
    for end in boundaries(raw):
        found[digest(raw[at:end], 7) >> 16 << 12 | end - at] = end - at
        at = end
    return found


def fingerprint(chunks: dict[int, int]) -> str:
    return ",".join([f"{x:015x}" for x in sorted(chunks)])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    least = min(sum(a.values()), sum(b.values()))
    if not least:
        return float(not a and not b)
    return sum(a[x] for x in a.keys() & b.keys()) / least


PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successor(documents: DataFrame) -> DataFrame:
    """Deals documents to buckets of descending doc_id and copies each bucket's first row to the bucket before it, so
    that every row meets its successor while streaming. A doc_id that fills several buckets, and null, are cut by a hash of
    the text. Text is shuffled once; the driver sees a few numbers a bucket."""
    spark = documents.sparkSession
    n = shuffle_partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    cuts, unknown = sorted(found[0] or []), -(-n * found[2] // max(found[1], 1))
    # a doc_id that is several cuts has as many buckets, which hold ranges of the mark
    below, upto = count_below(cuts, F.col("doc_id")), count_below(cuts, F.col("doc_id"), include=True)
    part = (F.col("mark") / float(1 << 64) + 0.5).cast("double")
    known = F.lit(len(cuts)) - upto + F.least(F.floor(part * (upto - below)), F.greatest(upto - below - 1, F.lit(0)))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + F.least(F.floor(part * unknown), F.lit(max(unknown - 1, 0)))).otherwise(known).cast("int"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), (-F.col("doc_id")).alias("down"), F.col("mark"))
    tops = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.min(place).alias("top")).collect()}
    order = sorted(tops)
    if not order:
        return rows.withColumn("ahead", F.lit(0)).drop("mark").limit(0)
    prior = {b: order[i - 1] for i, b in enumerate(order)}
    every = range(len(cuts) + 1 + max(unknown, 1))
    seat = F.array(*[F.lit(prior.get(b, 0)) for b in every])
    top_id = F.array(*[F.lit(None if b not in tops or tops[b]["down"] is None else -tops[b]["down"]).cast("long") for b in every])
    top_mark = F.array(*[F.lit(tops[b]["mark"] if b in tops else None).cast("long") for b in every])
    first = F.col("doc_id").eqNullSafe(F.get(top_id, F.col("bucket"))) & (F.col("mark") == F.get(top_mark, F.col("bucket")))
    own = F.struct(F.col("bucket"), F.lit(0).alias("ahead"))
    copy = F.struct(F.get(seat, F.col("bucket")).alias("bucket"), F.lit(1).alias("ahead"))
    dealt = rows.withColumn("to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "mark", "to.bucket", "to.ahead").repartitionById(len(every), F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "mark", "text").drop("mark")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and likeness to the edited text and the next document."""
    small_batches(documents.sparkSession)
    schema = arrow_schema(documents.sparkSession, PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def closed(x: tuple, text: str, chunks: dict[int, int]) -> dict:
            half = len(x[1]) // 2
            edited = x[1][: len(x[1]) - half] + text[:half]
            new = chunk_set(edited)
            return {"doc_id": x[0], "n_chars": len(x[1]), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": fingerprint(x[2]), "edited_fingerprint": fingerprint(new), "near_edited": likeness(x[2], new), "near_next": likeness(x[2], chunks)}

        for batch in batches:
            out = []
            for doc_id, text, bucket, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "ahead")), strict=True):
                if ahead and held is None:
                    continue
                chunks = chunk_set(text)
                if held is not None:
                    out.append(closed(held, text, chunks))
                held = None if ahead else (doc_id, text, chunks)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return with_successor(documents).mapInArrow(run, PRINTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
