"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern; each different piece is encoded once per part of the table and looked up
for the rest (anew once a part's dictionary has OWN_PIECES). Pieces go ahead of the batch of documents that needs them, so a task holds a
dictionary and a batch. Encoding is a fold of Spark's higher-order functions over a piece's bytes: the state is the array of its parts,
each a long of the rank of the merge with the next part and the part's start, so that the least element is the next merge, the
leftmost on ties; a step puts the merged part and its left neighbour, with the ranks of their next merges, in the place of three parts. Ranks
come from a literal rank map (Spark scans a map's keys, so the literal is an array of small maps by the CRC of the piece).
Bytes are held as characters U+0000 to U+00FF. A batch of documents is put together from its pieces' ids, and decoding concatenates the vocabulary's pieces of these.

Pieces that are common in a bounded sample of documents (SAMPLE_DOCUMENTS of them, COMMON pieces) are encoded first and broadcast;
that saves work and changes nothing. Pieces over LONG bytes, whose fold would be quadratic, are merged by a heap.

Defined cases: null text is empty and has no ids; ids depend on the text alone, so repeated rows are alike; a null doc_id is
kept; an empty table gives no row; extra columns are ignored; the texts of special tokens are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import arrow_schema, give_back, small_batches, table

SAMPLE_DOCUMENTS, COMMON = 16_000, 200_000
LONG, BUCKETS = 256, 1 << 14
#: Pieces after which a dictionary is begun anew, and pieces in a row.
OWN_PIECES, ROW_PIECES = 400_000, 1 << 14
#: Parts of the table that one task takes, and bytes of an Arrow batch.
MERGED_PARTS, BATCH_BYTES = 3, 8 << 20
#: Pieces that are put together at once, or those of a document that has more.
DIGESTED = 1 << 18
_NONE, _STARTS = 1 << 20, 1 << 20
#: A character that no byte is held as.
_PAD = "\u0100"


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a file of lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


#: Characters for which `re` and the pattern's own classes agree: Latin letters, ASCII, common punctuation.
_ODD = re.compile("[^\\t-\\r\\x20-\\x7e\\xa1-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u024f\\u2010-\\u2027]")
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: The default pattern for such texts, the most frequent matches first (order matters only for apostrophes and white space).
_PLAIN = re.compile(rf" [{_LETTERS}]++|[{_LETTERS}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s{_LETTERS}0-9]++|\s+(?!\S)|\s+")


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into the matches of the pattern; for the default pattern plain texts take a faster equal one."""
    full = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return full
    odd, plain = _ODD.search, _PLAIN.findall
    return lambda text: full(text) if odd(text) else plain(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once for body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def encode_pieces(pieces: Column, ranks: dict[bytes, int]) -> Column:
    """Array of byte strings to array of id arrays; empty strings give none."""
    none = F.lit(_NONE * _STARTS)

    def with_table(found: Column) -> Column:
        def rank(x: Column) -> Column:
            return F.coalesce(F.try_element_at(F.get(found, (F.crc32(x) % BUCKETS).cast("int")), x), F.lit(_NONE))

        def begin(part: Column) -> Column:
            return part.bitwiseAND(_STARTS - 1).cast("int")

        def merges(texts: Column, starts: Column) -> Column:
            return F.zip_with(texts, starts, lambda x, start: rank(x).cast("long") * _STARTS + start)

        def encode(piece: Column) -> Column:
            n = F.length(piece)
            inner = F.sequence(F.lit(2), n)

            def fold(padded: Column) -> Column:
                # the pads are in no token, so that the ends need no cases of their own
                def between(a: Column, b: Column) -> Column:
                    return F.substring(padded, a, b - a)

                def merge(parts: Column, least: Column, k: Column) -> Column:
                    # part k takes in part k + 1 (k counts from 1)
                    a, b, c, d = begin(F.get(parts, k - 2)), begin(least), begin(F.get(parts, k + 1)), begin(F.get(parts, k + 2))
                    return F.flatten(F.array(F.slice(parts, F.lit(1), k - 2), merges(F.array(between(a, c), between(b, d)), F.array(a, b)), F.slice(parts, k + 2, n)))

                def step(parts: Column, _: Column) -> Column:
                    # starts ascend, so those up to the least part's give its place; array_position took over half of the fold's time
                    place = lambda least: F.size(F.filter(parts, lambda x: x.bitwiseAND(_STARTS - 1) <= least.bitwiseAND(_STARTS - 1)))
                    return let(F.array_min(parts), lambda least: F.when(least < none, let(place(least), lambda k: merge(parts, least, k))).otherwise(parts))

                def ids(parts: Column) -> Column:
                    return F.transform(F.transform(F.sequence(F.lit(1), F.size(parts) - 3), lambda i: between(begin(F.get(parts, i)), begin(F.get(parts, i + 1)))), rank)

                pairs = merges(F.transform(inner, lambda i: F.substring(padded, i, F.lit(2))), inner)
                first = F.concat(F.array(none + 1), pairs, F.array(none + (n + 1), none + (n + 2), none + (n + 3)))
                return F.aggregate(inner, first, step, ids)

            merged = let(F.concat(F.lit(_PAD), piece, F.lit(_PAD)), fold)
            whole = let(rank(piece), lambda r: F.when((r < _NONE) | (n < 2), F.array(r)).otherwise(merged))
            return F.when(n == 0, F.array().cast("array<int>")).otherwise(whole)

        return F.transform(pieces, encode)

    return let(rank_literal(ranks), with_table)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for long pieces."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] - i != size:
            continue
        alive[j], ends[i], after[i] = False, ends[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (r := ranks.get(piece[left : ends[right]])) is not None:
                heapq.heappush(heap, (r, left, ends[right] - left))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


def common_pieces(documents: DataFrame, ranks: dict[bytes, int], pattern: str, documents_read: int, most: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces of a bounded sample of documents, how many ids each has, and all these ids."""
    n = documents.count()
    if n > documents_read:
        documents = documents.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < (documents_read << 20) // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = cutter(pattern), {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for x in cut(text):
                    seen[x] = seen.get(x, 0) + 1
        words = [x for x in seen if len(x.encode()) <= LONG]
        for at in range(0, len(words), ROW_PIECES):
            part = words[at : at + ROW_PIECES]
            yield pa.RecordBatch.from_arrays([pa.array([x.encode().decode("latin-1") for x in part]), pa.array([seen[x] for x in part], pa.int64())], names=["piece", "n"])

    words = documents.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    words = words.where(F.col("n") > 1).orderBy(F.desc("n"), "piece").limit(most)
    encoded = words.repartition(24).select("piece", encode_pieces(F.array("piece"), ranks)[0].alias("ids")).toArrow()
    found: list[str] = []
    for batch in encoded.to_batches(max_chunksize=10_000):
        found.extend(piece.encode("latin-1").decode() for piece in batch.column(0).to_pylist())
    ids = encoded.column(1)
    return found, *(np.concatenate([np.zeros(0, dtype=np.int32), *(part(x) for x in ids.chunks)]) for part in (_sizes, _values))


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()).astype(np.int32)


def _values(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.int32)


def _digests(parts: pa.Array, ends: np.ndarray, between: bytes = b"") -> list[str]:
    """Digests of runs of parts, each of which is followed by `between`, which the last one of a run isn't."""
    offsets = np.frombuffer(parts.buffers()[1], dtype=np.int64) if len(parts) else np.zeros(1, dtype=np.int64)
    data, at, out = memoryview(parts.buffers()[2] or b""), 0, []
    for end in offsets[ends].tolist():
        out.append(hashlib.sha256(data[at : max(at, end - len(between))]).hexdigest())
        at = end
    return out


CUT = "doc_ids array<long>, counts array<int>, places binary, pieces array<string>, long array<string>"
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


class _Places(dict):
    """Places of pieces: common ones from 0 on, then others in the order they are met."""

    def __init__(self, words: list[str]) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.first = len(words)
        self.own: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = self.first + len(self.own)
        self.own.append(piece)
        return place

    def forget(self) -> None:
        for piece in self.own:
            del self[piece]
        self.own = []


def _cut(documents: DataFrame, pattern: str, common: object, most_own: int = OWN_PIECES) -> DataFrame:
    """For each batch of documents rows of the pieces that weren't met before, then a row of its documents as places in the dictionary of common and met pieces. A row without
    pieces and documents ends the dictionary."""
    schema = arrow_schema(documents.sparkSession, CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, places_of = cutter(pattern), _Places(common.value)
        place = places_of.__getitem__
        for batch in batches:
            ids, places, sent = [], [], len(places_of.own)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = cut(text)
                ids.append(doc_id)
                places.append(np.fromiter(map(place, words), dtype=np.int32, count=len(words)))
            for at in range(sent, len(places_of.own), ROW_PIECES):
                part = [x.encode().decode("latin-1") for x in places_of.own[at : at + ROW_PIECES]]
                large = [x if len(x) > LONG else "" for x in part] if max(map(len, part)) > LONG else None
                yield pa.RecordBatch.from_pylist([{"pieces": [x if len(x) <= LONG else "" for x in part] if large else part, "long": large}], schema=schema)
            if ids:
                yield pa.RecordBatch.from_pylist([{"doc_ids": ids, "counts": [len(p) for p in places], "places": np.concatenate(places).tobytes()}], schema=schema)
            if len(places_of.own) >= most_own:
                yield pa.RecordBatch.from_pylist([{"doc_ids": []}], schema=schema)
                places_of.forget()
        give_back()

    return documents.mapInArrow(run, CUT)


def encode_documents(documents: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, documents_read: int = SAMPLE_DOCUMENTS, most: int = COMMON, keep_ids: bool = True, merged_parts: int = MERGED_PARTS, most_own: int = OWN_PIECES, digested: int = DIGESTED) -> DataFrame:
    """Per document: doc_id, n_tokens, digests of the ids and of the bytes they decode to, and the ids (null without keep_ids). No shuffle."""
    spark = documents.sparkSession
    small_batches(spark, BATCH_BYTES)
    ranks = load_ranks(path)
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common, sizes, values = common_pieces(rows, ranks, pattern, documents_read, most)
    words, encoded = spark.sparkContext.broadcast(common), spark.sparkContext.broadcast((sizes, values))
    # larger parts share more pieces
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // merged_parts)))
    table_of_ranks = spark.sparkContext.broadcast(ranks)
    schema = arrow_schema(spark, CODED)
    coded = _cut(rows, pattern, words, most_own).select("doc_ids", "counts", "places", "long", encode_pieces(F.col("pieces"), ranks).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_sizes, common_ids = encoded.value
        known = [[common_sizes], [common_ids]]
        vocabulary = [b""] * (max(table_of_ranks.value.values(), default=-1) + 1)
        for piece, rank in table_of_ranks.value.items():
            vocabulary[rank] = piece
        bytes_of = pa.array(vocabulary, pa.large_binary())
        texts_of = pa.array([b"%d " % i for i in range(len(vocabulary))], pa.large_binary())

        def closed(doc_ids: list, counts: list[int], here: np.ndarray) -> pa.RecordBatch:
            sizes, values = (x[0] for x in known)
            size = sizes[here].astype(np.int64)
            after = np.cumsum(size)
            ids = values[np.repeat((np.cumsum(sizes, dtype=np.int64) - sizes)[here] - (after - size), size) + np.arange(len(here) and after[-1])]
            ends = np.concatenate([[0], after])[np.cumsum(counts)]  # of documents, among the ids
            starts = np.concatenate([[0], ends])
            taken = pa.array(ids)
            out = (doc_ids, np.diff(starts), _digests(texts_of.take(taken), ends, b" "), _digests(bytes_of.take(taken), ends), [ids[a:b] for a, b in zip(starts, ends, strict=False)] if keep_ids else [None] * len(ends))
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):  # a row holds ROW_PIECES pieces or a batch of documents
                ids, long = (batch.column(c).slice(k, 1) for c in ("ids", "long"))
                if ids[0].is_valid:
                    ids, long = ids.flatten(), long[0].as_py()
                    if long is not None:
                        ids = pa.array([merge_long(x.encode("latin-1"), table_of_ranks.value) if x else found for x, found in zip(long, ids.to_pylist(), strict=True)], ids.type)
                    known[0].append(_sizes(ids))
                    known[1].append(_values(ids))
                    continue
                doc_ids, counts, places = (batch.column(c)[k].as_py() for c in ("doc_ids", "counts", "places"))
                if doc_ids:
                    known = [[np.concatenate(x)] if len(x) > 1 else x for x in known]
                    ends, flat = np.concatenate([[0], np.cumsum(counts)]), np.frombuffer(places, dtype=np.int32)
                    for a, b in pairwise([0, *(np.flatnonzero(np.diff(ends[1:] // digested)) + 1).tolist(), len(doc_ids)]):
                        yield closed(doc_ids[a:b], counts[a:b], flat[ends[a] : ends[b]])
                else:
                    known = [[common_sizes], [common_ids]]
        give_back()

    return coded.mapInArrow(run, CODED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False).drop("ids")
