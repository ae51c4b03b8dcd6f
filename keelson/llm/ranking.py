"""Ranked lexical search by pipelined term partitioning.

Terms are partitioned among OWNERS owners: in descending order of weight, each with about as many postings. The items to search for are dealt into
bundles of BUNDLE items. A bundle goes from owner to owner and carries sparse accumulators, the documents met so far with their scores; each owner adds the integer
contributions of its terms, and after the last owner the best documents of each item are selected.

Documents lie in shards of SHARD documents in a row, cut where they are read, so the search needs no shuffle of texts: one pass counts each
document's terms and writes a shard's postings of the items' terms, by term. A stage cogroups one owner's postings with the bundles by shard: a task holds a
shard's postings of one owner and its accumulators, whatever the sizes of the table and of a term's list.

Between stages a bundle drops the documents that can't be among the k best any more: those whose score and the most that the owners to come can
add stay below the k-th best score that the shard has already. What is dropped has k better documents in its own shard, so the result is that
of adding everything up. A document met again after that has a part of its score at most, which is below the k-th best as well.

Items are searched in blocks of BLOCK_ITEMS items and BLOCK_CHARS characters about, each one pass over the documents; only a block's terms and statistics are
broadcast, never what grows with the documents.

Defined cases: null and empty texts have no term; items without a term have no row; rows with equal item_id and text are one item, other rows with the same item_id
are items of their own; repeated documents are documents of their own; equal scores go by doc_id, null last; fewer documents than k give fewer rows;
empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import arrow_schema, give_back, materialize, small_batches, table

OWNERS, BUNDLE = 4, 32
#: Documents and postings that close a shard.
SHARD, SHARD_POSTINGS = 8192, 2_000_000
BLOCK_ITEMS, BLOCK_CHARS = 1000, 16 << 20

#: Bytes that separate terms become a space, and A-Z become a-z.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

SHARDS = "shard long, holding long, total long, doc_ids array<long>, sizes array<long>, terms array<int>, lists array<int>, most array<int>, docs binary, times binary"
POSTINGS = "shard long, n int, terms array<int>, lists array<int>, docs binary, factors binary"
BUNDLES = "shard long, bundle int, sizes array<int>, docs binary, scores binary"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


@dataclass
class Items:
    """A block of items: their terms by number, with repeats."""

    terms: list[Counter]
    number: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Items:
        number: dict[bytes, int] = {}
        return cls([Counter(number.setdefault(t, len(number)) for t in terms_of(x)) for x in texts], number)


class Route:
    """The owners in order: what each item's terms weigh there, and the most that the owners after it can add to an item."""

    def __init__(self, items: Items, n: int, stats: dict[int, tuple[int, int]], owners: int) -> None:
        """n documents with terms; stats: documents that hold a term and its most occurrences in one, by the term's number."""
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, (df, _) in stats.items()}
        least = 100 - 25
        bound = {t: weight[t] * (1_000_000_000 * tf // (1000 * tf + 12 * least)) for t, (_, tf) in stats.items()}
        order, postings, met = sorted(stats, key=lambda t: (-weight[t], t)), sum(df for df, _ in stats.values()), 0
        owner = {}
        for t in order:
            owner[t] = (2 * met + stats[t][0]) * owners // (2 * postings)  # where the middle of its list lies among all
            met += stats[t][0]
        self.terms = [np.array(sorted(t for t in order if owner[t] == s and weight[t]), np.int64) for s in range(owners)]
        self.weights: list[list[list[tuple[int, int]]]] = [[[(t, weight[t] * k) for t, k in sorted(c.items()) if owner.get(t) == s and weight[t]] for c in items.terms] for s in range(owners)]
        self.rest = [[sum(bound[t] * k for t, k in c.items() if owner.get(t, -1) > s) for c in items.terms] for s in range(owners)]


def shards(documents: DataFrame, items: Items) -> DataFrame:
    """A row for each SHARD documents in a row: how many hold a term, all their terms, and the postings of the items' terms, by term."""
    spark = documents.sparkSession
    small_batches(spark)
    schema, shared = arrow_schema(spark, SHARDS), spark.sparkContext.broadcast(items.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, made = shared.value, TaskContext.get().partitionId(), 0
        known = number.keys()
        doc_ids: list = []
        sizes: list[int] = []
        terms: list[int] = []
        times: list[int] = []
        lengths: list[int] = []
        holding = total = 0

        def closed() -> pa.RecordBatch:
            term, doc, time = np.array(terms, np.int64), np.repeat(np.arange(len(doc_ids)), lengths), np.array(times, np.int64)
            order = np.argsort(term, kind="stable")
            term, doc, time = term[order], doc[order], time[order]
            own, first, count = np.unique(term, return_index=True, return_counts=True)
            most = np.maximum.reduceat(time, first) if len(first) else first
            row = ((part << 32) + made, holding, total, doc_ids, sizes, own, count, most, doc.astype(np.int32).tobytes(), time.astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_py())
                if words:
                    holding += 1
                    total += len(words)
                    counts = Counter(words)
                    found = counts.keys() & known
                    if found:
                        doc_ids.append(doc_id)
                        sizes.append(len(words))
                        lengths.append(len(found))
                        terms += map(number.__getitem__, found)
                        times += map(counts.__getitem__, found)
                if len(doc_ids) >= SHARD or len(terms) >= SHARD_POSTINGS:
                    yield closed()
                    made += 1
                    holding = total = 0
                    doc_ids, sizes, terms, times, lengths = [], [], [], [], []
        if holding:
            yield closed()
        give_back()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, SHARDS)


def postings(written: DataFrame, route: object, owner: int, n: int, total: int) -> DataFrame:
    """The postings of one owner's terms, with what an occurrence count makes of a weight in a document of that size."""
    schema = arrow_schema(written.sparkSession, POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = route.value.terms[owner]
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                terms, lists = np.array(r["terms"], np.int64), np.array(r["lists"], np.int64)
                here = np.isin(terms, own)
                kept = np.repeat(here, lists)
                docs, times = np.frombuffer(r["docs"], np.int32)[kept], np.frombuffer(r["times"], np.int32)[kept].astype(np.int64)
                length = 100 - 25 + 25 * np.array(r["sizes"], np.int64) * n // total
                factors = 1_000_000_000 * times // (1000 * times + 12 * length[docs])
                row = (r["shard"], len(length), terms[here], lists[here], docs.tobytes(), factors.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    columns = written.select("shard", "sizes", "terms", "lists", "docs", "times")
    return columns.mapInArrow(run, POSTINGS)


def visit(bundles: DataFrame, at_owner: DataFrame, route: object, owner: int, k: int) -> DataFrame:
    """All bundles at one owner: contributions are added, and documents that can't be among the k best go."""
    schema = arrow_schema(bundles.sparkSession, BUNDLES)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        weights, rest = route.value.weights[owner], route.value.rest[owner]
        listed = right.to_pylist()[0]
        ends = np.cumsum(listed["lists"], dtype=np.int64) if listed["lists"] else np.zeros(0, np.int64)
        docs, factors = np.frombuffer(listed["docs"], np.int32), np.frombuffer(listed["factors"], np.int32).astype(np.int64)
        place = {t: (e - n, e) for t, e, n in zip(listed["terms"], ends.tolist(), listed["lists"], strict=True)}
        out = []
        for r in left.to_pylist():
            at, known, carried = 0, np.frombuffer(r["docs"], np.int32), np.frombuffer(r["scores"], np.int64)
            new: list[tuple[np.ndarray, np.ndarray]] = []
            for i, size in enumerate(r["sizes"]):
                item = r["bundle"] * BUNDLE + i
                scores = np.zeros(listed["n"], np.int64)
                scores[known[at : at + size]] = carried[at : at + size]
                at += size
                for term, weight in weights[item]:
                    if term in place:
                        here = slice(*place[term])
                        scores[docs[here]] += weight * factors[here]  # a document is once in a list
                met = np.flatnonzero(scores)
                scores = scores[met]
                if len(met) > k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    may = scores + rest[item] >= kth
                    met, scores = met[may], scores[may]
                new.append((met.astype(np.int32), scores))
            out.append((r["shard"], r["bundle"], [len(d) for d, _ in new], np.concatenate([d for d, _ in new]).tobytes(), np.concatenate([s for _, s in new]).tobytes()))
        return pa.Table.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return bundles.groupBy("shard").cogroup(at_owner.groupBy("shard")).applyInArrow(add, BUNDLES)


def _selected(bundles: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Each shard's k best documents of each item, by doc_id."""
    schema = arrow_schema(bundles.sparkSession, FOUND)

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        listed = right.column("doc_ids").to_pylist()[0]
        ids, null = np.array([0 if x is None else x for x in listed], np.int64), np.array([x is None for x in listed], bool)
        out: list[tuple] = []
        for r in left.to_pylist():
            at, docs, scores = 0, np.frombuffer(r["docs"], np.int32), np.frombuffer(r["scores"], np.int64)
            for i, size in enumerate(r["sizes"]):
                d, s = docs[at : at + size], scores[at : at + size]
                at += size
                best = np.lexsort((ids[d], null[d], -s))[:k]
                out += [(r["bundle"] * BUNDLE + i, None if null[x] else int(ids[x]), int(y)) for x, y in zip(d[best], s[best], strict=True)]
        return pa.Table.from_arrays([pa.array([row[c] for row in out], type=f.type) for c, f in enumerate(schema)], schema=schema)

    return bundles.groupBy("shard").cogroup(documents.groupBy("shard")).applyInArrow(select, FOUND)


def _search_block(documents: DataFrame, keys: list, texts: list[bytes | None], k: int, owners: int) -> DataFrame:
    spark = documents.sparkSession
    items = Items.of(texts)
    written = materialize(shards(documents, items), "shards")
    n, total = written.agg(F.coalesce(F.sum("holding"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    lists = written.select(F.explode(F.arrays_zip("terms", "lists", "most")).alias("x")).groupBy("x.terms").agg(F.sum("x.lists").alias("df"), F.max("x.most").alias("tf"))
    stats = {r["terms"]: (r["df"], r["tf"]) for r in lists.collect()}  # a row a term of the block's items at most
    route = spark.sparkContext.broadcast(Route(items, n, stats, owners))
    n_items = len(keys)
    empty = F.transform(F.sequence(F.lit(0), F.least(F.lit(BUNDLE), n_items - F.col("bundle") * BUNDLE) - 1), lambda _: F.lit(0))
    bundles = written.select("shard", F.explode(F.sequence(F.lit(0), F.lit((n_items - 1) // BUNDLE))).alias("bundle"))
    bundles = bundles.select("shard", "bundle", empty.alias("sizes"), F.lit(b"").alias("docs"), F.lit(b"").alias("scores"))
    for owner in range(owners):
        bundles = visit(bundles, postings(written, route, owner, n, total), route, owner, k)
    best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = _selected(bundles, written.select("shard", "doc_ids"), k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(keys)), "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most BLOCK_ITEMS names, about


def search(documents: DataFrame, items: DataFrame, k: int = 20, owners: int = OWNERS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The k documents with the highest scores for each item: item_id, rank, doc_id, score. items: item_id, text."""
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // BLOCK_CHARS))
    dealt = asked.withColumn("text", F.col("text").cast("binary")).withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).orderBy("item_id", "text").collect()
        if rows:
            found = found.unionByName(_search_block(documents, [r["item_id"] for r in rows], [r["text"] for r in rows], k, owners))
    return found


ORACLE_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT k, doc_id, ts, len(ts) AS n FROM words WHERE len(ts) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
post AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ts) AS t FROM d) GROUP BY k, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, total GROUP BY t, nn),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
scored AS (SELECT item_id, doc_id, k, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (t) JOIN post USING (t) JOIN d USING (k), total GROUP BY item_id, doc_id, k),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
