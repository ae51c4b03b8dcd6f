"""Mixing sources to target weights by weighted sampling without replacement.

Targets: the sources share `share` of all sizes by weight; a target stops at `most` times its source's size and
the excess is shared again by weight, until none is above. That is water-filling, and it has a closed form: with
sources in order of most*size/weight, the level is the first for which the sources not yet full lie above it.

Sampling (Efraimidis and Spirakis): each document draws an exponential key -ln(u)/w, with u a hash of seed and
doc_id and w its quality weight, and smaller keys go first. A target takes as many complete epochs (every document
once) as fit, and the rest is a fractional selection: documents by key while the prefix sum of sizes stays under
the budget, the document on the edge if that ends nearer. A source is cut into ranges of the logarithm of the key, whose sums are
prefix-summed first, so that no task sorts a whole source: an exponential key of any weight falls into a range of width d of its logarithm
with a probability of d / e at most, so no range expects more than 0.025 % of a source whatever its weights are.
Words are counted once, and sizes and weights are written for the three reads that follow.

Defined cases: null text has size 0; empty documents take part and take 0 words; a null source is a source, last;
documents without sizes leave all targets 0; ties go by doc_id, nulls last (same doc_id: by size and text digest), and a null doc_id draws by its text;
repeated rows are rows of their own; an empty table gives no row; extra columns don't matter. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import materialize, table

#: Ranges of keys in each source for a doubling of the key.
RANGES = 1024


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unit_draw(doc_id: Column, tie: Column, seed: int) -> Column:
    """Uniform in (0, 1), the same in every run: 48 bits of an MD5 of doc_id, or of tie where that is null."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), tie, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: source_size, target, and the whole epochs and the budget of the fractional selection. Sources are one row each here."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("top", F.col("source_size") * most)
    fill = W.partitionBy().orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    by = by.withColumn("level", F.max(F.when(F.col("top") / F.col("weight") > F.col("level"), F.col("level"))).over(everything))
    by = by.withColumn("target", F.when(F.col("level").isNull() | (F.col("top") / F.col("weight") <= F.col("level")), F.col("top")).otherwise(F.col("weight") * F.col("level")))
    by = by.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return by.select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))


def mix(sized: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17, ranges: int = RANGES) -> DataFrame:
    """sized: doc_id, source, size, quality (weight above 0). Also tie, which tells rows of one doc_id apart. It is read three
    times. Returns doc_id, source, tie, size, source_size, target, taken."""
    goal = targets(sized, weights, share, most)
    key = -F.log(unit_draw(F.col("doc_id"), F.col("tie"), seed)) / F.greatest(F.coalesce(F.col("quality"), F.lit(1.0)), F.lit(1e-9))
    keyed = sized.withColumn("key", key)
    keyed = keyed.withColumn("range", F.floor(ranges * F.log2("key")).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    up_to = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("range_size").over(up_to), F.lit(0))).withColumnsRenamed({"source": "s", "range": "r"})
    # a range's rows meet its sum: what lies below in other ranges, then the prefix inside
    inner = W.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r", "range_size")
    goal = goal.withColumnRenamed("source", "s")
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    prefix = F.col("below") + F.col("inside")
    chosen = prefix + F.col("size") / 2.0 < F.col("budget")
    taken = F.col("size") * (F.col("epochs") + F.when(chosen, 1).otherwise(0))
    return rows.select("doc_id", "source", "tie", "size", "source_size", "target", taken.cast("long").alias("taken"))


def size_and_weigh(documents: DataFrame) -> DataFrame:
    """Sizes, and quality weights: the share of letters among a text's characters, squared. Written, since mix reads it thrice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    letters = letters / F.greatest(F.length(text), F.lit(1))
    sized = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(text).alias("size"), (letters * letters + 0.05).alias("quality"), F.md5(text).alias("tie"))
    return materialize(sized, "sized")


def repeat_mixed(documents: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each document as often as the mix takes it. All columns stay; documents of size 0 go."""
    mixed = mix(size_and_weigh(documents), **options)
    copies = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie")).agg(F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("long").alias("__copies"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.withColumn("__text", F.md5(text)).dropDuplicates(["doc_id", "source", "__text"])
    met = rows.join(copies.where(F.col("__copies") > 0), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__text") == F.col("__tie")))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = size_and_weigh(table(spark, sf_dir, "documents"))
    return mix(sized).drop("source", "tie")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS size, md5(text) AS tie,
    pow((len(text) - len(regexp_replace(text, '\p{L}+', '', 'g'))) / greatest(len(text), 1)::DOUBLE, 2) + 0.05 AS quality
  FROM docs
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, tie)), 1, 12))::BIGINT + 0.5::DOUBLE) / pow(2, 48)) / quality AS key FROM sized
), by_source AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM keyed GROUP BY source
), filled AS (
  SELECT *, 2 * source_size AS top,
    (sum(source_size) OVER () * 1.5 - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM by_source
), levelled AS (
  SELECT *, max(level) FILTER (top / weight > level) OVER () AS at_level FROM filled
), goal AS (
  SELECT source, source_size, CASE WHEN at_level IS NULL OR top / weight <= at_level THEN top ELSE weight * at_level END AS target FROM levelled
), prefixed AS (
  SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM keyed k
)
SELECT p.doc_id, p.size::BIGINT AS size, g.source_size::BIGINT AS source_size, g.target,
  (p.size * (CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END
    + CASE WHEN p.prefix + p.size / 2.0::DOUBLE < g.target - (CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END) * g.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM prefixed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
"""
