"""Scans of run folders: JSON documents keyed by name or content, JSON lines, CSV, archives. All lazy, with narrow schemas."""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.text import record_key, stem
from keelson.operators.align import last_write
from keelson.sources.schema import ANNOTATION, CORRUPT, RECORD

#: Bookkeeping files of a run folder.
BOOKKEEPING = r"^(\.|config\.json$|run_metadata\.json$|summary\.json$|_)"


def documents(spark: SparkSession, paths: str | list[str], schema: str, glob: str = "*.json") -> DataFrame:
    """One row a JSON file: the schema's columns and file_name, modified. Malformed files and bookkeeping files are left out."""
    reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.option("pathGlobFilter", glob).json(paths).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"))
    # Spark refuses to read a corrupt column alone, which is what a count would come to; so the filter also looks at a column of the schema
    first = F.hash(F.col(T.StructType.fromDDL(schema)[0].name).cast("string")) >= -(1 << 31)
    return rows.where(F.col(CORRUPT).isNull() & first & ~F.col("file_name").rlike(BOOKKEEPING)).drop(CORRUPT)


def dead_letters(spark: SparkSession, paths: str | list[str], glob: str = "*.json") -> DataFrame:
    """The files that aren't JSON: file_name and text."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(paths).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return rows.where(F.try_parse_json("text").isNull() & ~F.col("file_name").rlike(BOOKKEEPING))


def records(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """Recognition records, the last written of a (video_id, condition); the content's keys go before the name's."""
    rows = documents(spark, paths, schema)
    video, condition = record_key(stem(F.col("file_name")))
    rows = rows.withColumn("video_id", F.coalesce("video_id", video)).withColumn("condition", F.coalesce("condition", condition))
    return last_write(rows.withColumn("written", F.struct("modified", "file_name")).drop("modified", "file_name"), ["video_id", "condition"], "written").drop("written")


def pruned(schema: str, columns: list[str]) -> str:
    """The part of a schema that dotted names of columns need, through structs and arrays of structs. An unknown name is an error."""

    def part(kind: T.DataType, names: list[str]) -> T.DataType:
        if not names or "" in names:
            return kind
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(part(kind.elementType, names))
        if not isinstance(kind, T.StructType):
            raise ValueError(f"{kind.simpleString()} has no {', '.join(names)}")
        wanted: dict[str, list[str]] = {}
        for name in names:
            first, _, rest = name.partition(".")
            wanted.setdefault(first, []).append(rest)
        if unknown := wanted.keys() - {f.name for f in kind}:
            raise ValueError(f"no column {', '.join(sorted(unknown))}")
        return T.StructType([T.StructField(f.name, part(f.dataType, wanted[f.name])) for f in kind if f.name in wanted])

    return part(T.StructType.fromDDL(schema), columns).toDDL()


def narrow(spark: SparkSession, paths: str | list[str], columns: list[str], conditions: list[str] | None = None, schema: str = RECORD) -> DataFrame:
    """video_id and condition by the files' names, and dotted columns of the content under their last names (those of arrays as arrays). Only files of
    the conditions are listed, and only those columns are parsed."""
    glob = "*__*.json" if conditions is None else "*__{" + ",".join(conditions) + "}.json"
    video, condition = record_key(stem(F.col("file_name")))
    rows = documents(spark, paths, pruned(schema, columns), glob)
    return rows.select(video.alias("video_id"), condition.alias("condition"), *[F.col(c).alias(c.rsplit(".", 1)[-1]) for c in columns])


def cell_records(spark: SparkSession, root: str, cell: str, condition: str, schema: str = RECORD) -> DataFrame:
    """Records of one cell's folder under a condition; only files of that condition are listed. The name's video_id ends at its first double underscore."""
    rows = documents(spark, f"{root.rstrip('/')}/{cell}", schema, f"*__{condition}.json")
    rows = rows.withColumn("video_id", F.coalesce(F.nullif(F.col("video_id"), F.lit("")), F.substring_index("file_name", "__", 1)))
    return last_write(rows, ["video_id"], "file_name").drop("modified", "file_name")


def feature_shards(spark: SparkSession, path: str, metadata: str | None = None) -> tuple[DataFrame, int | None]:
    """video_id, label and features of all Parquet shards of a folder, and the class count that the first of its metadata files
    (JSON, in order of name) states, other than 0."""
    rows = spark.read.schema("video_id string, label int, features array<float>").option("pathGlobFilter", "*.parquet").parquet(path)
    if metadata is None:
        return rows, None
    stated = documents(spark, metadata, "num_labels int").where("num_labels <> 0").agg(F.min_by("num_labels", "file_name")).first()[0]
    return rows, stated


def annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Annotations keyed by video_id, else by the file's stem."""
    return documents(spark, paths, ANNOTATION).withColumn("video_id", F.coalesce("video_id", stem(F.col("file_name")))).drop("modified")


def sweep(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """Records of insertion/deletion sweeps: ordering and fraction from the name, fraction 1 for full ones."""
    pattern = r"^(.*)__(?:id-([a-z-]+)-f(\d{2,3})|full)\.json$"
    rows = documents(spark, paths, schema).where(F.col("file_name").rlike(pattern))
    part = lambda i: F.nullif(F.regexp_extract("file_name", pattern, i), F.lit(""))
    return rows.withColumns({"video_id": part(1), "ordering": part(2), "fraction": F.coalesce(part(3).cast("double") / 100, F.lit(1.0))}).drop("modified")


def twins(rows: DataFrame) -> DataFrame:
    """(video_id, condition) that have both the plain and the --shuffled record, with both correctness values."""
    shuffled = rows.where(F.col("condition").endswith("--shuffled")).select("video_id", F.regexp_replace("condition", "--shuffled$", "").alias("condition"), F.col("top1_correct").alias("shuffled_top1"), F.col("top5_correct").alias("shuffled_top5"))
    return rows.select("video_id", "condition", "top1_correct", "top5_correct").join(shuffled, ["video_id", "condition"])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, bad lines left out."""
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def curves(spark: SparkSession, path: str, metrics: tuple[str, ...] = ("top1", "top5")) -> DataFrame:
    """Points of curves from CSV with ordering, fraction, metric and mean: ordering, percent, and each metric's mean in percent as a column."""
    rows = csv(spark, path, "ordering string, fraction double, metric string, mean double")
    points = rows.groupBy("ordering", F.round(F.col("fraction") * 100, 9).alias("percent")).pivot("metric", list(metrics)).agg(F.first("mean") * 100)
    return points.orderBy("ordering", "percent")


def kept_set(rows: DataFrame) -> DataFrame:
    """video_id and kept: of the first run, else of the segments labelled important."""
    first = F.try_element_at("mss_result.mss_runs", F.lit(1))["kept_indices"]
    labelled = F.transform(F.filter("segments", lambda s: s["label"] == "important"), lambda s: s["index"])
    return rows.select("video_id", F.array_sort(F.array_distinct(F.coalesce(first, labelled))).alias("kept"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, size, sha256 of every member of gzip tar archives. A whole archive is one task's; shards are bounded when written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select("path", "content")
    names = ["archive", "member", "size", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    rows = [(name, m.name, m.size, hashlib.sha256(tar.extractfile(m).read()).hexdigest()) for m in tar if m.isfile()]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.mapInArrow(run, "archive string, member string, size long, sha256 string")
