"""Release sinks: Parquet of bounded files, manifest CSV, deterministic archives, digests, Markdown and matrices."""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.order import in_order, numbered
from keelson.session import collect_all

ROWS_A_FILE, MEMBERS_AN_ARCHIVE = 100_000, 10_000


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; the commit protocol makes the write atomic."""
    rows.write.mode(mode).json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_release(rows: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE) -> None:
    """Nested Parquet in files of at most so many rows, ordered by video_id across files."""
    rows.repartitionByRange("video_id").sortWithinPartitions("video_id").write.option("maxRecordsPerFile", rows_a_file).option("compression", "snappy").parquet(path)


def manifest(rows: DataFrame, members: int = MEMBERS_AN_ARCHIVE) -> DataFrame:
    """Per video: label, segments, precheck, kept fraction, and the archive shard by its place in order of video_id."""
    n = F.size("segments")
    kept = F.size(F.filter("segments", lambda s: s["label"] == "important"))
    narrow = rows.select("video_id", "action_label", n.alias("n_segments"), "mss_result.precheck_passed", F.bround(F.try_divide(kept, n), 4).alias("kept_fraction"))
    return numbered(narrow, [F.col("video_id")]).withColumn("shard", F.floor(F.col("position") / members).cast("int")).drop("position")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def archives(files: DataFrame) -> DataFrame:
    """files: shard, name, content (binary). One row a shard: shard, content (gzip tar), sha256. Members are sorted and carry no
    time or owner, so the same files give the same bytes."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") as zipped, tarfile.open(fileobj=zipped, mode="w") as tar:
            for name, content in sorted(zip(rows["name"], rows["content"], strict=True)):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return pd.DataFrame({"shard": [key[0]], "content": [raw.getvalue()], "sha256": [hashlib.sha256(raw.getvalue()).hexdigest()]})

    return files.select("shard", "name", "content").groupBy("shard").applyInPandas(pack, "shard int, content binary, sha256 string")


def digests(spark, path: str) -> DataFrame:
    """path, sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def matrix(pairs: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """pairs: a, b, value. The symmetric matrix as text with three digits, the diagonal 1.000: a row for each name, and the columns asked for."""
    both = pairs.select("a", "b", F.col(value).alias("v"))
    full = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    diagonal = full.select("a", F.col("a").alias("b"), F.lit(1.0).alias("v")).distinct()
    return full.unionByName(diagonal).groupBy("a").pivot("b", columns).agg(F.format_string("%.3f", F.max("v")))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table of a small result; an error where it has more than `most` rows."""
    lines = [list(rows.columns), ["---"] * len(rows.columns)] + [["" if v is None else str(v) for v in r] for r in collect_all(rows, most)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_markdown(rows: DataFrame, path: str, order: list[str]) -> None:
    """The same table of any size, in order of its columns: text files that follow one another, the first with the head."""
    cells = F.transform(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), lambda x: F.regexp_replace(x, r"\|", r"\\|"))
    line = lambda names: "| " + " | ".join(names) + " |"
    body = numbered(rows.withColumn("__line", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))), [F.col(c) for c in order]).select("position", "__line")
    head = rows.sparkSession.createDataFrame([(-2, line(rows.columns)), (-1, line(["---"] * len(rows.columns)))], "position long, __line string")
    body.unionByName(head).repartitionByRange("position").sortWithinPartitions("position").select("__line").write.text(path)
