"""Scans and sinks of JSON lines, delimited text and Parquet, with the line numbers and checks that records rely on."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share: spark.checkpoint.dir, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and (base.startswith("file:") or ":/" not in base):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a local folder, which executors don't share")
    return f"{base.rstrip('/')}/loom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    place, store = _store(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(place)) if store.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; nothing may read it any more."""
    place, store = _store(spark, path)
    store.delete(place, True)


def append_lines(df: DataFrame, line: str, bucket: Column, path: str, suffix: str = ".jsonl") -> None:
    """Appends the column ``line`` to one file per bucket of a folder on a mount that all executors share.

    A task first cuts its file to the length that it had before, so a repeated task appends once.
    """
    spark = df.sparkSession
    base = path.removeprefix("file://")
    if ":/" in base:
        raise ValueError(f"{path}: files are appended to on shared mounts only")
    known = {x: os.path.getsize(f"{base}/{x}") for x in (os.listdir(base) if os.path.isdir(base) else [])}
    os.makedirs(base, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file, n = None, None, 0
        for batch in batches:
            for bucket, text in zip(batch["bucket"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if bucket != last or file is None:
                    if file:
                        file.close()
                    file, last, n = open(f"{base}/{bucket}{suffix}", "ab"), bucket, n + 1  # noqa: SIM115
                    file.truncate(known.get(f"{bucket}{suffix}", 0))
                file.write((text or "").encode() + b"\n")
        if file:
            file.close()
        yield pa.RecordBatch.from_pydict({"files": [n]})

    rows = df.select(bucket.cast("string").alias("bucket"), F.col(line).alias("line"))
    rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "files long").agg(F.sum("files")).collect()


def lines(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """file, line_no (from ``first``) and line of text files; blank lines count but are left out.

    Lines are numbered within file splits, in parallel, and shifted by the counts of the splits before.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"))
    before = W.Window.partitionBy("file").orderBy("at").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = raw.groupBy("file", "at").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = raw.withColumn("k", F.row_number().over(W.Window.partitionBy("file", "at").orderBy("seq"))).join(offsets, ["file", "at"])
    return placed.select("file", (F.col("offset") + F.col("k") - 1 + first).cast("long").alias("line_no"), F.col("value").alias("line")).where(F.trim("line") != "")


def json_lines(spark: SparkSession, path: str, schema: str, first: int = 1, strict: bool = False) -> DataFrame:
    """line_no and the record's fields; strict: a line that is no JSON is an error with its number."""
    numbered = lines(spark, path, first)
    parsed = F.from_json("line", schema)
    if strict:
        bad = F.try_parse_json("line").isNull()
        parsed = F.when(bad, F.raise_error(F.concat(F.lit("no JSON in line "), F.col("line_no").cast("string"))).cast("string")).otherwise(F.col("line"))
        parsed = F.from_json(parsed, schema)
    return numbered.select("file", "line_no", parsed.alias("r")).select("file", "line_no", "r.*")


def parquet(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(*paths)


def delimited(spark: SparkSession, path: str, required: list[str], sep: str = "\t") -> DataFrame:
    """A table with a header; missing columns are an error, empty cells stay empty texts."""
    df = spark.read.csv(path, sep=sep, header=True, nullValue="\0", emptyValue="")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.fillna("")


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """The reader that a path's extension asks for; JSON lines, text, delimited, Parquet, ORC."""
    ext = path.rstrip("/").rpartition(".")[2].lower()
    if ext in ("json", "jsonl"):
        return spark.read.json(path)
    if ext == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    if ext in ("csv", "tsv"):
        return delimited(spark, path, [], "\t" if ext == "tsv" else ",")
    return spark.read.format(ext).load(path)


def finished(spark: SparkSession, root: str, pattern: str, marker: str = "done.marker") -> DataFrame:
    """Paths under root that match a pattern and have the marker beside them."""
    listing = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return listing(pattern).join(listing(marker).select("folder").distinct(), "folder", "left_semi").select("path")


def write_json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_routes(df: DataFrame, route: str, path: str) -> None:
    """All routes in one pass, a folder for each."""
    df.write.mode("overwrite").partitionBy(route).json(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_step(df: DataFrame, path: str, step: int) -> None:
    """One step's generations; steps written before stay."""
    df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").json(path)


def merged_lists(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Items of files that each hold a JSON list, in the files' given order; files that hold none are left out."""
    out = None
    for i, path in enumerate(paths):
        text = spark.read.option("wholetext", "true").text(path)
        items = text.select(F.lit(i).alias("file_no"), F.posexplode(F.from_json("value", f"array<{schema}>")).alias("item_no", "item"))
        out = items if out is None else out.unionByName(items)
    return out


def record(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path (relative to the folder) and length of every file below it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("_full"), "length")
    inside = path.rstrip("/").partition(":")[2].lstrip("/") or path.strip("/")
    return files.select(F.regexp_replace(F.substring_index("_full", inside + "/", -1), "^/+", "").alias("path"), "length")
