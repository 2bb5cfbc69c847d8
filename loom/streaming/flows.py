"""Structured Streaming: incremental profiles, tails of growing files, packing, shuffling, splitting, rollouts, dedup by id.

Results go to Parquet, never to the driver.  The machines with state are those of ``loom.streaming.state``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loom.operators.sequential import rollout
from loom.sources import files
from loom.streaming import sources, state

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def tail(spark: SparkSession, path: str, suffix: str = ".jsonl", unfinished: bool = False) -> DataFrame:
    """file, at, line, rebuilt: lines as they are appended to the files of a folder."""
    sources.register(spark)
    return spark.readStream.format("loom_tail").option("path", path).option("suffix", suffix).option("unfinished", str(unfinished)).load()


def cycle(spark: SparkSession, path: str, columns: str, epochs: int = 0, units: int = 0, progress: str | None = None) -> DataFrame:
    """epoch, place, row and columns of Parquet files, over and over; see ``loom.streaming.sources.Cycle``."""
    sources.register(spark)
    reader = spark.readStream.format("loom_cycle").option("path", path).option("columns", columns).option("epochs", epochs).option("units", units)
    return (reader.option("progress", progress) if progress else reader).load()


def profile(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Running counts, sums and extremes per key; the checkpoint holds how far the files were read."""
    return stream.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def once_by_id(stream: DataFrame, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key. With a time column, keys are held for ``late`` only, which bounds the state."""
    if time:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def run(query_frame: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs until the input is read, into Parquet at path: the latest result (complete) or what each batch added, with its number.

    A batch that is run again after a failure replaces what it wrote.
    """
    spark = query_frame.sparkSession
    schema = query_frame.schema.add("batch", "long") if mode != "complete" else query_frame.schema

    def write(df: DataFrame, number: int) -> None:
        out = f"{path}/batch={number}" if mode != "complete" else f"{path}/latest"
        df.write.mode("overwrite").parquet(out)

    # machines with several states need a store with column families; the session's own choice comes back
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query_frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(schema).parquet(f"{path}/latest" if mode == "complete" else path)


COUNTERS = "file string, counter string, key string, n double"


def running_counters(stream: DataFrame, schema: str, totals: dict[str, Column], histograms: dict[str, Column], path: str, checkpoint: str) -> DataFrame:
    """file, counter, key, n over all lines that ``tail`` has given so far; the counters go on in the next call.

    Counters: "lines" (all), "bad" (not blank and no JSON), "samples" (records), each of ``totals``
    (summed over records, a condition counts as 0 or 1) and each of ``histograms`` (a count per value;
    of an array, of each element; nulls have none).  Columns see the record as ``r``.  A batch adds its own counts to
    the table before it, so that a repeated batch counts once; a file that was rebuilt begins anew.
    The latest table lies at path/batch=N; older ones than the last two are deleted.
    """
    spark = stream.sparkSession
    entry = lambda name, key, n: F.struct(F.lit(name).alias("counter"), key.cast("string").alias("key"), n.cast("double").alias("n"))
    nothing = F.lit(None).cast("string")

    def values(name: str, x: Column) -> Column:
        given = F.coalesce(F.when(F.col("good"), x.cast("array<string>")), F.array().cast("array<string>"))
        return F.transform(F.filter(given, lambda v: v.isNotNull()), lambda v: entry(name, v, F.lit(1)))

    def counted(df: DataFrame) -> DataFrame:
        parsed = F.try_parse_json("line")
        good = parsed.isNotNull() & (F.schema_of_variant(parsed).startswith("OBJECT"))
        rows = df.where("line IS NOT NULL").select("file", "line", (F.trim("line") == "").alias("blank"), F.coalesce(good, F.lit(False)).alias("good"), F.from_json("line", schema).alias("r"))
        one = [entry("lines", nothing, F.lit(1)), entry("bad", nothing, (~F.col("blank") & ~F.col("good")).cast("int")), entry("samples", nothing, F.col("good").cast("int"))]
        one += [entry(name, nothing, F.when(F.col("good"), F.coalesce(x.cast("double"), F.lit(0))).otherwise(0)) for name, x in totals.items()]
        each = [values(name, x if isinstance(rows.select(x).schema[0].dataType, T.ArrayType) else F.array(x)) for name, x in histograms.items()]
        return rows.select("file", F.explode(F.concat(F.array(*one), *each)).alias("c")).groupBy("file", "c.counter", "c.key").agg(F.sum("c.n").alias("n"))

    def add(df: DataFrame, number: int) -> None:
        found = counted(df)
        if number:
            before = spark.read.schema(COUNTERS).parquet(f"{path}/batch={number - 1}")
            again = df.where("rebuilt").select("file").distinct()
            found = before.join(again, "file", "left_anti").unionByName(found).groupBy("file", "counter", "key").agg(F.sum("n").alias("n"))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in files.folders(spark, path):
            if old.startswith("batch=") and int(old[6:]) < number - 1:
                files.delete(spark, f"{path}/{old}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = max((int(x[6:]) for x in files.folders(spark, path) if x.startswith("batch=")), default=None)
    return spark.createDataFrame([], COUNTERS) if last is None else spark.read.schema(COUNTERS).parquet(f"{path}/batch={last}")


def end_markers(rows: DataFrame, shard: str) -> DataFrame:
    """A row per shard of ``rows``, null in all other columns: appended to a stream's input, it ends the shard's."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(shard).distinct().select(*[F.col(c) if c == shard else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])


def _mode(limit: int | None) -> str:
    return "ProcessingTime" if limit else "None"


WHOLE = ("tinyint", "smallint", "int", "bigint")


def _as_text(stream: DataFrame, shard: str) -> tuple[DataFrame, list[str]]:
    """The stream with whole numbers besides its shard as text, and its schema in parts."""
    kinds = {c: "string" if kind in WHOLE and c != shard else kind for c, kind in stream.dtypes}
    return stream.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()]), [f"`{c}` {kind}" for c, kind in kinds.items()]


def _as_before(found: DataFrame, stream: DataFrame, *more: str) -> DataFrame:
    return found.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in stream.dtypes], *more)


def packed(stream: DataFrame, shard: str, key: str, length: str, most: int, interval: int = 128, idle: int | None = None) -> DataFrame:
    """shard, key, bin: rows of a shard are packed with what waits whenever ``interval`` of them have come; the last bin goes on waiting.

    End markers or a shard's silence of ``idle`` milliseconds give out what waits: no row is lost.  The
    state of a shard is less than an interval of rows and one bin.  A length above ``most`` has a bin of
    its own.  Keys are whole numbers; a batch's are taken in their order.
    """
    kind = stream.schema[shard].dataType.simpleString()
    machine = state.Packing(shard, key, length, most, interval, idle)
    rows = stream.select(shard, F.col(key).cast("string").alias(key), length)
    return rows.groupBy(shard).transformWithStateInPandas(machine, f"{shard} {kind}, {key} long, bin int", "Append", _mode(idle))


def shuffled(stream: DataFrame, shard: str, key: str, buffer: int = 1000, seed: int = 0, idle: int | None = None) -> DataFrame:
    """The stream's columns and at (place in the shard's output): rows drawn from a buffer of the last ``buffer`` that were not given out.

    A row moves forward by less than the buffer's size, and back by any number of places.  Draws rest
    on seed, shard and the row's number; rows of a batch are taken in the order of their keys.
    """
    rows, columns = _as_text(stream, shard)
    machine = state.Shuffling(stream.columns, ", ".join(columns), key, dict(stream.dtypes)[key] in WHOLE, buffer, seed, idle)
    found = rows.groupBy(shard).transformWithStateInPandas(machine, ", ".join([*columns, "at long"]), "Append", _mode(idle))
    return _as_before(found, stream, "at")


def split(stream: DataFrame, shard: str, key: str, sample: int, ratio: float) -> DataFrame:
    """The first ``sample`` rows of each shard and part: "val" for the first int(sample * ratio), then "train"."""
    if sample <= 0 or not 0 <= ratio <= 1:
        raise ValueError("sample must be positive and ratio between 0 and 1")
    rows, columns = _as_text(stream, shard)
    machine = state.Splitting(stream.columns, key, dict(stream.dtypes)[key] in WHOLE, int(sample * ratio), sample)
    return _as_before(rows.groupBy(shard).transformWithStateInPandas(machine, ", ".join([*columns, "part string"]), "Append", "None"), stream, "part")


def rollouts(stream: DataFrame, request: str, place: str, threshold: float = 0.8, most: int = 8, keep: int | None = None) -> DataFrame:
    """request, rounds, segments, finish after each batch of its outputs, numbered from 0 by ``place``.

    Outputs that come before their turn wait; an ended request takes no more, and a number that came
    counts once, from the first batch that had it (within a batch, the least of its outputs).  State is
    the first ``most`` outputs of a request, in one row of an aggregate, and all requests that a batch
    names are folded as they pass.  With ``keep``, a machine holds the state, which is forgotten so many
    milliseconds after its last change.
    """
    kind = stream.schema[request].dataType.simpleString()
    schema = f"{request} {kind}, rounds int, segments int, finish string"
    if keep:
        return stream.groupBy(request).transformWithStateInPandas(state.Rollouts(request, place, threshold, most, keep), schema, "Update", _mode(keep))
    names = state.Rollouts.FIELDS
    output = F.struct(F.current_timestamp().alias("at"), F.col("reason"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names[1:]])
    came = stream.select(F.col(request).alias("request"), F.col(place).alias("place"), output.alias("o"))
    held = came.groupBy("request").agg(*[F.min(F.when(F.col("place") == k, F.col("o"))).alias(f"o{k}") for k in range(most)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = []
            for column in batch.columns[1:]:
                known = column.is_valid().to_pylist()
                slots.append([x if k else None for k, *x in zip(known, *(c.to_pylist() for c in column.flatten()[1:]), strict=True)])
            found = [folded(outputs) for outputs in zip(*slots, strict=True)]
            rounds, segments, finish = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rounds, pa.int32()), pa.array(segments, pa.int32()), pa.array(finish, pa.string())], [request, "rounds", "segments", "finish"])

    def folded(outputs: tuple) -> tuple[int, int, str]:
        """The fold as far as there is no gap."""
        steps = [dict(zip(names, o, strict=True)) for o in takewhile(lambda o: o is not None, outputs)]
        return tuple(rollout(steps, threshold, most).values())

    return held.mapInArrow(run, schema)
