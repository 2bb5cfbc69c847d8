"""Nearest documents by an inverted file: vectors in cells around centroids, cells in blocks, blocks in a bucketed table.

Centroids are fitted by k-means on a bounded sample (``SAMPLE`` rows, those with the smallest seeded hashes
of their ids, each vector once); every vector is indexed.  A cell of many vectors, or of one vector many times, is
cut into blocks of about ``BLOCK_ROWS``, so no task holds a hot cell.  A query meets the blocks of its
nearest cells only, in one matrix product a block, whose table is bucketed by block and not shuffled.
By inner product, a cell can't hold a better document than |q| times its radius beyond its centroid:
``exact`` searches the cells that this bound leaves, and its result is that of a scan of all vectors.

Vectors of other lengths than the commonest (the longer of a tie), null ones and those with nulls are
not indexed; such queries find nothing.  Repeated ids are all found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loom.sources import files

SAMPLE, BLOCK_ROWS, MOST_CELLS = 16_384, 20_000, 1024
#: Routes of queries that are made at a time, and products of vectors and centroids, about.
ROUTED = 500_000
#: Held out of the sample, to find how many cells must be probed for a recall.
TUNED, TUNED_K = 256, 10
MADE = "dimension int, probes int, buckets int"


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def k_means(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centroids after some rounds of Lloyd's; a cell that empties takes the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        far = ((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)).clip(0)
        own = far.argmin(1)
        counts = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        away = far[np.arange(len(x)), own].argsort()[::-1]
        for cell, at in zip(np.flatnonzero(counts == 0), away, strict=False):
            centers[cell] = x[at]
    return centers


def probes_for(x: np.ndarray, centers: np.ndarray, recall: float, k: int = TUNED_K, held: int = TUNED) -> int:
    """The fewest cells to probe so that held-out vectors find ``recall`` of their k best among the others."""
    queries, rest = x[:held], x[held:]
    if len(rest) <= k:
        return len(centers)
    own = ((rest**2).sum(1)[:, None] - 2 * rest @ centers.T + (centers**2).sum(1)).argmin(1)
    best = own[np.argpartition(-(queries @ rest.T), k, axis=1)[:, :k]]
    place = np.empty((len(queries), len(centers)), int)
    np.put_along_axis(place, np.argsort(-(queries @ centers.T), axis=1), np.arange(len(centers))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, best, 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


class InvertedFile:
    """An index at a path in the shared store; ``build`` makes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.dimension, self.probes, self.buckets = spark.read.schema(MADE).parquet(f"{self.path}/made").first()
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        self.centers = np.array([c.center for c in cells]).reshape(len(cells), self.dimension)
        self.radius, self.first, self.parts = (np.array([c[name] for c in cells]) for name in ("radius", "first", "parts"))
        self.name = "loom_vectors_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (doc_id BIGINT, d ARRAY<DOUBLE>, block INT) USING parquet CLUSTERED BY (block) SORTED BY (block) INTO {self.buckets} BUCKETS LOCATION '{self.path}/vectors'")

    def close(self) -> None:
        """Drops the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    @classmethod
    def build(cls, docs: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, seed: int = 0) -> InvertedFile:
        """Indexes doc_id and d; cells: 4 times the root of the rows where it isn't given, MOST_CELLS at most, and few enough for the sample."""
        spark = docs.sparkSession
        whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("d").cast("array<double>").alias("d")).where("d IS NOT NULL AND size(d) > 0 AND NOT exists(d, x -> x IS NULL OR isnan(x))")
        sizes = whole.groupBy(F.size("d").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
        dimension, rows = (sizes.n, sizes.rows) if sizes else (0, 0)
        whole = whole.where(F.size("d") == dimension)
        sample = whole.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(SAMPLE).select("d").toArrow()["d"].combine_chunks()
        x = np.unique(_vectors(sample), axis=0) if len(sample) else np.zeros((0, dimension))  # a vector of many rows counts once
        x = np.random.default_rng(seed).permutation(x)
        count = max(1, min(cells or 4 * int(rows**0.5), MOST_CELLS, len(x) // 8)) if len(x) else 0
        centers = k_means(x, count, seed=seed) if count else np.zeros((0, dimension))
        probes = probes_for(x, centers, recall) if count else 0

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            few = max(1, ROUTED // max(1, count))
            for batch in (whole.slice(a, few) for whole in batches for a in range(0, whole.num_rows, few)):
                v = _vectors(batch["d"])
                cell = ((centers**2).sum(1) - 2 * v @ centers.T).argmin(1)
                off = np.sqrt(((v - centers[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(off)], ["doc_id", "d", "cell", "off"])

        placed = files.written(whole.mapInArrow(assigned, "doc_id long, d array<double>, cell int, off double"), "vector-cells")
        held = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("off").alias("radius")).collect()}
        parts = [max(1, -(-held[c].rows // BLOCK_ROWS)) if c in held else 1 for c in range(count)]
        first = [sum(parts[:c]) for c in range(count)]
        about = spark.createDataFrame([(c, centers[c].tolist(), held[c].radius if c in held else 0.0, first[c], parts[c]) for c in range(count)], "cell int, center array<double>, radius double, first int, parts int")
        about.coalesce(1).write.parquet(f"{path}/cells")
        buckets = max(1, min(sum(parts), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        spark.createDataFrame([(dimension, probes, buckets)], MADE).coalesce(1).write.parquet(f"{path}/made")
        index = cls(spark, path)
        block = F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
        rows_ = placed.join(F.broadcast(about.select("cell", "first", "parts")), "cell").select("doc_id", "d", block.cast("int").alias("block"))
        rows_.repartition(buckets, "block").write.mode("append").format("parquet").bucketBy(buckets, "block").sortBy("block").option("path", f"{path}/vectors").saveAsTable(index.name)
        return index

    def vectors(self) -> DataFrame:
        return self.spark.table(self.name)

    def _routes(self, queries: DataFrame, probes: int, beyond: bool) -> DataFrame:
        """query_id, q, block for the blocks of the ``probes`` cells of largest inner product; beyond: of those cells after them that the bound leaves above the column ``least``."""
        centers, radius, first, parts = self.centers, self.radius, self.first, self.parts
        length = np.sqrt((centers**2).sum(1)).max(initial=0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # so few queries at a time that neither their products nor their routes take much memory
            few = max(1, ROUTED // max(1, sum(parts)))
            for batch in (whole.slice(a, few) for whole in batches for a in range(0, whole.num_rows, few)):
                q = _vectors(batch["q"])
                near = q @ centers.T
                norm = np.sqrt((q**2).sum(1))[:, None]
                order = np.argsort(-near, axis=1, kind="stable")
                take = np.zeros(near.shape, bool)
                np.put_along_axis(take, order[:, :probes], True, 1)
                if beyond:
                    least = batch["least"].to_numpy(zero_copy_only=False).astype(float)[:, None]
                    # a margin above the rounding of products and of given scores
                    margin = 1e-6 + 1e-9 * norm * (length + radius)
                    take = ~take & (np.isnan(least) | (near + norm * radius + margin >= least))
                row, cell = np.nonzero(take)
                n = parts[cell]
                # the blocks of a cell follow each other
                block = np.repeat(first[cell] - np.cumsum(n) + n, n) + np.arange(n.sum())
                row = np.repeat(row, n)
                for a in range(0, len(row), 10_000):
                    at = pa.array(row[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays([batch["query_id"].take(at), batch["q"].take(at), pa.array(block[a : a + 10_000].astype(np.int32))], ["query_id", "q", "block"])

        return queries.mapInArrow(run, "query_id long, q array<double>, block int")

    def _met(self, routes: DataFrame, k: int, digits: int) -> DataFrame:
        """The k best of each block for each of its queries."""

        def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
            ids, asked = docs["doc_id"].to_numpy(), queries["query_id"].to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if len(ids) and len(asked):
                by_id = np.argsort(ids, kind="stable")
                ids, d = ids[by_id], _vectors(docs["d"].combine_chunks())[by_id]
                q = _vectors(queries["q"].combine_chunks())
                step = max(1, 4_000_000 // len(ids))
                for a in range(0, len(asked), step):
                    score = np.round(q[a : a + step] @ d.T, digits)
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    out.append((np.repeat(asked[a : a + step], best.shape[1]), ids[best].ravel(), np.take_along_axis(score, best, 1).ravel()))
            columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
            return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "doc_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(float))})

        return self.vectors().groupBy("block").cogroup(routes.groupBy("block")).applyInArrow(run, "query_id long, doc_id long, score double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, digits: int = 6) -> DataFrame:
        """query_id, doc_id, score, rank: the k documents of largest inner product (rounded), ties to the smaller doc_id.

        probes: cells per query, as many as the recall asked in ``build`` took in the sample where not given.
        """
        given = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).where(f"size(q) = {self.dimension} AND NOT exists(q, x -> x IS NULL OR isnan(x))")
        probes = self.probes if probes is None else probes
        order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = top(self._met(self._routes(given, probes, False), k, digits))
        if not exact:
            return found
        found = files.written(found.drop("rank"), "vector-found")
        least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        more = self._met(self._routes(given.join(least, "query_id", "left"), probes, True), k, digits)
        return top(found.unionByName(more))
