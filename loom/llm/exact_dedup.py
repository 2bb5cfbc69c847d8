"""Exact dedup against a persistent digest index: a table bucketed and sorted by digest.

Only DataFrame operations.  A batch is grouped by digest, joined to the index by a sort-merge join
for which the index needs no shuffle (each task sorts its own bucket, whose files are sorted runs, one
per batch), and the digests that the index lacks are appended.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.llm.common import materialise, new_path, table, with_groups

#: Up to so many keys (about 80 MB) are broadcast to pick rows out.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null becomes empty.  For ASCII texts lower() is that, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class DigestIndex:
    """Digests seen so far, at a path in the shared store; made where there is none, else opened.

    The number of buckets is fixed when an index is made and kept beside its data, so that it opens
    alike whatever the session's settings; asking for another number is an error.  The catalog entry,
    named after the whole path, is only a handle: it is made anew by each opening, and ``close`` drops it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "loom_digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        self.buckets = self._fixed_buckets()
        if self.buckets is None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/made")
        elif buckets not in (None, self.buckets):
            raise ValueError(f"the index at {self.path} has {self.buckets} buckets, not {buckets}")
        self.close()
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def _fixed_buckets(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").parquet(f"{self.path}/made").first().buckets
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def close(self) -> None:
        """Drops the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def digests(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, batch: str) -> DataFrame:
        """Appends the new digests of docs; returns doc_id, keep_id, group_size, kept, text_sha256 by row.

        Of rows with equal texts the one with the largest doc_id stays (a null doc_id counts as the
        smallest; of rows that tie in doc_id, one), unless an earlier batch has the text: then keep_id
        is the index's and none stays.  group_size counts the rows of this batch.  Adding a batch
        again under the same name decides as before and appends nothing, so a failed run can be
        repeated.  Other columns are ignored; an empty batch gives no rows.
        """
        sha = F.sha2(normalised(F.col("text")), 256)
        rows = materialise(docs.select("doc_id", F.unhex(sha).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
        total = rows.count()
        top = F.max(F.struct("doc_id", "row"))
        groups = rows.groupBy("digest").agg(top.alias("top"), F.count("*").alias("group_size"))
        before = self.digests().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
        groups = materialise(groups.hint("merge").join(before.hint("merge"), "digest", "left"), "groups")
        fresh = groups.where("old IS NULL").select("digest", F.col("top.doc_id").alias("keep_id"), F.lit(batch).alias("batch"))
        fresh = fresh.join(self.digests().hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/digests").saveAsTable(self.name)
        found = with_groups(rows, groups, "digest", total)
        keep = F.when(F.col("old"), F.col("old_id")).otherwise(F.col("top.doc_id"))
        return found.select("doc_id", keep.alias("keep_id"), "group_size", (F.col("old").isNull() & (F.col("row") == F.col("top.row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The rows that go are picked out by doc_id and digest: by a broadcast while they are few (the
    count is checked), else by a shuffle.  Rows equal in both are one document; where such a row is
    the one that stays, one of them is returned.
    """
    decided = materialise(index.add(docs, batch).select("doc_id", "text_sha256", "kept"), "decided")
    by_key = decided.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    by_key = materialise(by_key.where("NOT kept OR rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "going")
    few = by_key.count() <= BROADCAST_ROWS
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("_doc"), F.sha2(normalised(F.col("text")), 256).alias("_digest"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    pick = lambda how, x: packed.join(F.broadcast(x) if few else x, same, how)
    once = pick("left_semi", by_key.where("kept")).dropDuplicates(["_doc", "_digest"])
    stays = pick("left_anti", by_key).unionByName(once)
    return stays.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as one batch for a new index."""
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    found = index.add(table(spark, sf_dir, "documents"), "documents")
    index.close()
    return found


OP10_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
