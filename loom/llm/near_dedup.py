"""MinHash near-dedup with HyperMinHash registers.

1. Every text becomes the set of its distinct word shingles (64-bit hashes) and the compressed
   registers of that set.  Equal sets are one node from here on, whatever their number.
2. Bands of registers are keys; nodes that share a key are candidates.  Each node is first compared
   with the center of one of its buckets (the best one by the registers' corrected estimate), which
   contracts large groups with one comparison a node.
3. In buckets that still hold several components, the nodes outside the bucket's largest component
   are compared with the others: by a join in small buckets, block by block in large ones, to which
   the main component's nodes go once per block of the others.  Registers travel first, and full sets
   only of nodes that have a likely partner.  No pair inside a component is ever formed.
4. Pairs whose estimate is not far below the threshold are confirmed on full shingle sets; the
   confirmed links' connected components are the result.

With 32 bands of 5 registers a pair at a similarity of 0.85 (0.8) shares no band with a probability
of 7e-9 (3e-6); pairs are dropped by the estimate at more than 5 standard deviations only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.llm.common import HOT_SHARE, materialise, released, small_batches, table, with_groups
from loom.llm.graph import components
from loom.llm.sketch import ODD, HyperMinHash, U, WordHasher, mix, sets

BANDS, ROWS = 32, 5
#: Up to so many ids (16 MB) are broadcast to pick documents out; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Buckets of up to so many nodes are paired by a join, larger ones in groups of two blocks of so many nodes.
SMALL, BLOCK_NODES = 24, 512
#: A node with more pairs than this, and than HOT_SHARE of all, is met by its partners in parts.
HOT_PAIRS = 1000


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = WordHasher(), HyperMinHash(bands, rows)
        for batch in batches:
            n, prints, registers = [], [], []
            for s in sets(_texts(batch.column(1)), size, hasher):
                n.append(len(s))
                if len(s):
                    prints.append(np.array([mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s * ODD[11])) + U(len(s))]).tobytes())
                    registers.append(sketch.registers(s).tobytes())
                else:
                    prints.append(None)
                    registers.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n", "fp", "registers"])

    return released(run)


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = [s.view(np.int64) for s in sets(_texts(batch.column(1)), size, hasher)]
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "set"])

    return released(run)


def _estimated(bands: int, rows: int, threshold: float):
    """Keeps (a, b) whose corrected estimate is at most 5 standard deviations below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = HyperMinHash(bands, rows)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, sketch.m) for c in ("ra", "rb"))
            estimate = sketch.estimate(x, y)
            n = np.minimum(sketch.m, np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()))
            keep = estimate >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / n)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(estimate)], ["a", "b", "estimate"])
            yield out.filter(pa.array(keep))

    return released(run)


def _likely_within(main, component, side, node, n, registers, band, sketch, percent):
    """(x, its likely partners, the likeliest first) of one group: nodes outside the main component against all of other components."""
    threshold = percent / 100
    for x in np.flatnonzero(~main):
        other = (component != component[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if side is not None:  # two blocks: only across
            other &= side != side[x]
        other &= main | (node > node[x])
        y = np.flatnonzero(other)
        if not len(y):
            continue
        same = registers[y] == registers[x]
        # a pair meets in several buckets: the first band that it shares has it
        y, same = (z[np.argmax(same.reshape(len(y), sketch.bands, sketch.rows).all(axis=2), axis=1) == band] for z in (y, same))
        chance = 2.0**-sketch.mantissa / 3
        estimate = (same.mean(axis=1) - chance) / (1 - chance)
        least = threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.minimum(sketch.m, np.minimum(n[y], n[x])))
        order = np.argsort(-estimate, kind="stable")
        yield x, y[order[estimate[order] >= least[order]]]


def _links_within(likely, component, node, found, percent):
    """Confirmed links of one group, at most one of a node to a component."""
    for x, partners in likely:
        done = set()
        for y in partners:
            if component[y] in done:
                continue
            s = found[y]
            at = np.searchsorted(found[x], s)
            both = int((found[x][np.minimum(at, len(found[x]) - 1)] == s).sum())
            if 100 * both >= percent * (len(s) + len(found[x]) - both):
                done.add(component[y])
                yield min(node[x], node[y]), max(node[x], node[y])


def _meeting(bands: int, rows: int, percent: int, full: bool):
    """Of groups (key, i, j): without full sets the nodes that have a likely partner there, with them the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = HyperMinHash(bands, rows)

        def met(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            col = lambda c: t.column(c).to_numpy()
            registers = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, sketch.m)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            main = t.column("main").to_numpy(zero_copy_only=False)
            likely = _likely_within(main, col("component"), col("own") if i != j else None, col("node"), col("n"), registers, t.column("band")[0].as_py(), sketch, percent)
            if not full:
                hit = np.zeros(t.num_rows, bool)
                for x, partners in likely:
                    hit[partners] = True
                    hit[x] |= len(partners) > 0
                names = ["key", "i", "j", "node"]
                return pa.RecordBatch.from_arrays([pa.array(col(c)[hit]) for c in names], names)
            sets_ = t.column("set").combine_chunks()
            ends, flat = sets_.offsets.to_numpy(), np.ascontiguousarray(sets_.values.to_numpy()).view(np.uint64)
            found = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            out = list(_links_within(likely, col("component"), col("node"), found, percent))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = np.flatnonzero((np.diff(ids, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if last is not None and tuple(ids[a]) != last:
                    yield met(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(ids[a])
        if held:
            yield met(held)

    return released(run)


class NearDuplicates:
    """Links of documents whose shingle sets have ``100 * intersection >= percent * union``."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> None:
        self.docs = small_batches(docs).select("doc_id", "text")
        self.shingle, self.percent, self.bands, self.rows = shingle, percent, bands, rows

    def _met(self, pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        """pairs, a table, with a's row for their a and b's for their b.

        An a with many pairs is one key: its row is repeated for parts of HOT_PAIRS pairs, so that no
        task holds them all.  There are at most 1 / HOT_SHARE such keys; only they are broadcast.
        """
        limit = max(HOT_PAIRS, int(pairs.count() * HOT_SHARE))
        hot = F.broadcast(materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts")).where("parts > 1"), "hot"))
        dealt = pairs.join(hot, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        there = a.join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return dealt.join(there, ["a", "part"]).join(b, "b")

    def _candidates(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
        return self._met(materialise(pairs, "pairs"), side("a"), side("b")).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(self.bands, self.rows, self.percent / 100), "a long, b long, estimate double")

    def _sets(self, ids: DataFrame) -> DataFrame:
        """The full shingle sets of the documents in ids, a table; of a doc_id with several texts, the least set."""
        few = ids.count() <= BROADCAST_IDS
        picked = self.docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        return materialise(picked.mapInArrow(_full_sets(self.shingle), "doc_id long, set array<long>").groupBy("doc_id").agg(F.min("set").alias("set")), "sets")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that hold on full sets; pairs is a table."""
        full = self._sets(materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids"))
        side = lambda x: full.select(F.col("doc_id").alias(x), F.col("set").alias(f"s{x}"))
        both = F.size(F.array_intersect("sa", "sb"))
        found = self._met(pairs.select("a", "b"), side("a"), side("b")).select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        return found.where(F.lit(100) * F.col("i") >= F.lit(self.percent) * (F.col("t") - F.col("i"))).select("a", "b")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept: see the query.

        Rows without a doc_id are linked with nothing: component_id is null and kept true.  Rows that
        repeat a doc_id are one document; each returns its row with its own text's n_shingles.  Where
        such rows differ in their texts, the document has the links of the set that sorts first, and
        the documents whose sets equal one of the others are linked to it, too.
        """
        known = self.docs.where(F.col("doc_id").isNotNull())
        sketched = materialise(known.mapInArrow(_sketches(self.shingle, self.bands, self.rows), "doc_id long, n long, fp binary, registers binary"), "sketches")
        total = sketched.count()
        filled = sketched.where("n > 0")
        groups = materialise(filled.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("group_size"), F.first("n").alias("n"), F.first("registers").alias("registers")), "groups")
        nodes = groups.select("node", "n", "registers")
        links = self._links(nodes, total)
        named = components(links)
        groups = materialise(groups.drop("registers", "n").join(named, "node", "left").select("fp", "group_size", F.coalesce("component", "node").alias("component_id")), "named")
        linked = with_groups(filled.select("doc_id", "n", "fp"), groups, "fp", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        alone = sketched.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        lost = self.docs.where(F.col("doc_id").isNull()).mapInArrow(_sketches(self.shingle, self.bands, self.rows), "doc_id long, n long, fp binary, registers binary")
        out = linked.unionByName(alone).unionByName(lost.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    def _links(self, nodes: DataFrame, total: int) -> DataFrame:
        width = 2 * self.rows
        band = F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda i: F.xxhash64(i, F.expr("registers").substr(i * width + 1, F.lit(width))))
        keyed = nodes.select("node", "n", F.posexplode(band).alias("band", "key"))
        sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("bucket_size")).where("bucket_size > 1"), "buckets")
        members = materialise(with_groups(keyed, sizes, "key", total, "bucket_size"), "members")

        # a bucket's center is the node with most neighbours over all of its buckets: the copied text rather than a copy
        degrees = members.groupBy("node").agg(F.sum("bucket_size").alias("degree"))
        ranked = members.join(degrees, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("center"), F.count("*").alias("bucket_size"))
        centered = with_groups(members.drop("bucket_size"), materialise(ranked, "centers"), "key", total, "bucket_size")
        star = centered.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
        tried = materialise(self._candidates(star, nodes).groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")), "tried")
        first = materialise(self._confirmed(tried), "links")
        named = components(first)

        held = materialise(members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")), "held")
        parts = held.groupBy("key", "component").agg(F.count("*").alias("size"))
        mixed = parts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("bucket_size"), F.max("size").alias("main_size")).where("parts > 1")
        several = materialise(with_groups(held.drop("bucket_size"), materialise(mixed.drop("parts"), "mixed"), "key", total, "bucket_size"), "several")
        small = self._small_buckets(several.where(F.col("bucket_size") <= SMALL)).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        second = self._confirmed(materialise(self._candidates(small, nodes), "pairs"))
        third = self._large_buckets(several.where(F.col("bucket_size") > SMALL), nodes)
        return materialise(first.unionByName(second).unionByName(third), "links")

    def _small_buckets(self, several: DataFrame) -> DataFrame:
        """Pairs across components in buckets of up to SMALL nodes; less than SMALL pairs a node and bucket."""
        left = several.where("component != most").select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))
        right = several.select("key", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), "most")
        near = F.lit(100) * F.least("nx", "ny") >= F.lit(self.percent) * F.greatest("nx", "ny")
        cross = left.join(right, "key").where((F.col("cx") != F.col("cy")) & near & ((F.col("cy") == F.col("most")) | (F.col("x") < F.col("y"))))
        return cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def _large_buckets(self, several: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links across components in larger buckets, found where blocks of their nodes meet.

        Registers meet first; the nodes that have a likely partner in a group meet there again with
        their full sets, and only confirmed links leave it.
        """
        dealt = materialise(_dealt(several), "dealt")
        grouped = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        sketched = dealt.join(nodes.select("node", "n", "registers"), "node")
        likely = grouped(sketched).mapInArrow(_meeting(self.bands, self.rows, self.percent, False), "key long, i int, j int, node long")
        likely = materialise(likely, "likely")
        full = self._sets(materialise(likely.select(F.col("node").alias("doc_id")).distinct(), "ids")).withColumnRenamed("doc_id", "node")
        rows = sketched.join(likely, ["key", "i", "j", "node"]).join(full, "node")
        return grouped(rows).mapInArrow(_meeting(self.bands, self.rows, self.percent, True), "a long, b long").distinct()


def _dealt(several: DataFrame) -> DataFrame:
    """Rows of buckets dealt to the groups (key, i, j) where two blocks of about BLOCK_NODES nodes meet.

    Nodes outside the main component have the first blocks, and meet in pairs of blocks all others; the
    main component's nodes have the further ones, and meet the first ones only.  A bucket with one node
    outside has as many groups as main blocks, and each main node is in one.
    """
    main = F.col("component") == F.col("most")
    blocks = lambda n: F.ceil(n / BLOCK_NODES).cast("int")
    first, all_ = blocks(F.col("bucket_size") - F.col("main_size")), blocks(F.col("bucket_size") - F.col("main_size")) + blocks(F.col("main_size"))
    own = F.when(main, first + F.pmod(F.xxhash64("node", F.lit(3)), blocks(F.col("main_size")))).otherwise(F.pmod(F.xxhash64("node", F.lit(3)), first)).cast("int")
    dealt = several.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, first).otherwise(all_) - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "node", "component", main.alias("main"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id linked, directly or not), kept; see the module.

    A set holds the distinct shingles of ``shingle`` words (A-Z lower-cased); a shorter text's whole
    word sequence is its one shingle; texts without words (null, empty) have none and link with
    nothing.  Other columns are ignored.  Rows without a doc_id are linked with nothing (component_id
    null, kept true); rows that repeat one are one document, see ``NearDuplicates.run``.  No rows give no rows.
    """
    return NearDuplicates(docs, shingle, percent, bands, rows).run()


def distinct_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each linked group.

    The ids that go are broadcast while they are few (the count is checked), else joined by a shuffle.
    All rows of an id that goes go; rows without an id, or without words, stay.
    """
    going = materialise(near_duplicates(docs, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("__loom_id")).distinct(), "going")
    few = going.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(going) if few else going, F.col("doc_id") == F.col("__loom_id"), "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, by three-word shingles and a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     ')), ' +') AS w FROM documents),
e AS (SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM d),
s AS (SELECT doc_id, hash(CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM e)),
t AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v),
k AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.c AS component_id, doc_id = k.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN k ON k.v = doc_id
"""
