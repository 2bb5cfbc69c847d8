"""A Merkle manifest: leaves of rows, a tree per group, a tree over the groups' roots, a proof per row.

Leaves are hashed where the rows are read; from then on only digests move.  A range sort lays them in
order, each sorted part numbers its own, and the counts of parts give every leaf its index in its
group.  Parts are cut into chunks.  A chunk is a mountain range: leaves are pushed on a stack, and each
push that ends a run of ``fanout`` siblings carries into their parent, as in counting with that base.
What the stack holds at the end are the chunk's peaks: nodes whose siblings lie in other chunks.  A run
that ends its level is complete however short it is, and its hash takes no padding.  Peaks of a span of
the index meet in one task and go through the same stack, then those of larger spans, until every
group has one node, its root; a task never holds more than a chunk's leaves or a span's peaks.  Then
the spans are walked back: each stack run again with its node records gives every input its siblings,
to which those of the peak above it are added, down to the leaves.

Odd rows: leaves of one doc_id are ordered by their digest, a null doc_id comes first; equal leaves are
all kept.  A null doc_id is never tampered with.  Columns of other names are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loom.llm.common import discard, materialise, released, table

FANOUT = 2
#: Leaves of a chunk; and about as many nodes meet in a span.
CHUNK = 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digests are kept as 32 bytes and hashed as hex text.
DIGEST = 32


def node_hash(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row of documents, as binary; ``changed`` columns stand for those of their names."""
    return F.unhex(F.sha2(F.concat(*[_field(changed.get(c, F.col(f"`{c}`"))) for c in FIELDS]), 256))


def level_sizes(n: int, fanout: int) -> list[int]:
    """Nodes on each level, from n leaves to one root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


class Mountains:
    """A stack of nodes (level, index, digest) of one group, pushed in the order of their leaves."""

    def __init__(self, n: int, fanout: int, recording: bool = False) -> None:
        self.sizes, self.fanout, self.stack = level_sizes(n, fanout), fanout, []
        self.records: dict[tuple[int, int], bytes] | None = {} if recording else None

    def push(self, level: int, index: int, digest: bytes) -> None:
        """Adds a node; while a run of siblings ends with it and is here in full, the run becomes its parent."""
        stack, fanout = self.stack, self.fanout
        while True:
            stack.append((level, index, digest))
            if self.records is not None:
                self.records[level, index] = digest
            if self.sizes[level] == 1 or not (index % fanout == fanout - 1 or index == self.sizes[level] - 1):
                return
            run = index % fanout + 1
            if len(stack) < run or stack[-run][:2] != (level, index - run + 1):
                return
            digest = node_hash([x[2] for x in stack[-run:]])
            del stack[-run:]
            level, index = level + 1, index // fanout

    def siblings(self, level: int, index: int) -> tuple[bytes, tuple[int, int]]:
        """Digests of a node's siblings, level by level, up to the peak over it; and that peak."""
        found = []
        while self.sizes[level] > 1:
            if (level + 1, index // self.fanout) not in self.records:
                break
            first = index - index % self.fanout
            found += [self.records[level, i] for i in range(first, min(first + self.fanout, self.sizes[level])) if i != index]
            level, index = level + 1, index // self.fanout
        return b"".join(found), (level, index)


def folded(digest: bytes, index: int, n: int, proof: bytes, fanout: int) -> tuple[bytes, int]:
    """The root that a leaf and its siblings give, and how many bytes of proof it took."""
    at = 0
    for size in level_sizes(n, fanout)[:-1]:
        place = index % fanout
        run = min(fanout, size - (index - place))
        others = [proof[at + DIGEST * k : at + DIGEST * (k + 1)] for k in range(run - 1)]
        digest = node_hash([*others[:place], digest, *others[place:]])
        at, index = at + DIGEST * (run - 1), index // fanout
    return digest, at


#: Nodes and proofs as they move between spans; ``made`` is the chunk or span whose peak a node is, ``seed`` what its group's root was given.
NODE = "grp string, level int, idx long, digest binary, n long, made string"
PROOF = "grp string, level int, idx long, proof binary, seed binary, span string"


def _rows(found: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(found[c].to_pylist() for c in names), strict=True))


def _table(rows: list[tuple], names: str, schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _ranges(nodes: pa.Table, fanout: int, recording: bool = False) -> dict[str, Mountains]:
    """The stacks of a chunk or span, one per group."""
    rows = _rows(nodes, "grp", "level", "idx", "digest", "n")
    rows.sort(key=lambda r: (r[0], r[2] * fanout ** r[1]))
    found: dict[str, Mountains] = {}
    for grp, level, idx, digest, n in rows:
        if grp not in found:
            found[grp] = Mountains(n, fanout, recording)
        found[grp].push(level, idx, digest)
    return found


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, a table with a column grp, with idx (place in the group by ``order``), n (rows of the group) and chunk.

    A part of the range sort is one task's; a tie that ``order`` leaves must be between equal rows.
    """
    size = CHUNK

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, last, local = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            chunks, places = [], []
            for grp in batch["grp"].to_pylist():
                last, local = grp, local + 1 if grp == last else 0
                chunks.append(f"{part}-{row // size}")
                places.append(local)
                row += 1
            more = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(chunks, pa.string()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "chunk", "place"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    laid = materialise(laid.mapInArrow(count, f"{kinds}, part int, chunk string, place long"), "merkle-laid")
    counts = laid.groupBy("grp", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(counts.groupBy("grp").agg(F.sum("rows").alias("n")), "grp").drop("rows")
    found = laid.join(offsets, ["grp", "part"]).withColumn("idx", F.col("place") + F.col("before")).drop("part", "place", "before")
    found = materialise(found, "merkle-numbered")
    discard(laid)
    return found


class Forest:
    """Trees over numbered leaves, one per group: peaks of chunks, merged span by span up to the roots.

    ``leaves`` is a table of grp, idx, n, chunk, digest and columns to keep.  The nodes of a round are
    a table in the shared folder, so a lost executor costs a part of a round; rounds follow the
    logarithm of the leaves.  ``close`` deletes the tables.
    """

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT) -> None:
        self.fanout, self.leaves = fanout, leaves
        depth = len(level_sizes(CHUNK, fanout)) - 1
        peaks = 2 * (fanout - 1) * max(1, depth)
        reach, step = depth + max(1, len(level_sizes(max(1, CHUNK // peaks), fanout)) - 1), max(1, depth)
        height = len(level_sizes(leaves.agg(F.max("n").alias("n")).first().n or 1, fanout)) - 1
        nodes = self._merged(leaves.select("grp", F.lit(0).alias("level"), "idx", "digest", "n", F.col("chunk").alias("span")))
        self.rounds: list[DataFrame] = []
        while not self.rounds or reach - step < height:
            # a span of fanout ** reach leaves; a node larger than that is in the span where it begins
            place = "0L" if reach >= height else f"idx * CAST(pow({fanout}, level) AS LONG) div {fanout**reach}L"
            self.rounds.append(materialise(nodes.withColumn("span", F.concat_ws("-", "grp", F.expr(place).cast("string"))), "merkle-nodes"))
            nodes = self._merged(self.rounds[-1])
            reach += step
        self.roots = materialise(nodes, "merkle-roots")
        self.tables = [*self.rounds, self.roots]

    def _merged(self, nodes: DataFrame) -> DataFrame:
        """The peaks of each span."""
        fanout, schema = self.fanout, _arrow(NODE)

        def run(key: tuple, nodes: pa.Table) -> pa.Table:
            ranges = _ranges(nodes, fanout)
            return _table([(grp, *peak, m.sizes[0], key[0].as_py()) for grp, m in ranges.items() for peak in m.stack], NODE, schema)

        return nodes.groupBy("span").applyInArrow(run, NODE)

    def _below(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        """Proofs of a round's nodes, given those of its spans' peaks: own siblings first, then the peak's."""
        fanout, schema = self.fanout, _arrow(PROOF)

        def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
            ranges = _ranges(nodes, fanout, recording=True)
            upper = {(grp, level, idx): more for grp, level, idx, *more in _rows(above, "grp", "level", "idx", "proof", "seed")}
            rows = []
            for grp, level, idx, made in _rows(nodes, "grp", "level", "idx", "made"):
                own, peak = ranges[grp].siblings(level, idx)
                proof, seed = upper[grp, *peak]
                rows.append((grp, level, idx, own + proof, seed, made))
            return _table(rows, PROOF, schema)

        return nodes.groupBy("span").cogroup(above.groupBy("span")).applyInArrow(run, PROOF)

    def proofs(self, seeds: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """grp, idx, n, digest, proof, seed and the kept columns of each leaf.

        proof holds the digests of its siblings, level by level, 32 bytes each; seed is its group's in seeds (grp, seed).
        """
        fanout = self.fanout
        above = self.roots.join(seeds, "grp").select("grp", "level", "idx", F.lit(b"").alias("proof"), "seed", F.col("made").alias("span"))
        for nodes in reversed(self.rounds):
            above = materialise(self._below(nodes, above), "merkle-proofs")
            self.tables.append(above)
        names = ("grp", "idx", "n", "digest", *keep)
        leaves = self.leaves.select(*names, "chunk")
        kinds = dict(leaves.dtypes)

        def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
            nodes = leaves.append_column("level", pa.array([0] * len(leaves), pa.int32()))
            ranges = _ranges(nodes, fanout, recording=True)
            upper = {(grp, level, idx): more for grp, level, idx, *more in _rows(above, "grp", "level", "idx", "proof", "seed")}
            proofs, seeds = [], []
            for grp, idx in _rows(leaves, "grp", "idx"):
                own, peak = ranges[grp].siblings(0, idx)
                proof, seed = upper[grp, *peak]
                proofs.append(own + proof)
                seeds.append(seed)
            return leaves.drop_columns(["chunk"]).append_column("proof", pa.array(proofs, pa.binary())).append_column("seed", pa.array(seeds, pa.binary()))

        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", proof binary, seed binary"
        return leaves.groupBy("chunk").cogroup(above.groupBy("span")).applyInArrow(run, schema)

    def close(self) -> None:
        discard(*self.tables)


#: Columns of a manifest.
MANIFEST = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verified(fanout: int):
    """Rows of proofs, with tampered leaves, to rows of the manifest."""
    number = lambda x: int.from_bytes(x, "big")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for idx, n, digest, tampered, proof, seed in _rows(batch, "idx", "n", "digest", "tampered", "proof", "seed"):
                subroot, root, at, of, upper = seed[:32], seed[32:64], number(seed[64:72]), number(seed[72:80]), seed[80:]
                top, _ = folded(digest if tampered is None else tampered, idx, n, proof, fanout)
                top, _ = folded(top, at, of, upper, fanout)
                rows.append((digest.hex(), subroot.hex(), root.hex(), hashlib.sha256((proof + upper).hex().encode()).hexdigest(), top.hex(), top == root))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string()] * 5 + [pa.bool_()]
            names = [field.split(" ")[0] for field in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    return run


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    A leaf covers doc_id, source, lang, n_chars and text.  Per lang, leaves ascend by doc_id; the
    langs' roots, null first, then bytewise, make the root.  Where ``tampered`` is true, folding starts
    from the leaf of n_chars + 1.  Odd rows: see the module.
    """
    changed = leaf_of(n_chars=F.col("n_chars") + 1)
    wrong = F.when(tampered & F.col("n_chars").isNotNull(), changed) if tampered is not None else F.lit(None).cast("binary")
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    rows = materialise(docs.select(group.alias("grp"), "lang", "doc_id", leaf_of().alias("digest"), wrong.alias("tampered"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    leaves = numbered(rows.drop("lang"), ["doc_id", "digest", "row"])
    trees = Forest(leaves, fanout)
    langs = trees.roots.select("grp", "digest").join(rows.groupBy("grp").agg(F.first("lang").alias("lang")), "grp")
    langs = materialise(langs.select(F.lit("").alias("grp"), F.col("grp").alias("lang_grp"), "lang", "digest"), "merkle-langs")
    tops = numbered(langs, ["lang"])
    top = Forest(tops, fanout)
    whole = top.proofs(top.roots.select("grp", F.col("digest").alias("seed")), ("lang_grp",))
    long = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    seeds = materialise(whole.select(F.col("lang_grp").alias("grp"), F.concat("digest", "seed", long(F.col("idx")), long(F.col("n")), "proof").alias("seed")), "merkle-seeds")
    kind = dict(docs.dtypes)["doc_id"]
    found = trees.proofs(seeds, ("doc_id", "tampered")).mapInArrow(_verified(fanout), f"doc_id {kind}, {MANIFEST}")
    found = materialise(found, "merkle-manifest")
    trees.close()
    top.close()
    discard(rows, leaves, langs, tops, seeds)
    return found


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; rows whose doc_id's checksum 7 divides are tampered with."""
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)

_SQL_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in FIELDS) + ")"
#: CRC-32 of a decimal number, bit by bit.
_SQL_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, b: list_reduce(list_prepend(xor(x, b), CAST(range(8) AS BIGINT[])), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))))"
_SQL_RAISED = "SELECT level + 1, grp, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM {0}) WHERE c > 1 GROUP BY level, grp, idx // 2"
OP12_SQL = f"""
WITH RECURSIVE leaf AS (SELECT doc_id, lang AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, {_SQL_LEAF} AS h, CASE WHEN {_SQL_CRC} % 7 = 0 THEN {_SQL_LEAF.replace('n_chars', '(n_chars + 1)')} ELSE {_SQL_LEAF} END AS t FROM documents),
low AS (SELECT 0 AS level, grp, idx, h FROM leaf UNION ALL {_SQL_RAISED.format('low')}),
root_of AS (SELECT grp, max(level) AS height, max_by(h, level) AS subroot FROM low GROUP BY grp),
langs AS (SELECT *, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place FROM root_of),
high AS (SELECT 0 AS level, true AS grp, place AS idx, subroot AS h FROM langs UNION ALL {_SQL_RAISED.format('high')}),
total AS (SELECT max(level) AS top, max_by(h, level) AS root FROM high),
node AS (SELECT d.doc_id, level, low.h FROM leaf d JOIN root_of r ON d.grp IS NOT DISTINCT FROM r.grp JOIN low ON low.grp IS NOT DISTINCT FROM d.grp AND level < height AND low.idx = xor(d.idx >> level, 1)
  UNION ALL SELECT d.doc_id, height + level, high.h FROM leaf d JOIN langs r ON d.grp IS NOT DISTINCT FROM r.grp, total JOIN high ON level < top AND high.idx = xor(place >> level, 1)),
fold AS (SELECT d.doc_id, 0 AS level, height, top, d.idx, place, t AS h FROM leaf d JOIN langs r ON d.grp IS NOT DISTINCT FROM r.grp, total
  UNION ALL SELECT f.doc_id, f.level + 1, height, top, idx, place, sha256(CASE WHEN n.h IS NULL THEN f.h WHEN (CASE WHEN f.level < height THEN idx >> f.level ELSE place >> (f.level - height) END) % 2 = 0 THEN f.h || n.h ELSE n.h || f.h END)
  FROM fold f LEFT JOIN node n ON n.doc_id = f.doc_id AND n.level = f.level WHERE f.level < height + top),
proof AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY level)) AS p FROM node GROUP BY doc_id)
SELECT d.doc_id, d.h AS leaf, r.subroot, root, coalesce(p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaf d JOIN root_of r ON d.grp IS NOT DISTINCT FROM r.grp JOIN fold f ON f.doc_id = d.doc_id AND f.level = f.height + f.top LEFT JOIN proof p ON p.doc_id = d.doc_id, total
"""
