"""Streams against plain folds: tails of files, counters, packing, shuffling, splitting, cycles, rollouts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from loom.operators.sequential import pack, rollout
from loom.sources import files
from loom.streaming import flows, state
from loom.streaming.sources import TailReader


def runs(spark, parts, make, mode="append"):
    """The parts as batches of one query, each after a restart; the result with the batch that gave it."""
    path, out, checkpoint = (files.scratch(spark, x) for x in ("in", "out", "checkpoint"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        found = flows.run(make(flows.source(spark, path, part.schema, files_per_trigger=100)), out, checkpoint, mode)
    return found


@pytest.fixture(scope="module")
def rows(spark):
    return [(i % 3 if i % 7 else 5, i * 10 + 2**60 + 1, (i * 37) % 50 + 1 if i % 101 else 300) for i in range(700)]


KIND = "shard long, id long, len long"


def batches(spark, rows, cuts, ends):
    edges = [0, *cuts, len(rows)]
    parts = [spark.createDataFrame(rows[a:b], KIND) for a, b in zip(edges, edges[1:], strict=False)]
    return [*parts, spark.createDataFrame([(s, None, None) for s in ends], KIND)] if ends else parts


def plain_packing(rows, most, interval, finished):
    """The fold of the whole input, whatever its batches: carry the last bin, take the next interval."""
    out = {}
    for shard in {r[0] for r in rows}:
        items, waiting, fresh, done = [(i, n) for s, i, n in rows if s == shard], [], 0, 0
        for k, item in enumerate(items):
            waiting, fresh = [*waiting, item], fresh + 1
            last = shard in finished and k == len(items) - 1
            if fresh == interval or last:
                bins = pack([n for _, n in waiting], most)
                keep = max(bins) + 1 if last else max(bins)
                out |= {(shard, i): done + b for (i, _), b in zip(waiting, bins, strict=True) if b < keep}
                waiting, done, fresh = [w for w, b in zip(waiting, bins, strict=True) if b >= keep], done + keep, 0
    return out


@pytest.mark.parametrize("cuts", [[], [1, 130, 131, 400]])
def test_packing(spark, rows, cuts):
    found = runs(spark, batches(spark, rows, cuts, [0, 1, 5]), lambda s: flows.packed(s, "shard", "id", "len", 128, 64)).collect()
    placed = {(r.shard, r.id): r.bin for r in found}
    expected = plain_packing(rows, 128, 64, {0, 1, 5})
    assert len(found) == len(placed) == len(expected) and placed == expected
    lengths, held = {(s, i): n for s, i, n in rows}, {}
    for key, b in placed.items():
        held.setdefault((key[0], b), []).append(lengths[key])
    assert all(sum(x) <= 128 or len(x) == 1 for x in held.values())
    assert {k for k in lengths if k[0] != 2} <= set(placed) and len([k for k in lengths if k[0] == 2 and k not in placed]) < 64 + 128


def test_packing_gives_out_what_waits_after_silence(spark, rows):
    path, out, checkpoint = (files.scratch(spark, x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame(rows[:100], KIND).write.parquet(path)
    before = spark.conf.get(flows.PROVIDER)
    spark.conf.set(flows.PROVIDER, flows.ROCKS)
    query = flows.packed(flows.source(spark, path, KIND), "shard", "id", "len", 128, 64, idle=1000).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(out)
    try:
        deadline, seen = time.time() + 90, 0
        while time.time() < deadline and seen < 100:
            time.sleep(1)
            seen = spark.read.schema("shard long, id long, bin int").parquet(out).count() if os.path.isdir(out.removeprefix("file://")) else 0
    finally:
        query.stop()
        spark.conf.set(flows.PROVIDER, before)
    assert {r.id for r in spark.read.parquet(out).collect()} == {r[1] for r in rows[:100]} and seen == 100


def plain_shuffle(rows, shard, buffer, seed, end):
    held, out, seen = [], [], 0
    for row in (r for r in rows if r[0] == shard):
        if len(held) < buffer:
            held.append(row)
        else:
            at = state.draw(seed, shard, seen, buffer)
            out.append(held[at])
            held[at] = row
        seen += 1
    while end and held:
        out.append(held.pop(state.draw(seed, shard, seen + len(held), len(held))))
    return out


def test_shuffle(spark, rows):
    rows = [(s, i, None if n == 5 else n) for s, i, n in rows]
    found = runs(spark, batches(spark, rows, [40, 300], [0, 1, 5]), lambda s: flows.shuffled(s, "shard", "id", 30, 3)).collect()
    for shard in (0, 1, 2, 5):
        given = [(r.shard, r.id, r.len) for r in sorted((r for r in found if r.shard == shard), key=lambda r: r.at)]
        own = [r for r in rows if r[0] == shard]
        assert given == plain_shuffle(rows, shard, 30, 3, shard != 2) and sorted(r.at for r in found if r.shard == shard) == list(range(len(given)))
        assert len(given) == len(own) - (30 if shard == 2 else 0) and given != own[: len(given)]
        assert all(given.index(r) > k - 30 for k, r in enumerate(own) if r in given)


def test_split(spark, rows):
    found = runs(spark, batches(spark, rows, [35, 36], []), lambda s: flows.split(s, "shard", "id", 20, 0.25)).collect()
    for shard in (0, 1, 2, 5):
        assert [(r.id, r.part) for r in sorted((r for r in found if r.shard == shard), key=lambda r: r.id)] == [(r[1], "val" if k < 5 else "train") for k, r in enumerate([r for r in rows if r[0] == shard][:20])]
    for sample, ratio in ((0, 0.5), (5, 1.5)):
        with pytest.raises(ValueError, match="sample"):
            flows.split(spark.readStream.format("rate").load().selectExpr("value AS shard", "value AS id"), "shard", "id", sample, ratio)


def test_rollouts(spark):
    r = __import__("random").Random(4)
    steps = [(q, p, r.choice(["seg"] * 6 + ["answer", "stop", None]), r.uniform(-1, 9), r.uniform(0, 12), 10.0) for q in range(40) for p in range(r.randint(1, 12))]
    mixed = r.sample(steps, len(steps)) + steps[:30]
    schema = "request long, place long, reason string, start double, end double, duration double"
    parts = [spark.createDataFrame(mixed[k::3], schema) for k in range(3)]
    found = runs(spark, parts, lambda s: flows.rollouts(s, "request", "place"), "update").collect()
    names = ("reason", "start", "end", "duration")
    for q in range(40):
        expected = rollout([dict(zip(names, s[2:], strict=True)) for s in steps if s[0] == q])
        last = max((x for x in found if x.request == q), key=lambda x: x.batch)
        assert (last.rounds, last.segments, last.finish) == (expected["rounds"], expected["segments"], expected["finish"])


def test_rollouts_fold_without_a_call_per_request(spark):
    """The first batch's output of a number counts; a missing start is 0, as in sequential.rollouts, and a missing place is no output."""
    schema = "request long, place long, reason string, start double, end double, duration double"
    first = [(1, 1, "answer", None, None, 10.0), (2, 0, "seg", None, 2.0, 10.0), (2, None, "seg", 1.0, 2.0, 10.0), (None, 0, None, 1.0, 2.0, 10.0), (3, 9, "seg", 1.0, 2.0, 10.0), (4, 0, "seg", 1.0, 2.0, 10.0)]
    then = [(1, 1, "seg", 1.0, 2.0, 10.0), (1, 0, "seg", 0.0, 5.0, 10.0), (2, 1, "seg", 1.0, 2.0, 10.0)]
    machine = lambda s: flows.rollouts(s, "request", "place")
    found = runs(spark, [spark.createDataFrame(x, schema) for x in (first, then)], machine, "update").collect()
    assert sorted((r.batch, r.request or 0, r.rounds, r.segments, r.finish) for r in found) == [(0, 0, 1, 0, "finalized"), (0, 1, 0, 0, "open"), (0, 2, 1, 1, "open"), (0, 3, 0, 0, "open"), (0, 4, 1, 1, "open"), (1, 1, 2, 1, "answer"), (1, 2, 2, 2, "open")]
    rate = spark.readStream.format("rate").load().selectExpr("value AS request", "value AS place", "'seg' AS reason", "0D AS start", "1D AS end", "1D AS duration")
    plan = lambda keep: flows.rollouts(rate, "request", "place", keep=keep)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan(None) and "TransformWithState" in plan(1000)


def test_cycle(spark):
    path = files.scratch(spark, "cycle")
    spark.range(100).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    out, checkpoint, progress = (files.scratch(spark, x) for x in ("out", "checkpoint", "progress"))
    for epochs in (1, 3):
        found = flows.run(flows.cycle(spark, path, "id long", epochs), out, checkpoint, "append").collect()
        for e in range(epochs):
            assert [r.id for r in sorted((r for r in found if r.epoch == e), key=lambda r: (r.place, r.row))] == list(range(100))
        assert len(found) == 100 * epochs
    out, checkpoint = (files.scratch(spark, x) for x in ("out", "checkpoint"))
    for k in range(1, 6):  # two of three units at a time, without end
        found = flows.run(flows.cycle(spark, path, "id long", 0, 2, progress), out, checkpoint, "append")
        assert found.select("epoch", "place").distinct().count() == 2 * k and found.count() == found.distinct().count()
    with pytest.raises(Exception, match="endless"):
        flows.run(flows.cycle(spark, path, "id long"), *(files.scratch(spark, x) for x in ("out", "checkpoint")), "append")


def append(path, name, data):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "ab") as f:
        f.write(data)


def test_tail_reads_each_line_once(spark, tmp_path):
    path, out, checkpoint = str(tmp_path / "in"), *(files.scratch(spark, x) for x in ("out", "checkpoint"))
    stream = lambda: flows.tail(spark, path)
    append(path, "a.jsonl", b"one\ntwo\r\n\nunfinis")
    append(path, "b.jsonl", "ü\n".encode() + b"\xff\n")
    append(path, ".hidden.jsonl", b"no\n")
    append(path, "c.txt", b"no\n")
    found = lambda n: sorted((os.path.basename(r.file), r.at, r.line) for r in flows.run(stream(), out, checkpoint, "append").where(F.col("batch") == n).collect())
    assert found(0) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 9, ""), ("b.jsonl", 0, "ü"), ("b.jsonl", 3, "�")]
    append(path, "a.jsonl", b"hed\nmore")
    assert found(1) == [("a.jsonl", 10, "unfinished")]
    with open(f"{path}/a.jsonl", "wb") as f:
        f.write(b"new\n")
    os.remove(f"{path}/b.jsonl")
    again = [(os.path.basename(r.file), r.at, r.line, r.rebuilt) for r in flows.run(stream(), out, checkpoint, "append").where("batch = 2").collect()]
    assert sorted(again, key=repr) == sorted([("a.jsonl", 0, None, True), ("a.jsonl", 0, "new", False), ("b.jsonl", 0, None, True)], key=repr)


@pytest.mark.parametrize("split", [1, 2, 7, 64, 10_000])
def test_tail_ranges_cut_anywhere(tmp_path, split):
    lines = [b"x" * (k * k % 23) for k in range(60)]
    append(str(tmp_path), "a.jsonl", b"\n".join(lines) + b"\n")
    reader = TailReader({"path": str(tmp_path), "split": str(split)})
    end = reader.latestOffset()
    found = [x for part in reader.partitions({}, end) for batch in reader.read(part) for x in batch["line"].to_pylist()]
    assert [x.encode() for x in found] == lines
    assert [x for part in reader.partitions(end, end) for batch in reader.read(part) for x in batch["line"].to_pylist()] == []


def test_counters_go_on_and_begin_anew(spark, tmp_path):
    path, out, checkpoint = str(tmp_path / "in"), *(files.scratch(spark, x) for x in ("out", "checkpoint"))

    def totals():
        found = flows.running_counters(flows.tail(spark, path), "x long, labels array<string>", {"x": F.col("r.x")}, {"label": F.col("r.labels"), "n": F.size("r.labels")}, out, checkpoint)
        return {(os.path.basename(r.file), r.counter, r.key): r.n for r in found.collect() if r.n}

    append(path, "a.jsonl", b'{"x": 2, "labels": ["p", "q"]}\n\n{bad\n[1]\n')
    assert totals() == {("a.jsonl", "lines", None): 4, ("a.jsonl", "bad", None): 2, ("a.jsonl", "samples", None): 1, ("a.jsonl", "x", None): 2, ("a.jsonl", "label", "p"): 1, ("a.jsonl", "label", "q"): 1, ("a.jsonl", "n", "2"): 1}
    append(path, "a.jsonl", b'{"x": 5}\n{"labels": ["p"]}\n')
    append(path, "b.jsonl", b'{"x": 1}\n')
    second = totals()
    assert second["a.jsonl", "x", None] == 7 and second["a.jsonl", "label", "p"] == 2 and second["b.jsonl", "samples", None] == 1 and second["a.jsonl", "lines", None] == 6
    assert totals() == second
    with open(f"{path}/a.jsonl", "wb") as f:
        f.write(b'{"x": 9}\n')
    third = totals()
    assert third["a.jsonl", "x", None] == 9 and third["a.jsonl", "lines", None] == 1 and third["b.jsonl", "x", None] == 1 and ("a.jsonl", "label", "p") not in third


def test_append_lines_is_repeatable(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"line {i}") for i in range(40)], "k long, line string")
    path = f"file://{tmp_path}/out"
    for _ in range(2):
        files.append_lines(rows, "line", F.col("k") % 3, path)
    found = {p: open(f"{tmp_path}/out/{p}").read().splitlines() for p in os.listdir(tmp_path / "out")}  # noqa: SIM115
    assert set(found) == {"0.jsonl", "1.jsonl", "2.jsonl"} and all(sorted(x[: len(x) // 2]) == sorted(x[len(x) // 2 :]) for x in found.values()) and sum(map(len, found.values())) == 80
    with pytest.raises(ValueError, match="shared mounts"):
        files.append_lines(rows, "line", F.col("k"), "s3://somewhere/x")
