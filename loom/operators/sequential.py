"""Steps that are sequential by nature, as grouped Arrow/pandas functions over bounded groups.

Packing, balanced partitions and quota choice depend on every earlier row of their group; a group is
a shard of bounded size, and shards run in parallel.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.sources import files


def pack(lengths: Sequence[int], most: int) -> list[int]:
    """A bin per item so that no bin holds more than ``most``: longest first, each into the fullest bin it fits."""
    bins: list[int] = []
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [b for b, held in enumerate(bins) if held + lengths[i] <= most]
        if fits:
            b = max(fits, key=lambda b: (bins[b], -b))
            bins[b] += lengths[i]
        else:
            b = len(bins)
            bins.append(lengths[i])
        out[i] = b
    return out


def packed(df: DataFrame, key: str, length: str, most: int, interval: int = 128) -> DataFrame:
    """key, length, shard, bin: rows in key order, packed within intervals of rows.

    Intervals are packed apart, so that each is a task of its own; their last bins are emptier than where
    a bin is carried on, as ``loom.streaming.flows.packed`` does.
    """
    shard = F.floor(F.col(key) / interval)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pdf.assign(bin=pack(pdf[length].tolist(), most))

    kind = f"{key} long, {length} long, shard long, bin int"
    return df.select(F.col(key).cast("long").alias(key), F.col(length).cast("long").alias(length), shard.alias("shard")).groupBy("shard").applyInPandas(run, kind)


def packed_rows(bins: DataFrame, key: str, length: str) -> DataFrame:
    """Adds where a row begins in its bin; positions restart there."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy("shard", "bin").orderBy(key)
    return bins.withColumn("offset", F.sum(length).over(w) - F.col(length))


def balanced(lengths: Sequence[int], parts: int, equal: bool = False) -> list[int]:
    """A part per item with sums as even as largest differences first makes them; equal: parts of equal counts."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal and len(order) % parts:
        raise ValueError("items do not divide into equal parts")
    states = []
    groups = [order[i : i + parts] for i in range(0, len(order), parts)] if equal else [[i] for i in order]
    for n, group in enumerate(groups):
        sets = sorted([(lengths[i], [i]) for i in group] + [(0, [])] * (parts - len(group)), key=lambda s: -s[0])
        heapq.heappush(states, (-(sets[0][0] - sets[-1][0]), -sets[0][0], n, sets))
    count = len(groups)
    while len(states) > 1:
        a, b = heapq.heappop(states)[3], heapq.heappop(states)[3]
        merged = sorted([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)], key=lambda s: -s[0])
        heapq.heappush(states, (-(merged[0][0] - merged[-1][0]), -merged[0][0], count, merged))
        count += 1
    out = [0] * len(lengths)
    for part, (_, items) in enumerate(states[0][3] if states else []):
        for i in items:
            out[i] = part
    return out


def greedy(lengths: Sequence[int], parts: int) -> list[int]:
    """Each item in turn to the part with the least sum."""
    sums, out = [(0, p) for p in range(parts)], []
    heapq.heapify(sums)
    for x in lengths:
        held, p = heapq.heappop(sums)
        out.append(p)
        heapq.heappush(sums, (held + x, p))
    return out


def balanced_parts(df: DataFrame, group: str, key: str, length: str, parts: int) -> DataFrame:
    """group, key, length, part: each group (a batch) split evenly."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pdf.assign(part=balanced(pdf[length].tolist(), parts))

    return df.select(F.col(group).cast("long").alias(group), F.col(key).cast("long").alias(key), F.col(length).cast("long").alias(length)).groupBy(group).applyInPandas(run, f"{group} long, {key} long, {length} long, part int")


def merged_loads(loads: Sequence[Sequence[int]]) -> list[list[int]]:
    """Per state (sums of as many parts each), the part of the merged state that each of its parts goes to.

    As in ``balanced``, the two states of the largest differences meet first, the largest part of one
    with the smallest of the other.
    """
    heap = [(-(max(x) - min(x)), n, sorted(((v, [(n, p)]) for p, v in enumerate(x)), key=lambda s: -s[0])) for n, x in enumerate(loads)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        met = sorted([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)], key=lambda s: -s[0])
        heapq.heappush(heap, (-(met[0][0] - met[-1][0]), count, met))
        count += 1
    out = [[0] * len(x) for x in loads]
    for part, (_, held) in enumerate(heap[0][2] if heap else []):
        for n, p in held:
            out[n][p] = part
    return out


def balanced_whole(df: DataFrame, key: str, length: str, parts: int, chunk_rows: int = 10_000, fan: int = 256) -> DataFrame:
    """key, length, part: all rows in ``parts`` parts of sums as even as may be, by differencing in a tree.

    Chunks of rows, dealt by a hash of their numbers, are split by ``balanced``.  A chunk's sums are a state;
    states of ``fan`` chunks merge in one task into one, those of as many again into the next, up to one:
    a task holds chunk_rows lengths or fan * parts sums, and rows are written twice however many there are.
    Sums are even where a chunk has some hundred rows a part (spread 1 of 3,122,942 with 200,000 rows in
    64 parts, as in one task; 353 of 125,202 with 12 rows a chunk and part).  A null length weighs nothing;
    rows that repeat a key are rows of their own.
    """
    rows = files.written(df.select(F.col(key).alias("key"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("length"), F.monotonically_increasing_id().alias("row")), "lengths")
    chunks = max(1, -(-rows.count() // chunk_rows))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row").drop(columns="row")
        return pdf.assign(slot=balanced(pdf["length"].tolist(), parts))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["node"]))
        loads = {(n, p): v for n, p, v in zip(pdf["node"], pdf["slot"], pdf["load"], strict=True)}
        to = merged_loads([[int(loads.get((n, p), 0)) for p in range(parts)] for n in nodes])
        return pd.DataFrame([(n, p, nodes[0] // fan, to[i][p], loads.get((n, p), 0)) for i, n in enumerate(nodes) for p in range(parts)], columns=["node", "slot", "parent", "part", "load"])

    kind = df.schema[key].dataType.simpleString()
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks))).groupBy("chunk").applyInPandas(deal, f"key {kind}, length long, chunk long, slot int")
    dealt = files.written(dealt, "dealt")
    states = dealt.groupBy(F.col("chunk").alias("node"), "slot").agg(F.sum("length").alias("load"))
    places, nodes = None, chunks
    while True:
        up = files.written(states.groupBy(F.floor(F.col("node") / fan).alias("g")).applyInPandas(merge, "node long, slot int, parent long, part int, load long"), "merged")
        places = up.select(F.col("node").alias("chunk"), "slot", "parent", "part") if places is None else places.join(up.select(F.col("node").alias("parent"), F.col("slot").alias("part"), F.col("parent").alias("above"), F.col("part").alias("then")), ["parent", "part"]).select("chunk", "slot", F.col("above").alias("parent"), F.col("then").alias("part"))
        states, nodes = up.groupBy(F.col("parent").alias("node"), F.col("part").alias("slot")).agg(F.sum("load").alias("load")), -(-nodes // fan)
        if nodes <= 1:
            break
    return dealt.join(places.select("chunk", "slot", "part"), ["chunk", "slot"]).select(F.col("key").alias(key), F.col("length").alias(length), "part")


def quota_choice(df: DataFrame, shard: Column, key: str, kinds: str, targets: dict[str, float]) -> DataFrame:
    """Per row the candidate kind that lags its target share most, then weighs most; counts run on within a shard."""
    whole = sum(targets.values())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, int] = {}
        chosen = []
        for options in pdf.sort_values(key)[kinds]:
            n = sum(counts.values()) + 1
            best = max(sorted(options), key=lambda k: (n * targets.get(k, 1) / whole - counts.get(k, 0), targets.get(k, 1)), default=None)
            if best is not None:
                counts[best] = counts.get(best, 0) + 1
            chosen.append(best)
        return pdf.sort_values(key)[["shard", key]].assign(kind=chosen)

    return df.select(shard.cast("long").alias("shard"), F.col(key).cast("long").alias(key), kinds).groupBy("shard").applyInPandas(run, f"shard long, {key} long, kind string")


_DECODER = json.JSONDecoder()


def json_object(text: str) -> str | None:
    """The first {...} of a text that is JSON: from each brace on, as far as a JSON parser goes."""
    at = text.find("{")
    while at >= 0:
        try:
            return text[at : _DECODER.raw_decode(text, at)[1]]
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


def boxed(text: str) -> str | None:
    """The inside of the last \\boxed{...}, braces balanced."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for i in range(at + 6, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at + 7 : i]
    return None


# --- fixed values: spellings of a LaTeX answer that count as one, replaced in this order
MATH_SPELLINGS = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)
MATH_UNIT = "\\text{ "
MATH_NUMBERS = (("\\%", ""), (" .", " 0."), ("{.", "{0."))
MATH_HALF = ("0.5", "\\frac{1}{2}")
# ---
#: A command and what follows it without a brace.
_BARE_ROOT, _BARE_FRACTION = re.compile(r"\\sqrt([^{])"), re.compile(r"\\frac([^{])(\{?)(.?)")
_QUOTIENT = re.compile(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)")


def plain_math(x: str) -> str:
    """A LaTeX answer in the one spelling that equal answers share: arguments braced, no sizes, units, percent signs or blanks.

    A name of one or two characters before a single equals sign goes, its blanks counted; an unbraced
    fraction that lacks an argument leaves all fractions as they are.
    """
    for old, new in MATH_SPELLINGS:
        x = x.replace(old, new)
    x = x.partition(MATH_UNIT)[0]
    for old, new in MATH_NUMBERS:
        x = x.replace(old, new)
    x = "0" + x if x.startswith(".") else x
    name, _, value = x.partition("=")
    x = value if x.count("=") == 1 and len(name) <= 2 else x
    x = _BARE_ROOT.sub(r"\\sqrt{\1}", x).replace(" ", "")
    found = list(_BARE_FRACTION.finditer(x))
    if all(m[2] or m[3] for m in found):
        x = _BARE_FRACTION.sub(lambda m: f"\\frac{{{m[1]}}}" + (f"{{{m[3]}" if m[2] else f"{{{m[3]}}}"), x)
    x = MATH_HALF[1] if x == MATH_HALF[0] else x
    whole = _QUOTIENT.fullmatch(x)
    return f"\\frac{{{whole[1]}}}{{{whole[2]}}}" if whole else x


def action(text: str) -> tuple[str, str]:
    """Name and input of the last Action / Action Input pair."""
    a, b = text.rfind("Action:"), text.rfind("Action Input:")
    if a < 0 or b < a:
        return "", ""
    return text[a + 7 : b].strip(), text[b + 13 :].strip()


def argument_f1(said: str, true: str) -> float:
    """F1 of two JSON objects' (key, value) pairs; 0 where either is none."""
    try:
        a, b = json.loads(said), json.loads(true)
    except ValueError:
        return 0.0
    if not isinstance(a, dict) or not isinstance(b, dict):
        return 0.0
    if not a and not b:
        return 1.0
    hit = sum(a.get(k) == v for k, v in b.items() if k in a)
    return 0.0 if not hit else 2 * hit / (len(a) + len(b))


def rouge(said: Sequence[str], true: Sequence[str], n: int | str) -> float:
    """F of n-gram overlap, or of the longest common subsequence ("l")."""
    if not said or not true:
        return 0.0
    if n == "l":
        row = [0] * (len(true) + 1)
        for a in said:
            last = 0
            for j, b in enumerate(true, 1):
                last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
        hit, p, r = row[-1], len(said), len(true)
    else:
        from collections import Counter

        grams = lambda w: Counter(zip(*[w[i:] for i in range(n)], strict=False))
        a, b = grams(said), grams(true)
        hit, p, r = sum((a & b).values()), sum(a.values()), sum(b.values())
    return 0.0 if not hit else 2 * hit / (p + r)


def bleu(said: Sequence[str], true: Sequence[str], most: int = 4) -> float:
    """Sentence BLEU; a precision without hits counts as one over a power of two times its grams."""
    import math
    from collections import Counter

    if not said:
        return 0.0
    logs, zeros = 0.0, 1
    for n in range(1, most + 1):
        a = Counter(zip(*[said[i:] for i in range(n)], strict=False))
        b = Counter(zip(*[true[i:] for i in range(n)], strict=False))
        total, hit = max(1, sum(a.values())), sum((a & b).values())
        if n == 1 and not hit:
            return 0.0
        if not hit:
            zeros *= 2
        logs += math.log(hit / total if hit else 1 / (zeros * total)) / most
    return math.exp(logs) * min(1.0, math.exp(1 - len(true) / len(said)))


def generation_metrics(df: DataFrame, said: str, true: str) -> DataFrame:
    """One row: means of ROUGE-1, -2, -L and BLEU-4, times 100, over texts split at blanks; Arrow batches."""

    @F.pandas_udf("struct<r1:double,r2:double,rl:double,b4:double>")
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(x.split(), y.split()) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"r1": [rouge(x, y, 1) for x, y in rows], "r2": [rouge(x, y, 2) for x, y in rows], "rl": [rouge(x, y, "l") for x, y in rows], "b4": [bleu(x, y) for x, y in rows]})

    return df.select(score(said, true).alias("s")).agg(*[F.round(F.avg(f"s.{c}") * 100, 6).alias(n) for c, n in (("r1", "rouge_1"), ("r2", "rouge_2"), ("rl", "rouge_l"), ("b4", "bleu_4"))])


def texts(function, kind: str = "string"):
    """A text function over Arrow batches."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else function(t))

    return run


def rollout_step(used: list[tuple[float, float]], output: dict, n: int, threshold: float = 0.8, most: int = 8, finalise: bool = True) -> str | None:
    """Takes a request's n-th output (reason, start, end, duration); adds its segment to ``used`` or says how the request ends."""
    if output["reason"] == "answer":
        return "answer"
    if output["reason"] != "seg":
        return "finalized" if finalise else output["reason"]
    a, b = (max(0.0, min(output[x], output["duration"])) for x in ("start", "end"))
    if a < b:
        common = [max(0.0, min(b, y) - max(a, x)) for x, y in used]
        if not any(c / ((b - a) + (y - x) - c) >= threshold for c, (x, y) in zip(common, used, strict=True)):
            used.append((a, b))
    if n >= most:
        return "finalized" if finalise else "max_rounds"
    return None


def rollout(steps: Sequence[dict], threshold: float = 0.8, most: int = 8, finalise: bool = True) -> dict:
    """Folds a request's outputs (reason, start, end, duration) in order: accepted segments, rounds, and how it ended."""
    used: list[tuple[float, float]] = []
    for n, s in enumerate(steps, 1):
        if finish := rollout_step(used, s, n, threshold, most, finalise):
            return {"rounds": n, "segments": len(used), "finish": finish}
    return {"rounds": len(steps), "segments": len(used), "finish": "open"}


def rollouts(df: DataFrame, request: str, order: str, threshold: float = 0.8, most: int = 8, finalise: bool = True) -> DataFrame:
    """request, rounds, segments, finish: each output depends on those before.

    Requests follow each other within a partition, sorted by their order, so a task folds them as they pass and holds
    one fold at a time.
    """
    names = ("reason", "start", "end", "duration")
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names[1:]]
    rows = df.repartition(request).sortWithinPartitions(request, F.col(order).asc_nulls_last()).select(F.col(request).alias("k"), F.col("reason"), *numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, used, finish = batches, 0, [], None  # no request is the iterator
        for batch in batches:
            keys, ended = batch["k"], []
            for k, *output in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or key is batches:
                    if key is not batches:
                        ended.append((key, n, len(used), finish or "open"))
                    key, n, used, finish = k, 0, [], None
                if finish is None:
                    n += 1
                    finish = rollout_step(used, dict(zip(names, output, strict=True)), n, threshold, most, finalise)
            if ended:
                yield folded(ended, keys.type)
        if key is not batches:
            yield folded([(key, n, len(used), finish or "open")], keys.type)

    def folded(ended: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        key, rounds, segments, finish = zip(*ended, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array(rounds, pa.int32()), pa.array(segments, pa.int32()), pa.array(finish)], [request, "rounds", "segments", "finish"])

    return rows.mapInArrow(run, f"{request} {df.schema[request].dataType.simpleString()}, rounds int, segments int, finish string")


class Accumulator:
    """A metric with named states: add_state, update, compute, reset."""

    def __init__(self) -> None:
        self.defaults: dict = {}

    def add_state(self, name: str, default) -> None:
        self.defaults[name] = default
        setattr(self, name, default)

    def reset(self) -> None:
        for k, v in self.defaults.items():
            setattr(self, k, v)

    def update(self, values) -> None:
        raise NotImplementedError

    def compute(self):
        raise NotImplementedError

    def states(self) -> dict:
        return {k: getattr(self, k) for k in self.defaults}

    def merge(self, states: dict) -> None:
        """Adds another accumulator's states: sums, unless a metric says otherwise."""
        for k, v in states.items():
            setattr(self, k, getattr(self, k) + v)


class Mean(Accumulator):
    def __init__(self, empty: float = 0.0) -> None:
        super().__init__()
        self.empty = empty
        self.add_state("total", 0.0)
        self.add_state("n", 0)

    def update(self, values) -> None:
        self.total += float(sum(values))
        self.n += len(values)

    def compute(self) -> float:
        return self.total / self.n if self.n else self.empty


def accumulated(df: DataFrame, by: str, x: str, make=Mean) -> DataFrame:
    """An accumulator per group: its states per Arrow batch, merged per group, so that no worker holds a group's values."""
    kind = df.schema[by].dataType.simpleString()

    def part(batches):
        for pdf in batches:
            rows = []
            for key, values in pdf.groupby(by, dropna=False)[x]:
                metric = make()
                metric.update(values.dropna().tolist())
                rows.append((key, json.dumps(metric.states())))
            yield pd.DataFrame(rows, columns=[by, "states"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        metric = make()
        for states in pdf["states"]:
            metric.merge(json.loads(states))
        return pd.DataFrame({by: pdf[by].iloc[:1], "value": [metric.compute()]})

    parts = df.select(by, x).mapInPandas(part, f"{by} {kind}, states string")
    return parts.groupBy(by).applyInPandas(merge, f"{by} {kind}, value double")
