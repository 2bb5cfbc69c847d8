"""Line dedup, the Merkle manifest and whitening against plain versions, on odd rows and beyond their broadcasts."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loom.llm import line_dedup, merkle, whitening
from loom.llm.common import table

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)


def plain_lines(docs, least_chars=40, least_docs=5):
    """(doc_id, text) to (doc_id, lines, dropped, kept text) by a dictionary; a null doc_id is the smallest."""
    held = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                held[key_of(line)].add(i)
    gone = {k: max(v, key=lambda x: (x is not None, x or 0)) for k, v in held.items() if len(v) >= least_docs}
    out = collections.Counter()
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in gone or gone[key_of(x)] == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def found_lines(frame):
    return collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in frame.collect())


LINE = "a line that is long enough to be looked for, Ä and É included"
OTHER = "another line which four documents hold, so that it stays in all"


@pytest.fixture(scope="module")
def shared(spark, odd):
    r = random.Random(5)
    texts = [f"own {i} words of this document only, in a long enough line\n  {LINE.replace('line', 'LINE') if i % 2 else LINE}\t\n\n{LINE if i % 3 else 'short'}\n" for i in range(30)]
    texts += [OTHER + "\n" + OTHER] * 4 + [LINE] * 40 + ["x" * 39 + "\n" + "x" * 40 + "\r"] * 6 + ["\n".join([LINE, "tail"] * 2000), "\n" * 3000, LINE + " "]
    rows = [(r.choice([i + 100, i + 100, 100, None]), t) for i, t in enumerate(texts)]
    return odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("few", [True, False])
def test_lines(shared, few, monkeypatch):
    if not few:
        monkeypatch.setattr(line_dedup, "BROADCAST_WORDS", -1)
    docs = [(r.doc_id, r.text) for r in shared.collect()]
    expected = plain_lines(docs)
    assert found_lines(line_dedup.without_repeats(shared)) == expected and sum(k[2] for k in expected) > 50


def test_lines_small_chunks_and_low_bounds(shared, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 7)
    docs = [(r.doc_id, r.text) for r in shared.collect()]
    assert found_lines(line_dedup.without_repeats(shared, 3, 2)) == plain_lines(docs, 3, 2)


def test_lines_odd_rows(odd, empty):
    found = line_dedup.without_repeats(odd.withColumn("n_lines", F.lit("theirs")))
    assert found.columns == [*odd.columns, "n_lines", "n_dropped"] and found.count() == odd.count()
    assert line_dedup.without_repeats(empty).count() == 0
    assert {r.n_lines for r in found.where("text = '' AND doc_id IN (1, 2)").collect()} == {1}


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    again = rng.choice(h, 800, replace=False)
    pair = line_dedup.FilterPair(0, 1 << 10, 10)
    pair.add(h[:2500], np.intersect1d(again, h[:200]))
    pair.add(h[2500:], np.zeros(0, np.uint64))
    pair.add(np.unique(again), np.zeros(0, np.uint64))
    word, mask = line_dedup.probes(h, 10)
    hit = (pair.twice[word] & mask) == mask
    assert hit[np.isin(h, again)].all() and hit[~np.isin(h, again)].mean() < 0.2


def plain_manifest(docs, tampered, fanout=2):
    """Rows (doc_id, source, lang, n_chars, text) to their manifest; trees as lists of levels."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(field, (r[0], r[1], r[2], r[3] + more if r[3] is not None else None, r[4]))))

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def up(tree, i, h):
        proof = []
        for level in tree[:-1]:
            first = i - i % fanout
            run = level[first : first + fanout]
            proof += run[: i - first] + run[i - first + 1 :]
            h = sha("".join([*run[: i - first], h, *run[i - first + 1 :]]))
            i //= fanout
        return h, proof

    langs = sorted({r[2] for r in docs}, key=lambda x: (x is not None, (x or "").encode()))
    rows = {lang: sorted((r for r in docs if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    trees = {lang: levels([leaf(r) for r in rows[lang]]) for lang in langs}
    top = levels([trees[lang][-1][0] for lang in langs])
    out = collections.Counter()
    for k, lang in enumerate(langs):
        for i, r in enumerate(rows[lang]):
            low, proof = up(trees[lang], i, leaf(r, int(tampered(r[0]))))
            high, more = up(top, k, low)
            out[r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha("".join(proof + more)), high, high == top[-1][0]] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("chunk", "fanout"), [(4, 2), (7, 2), (8, 3), (1 << 14, 2), (1 << 14, 5)])
def test_manifest(spark, odd, chunk, fanout, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    r = random.Random(chunk)
    rows = [(i if i % 11 else None, "s" if i % 3 else None, r.choice(["en", "en", "en", "de", None, "é", "Z", ""]), i if i % 4 else None, f"text {i} ü") for i in range(331)]
    rows += [rows[5]] * 9 + [(1, "s", "lone", 3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").unionByName(odd.select("doc_id", "source", "lang", "n_chars", "text")).repartition(5)
    tampered = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    found = collections.Counter(tuple(x[c] for c in COLUMNS) for x in merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fanout).collect())
    assert found == plain_manifest([tuple(x) for x in docs.collect()], tampered, fanout)


def test_manifest_of_few_rows(spark, odd, empty):
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].verified and one[0].proof_sha256 == sha("")
    assert all(r.verified for r in merkle.manifest(odd).collect())


def plain_whitening(vectors, components=16):
    kept = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in kept}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, s = len(fit), fit.sum(0)
    off = ((fit * n - s) / n).astype(float)
    v = off.T @ off / n
    e, q = np.linalg.eigh(v)
    return x, n, s, e[::-1][:components], q[:, ::-1][:, :components], np.trace(v)


def test_whitening(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1 + k) + (r.random() if k else 0) for k in range(6)]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1003, [float("nan")] * 6), (1004, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (1005, [1.0, 2.0])] + [(2000 + i, rows[0][1]) for i in range(300)]
    frame = spark.createDataFrame([(i, v, "theirs", 1) for i, v in rows], "vec_id long, embedding array<double>, n string, component int").repartition(7)
    found = whitening.whitened(frame, 4).collect()
    x, n, s, e, q, trace = plain_whitening([(i, v) for i, v in rows if i < 1000 or i >= 2000], 4)
    assert len(found) == 4 * 700 and {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    by = {(r.vec_id, r.component): r for r in found}
    for k in range(4):
        direction = q[:, k] / np.sqrt(e[k])
        sign = np.sign(q[abs(q[:, k]).argmax(), k])
        for i in x:
            off = np.array([(n * a - b) / n for a, b in zip(x[i], s, strict=True)], dtype=float)
            assert by[i, k + 1].whitened == pytest.approx(sign * off @ direction, abs=1e-8)
            assert by[i, k + 1].explained == pytest.approx(e[k] / trace, rel=1e-9)
            assert by[i, k + 1].deviation == sum((n * a - b) ** 2 for a, b in zip(x[i], s, strict=True))


def test_whitening_odd_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one vector has no variance
    flat = whitening.whitened(make([(None, [1.0, 5.0, 2.0]), (2, [2.0, 5.0, 4.0]), (2, [2.0, 5.0, 4.0])])).collect()
    assert [r.component for r in flat] == [1, 1, 1] and {r.explained for r in flat} == {1.0} and {r.n for r in flat} == {2}
    huge = whitening.whitened(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(r.deviation is None for r in huge if r.vec_id < 3)


@pytest.mark.parametrize(("name", "query", "sql"), [("documents", line_dedup.op11_line_dedup, line_dedup.OP11_SQL), ("documents", merkle.op12_merkle_manifest, merkle.OP12_SQL), ("embeddings", lambda s, d: whitening.op13_whitening(s, d).select("vec_id", "component", "n", "deviation"), whitening.WHITENED_ROWS_SQL)])
def test_queries_against_sql(spark, sf_dir, name, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = query(spark, sf_dir)
    expected = con.execute(sql).df()
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == sorted(expected[sorted(found.columns)].itertuples(index=False, name=None))


def test_whitened_query(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    x, n, s, e, q, trace = plain_whitening(vectors)
    found = whitening.op13_whitening(spark, sf_dir).collect()
    kept = min(16, int((e > 1e-12 * e[0]).sum()))
    assert len(found) == len(x) * kept and found[0].identity_error < 1e-4
    by = {(r.vec_id, r.component): r for r in found}
    for k in range(kept):
        signs = {int(np.sign(by[i, k + 1].whitened * (w := np.array([(n * a - b) / n for a, b in zip(x[i], s, strict=True)], dtype=float) @ q[:, k]))) for i in x if abs(by[i, k + 1].whitened) > 1e-6}
        assert len(signs) == 1 and by[vectors[0][0], k + 1].explained == pytest.approx(e[k] / trace, rel=1e-6)
        assert all(abs(by[i, k + 1].whitened) == pytest.approx(abs(np.array([(n * a - b) / n for a, b in zip(x[i], s, strict=True)], dtype=float) @ q[:, k]) / np.sqrt(e[k]), abs=1e-6) for i in x)
