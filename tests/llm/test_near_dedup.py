"""Near-dedup and components against brute force."""

import random
import re

import numpy as np
import pytest

from loom.llm import graph, near_dedup, sketch
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(docs, size, percent):
    """doc_id: (number of shingles, smallest doc_id reachable)."""
    sets = {i: shingles(t, size) for i, t in docs}
    ids, parent = list(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(n, seed=0, words=150):
    """Copies of a text with more and more words changed; some link only through others."""
    r, base = random.Random(seed), prose(seed, words).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, size, percent):
    docs = family(60) + [(100 + k, t) for k, t in family(40, 5, 12)] + [(200 + k, prose(k, 3)) for k in range(8)] + [(300, ""), (301, None), (302, "a b"), (303, "A  B\n"), (304, "a b c")]
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 8)
    docs = family(70, 3)
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, 3, 85)


def test_one_outlier_ships_main_nodes_once(spark):
    """5,000 nodes of a component and one outside: a row for each main node, and the outlier's for each main block."""
    rows = [(1, 0, k, 7 if k < 5000 else 9, 7, 5001, 5000) for k in range(5001)]
    several = spark.createDataFrame(rows, "key long, band int, node long, component long, most long, bucket_size long, main_size long")
    dealt = near_dedup._dealt(several).collect()
    main = [r for r in dealt if r.main]
    assert len(main) == 5000 and len(dealt) - len(main) <= -(-5000 // near_dedup.BLOCK_NODES) + 1
    meet = {(r.i, r.j) for r in main}
    assert meet == {(r.i, r.j) for r in dealt if not r.main} - {(0, 0)}


def test_blocks_meet_once(spark, monkeypatch):
    """Every pair that has a node outside the main component meets in exactly one group."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 4)
    rows = [(1, 0, k, 7 if k < 30 else 100 + k % 5, 7, 45, 30) for k in range(45)]
    several = spark.createDataFrame(rows, "key long, band int, node long, component long, most long, bucket_size long, main_size long")
    groups, met = {}, {}
    for r in near_dedup._dealt(several).collect():
        groups.setdefault((r.i, r.j), []).append(r)
    for (i, j), g in groups.items():
        for a in g:
            for b in g:
                if a.node < b.node and not (a.main and b.main) and (i == j or a.own != b.own):
                    met[a.node, b.node] = met.get((a.node, b.node), 0) + 1
    assert met == {(a, b): 1 for a in range(45) for b in range(max(a + 1, 30), 45)}


def test_hot_centers_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_PAIRS", 5)
    monkeypatch.setattr(near_dedup, "HOT_SHARE", 0.0)
    docs = family(60, 4)
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, 3, 85)


def test_a_doc_id_with_two_texts(spark):
    docs = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(1, 50)), (3, prose(2, 50)), (4, prose(3, 50))]
    for part in (1, 3):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(part)
        found = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85).collect())
        assert found == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_documents(spark, sf_dir, texts):
    found = near_dedup.op4_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(list(texts.items()), 3, 85)


def test_odd_rows(spark, odd, empty):
    found = near_dedup.near_duplicates(odd, 3, 85).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0 and by_id[2].component_id == 2
    assert by_id[6].component_id == 5 and {by_id[k].component_id for k in (7, 8, 9, 10)} == {7}
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    assert near_dedup.near_duplicates(empty, 3, 85).count() == 0
    assert near_dedup.distinct_documents(odd).columns == odd.columns


def test_estimate_is_close():
    sk, rng = sketch.HyperMinHash(32, 5), np.random.default_rng(0)
    for j in (0.5, 0.85, 1.0):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        common = int(2000 * 2 * j / (1 + j))
        a, b = pool[:2000], np.concatenate((pool[:common], pool[2000 : 4000 - common]))
        estimate = sk.estimate(sk.registers(np.unique(a))[None], sk.registers(np.unique(b))[None])[0]
        assert abs(estimate - j) < 0.15


def test_word_hashes_in_blocks(monkeypatch):
    texts = [b"a bb  ccc\n", None, b"", b"z" * 5000, prose(1, 900).encode()]
    whole = [s.tolist() for s in sketch.sets(texts, 3, sketch.WordHasher())]
    assert len(whole) == 5 and whole[1] == whole[2] == [] and len(whole[3]) == 1
    long = prose(2, 2000).encode()
    monkeypatch.setattr(sketch, "BLOCK", 1 << 12)
    cut = [s.tolist() for s in sketch.sets([*texts[:3], texts[4], long], 3, sketch.WordHasher())]
    assert cut[3] == whole[4] and len(cut[4]) == 1998


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and found[101] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
