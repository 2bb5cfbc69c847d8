"""Operators over every oddity of texts and rows: values, not only counts."""

import collections
import hashlib
import zlib

import pytest

from loom.llm import personal_data, pieces, secret_scan, sharding, source_mix, token_scan
from loom.llm.common import n_words, new_path
from tests.llm.test_texts import plain_personal, plain_secrets

#: One long run each, as long as plain patterns can take; ties and repeated rows follow.
LONG = [" " * 6000, "9" * 5000, "(" * 5000, "a" * 4000, "\n" * 5000, "x\n" * 3000, "▁" * 3000]


@pytest.fixture(scope="module")
def strange(spark, odd):
    extra = [(1000 + i, t) for i, t in enumerate(LONG)] + [(2000, "same text"), (2000, "same text"), (2001, "same text")]
    return odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))


@pytest.fixture(scope="module")
def given(strange):
    return [(r.doc_id, r.text or "") for r in strange.collect()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_secrets(strange, given):
    expected = collections.Counter((i, sha(secret_scan.joined(plain_secrets(t)))) for i, t in given)
    found = secret_scan.secrets(strange).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in found) == expected


def test_personal_data(strange, given):
    expected = collections.Counter((i, sha(personal_data.joined(plain_personal(t)))) for i, t in given)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in personal_data.personal_data(strange).collect()) == expected


def test_encoding(strange, given):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    expected = collections.Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))) for i, t in given for ids in [sp.encode(t, add_eos=True)])
    found = pieces.encoded(strange, ("n_tokens", "ids_text", "decoded")).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, sha(r.ids_text), sha(r.decoded)) for r in found) == expected


def test_token_counts(spark, strange, given):
    encode = token_scan._encoding("byte_bpe_multi_50k.tiktoken").encode_ordinary
    path = new_path(spark, "tokens")
    token_scan.write_tokens(strange, path)
    expected = collections.Counter((i, len(encode(t))) for i, t in given)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in token_scan.token_counts(spark, path).collect()) == expected


def test_shards(strange, given):
    found = sharding.sharded(strange, 4).collect()
    expected = collections.Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in given)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == expected
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))


def test_mix(odd):
    rows = odd.select("doc_id", "source", n_words(odd.text).alias("size"))
    found = source_mix.plan(rows).collect()
    taken, target = collections.Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + sum(s["to"] - s["from"] for s in r.spans)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= max(1, 0.02 * t) for s, t in target.items())


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_of_the_pipeline(spark, sf_dir, odd, empty, stage):
    """Each stage on odd rows by itself: what stays, with all columns."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    found = run(spark, odd, sf_dir)
    kept = collections.Counter((r.doc_id, r.text) for r in found.collect()) if stage < 4 else None
    given = collections.Counter((r.doc_id, r.text) for r in odd.collect())
    assert run(spark, empty, sf_dir).count() == 0
    if stage == 4:
        assert collections.Counter(r.doc_id for r in found.collect()) == collections.Counter(r.doc_id for r in odd.collect())
        return
    assert found.columns == odd.columns
    if stage == 0:
        assert all(t and len(t.split()) >= 50 for _, t in kept) and kept <= given
    if stage == 1:
        lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        assert kept <= given and sorted(lower(t) for _, t in kept) == sorted({lower(t) for _, t in given})
    if stage == 2:
        assert kept <= given and {(i, t) for i, t in given if i is None or not (t or "").split()} <= set(kept) and not {8, 9, 10} & {i for i, _ in kept}
    if stage == 3:
        assert {i for i, _ in kept} <= {i for i, _ in given} and all(t for _, t in kept)
