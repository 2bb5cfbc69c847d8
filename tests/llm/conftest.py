"""Documents with every oddity that operators must take."""

import random

import pytest

CLASHING = ("size", "target", "n", "node", "key", "row", "doc", "kept", "set", "block", "w", "words", "digest", "bin", "rank", "spans", "_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(words))


def rows():
    base = prose(1, 120)
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, base), (8, base), (9, base.upper()), (9, base.upper()), (10, base + " tail word"), (11, prose(2, 200)), (12, prose(3, 60000)),
        (13, "ünïcode ÄÖ " + prose(4, 80)), (14, "▁ a  b\x00c d"), (None, prose(5, 70)), (None, base), (-5, prose(6, 90)), (15, "same line here\n" * 30), (16, "日本語のテキスト " * 40),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        source = None if i % 5 == 0 else f"src{i % 3}"
        out.append((doc_id, text, None if i % 4 == 0 else "en", source, None if text is None else len(text), *[None if i % 2 else c for c in CLASHING]))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(11, 1, 0), (7, 1, None), (15, 0, 0), (None, 1, 0), (12, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
