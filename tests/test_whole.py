"""Queries read whole texts, and openings of five words."""

import re

import pytest

from loom import views
from loom.queries import QUERIES, SQL

CUT = re.compile(r"substring\((?:text|response|regexp_replace\(text, '[^']*', '', 'g'\)), 1, \d+\)|lang = 'en'$")


def test_no_query_cuts_texts():
    assert [n for n, s in SQL.items() if CUT.search(s)] == []


@pytest.fixture
def long_texts(spark, tmp_path):
    late = " tail <answer>late</answer> zqx"
    spark.createDataFrame([(i, "word " * 100 + late + f" {i}", "de" if i % 2 else "en", "s", 1) for i in range(1, 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_ends_of_texts_count(spark, long_texts):
    run = lambda name: QUERIES[name](spark, long_texts).collect()
    assert all(r.first == "late" for r in run("answers__STR01"))
    assert all("zqx" in r.qa for r in run("normalised_answers__STR03_STR04"))
    assert all("zqx" in r.c for r in run("cleaned_text__STR09"))
    assert all("zqx" in r.m for r in run("response_messages__PRJ07_PRJ11") if r.doc_id % 4)
    assert len(run("bad_descriptions__FLT12")) == 8
    assert run("template_repeats__AGG11")[0].unique == 1
    halves = views.view(spark, long_texts, views.RESPONSES).where("doc_id = 1").first().response
    assert halves.count("word ") >= 99  # the cut in the middle may lie in a word


def test_five_words_tell_openings_apart(spark, tmp_path):
    texts = ["so it goes on and ends", "so it goes on and stops", "so it goes off", "so", "no"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert run("opening_concentration__AGG12")[0][:2] == (4, 1)
    assert run("diversity_by_type__AGG14")[0][:3] == ("en", 4, 1)
    assert run("most_common_openings__AGG06") == [("so it goes on and", 2), ("so it goes off", 1), ("so", 1), ("no", 1)]
