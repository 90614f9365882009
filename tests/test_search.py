"""Searches through trigrams against a scan."""

from __future__ import annotations

import random

import pytest

from test_plans import plan, pushed
from tradeloom.functions.text import contains_text
from tradeloom.operators import search

TEXTS = ["", "a", "AB", "abc", "ABCabc", "Красный меч", "красный", "ааа", "%_%", "x%_%y", "日本語の剣", "日本", "b" * 50, "  two  blanks ", "😀😀😀!", None]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, rng.choice(TEXTS), (rng.choice(TEXTS) or "") + rng.choice(["", "abcabc", "МЕЧ"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, name string, description string")
    path = str(tmp_path_factory.mktemp("postings") / "index")
    search.write_postings(df, path, ["name", "description"])
    return df, spark.read.parquet(path)


@pytest.mark.parametrize("column", ["name", "description"])
@pytest.mark.parametrize("text", ["", "a", "AB", "abc", "ABCABC", "меч", "КРАСНЫЙ", "%_%", "本語の", "bbb", "b" * 50, "b" * 51, "😀😀😀", "none of it", "o  b"])
def test_search_equals_a_scan(indexed, column, text):
    df, index = indexed
    got = sorted(r.id for r in search.search(df, index, column, text).collect())
    assert got == sorted(r.id for r in df.filter(contains_text(column, text)).collect())


def test_a_search_reads_its_trigrams_alone(indexed):
    df, index = indexed
    text = pushed(plan(search.search(df, index, "name", "ABCab")))
    assert "In(gram, [abc,bca,cab])" in text and "EqualTo(field,name)" in text
    assert index.filter("gram = 'abc'").count() == index.filter("gram = 'abc'").distinct().count()


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "id bigint, name string")
    search.write_postings(empty, str(tmp_path / "index"), ["name"])
    assert search.search(empty, spark.read.schema("field string, gram string, key bigint").parquet(str(tmp_path / "index")), "name", "abc").count() == 0
