from __future__ import annotations

import hashlib
import re

import pytest
import tiktoken

import corpus_pipeline as pipeline
from __spark_entry__ import queries
from test_simhash import plain_components, plain_fingerprint
from tradeloom.llm import byte_bpe, language, mixing, quality
from tradeloom.plans.workspace import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], small), name))
    return out


def by_id(df):
    return {row.doc_id: row for row in df.collect()}


def test_stages_in_order(kept):
    assert [name for name, _ in pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixing", "tokens"]
    assert all(df.columns == COLUMNS for df in kept[:-1])
    assert all(df.count() == len(by_id(df)) > 0 for df in kept)


def test_classifier_stages_drop_what_they_reject(kept, spark, small):
    rejected = {r.doc_id for r in language.predict(kept[0], language.fit(kept[0])).where("rejected").collect()}
    assert set(by_id(kept[1])) == set(by_id(kept[0])) - rejected
    labels = spark.read.parquet(f"{small}/labels.parquet").selectExpr("doc_id", "quality AS label")
    good = {r.doc_id for r in quality.classify(kept[1], labels).where("kept").collect()}
    assert set(by_id(kept[2])) == good
    truth = {r.doc_id: r.label for r in labels.collect()}
    assert all(truth.get(i, 1) == 1 for i in good)
    assert len([i for i in truth if truth[i] == 1 and i in by_id(kept[1])]) <= 1.03 * len([i for i in good if i in truth])


def test_one_document_of_each_group_stays(kept):
    prints = {i: plain_fingerprint(row.text) for i, row in by_id(kept[2]).items()}
    classes = plain_components(prints, 3)
    assert set(by_id(kept[3])) == set(classes.values())
    before, after = by_id(kept[2]), by_id(kept[3])
    assert all(after[i] == before[i] for i in after)


def test_mix_takes_the_planned_words(kept):
    taken = {r.key: r.taken for r in mixing.taken(mixing.mix(kept[3])).collect()}
    rows, before = by_id(kept[4]), by_id(kept[3])
    assert set(rows) == {i for i, n in taken.items() if n}
    for i, row in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text)
        assert len(words) == taken[i] and set(words) <= set(before[i].text.split())
        assert row.n_chars == len(row.text) and (row.lang, row.source) == (before[i].lang, before[i].source)


def test_tokens_are_those_of_the_library(kept):
    library = tiktoken.Encoding("x", pat_str=pipeline.PATTERN, mergeable_ranks=byte_bpe.read_ranks(pipeline.RANKS), special_tokens={})
    texts, rows = by_id(kept[4]), by_id(kept[5])
    assert set(rows) == set(texts)
    for i, row in rows.items():
        assert list(row.ids) == library.encode_ordinary(texts[i].text) and row.n_tokens == len(row.ids)
        assert row.decoded_sha256 == hashlib.sha256(texts[i].text.encode()).hexdigest()


def test_run_equals_its_stages(kept, spark, small):
    assert by_id(queries()["pipeline"](spark, small)) == by_id(kept[5])


def test_odd_documents(spark, small, tmp_path):
    rows = [
        (1, "a clean enough text of some words, said once.", "en", "s", 45), (2, None, None, None, None), (3, "", "en", "s", 0),
        (None, "a text without an id but with words.", "en", None, 36), (4, "A clean enough text of some words, said once.", None, "s", None),
        (1, "a clean enough text of some words, said once.", "en", "s", 45), (5, "a long one of words " * 9000, "en", "t", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for table, n in ((docs, 1), (docs.limit(0), 0)):
        for _, stage in pipeline.STAGES:
            table = stored(stage(spark, table, small), "odd")
        found = {row.doc_id for row in table.collect()}
        assert found == ({1, 5, None} if n else set())
