"""Records of files that are read in small ranges, against plain parsers of the whole file."""

from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tradeloom.sources import exports, imports, ranges


@pytest.fixture()
def small_ranges(spark):
    """Files are cut every 64 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "0")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


STRINGS = ["", "}", "{", "][", 'say "hi"', "\\", "\\\\}", 'é}"{', "a\nb", "日本", "x" * 90]


def elements(rng: random.Random, count: int) -> list:
    def value(depth: int):
        kind = rng.random()
        if kind < 0.4 or depth > 2:
            return rng.choice([rng.choice(STRINGS), rng.randint(-9, 9), None, True])
        if kind < 0.8:
            return {rng.choice(STRINGS) or "k": value(depth + 1) for _ in range(rng.randint(0, 3))}
        return [value(depth + 1) for _ in range(rng.randint(0, 3))]

    return [value(0) if rng.random() < 0.4 else {"name": rng.choice(STRINGS), "more": value(1)} for _ in range(count)]


@pytest.mark.parametrize("seed", range(3))
def test_array_elements_equal_the_whole_parse(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    files = {}
    for i in range(4):
        files[f"{i}.json"] = elements(rng, rng.choice([0, 1, 30, 60]))
        text = json.dumps(files[f"{i}.json"], ensure_ascii=i % 2 == 0, indent=rng.choice([None, 1]))
        (tmp_path / f"{i}.json").write_text(rng.choice(["", "\n "]) + text + rng.choice(["", "\n"]), encoding="utf-8")
    found = ranges.array_elements(spark, str(tmp_path)).collect()
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got: dict = {}
    for r in found:
        got.setdefault(r.source.rsplit("/", 1)[1], {})[r.position] = r.element
    for name, want in files.items():
        have = got.get(name, {})
        assert sorted(have) == list(range(len(want)))
        for i, value in enumerate(want):
            plain = have[i] if isinstance(value, str) or value is None else json.loads(have[i])
            assert plain == value


def test_broken_array_files_are_one_element(spark, tmp_path, small_ranges):
    texts = ['[{"a": 1}, {"b"', '{"a": 1}', '[{"a": "x}]', '[{"a": 1}]]', '[{"a": 1}', "5", '[{"a": 1}, {"b" 2}, {"c": 3}]']
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    found = sorted((r.source[-6], r.position, r.element) for r in ranges.array_elements(spark, str(tmp_path)).collect())
    assert found[:6] == [(str(i), 0, None) for i in range(6)]
    assert found[6:] == [("6", 0, '{"a": 1}'), ("6", 1, None), ("6", 2, '{"c": 3}')] or found[6:] == [
        ("6", 0, '{"a":1}'), ("6", 1, None), ("6", 2, '{"c":3}')
    ]


@pytest.mark.parametrize("count", [0, 1, 500])
def test_exported_array_is_one_json_text_and_comes_back(spark, tmp_path, count):
    names = F.concat(F.element_at(F.array(*map(F.lit, STRINGS)), (F.col("id") % len(STRINGS) + 1).cast("int")), F.col("id").cast("string"))
    rows = spark.range(count).select(
        F.col("id"), names.alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") * 10).alias("price"), F.lit("{}").alias("bonus_stats")
    )
    path = str(tmp_path / "out")
    exports.export_array(rows.repartition(5), path, ["id"])
    parts = sorted((tmp_path / "out").glob("part-*"))
    whole = json.loads("".join(part.read_text(encoding="utf-8") for part in parts))
    assert whole == [r.asDict() for r in rows.orderBy("id").collect()]
    accepted, rejected = imports.import_items(spark, path, layout="parts")
    assert accepted.count() + rejected.count() == count
    assert sorted(r.position for r in rejected.collect()) == [i for i in range(count) if i % 3 == 0]


def plain_csv(text: str) -> list[list[str]]:
    return [row for row in csv.reader(text.splitlines(keepends=True)) if row]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_records_equal_the_plain_reader(spark, tmp_path, small_ranges, ending):
    rng = random.Random(2)
    fields = ["a", "b c", "", 'q "x"', "line\nbreak", "\n\n", ",", '"', "é" * 40, 'a\n"b",\nc']
    texts = {}
    for i in range(3):
        with open(tmp_path / f"{i}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=ending)
            names = rng.sample(["username", "role", "balance", "password"], 4)
            writer.writerow(names)
            for n in range(40):
                row = {"username": f"{i}-{n} {rng.choice(fields)}", "role": rng.choice(fields), "balance": rng.choice(["5", "x"]), "password": "p"}
                writer.writerow([row[name] for name in names])
        texts[f"{i}.csv"] = open(tmp_path / f"{i}.csv", newline="", encoding="utf-8").read()
    got = ranges.csv_fields(spark, str(tmp_path), ["username", "role", "balance", "none"]).collect()
    for name, text in texts.items():
        header, *want = plain_csv(text)
        rows = sorted((r for r in got if r.file.endswith(name)), key=lambda r: (r.range, r.piece))
        assert [[r.username, r.role or "", r.balance] for r in rows] == [
            [row[header.index(field)] for field in ("username", "role", "balance")] for row in want
        ]
        assert all(r.closed and not r.has_none and r.none is None for r in rows)


def test_a_quote_that_never_closes(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('username,balance\nann,5\n"bob,6\ncid,7\n' + "x,1\n" * 50)
    accepted, rejected = imports.import_users(spark, str(tmp_path), spark.createDataFrame([], "username string"))
    assert [r.username for r in accepted.collect()] == ["ann"]
    assert [r.reason for r in rejected.collect()] == ["unclosed_quote"]


def test_users_with_line_breaks_in_quotes(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('username,"password",role,balance\n"ann\nlee",p,"user\n",5\n\nbob,"p\n,\n",user,7\n"c ""d""",p,user,8\n')
    accepted, _ = imports.import_users(spark, str(tmp_path), spark.createDataFrame([], "username string"))
    assert sorted(tuple(r) for r in accepted.collect()) == [("ann\nlee", "user\n", 5), ("bob", "user", 7), ('c "d"', "user", 8)]
