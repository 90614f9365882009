from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from registry import queries
from tradeloom import bindings
from tradeloom.sources import exports, imports, tables
from tradeloom.tables import SCHEMAS


def item(**changes):
    base = {"name": "n", "price": 5, "bonus_stats": '{"strength": 10}'}
    return {**base, **changes}


OBJECTS = [
    item(name="Имя"),
    item(name="null price", price=None),
    item(name="text price", price="x"),
    item(name="negative", price=-1),
    item(name=None),
    item(name="null stock", stock=None),
    item(name="rounded", price=1.5, level_required="7"),
    item(name="null text", description=None, rarity=None),
    item(name="l" * 201),
    {},
]
EXPECTED = {
    "null price": "missing_price", "text price": "not_a_number_price", "negative": "negative_price",
    None: "missing_name", "null stock": "missing_stock", "l" * 201: "too_long",
}


@pytest.mark.parametrize("layout", ["array", "lines"])
def test_import_items(spark, tmp_path, layout):
    text = json.dumps(OBJECTS, ensure_ascii=False) if layout == "array" else "\n".join(json.dumps(o) for o in OBJECTS)
    (tmp_path / "items.json").write_text(text, encoding="utf-8")
    accepted, rejected = imports.import_items(spark, str(tmp_path), layout)
    rows = {r.name: r for r in accepted.collect()}
    assert {r.name: r.reason for r in rejected.collect()} == EXPECTED
    assert set(rows) == {"Имя", "rounded", "null text", ""}
    plain = rows[""]
    assert (plain.price, plain.category, plain.rarity, plain.level_required, plain.slot) == (0, "other", "common", 1, "other")
    assert (plain.durability, plain.bonus_stats, plain.stock, plain.image_url) == (100, "{}", 0, "")
    assert (rows["rounded"].price, rows["rounded"].level_required) == (2, 7)
    assert rows["null text"].rarity is None and rows["null text"].description is None


def test_unreadable_files_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("[{broken")
    accepted, rejected = imports.import_items(spark, str(tmp_path), "array")
    assert accepted.count() == 0 and [r.reason for r in rejected.collect()] == ["unreadable"]
    with pytest.raises(ValueError):
        imports.import_items(spark, str(tmp_path), "table")


USERS = """username,password,role,balance
 ann ,p,user,100
ANN,p,admin,200
,p,user,1
bob,p,user,zz
bob,p,user, 12
cid,p,user,1.5
dan,p
eve,p,user,
STORED,p,user,3
"a, b",p,user,-4
"""


def test_import_users(spark, tmp_path):
    (tmp_path / "users.csv").write_text(USERS)
    stored = spark.createDataFrame([("stored ",)], "username string")
    accepted, rejected = imports.import_users(spark, str(tmp_path), stored)
    assert sorted(tuple(r) for r in accepted.collect()) == [("a, b", "user", -4), ("ann", "user", 100), ("bob", "user", 12)]
    reasons = sorted((r.username, r.reason) for r in rejected.collect())
    assert reasons == [
        ("", "blank_username"), ("ANN", "username_exists"), ("STORED", "username_exists"), ("bob", "bad_balance"),
        ("cid", "bad_balance"), ("dan", "bad_balance"), ("eve", "bad_balance"),
    ]


def test_import_users_without_optional_columns(spark, tmp_path):
    (tmp_path / "users.csv").write_text("username,password\nann,p")
    stored = spark.createDataFrame([], "username string")
    accepted, _ = imports.import_users(spark, str(tmp_path), stored)
    assert [tuple(r) for r in accepted.collect()] == [("ann", "user", 1000)]


def test_exports(spark, tmp_path):
    when = dt.datetime(2024, 1, 2, 3, 4, 5, 600000)
    users = spark.createDataFrame([(2, "b", "user", 1, None), (1, "a,x", "admin", 2, when)], SCHEMAS["users"])
    exports.export_users(users, str(tmp_path / "users"))
    lines = [line for f in sorted((tmp_path / "users").glob("part-*")) for line in f.read_text().splitlines()]
    assert [line for line in lines if not line.startswith("id,")] == ['1,"a,x",admin,2,2024-01-02 03:04:05', "2,b,user,1,"]
    items = spark.createDataFrame([(1, "Меч", None, 5, "c", "r", 1, "s", 1, "{}", 0, "", when)], SCHEMAS["items"])
    exports.export_items(items, str(tmp_path / "items"))
    (text,) = [f.read_text(encoding="utf-8") for f in (tmp_path / "items").glob("part-*") if f.stat().st_size]
    assert "Меч" in text and json.loads(text)["description"] is None
    assert json.loads(text)["created_at"] == "2024-01-02 03:04:05"


def test_tables(spark, small):
    tables.register(spark, {"users": bindings.users(spark, small), "inventory": spark.createDataFrame([], SCHEMAS["inventory"])})
    assert {"users", "inventory"} <= set(tables.table_names(spark))
    columns, rows = tables.scan(spark, "users")
    assert columns == ["id", "username", "role", "balance", "created_at"] and rows.count() == bindings.users(spark, small).count()
    with pytest.raises(ValueError):
        tables.scan(spark, "users; DROP TABLE users")
    described = {r.field: r for r in tables.describe(spark, "users").collect()}
    assert (described["id"].key, described["username"].key, described["role"].default_value) == ("PRI", "UNI", "user")
    assert not described["username"].nullable and described["balance"].default_value == "1000"
    assert {r.field: r.key for r in tables.describe(spark, "inventory").collect()}["user_id"] == "MUL"


def test_array_elements_are_judged_one_by_one(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "a", "price": 3}, 5, null, "x", [1], {"name": "b", "price": 4}]')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text('[{"name": "c", "price": 3}, {"name"')
    accepted, rejected = imports.import_items(spark, str(tmp_path))
    assert sorted(r.name for r in accepted.collect()) == ["a", "b"]
    bad = [(r.source.rsplit("/", 1)[1], r.position, r.reason) for r in rejected.collect()]
    assert sorted(bad) == [("a.json", i, "unreadable") for i in (1, 2, 3, 4)] + [("c.json", 0, "unreadable")]


def test_user_files_with_different_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("username,password,role,balance\nann,x,admin,5\n")
    (tmp_path / "2.csv").write_text("username,password\nbob,y\n")
    (tmp_path / "3.csv").write_text("balance,username\n7,cid\n")
    existing = spark.createDataFrame([], "username string")
    accepted, rejected = imports.import_users(spark, str(tmp_path), existing)
    assert {(r.username, r.role, r.balance) for r in accepted.collect()} == {
        ("ann", "admin", 5), ("bob", "user", 1000), ("cid", "user", 7)
    }
    assert rejected.count() == 0


def test_array_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(queries, "_item_file_rows", lambda s, root, broken: s.range(170_000).select("id", F.lit("5").alias("value")))
    monkeypatch.setattr(queries, "_imported_items", lambda s, path, layout: s.read.text(path, wholetext=True))
    sizes = [len(json.loads(row.value)) for row in queries.import_item_arrays(spark, "").collect()]
    assert sum(sizes) == 170_000 and max(sizes) <= 10_000 and 0 in sizes
