from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import audit, changes, ledger
from tradeloom.operators import replay as R
from tradeloom.tables import SCHEMAS

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
HELD = "user_id bigint, item_id bigint, quantity bigint, purchased_at timestamp_ntz"


def test_holding_changes(spark):
    held = spark.createDataFrame([(1, 1, 5, T0), (1, 2, 2, T0)], HELD)
    moves = spark.createDataFrame(
        [(1, 1, 3, T1), (1, 2, -2, T1), (2, 1, 1, T1), (3, 3, -1, T1)], "user_id bigint, item_id bigint, quantity bigint, at timestamp_ntz"
    )
    rows = sorted(tuple(r) for r in changes.apply_holding_changes(held, moves).collect())
    assert rows == [(1, 1, 8, T0), (2, 1, 1, T1)]


def test_patch(spark):
    users = spark.createDataFrame([(1, "a", "user", 5), (2, "b", "user", 6)], "id bigint, username string, role string, balance bigint")
    patches = spark.createDataFrame(
        [(1, 1, "x", None, 10), (1, 2, "", "moderator", None), (2, 3, None, None, -1), (2, 4, "", "", None), (9, 5, "z", None, None)],
        "id bigint, seq bigint, username string, role string, balance bigint",
    )
    patched, refused = changes.patch(users, patches, ["username", "role", "balance"], {"balance": 0}, ("username", "role"))
    assert sorted(tuple(r) for r in patched.collect()) == [(1, "x", "moderator", 10), (2, "b", "user", 6)]
    assert {r.seq: r.reason for r in refused.collect()} == {3: "below_0_balance", 4: "nothing_to_update"}


def test_insert_users(spark):
    users = spark.createDataFrame([(7, "Ann", "user", 1, T0)], SCHEMAS["users"])
    rows = spark.createDataFrame([(3, "bob", None), (1, "cid", 9), (2, "BOB ", 5), (4, " ann", 1)], "n bigint, username string, balance bigint")
    after, refused = changes.insert_users(users, rows, ["n"], F.lit(T1).cast("timestamp_ntz"))
    assert sorted(tuple(r) for r in after.collect()) == [
        (7, "Ann", "user", 1, T0), (8, "cid", "user", 9, T1), (9, "BOB ", "user", 5, T1),
    ]
    assert sorted((r.n, r.reason) for r in refused.collect()) == [(3, "username_exists"), (4, "username_exists")]


def test_insert_into_empty_table(spark):
    items = spark.createDataFrame([], SCHEMAS["items"])
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "name string, price bigint")
    after = changes.insert_items(items, rows, ["name"])[0].select("id", "name", "rarity", "stock", "durability").collect()
    assert sorted(tuple(r) for r in after) == [(1, "a", "common", 0, 100), (2, "b", "common", 0, 100)]


@pytest.fixture(scope="module")
def shop(spark):
    def table(name, rows):
        return spark.createDataFrame([tuple(r.get(c.name) for c in SCHEMAS[name]) for r in rows], SCHEMAS[name])

    return {
        "users": table("users", [{"id": 1, "username": "a"}, {"id": 2, "username": "A "}, {"id": 2, "username": None}]),
        "items": table("items", [{"id": 1, "name": "i", "price": -1, "stock": 0}, {"id": 2, "name": "j", "price": 1, "stock": 0}]),
        "inventory": table("inventory", [{"id": 1, "user_id": 1, "item_id": 1, "quantity": 0}, {"id": 2, "user_id": 1, "item_id": 1, "quantity": 1}, {"id": 3, "user_id": 9, "item_id": 2, "quantity": 1}]),
        "transactions": table("transactions", [{"id": 1, "user_id": 2, "item_id": 2, "quantity": 1, "transaction_type": "gift"}]),
        "offers": table("offers", [{"id": 5, "seller_id": 1, "item_id": 2, "quantity": 1, "price_per_unit": 1, "status": "active"}, {"id": 6, "seller_id": 2, "item_id": 2, "quantity": 1, "price_per_unit": 1, "status": "active"}]),
        "trades": table("trades", [{"id": 8, "offer_id": 5, "item_id": 2, "quantity": 1, "price_per_unit": 1, "total_amount": 1}, {"id": 9, "offer_id": 6, "item_id": 2, "quantity": 1, "price_per_unit": 1, "total_amount": 1}]),
        "participants": table("participants", [{"id": 1, "transaction_id": 8, "user_id": 2, "role": "buyer"}, {"id": 2, "transaction_id": 9, "user_id": 2, "role": "thief"}]),
        "game_stats": table("game_stats", [{"id": 1, "user_id": 1, "action_type": "wheel"}]),
    }


def test_audit_finds_each_kind_of_violation(shop):
    found = {(r.table_name, r.rule): r.violations for r in audit.constraint_audit(shop).collect()}
    assert {k: v for k, v in found.items() if v} == {
        ("users", "not_null:username"): 1,
        ("users", "unique:id"): 1,
        ("users", "unique:username"): 1,
        ("items", "at_least_0:price"): 1,
        ("inventory", "at_least_1:quantity"): 1,
        ("inventory", "unique:user_id,item_id"): 1,
        ("inventory", "parent:user_id->users"): 1,
        ("transactions", "one_of:transaction_type"): 1,
        ("participants", "one_of:role"): 1,
    }


def test_cascade(spark, shop):
    kept = audit.cascade_delete(shop, {"users": spark.createDataFrame([(1,)], "id bigint")})
    counts = {name: df.count() for name, df in kept.items()}
    assert counts == {
        "users": 2, "items": 2, "inventory": 1, "transactions": 1, "offers": 1, "trades": 1, "participants": 1, "game_stats": 0,
    }


def test_logs_explain_the_new_snapshot(spark):
    """Opening amounts plus folded logs give the snapshots after a replay; a changed balance shows up."""
    from test_replay import frames, make

    kinds = (R.BUY, R.SELL, R.LIST, R.MARKET_BUY, R.CANCEL, R.GRANT)
    data = make(21, 300, 15, 8, kinds)
    requests, users, items, held, offers = frames(spark, *data)
    result = R.replay(requests, users, items, held, offers)
    entries = ledger.fold(
        ledger.shop_entries(result.transactions),
        ledger.trade_entries(result.trades, result.participants),
        ledger.offer_entries(result.offers),
        ledger.offer_entries(offers).withColumn("amount", -F.col("amount")),
    )
    opening = ledger.snapshot_entries(users, items, held)
    closing = ledger.snapshot_entries(result.users, result.items, result.inventory)
    assert ledger.reconcile(opening, entries, closing).count() == 0
    wrong = result.users.withColumn("balance", F.col("balance") + F.when(F.col("id") == 3, 1).otherwise(0))
    changed = ledger.reconcile(opening, entries, ledger.snapshot_entries(wrong, result.items, result.inventory)).collect()
    assert [(r.account, r.user_id, r.actual - r.expected) for r in changed] == [("balance", 3, 1)]


def test_names_stay_unique_when_edited(spark):
    users = spark.createDataFrame([(1, "a", "user", 5), (2, "b", "user", 5), (3, "c", "user", 5)], "id bigint, username string, role string, balance bigint")
    patches = spark.createDataFrame(
        [(1, 1, "b", None), (2, 2, "new", None), (3, 3, "NEW", "admin"), (1, 4, " ", "boss"), (3, 5, "c", None), (2, 6, "x" * 101, None)],
        "id bigint, seq bigint, username string, role string",
    )
    after, refused = changes.edit_users(users, patches)
    assert {(r.id, r.username, r.role) for r in after.collect()} == {(1, "a", "boss"), (2, "new", "user"), (3, "c", "user")}
    assert {(r.seq, r.reason) for r in refused.collect()} == {(1, "username_exists"), (3, "username_exists"), (6, "too_long_username")}


def test_inserted_rows_obey_the_rules(spark):
    users = spark.createDataFrame([], SCHEMAS["users"])
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "ok"), (4, "y" * 101)], "n int, username string")
    after, refused = changes.insert_users(users, rows, ["n"], F.lit(T1).cast("timestamp_ntz"))
    assert [r.username for r in after.collect()] == ["ok"]
    assert {(r.n, r.reason) for r in refused.collect()} == {(1, "blank_username"), (2, "blank_username"), (4, "too_long_username")}
    items = spark.createDataFrame([], SCHEMAS["items"])
    rows = spark.createDataFrame([(1, None, 5), (2, "a", -5), (3, "b", None), (4, "c", 1)], "n int, name string, price bigint")
    after, refused = changes.insert_items(items, rows, ["n"], F.lit(T1).cast("timestamp_ntz"))
    assert [(r.name, r.price) for r in after.collect()] == [("c", 1)]
    assert {(r.n, r.reason) for r in refused.collect()} == {(1, "missing_name"), (2, "below_0_price"), (3, "missing_price")}


def test_audit_compares_texts_where_hashes_meet(spark, monkeypatch):
    """With every text on one hash, only equal texts are repeated keys."""
    from pyspark.sql import functions as F

    users = spark.createDataFrame([(1, "a "), (2, "A"), (3, "b"), (4, None)], "id bigint, username string")
    rules = {"users": audit.RULES["users"]}
    found = lambda: {r.rule: r.violations for r in audit.constraint_audit({"users": users}, rules).collect()}
    first = found()
    assert first["unique:username"] == 1 and first["not_null:username"] == 1
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.length(columns[0]).cast("bigint") * 0)
    assert found() == first


def test_audit_of_text_keys(spark):
    rules = {
        "parents": audit.Rules(key="code"),
        "children": audit.Rules(key="id", parents={"code": "parents"}),
    }
    tables = {
        "parents": spark.createDataFrame([("x",), ("Y ",), ("x",), (None,)], "code string"),
        "children": spark.createDataFrame([(1, "X"), (2, "y"), (3, "z"), (4, None), (5, "z")], "id bigint, code string"),
    }
    found = {(r.table_name, r.rule): r.violations for r in audit.constraint_audit(tables, rules).collect()}
    assert found == {
        ("parents", "unique:code"): 1, ("children", "unique:id"): 0, ("children", "parent:code->parents"): 2,
    }


def test_running_audit_equals_the_full_one(spark, tmp_path):
    """Batches of random rows, removals and a repeated batch; only buckets of the batch's keys are read."""
    import random

    rng = random.Random(4)
    rules = {name: audit.RULES[name] for name in ("users", "inventory")}
    users_schema, held_schema = "id bigint, username string", "id bigint, user_id bigint, item_id bigint, quantity bigint"
    empty = {"users": spark.createDataFrame([], users_schema), "inventory": spark.createDataFrame([], held_schema)}
    running = audit.RunningAudit(spark, str(tmp_path / "audit"), empty, rules, buckets=4)
    people, held = [], []
    for batch in range(4):
        new_people = [(rng.randint(1, 12), rng.choice(["a", "B", "b ", "c", None])) for _ in range(4)]
        new_held = [(len(held) + i, rng.choice([None, *range(1, 12)]), rng.randint(1, 3), rng.randint(0, 2)) for i in range(6)]
        gone = [people.pop(rng.randrange(len(people)))] if batch == 2 else []
        people += new_people
        held += new_held
        new = {"users": spark.createDataFrame(new_people, users_schema), "inventory": spark.createDataFrame(new_held, held_schema)}
        removed = {"users": spark.createDataFrame(gone, users_schema)} if gone else None
        running.add(batch, new, removed)
        if batch == 3:
            running.add(batch, new, removed)
        whole = {"users": spark.createDataFrame(people, users_schema), "inventory": spark.createDataFrame(held, held_schema)}
        assert sorted(map(tuple, running.violations().collect())) == sorted(map(tuple, audit.constraint_audit(whole, rules).collect()))


def test_a_batch_of_the_running_audit_compares_its_keys_in_one_shuffle(spark, tmp_path, monkeypatch, capsys):
    """Keys before and after a batch meet once; whether they are cut to the batch's keys first changes no violation."""
    rules = {name: audit.RULES[name] for name in ("users", "inventory")}
    users_schema, held_schema = "id bigint, username string", "id bigint, user_id bigint, item_id bigint, quantity bigint"
    empty = {"users": spark.createDataFrame([], users_schema), "inventory": spark.createDataFrame([], held_schema)}
    found = []
    for sparse in (0, 10**9):
        monkeypatch.setattr(audit, "SPARSE", sparse)
        running = audit.RunningAudit(spark, str(tmp_path / f"audit-{sparse}"), empty, rules, buckets=4)
        for batch, (people, held) in enumerate(
            [([(1, "a")], [(1, 2, 5, 1), (2, 2, 6, 1), (3, 3, 5, 0)]), ([(2, "A"), (1, "c")], [(4, 9, 5, 1)]), ([(3, "d")], [(4, 9, 5, 1)])]
        ):
            running.add(batch, {"users": spark.createDataFrame(people, users_schema), "inventory": spark.createDataFrame(held, held_schema)})
        found.append({(r.table_name, r.rule): r.violations for r in running.violations().collect() if r.violations})
    assert found[0] == found[1]
    assert found[0][("inventory", "parent:user_id->users")] == 2
    assert found[0][("users", "unique:id")] == found[0][("users", "unique:username")] == 1
    counts = spark.createDataFrame([(1, 2, None, 0, 0, 1)], "domain int, key bigint, text string, check int, before bigint, after bigint")
    running._changed(counts).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    assert running._changed(counts, 3 * audit.TASK_ROWS).rdd.getNumPartitions() == 4
