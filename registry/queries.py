"""Registered queries: each one runs an operator over the whole bound tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom import bindings as b
from tradeloom.functions.numbers import half_price, whole_units
from tradeloom.functions.text import json_pairs
from tradeloom.operators import analytics, audit, catalog, changes, holdings, ledger, market, rewards, rollup, search
from tradeloom.operators import replay as replays
from tradeloom.plans.workspace import new_path, stored
from tradeloom.sources import exports, imports, ranges, tables
from tradeloom.sources.versions import VersionedTable
from tradeloom.streaming import live, state
from tradeloom.streaming.sinks import run_available
from tradeloom.tables import RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _shop_as_of(spark: SparkSession, root: str):
    return b.latest(b.read(spark, root, "lineitem"), "l_shipdate")


def _event_as_of(spark: SparkSession, root: str):
    return b.latest(b.read(spark, root, "events"), "ts")


# Catalog -----------------------------------------------------------------


@query
def catalog_browse(spark, root):
    return catalog.browse(b.items(spark, root), category="ECONOMY", availability="in_stock", sort_by="price", order="desc")


@query
def catalog_quick_search(spark, root):
    return catalog.quick_search(b.items(spark, root), text="  RED ", availability="in_stock")


@query
def indexed_search(spark, root):
    """Descriptions that contain a text, found through the trigrams of all items."""
    items, path = b.items(spark, root), new_path(spark, "postings")
    search.write_postings(items, path, ["name", "description"])
    return search.search(items, spark.read.parquet(path), "description", "BOLT from Brand#2")


@query
def advanced_search(spark, root):
    return catalog.advanced_search(
        b.items(spark, root), name="Bolt", price_min=90000, price_max=150000, level_min=5, level_max=40,
        availability="in_stock", sort_by="price",
    )


@query
def stock_bands(spark, root):
    return catalog.stock_bands(b.items(spark, root))


@query
def low_stock(spark, root):
    return catalog.low_stock(b.items(spark, root))


@query
def out_of_stock(spark, root):
    return catalog.out_of_stock(b.items(spark, root))


@query
def dashboard_counts(spark, root):
    return analytics.dashboard_counts(b.users(spark, root), b.items(spark, root))


@query
def lookup_users(spark, root):
    buyers = b.read(spark, root, "orders").select("o_custkey")
    return catalog.lookup(catalog.list_users(b.users(spark, root), None), buyers)


@query
def lookup_items(spark, root):
    traded = b.read(spark, root, "lineitem").select("l_partkey")
    return catalog.lookup(b.items(spark, root), traded)


@query
def user_balances(spark, root):
    ids = b.read(spark, root, "orders").select(F.col("o_orderkey"))
    return catalog.balances(b.users(spark, root), ids)


@query
def list_users(spark, root):
    return catalog.list_users(b.users(spark, root), "username")


@query
def item_picklist(spark, root):
    return catalog.pick_list(b.items(spark, root))


@query
def labelled_items(spark, root):
    labels = {"ECONOMY": "Economy", "SMALL": "Small"}
    rarities = {"Brand#1": "Common", "Brand#2": "Rare"}
    slots = {"Bolt": "Fastener", "Widget": "Part", "Gear": "Drive"}
    return catalog.labelled(b.items(spark, root), labels, rarities, "Legendary", slots, "Loose")


@query
def labelled_users(spark, root):
    return catalog.labelled_users(b.users(spark, root), {"HOUSEHOLD": "Home", "MACHINERY": "Works"}, "Other")


@query
def bonus_pairs(spark, root):
    return json_pairs(b.items(spark, root), "bonus_stats", "id")


@query
def event_props(spark, root):
    return json_pairs(b.read(spark, root, "events"), "props", "event_id")


# Holdings and market -------------------------------------------------------


@query
def inventory_detail(spark, root):
    return holdings.inventory_detail(b.inventory(spark, root), b.items(spark, root), holdings.PRICED)


@query
def holdings_value(spark, root):
    return holdings.holdings_value(b.inventory(spark, root), b.items(spark, root))


@query
def all_users_inventory(spark, root):
    held = stored(b.inventory(spark, root), "inventory")
    return holdings.all_users_inventory(b.users(spark, root), held, b.items(spark, root))


@query
def labelled_inventory(spark, root):
    return holdings.labelled_inventory(all_users_inventory(spark, root))


@query
def active_offers(spark, root):
    return market.active_offers(b.offers(spark, root), b.items(spark, root), b.users(spark, root), exclude_seller=1)


@query
def own_offers(spark, root):
    return market.active_offers(b.offers(spark, root), b.items(spark, root), b.users(spark, root), seller_id=10)


@query
def item_offers(spark, root):
    return market.active_offers(b.offers(spark, root), b.items(spark, root), b.users(spark, root), item_id="7")


def _trading(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Trades and participants over order lines that are put together once."""
    lines = stored(b.order_lines(spark, root), "order-lines")
    return b.trades(spark, root, lines), b.participants(spark, root, lines)


@query
def trade_details(spark, root):
    return market.trade_details(*_trading(spark, root), b.items(spark, root), b.users(spark, root))


@query
def trade_history(spark, root):
    return market.trade_history(*_trading(spark, root), b.items(spark, root), b.users(spark, root))


@query
def scarce_history(spark, root):
    """Histories when the items out of stock are gone: their trades do not take the place of others."""
    goods = b.items(spark, root).filter(F.col("stock") > 0)
    return market.trade_history(*_trading(spark, root), goods, b.users(spark, root), n=3)


@query
def full_history(spark, root):
    return market.full_history(
        *_trading(spark, root), b.transactions(spark, root), b.items(spark, root), b.users(spark, root), n=10
    )


@query
def labelled_history(spark, root):
    return market.labelled_history(
        market.trade_history(*_trading(spark, root), b.items(spark, root), b.users(spark, root), n=5)
    )


# Analytics -----------------------------------------------------------------


@query
def total_stats(spark, root):
    return analytics.total_stats(b.transactions(spark, root, with_user=False), "month", _shop_as_of(spark, root))


@query
def popular_items(spark, root):
    return analytics.popular_items(b.transactions(spark, root, with_user=False), b.items(spark, root))


@query
def popular_items_month(spark, root):
    facts = b.transactions(spark, root, with_user=False)
    return analytics.popular_items(facts, b.items(spark, root), "month", _shop_as_of(spark, root))


@query
def category_stats(spark, root):
    facts = b.transactions(spark, root, with_user=False)
    return analytics.category_stats(facts, b.items(spark, root), "year", _shop_as_of(spark, root))


def _dynamics(period: str) -> Query:
    def run(spark, root):
        facts = b.transactions(spark, root, with_user=False)
        return analytics.sales_dynamics(facts, period, _shop_as_of(spark, root))

    return run


for _period in ("week", "month", "year"):
    QUERIES[f"sales_dynamics_{_period}"] = _dynamics(_period)


@query
def sales_dynamics_day(spark, root):
    return analytics.sales_dynamics(b.event_sales(spark, root), "day", _event_as_of(spark, root))


@query
def price_history_daily(spark, root):
    facts = b.transactions(spark, root, with_user=False)
    return analytics.daily_prices(facts, 30, _shop_as_of(spark, root))


@query
def price_history_year(spark, root):
    facts = b.transactions(spark, root, with_user=False)
    return analytics.price_history(facts, "year", _shop_as_of(spark, root))


@query
def price_candles_day(spark, root):
    return analytics.price_history(b.event_prices(spark, root), "day", _event_as_of(spark, root))


@query
def price_candles_15m(spark, root):
    """All 15-minute candles: the day view without its trailing bound."""
    return analytics.candles(b.event_prices(spark, root))


@query
def game_stats(spark, root):
    return analytics.game_counters(b.game_stats(spark, root))


@query
def daily_action_counts(spark, root):
    return analytics.daily_actions(b.game_stats(spark, root))


@query
def db_summary(spark, root):
    lines = stored(b.order_lines(spark, root), "order-lines")
    return analytics.database_summary(
        b.users(spark, root), b.items(spark, root), b.inventory(spark, root),
        b.transactions(spark, root, with_user=False), b.offers(spark, root, lines), b.trades(spark, root, lines),
        b.game_stats(spark, root),
    )


# Imports, exports and tables ------------------------------------------------


def _item_file_rows(spark: SparkSession, root: str, broken: Column) -> DataFrame:
    """Items as JSON text with absent, unreadable and wrong fields: (id, value)."""
    case = F.col("level_required") % 10
    return b.items(spark, root).select(
        "id",
        F.when(case == 4, broken).otherwise(
            F.to_json(
                F.struct(
                    "name",
                    F.when(case == 2, "x").when(case == 3, F.concat(F.lit("-"), F.col("price").cast("string")))
                    .otherwise(F.col("price").cast("string")).alias("price"),
                    "category",
                    F.when(case != 5, F.col("rarity")).alias("rarity"),
                    "level_required",
                    F.when(case != 1, F.col("stock")).alias("stock"),
                    "bonus_stats",
                )
            )
        ).alias("value"),
    )


def _imported_items(spark: SparkSession, path: str, layout: str) -> DataFrame:
    accepted, rejected = imports.import_items(spark, path, layout=layout)
    good = accepted.withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(rejected.select("name", "reason"), allowMissingColumns=True)


@query
def import_items(spark, root):
    """Items written as JSON Lines, then imported."""
    path = new_path(spark, "items-file")
    _item_file_rows(spark, root, F.concat(F.lit("{broken "), "name")).select("value").write.text(path)
    return _imported_items(spark, path, "lines")


@query
def import_item_arrays(spark, root):
    """Items written as files of one JSON array of up to 10,000 ids each, among them elements that are no objects and an empty array."""
    path = new_path(spark, "items-arrays")
    files = (
        _item_file_rows(spark, root, F.lit("5"))
        .groupBy(F.expr("id div 10000").alias("part"))
        .agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
        .union(spark.range(1).select(F.lit(-1).cast("bigint").alias("part"), F.lit("[]").alias("value")))
    )
    files.repartition("part").write.partitionBy("part").text(path)
    return _imported_items(spark, path, "array")


@query
def import_users(spark, root):
    """Users written as CSV, every fifth one twice, then imported beside every third one."""
    people = b.users(spark, root)
    rows = people.select("id", F.lit(0).alias("copy"), F.concat(F.lit(" "), "username", F.lit(" ")).alias("username"), "role", "balance")
    again = rows.filter(F.col("id") % 5 == 0).withColumn("copy", F.lit(1)).withColumn("username", F.upper("username"))
    file = (
        rows.unionByName(again)
        .withColumn("username", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("username")))
        .withColumn("balance", F.when(F.col("id") % 7 == 0, "zz").otherwise(F.col("balance").cast("string")))
        .repartitionByRange("copy", "id")
        .sortWithinPartitions("copy", "id")
        .select("username", F.lit("secret").alias("password"), "role", "balance")
    )
    path = new_path(spark, "users-file")
    plain = file.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    plain.csv(f"{path}/full")
    # Files of another header: names of suppliers alone.
    b.read(spark, root, "supplier").select(F.col("s_name").alias("username")).write.option("header", True).csv(f"{path}/short")
    accepted, rejected = imports.import_users(spark, [f"{path}/full", f"{path}/short"], people.filter(F.col("id") % 3 == 0))
    good = accepted.withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(rejected.select("username", "reason"), allowMissingColumns=True)


@query
def export_items(spark, root):
    path = new_path(spark, "items-export")
    exports.export_items(b.items(spark, root), path)
    schema = exports.item_export(b.items(spark, root)).schema
    return spark.read.schema(schema).json(path)


@query
def export_item_array(spark, root):
    """All items exported as one JSON array over several part files, read back as one."""
    path = new_path(spark, "items-array")
    exports.export_array(b.items(spark, root).select("id", "name", "price", "bonus_stats"), path, ["id"])
    fields = F.from_json("element", "id bigint, name string, price bigint, bonus_stats string").alias("item")
    return ranges.array_elements(spark, path, as_one=True).select("position", fields).select("position", "item.*")


@query
def export_users(spark, root):
    path = new_path(spark, "users-export")
    exports.export_users(b.users(spark, root), path)
    schema = exports.user_export(b.users(spark, root)).schema
    return spark.read.schema(schema).option("header", True).csv(path)


def _tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All logical tables. The joined ones are stored once, since an audit passes over them often."""
    lines = stored(b.order_lines(spark, root), "order-lines")
    return {
        "users": b.users(spark, root),
        "items": b.items(spark, root),
        "inventory": stored(b.inventory(spark, root), "inventory"),
        "transactions": stored(b.transactions(spark, root), "transactions"),
        "offers": b.offers(spark, root, lines),
        "trades": b.trades(spark, root, lines),
        "participants": b.participants(spark, root, lines),
        "game_stats": b.game_stats(spark, root),
    }


@query
def list_tables(spark, root):
    return tables.row_counts(_tables(spark, root))


@query
def table_scan(spark, root):
    tables.register(spark, {"trades": b.trades(spark, root)})
    return tables.scan(spark, "trades")[1]


@query
def table_profiles(spark, root):
    """Names, types, keys, defaults and filled rows of the columns of the listed tables."""
    shown = {"users": b.users(spark, root), "items": b.items(spark, root), "inventory": b.inventory(spark, root)}
    tables.register(spark, shown)
    names = [name for name in tables.table_names(spark) if name in shown]
    return reduce(DataFrame.unionAll, [tables.profile(spark, name) for name in names])


# Audit and changes ----------------------------------------------------------


@query
def constraint_audit(spark, root):
    """All rules, with the further rule that no balance is negative."""
    rules = {**RULES, "users": replace(RULES["users"], at_least={"balance": 0})}
    return audit.constraint_audit(_tables(spark, root), rules)


@query
def running_audit(spark, root):
    """The rules of constraint_audit over rows that come in three batches, children before and after their parents."""
    bound = _tables(spark, root)
    rules = {**RULES, "users": replace(RULES["users"], at_least={"balance": 0})}
    running = audit.RunningAudit(spark, new_path(spark, "running-audit"), bound, rules, buckets=8)
    for batch in range(3):
        running.add(batch, {name: df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == batch) for name, df in bound.items()})
    return running.violations()


@query
def orphan_check(spark, root):
    """Parent references when users in debt and items out of stock are gone."""
    bound = _tables(spark, root)
    bound["users"] = bound["users"].filter(F.col("balance") >= 0)
    bound["items"] = bound["items"].filter(F.col("stock") > 0)
    return audit.orphan_check(bound)


@query
def cascade_delete(spark, root):
    bound = _tables(spark, root)
    deleted = {
        "users": bound["users"].filter(F.col("balance") < 0).select("id"),
        "items": bound["items"].filter(F.col("stock") == 0).select("id"),
    }
    return tables.row_counts(audit.cascade_delete(bound, deleted)).select("table_name", "rows")


def _item_patches(spark: SparkSession, root: str) -> DataFrame:
    """Shop lines as item patches: purchases set the price, sales the stock, grants nothing."""
    lines = b.transactions(spark, root, with_user=False)
    return lines.select(
        F.col("item_id").alias("id"),
        # Day, quantity and amount in one number, so that the newest value is found in a hash table.
        F.expr(
            "unix_date(CAST(transaction_date AS DATE)) * 4398046511104L + quantity * 4294967296L + total_amount"
        ).alias("seq"),
        F.when(F.col("transaction_type") == "purchase", F.col("price_per_unit")).alias("price"),
        F.when(F.col("transaction_type") == "sale", F.col("quantity") - 10).alias("stock"),
    )


@query
def patch_items(spark, root):
    patched, _ = changes.patch(b.items(spark, root), _item_patches(spark, root), ["price", "stock"], {"price": 0, "stock": 0})
    return patched.select("id", "name", "price", "stock")


@query
def patch_items_in_place(spark, root):
    """The patches of every eighth item, into the buckets that these fall in."""
    items = b.items(spark, root)
    patches = _item_patches(spark, root).filter(F.col("id") % 8 == 1)
    table = VersionedTable(spark, new_path(spark, "items-versions"), items.schema, ["id"])
    table.create(items, buckets=64)
    table.change(patches, lambda rows, some: changes.patch(rows, some, ["price", "stock"], {"price": 0, "stock": 0})[0])
    return table.read().select("id", "name", "price", "stock")


@query
def patch_items_refused(spark, root):
    _, refused = changes.patch(b.items(spark, root), _item_patches(spark, root), ["price", "stock"], {"price": 0, "stock": 0})
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("patches"))


def _user_patches(spark: SparkSession, root: str) -> DataFrame:
    """Orders as user patches: the status as the role, the price as the balance of finished ones."""
    finished = F.col("o_orderstatus") == "F"
    return b.read(spark, root, "orders").select(
        F.col("o_custkey").alias("id"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
        F.when(finished, whole_units("o_totalprice")).alias("balance"),
        F.when(finished, "").otherwise(F.col("o_orderstatus")).alias("role"),
    )


@query
def edit_users(spark, root):
    return changes.edit_users(b.users(spark, root), _user_patches(spark, root))[0]


@query
def rename_users_refused(spark, root):
    """Every order asks for a name: most are asked for by several users, or belong to one."""
    names = F.concat(F.lit("Customer#"), F.lpad((F.col("seq.o_orderkey") % 4000).cast("string"), 9, "0"))
    patches = _user_patches(spark, root).drop("balance", "role").withColumn("username", names)
    refused = changes.edit_users(b.users(spark, root), patches)[1]
    return refused.select("id", F.col("seq.o_orderkey").alias("order_id"), "reason")


@query
def assign_moderators(spark, root):
    sellers = b.read(spark, root, "lineitem").select("l_suppkey")
    return changes.assign_moderators(b.users(spark, root), sellers)


@query
def upsert_inventory(spark, root):
    signed = F.when(F.col("transaction_type") == "sale", -F.col("quantity")).otherwise(F.col("quantity"))
    moves = b.transactions(spark, root).select("user_id", "item_id", signed.alias("quantity"), F.col("transaction_date").alias("at"))
    return changes.apply_holding_changes(b.inventory(spark, root), moves)


def _new_users(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers join as users, each of them twice and some without a name, together with names that exist."""
    name = F.when(F.col("s_suppkey") % 9 == 0, F.lit(" ")).when(F.col("s_suppkey") % 9 != 1, F.col("s_name"))
    suppliers = b.read(spark, root, "supplier").select(
        F.col("s_suppkey").alias("n"), F.posexplode(F.array(F.upper(name), name)).alias("copy", "username")
    )
    known = b.users(spark, root).select(F.col("id").alias("n"), "username")
    rows = suppliers.withColumn("copy", 1 - F.col("copy")).unionByName(known.withColumn("copy", F.lit(2)))
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return changes.insert_users(b.users(spark, root), rows, ["copy", "n"], at)


@query
def insert_users(spark, root):
    return _new_users(spark, root)[0]


@query
def insert_users_refused(spark, root):
    return _new_users(spark, root)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def _new_items(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All items once more, some without a name, a price or with a negative one."""
    case = F.col("id") % 8
    rows = b.items(spark, root).select(
        F.col("id").alias("n"), F.when(case != 0, F.col("name")).alias("name"), "description",
        F.when(case == 1, -F.col("price")).when(case != 2, F.col("price")).alias("price"), "category", "image_url",
    )
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return changes.insert_items(b.items(spark, root), rows, ["name", "n"], at)


@query
def insert_items(spark, root):
    return _new_items(spark, root)[0]


@query
def insert_items_refused(spark, root):
    return _new_items(spark, root)[1].select("n", "reason")


def _all_entries(spark: SparkSession, root: str) -> DataFrame:
    """Movements of all logs."""
    lines = stored(b.order_lines(spark, root), "order-lines")
    return ledger.fold(
        ledger.shop_entries(b.transactions(spark, root)),
        ledger.trade_entries(b.trades(spark, root, lines), b.participants(spark, root, lines)),
        ledger.offer_entries(b.offers(spark, root, lines)),
        ledger.reward_entries(b.game_stats(spark, root)),
    )


@query
def ledger_fold(spark, root):
    return _all_entries(spark, root)


# Replays ---------------------------------------------------------------------

LINE_ORDER = ["at", "user_id", "item_id", "kind", "quantity"]


def _rich_users(spark: SparkSession, root: str) -> DataFrame:
    return b.users(spark, root).withColumn("balance", F.col("balance") * 1000)


def _full_items(spark: SparkSession, root: str) -> DataFrame:
    return b.items(spark, root).withColumn("stock", F.col("stock") * 40)


def _line_requests(spark: SparkSession, root: str, kinds: dict[str, str]) -> DataFrame:
    """Shop lines as requests, by time."""
    lines = b.transactions(spark, root).filter(F.col("transaction_type").isin(*kinds))
    pairs = [F.lit(part) for entry in kinds.items() for part in entry]
    rows = lines.select(
        F.create_map(*pairs)[F.col("transaction_type")].alias("kind"),
        "user_id", "item_id", "quantity", F.col("transaction_date").alias("at"),
    )
    return replays.number_requests(rows, LINE_ORDER)


def _shop_replay(
    spark: SparkSession, root: str, kinds: dict[str, str], requests: DataFrame | None = None
) -> replays.Replay:
    return replays.replay(
        _line_requests(spark, root, kinds) if requests is None else requests, _rich_users(spark, root), _full_items(spark, root),
        stored(b.inventory(spark, root), "inventory"), b.offers(spark, root),
    )


SALES = {"admin_grant": "grant", "purchase": "buy", "sale": "sell"}
MOVES = {"admin_grant": "grant", "purchase": "stock_add", "sale": "stock_remove"}


@query
def ledger_reconcile(spark, root):
    """Accounts that the shop log does not lead from the opening snapshots to those after its replay: of refused lines."""
    opening = ledger.snapshot_entries(_rich_users(spark, root), _full_items(spark, root), b.inventory(spark, root))
    goods = _full_items(spark, root).select(F.col("id").alias("item_id"), "price")
    types = {kind: line for kind, line in zip(SALES.values(), SALES, strict=True)}
    pairs = [F.lit(part) for entry in types.items() for part in entry]
    unit = F.when(F.col("kind") == "sell", half_price("price")).otherwise(F.col("price"))
    requests = _line_requests(spark, root, SALES)
    log = requests.join(goods, "item_id").select(
        "user_id", "item_id", "quantity", F.create_map(*pairs)[F.col("kind")].alias("transaction_type"),
        (unit * F.col("quantity")).alias("total_amount"),
    )
    after = _shop_replay(spark, root, SALES, requests)
    closing = ledger.snapshot_entries(after.users, after.items, after.inventory)
    return ledger.reconcile(opening, ledger.fold(ledger.shop_entries(log)), closing)


@query
def replay_purchases(spark, root):
    result = _shop_replay(spark, root, {"purchase": "buy"})
    return result.decisions.select("seq", "user_id", "item_id", "quantity", "accepted", "reason")


@query
def replay_sales(spark, root):
    """Grants, purchases and sales of all shop lines against the held inventory."""
    result = _shop_replay(spark, root, SALES)
    return result.decisions.select("seq", "kind", "user_id", "item_id", "quantity", "accepted", "reason")


@query
def replay_sales_balances(spark, root):
    return _shop_replay(spark, root, SALES).users.select("id", "balance")


@query
def replay_sales_stock(spark, root):
    return _shop_replay(spark, root, SALES).items.select("id", "stock")


@query
def replay_sales_holdings(spark, root):
    return _shop_replay(spark, root, SALES).inventory


@query
def replay_admin(spark, root):
    result = _shop_replay(spark, root, MOVES)
    return result.decisions.select("seq", "kind", "user_id", "item_id", "quantity", "units", "accepted", "reason")


@query
def replay_admin_holdings(spark, root):
    return _shop_replay(spark, root, MOVES).inventory


def _market_requests(spark: SparkSession, root: str, inventory: DataFrame) -> DataFrame:
    """Lines as market purchases by supplier keys, urgent orders as cancellations, sales as listings."""
    lines = b.read(spark, root, "lineitem")
    orders = b.read(spark, root, "orders")
    buys = lines.filter(F.col("l_returnflag") == "N").select(
        F.lit("market_buy").alias("kind"),
        F.col("l_suppkey").alias("user_id"),
        F.lit(None).cast("bigint").alias("item_id"),
        F.col("l_orderkey").alias("offer_id"),
        F.col("l_linenumber").cast("bigint").alias("quantity"),
        F.lit(None).cast("bigint").alias("price_per_unit"),
        F.col("l_shipdate").alias("at"),
    )
    cancels = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.lit("cancel").alias("kind"),
        F.col("o_custkey").alias("user_id"),
        F.lit(None).cast("bigint").alias("item_id"),
        F.col("o_orderkey").alias("offer_id"),
        F.lit(None).cast("bigint").alias("quantity"),
        F.lit(None).cast("bigint").alias("price_per_unit"),
        F.col("o_orderdate").alias("at"),
    )
    listings = inventory.select(
        F.lit("list").alias("kind"),
        "user_id",
        "item_id",
        F.lit(None).cast("bigint").alias("offer_id"),
        F.ceil(F.col("quantity") / 2).alias("quantity"),
        F.lit(5000).cast("bigint").alias("price_per_unit"),
        F.col("purchased_at").alias("at"),
    )
    return replays.number_requests(
        buys.unionByName(cancels).unionByName(listings), ["at", "kind", "offer_id", "user_id", "item_id", "quantity"]
    )


def _cheap_offers(spark: SparkSession, root: str) -> DataFrame:
    return b.offers(spark, root).withColumn("price_per_unit", F.expr("price_per_unit div 100"))


def _market_replay(spark: SparkSession, root: str) -> replays.Replay:
    inventory = stored(b.inventory(spark, root), "inventory")
    return replays.replay(
        _market_requests(spark, root, inventory), _rich_users(spark, root), _full_items(spark, root), inventory,
        stored(_cheap_offers(spark, root), "offers"),
    )


@query
def replay_market(spark, root):
    result = _market_replay(spark, root)
    return result.decisions.select("seq", "kind", "user_id", "offer_id", "quantity", "accepted", "reason")


@query
def market_balances(spark, root):
    return _market_replay(spark, root).users.select("id", "balance")


@query
def market_holdings(spark, root):
    return _market_replay(spark, root).inventory.select("user_id", "item_id", "quantity")


@query
def market_offers(spark, root):
    return _market_replay(spark, root).offers.select("id", "seller_id", "item_id", "quantity", "status", "sold_at")


@query
def market_trades(spark, root):
    return _market_replay(spark, root).trades


@query
def market_participants(spark, root):
    return _market_replay(spark, root).participants


def _logged_games(spark: SparkSession, root: str) -> DataFrame:
    """The three games of the log; every fifth action won an item, some of which do not exist, lost hunts cost coins."""
    games = b.game_stats(spark, root).filter(F.col("action_type").isin("wheel", "hunt", "chest"))
    item, lost = F.col("id") % 5 == 0, (F.col("action_type") == "hunt") & (F.col("result") == "lose")
    value = F.col("reward_value")
    return games.withColumns(
        {
            "reward_type": F.when(item, "item").otherwise("coins"),
            "reward_value": F.when(item, F.col("id") % 2500 + 1).when(lost, -10 * value).otherwise(value),
        }
    )


def _played(spark: SparkSession, root: str):
    """All logged game actions of users who start with 500 coins."""
    people = b.users(spark, root).withColumn("balance", F.lit(500).cast("bigint"))
    return rewards.play(_logged_games(spark, root), people, b.items(spark, root), b.inventory(spark, root))


@query
def replay_rewards(spark, root):
    log, _ = _played(spark, root)
    return log.select("id", "user_id", "action_type", "reward_type", "reward_value", "accepted", "reason")


@query
def reward_balances(spark, root):
    return _played(spark, root)[1].users.select("id", "balance")


@query
def reward_holdings(spark, root):
    return _played(spark, root)[1].inventory.select("user_id", "item_id", "quantity")


# Streams ---------------------------------------------------------------------


def _event_stream(spark: SparkSession, root: str) -> DataFrame:
    schema = b.read(spark, root, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)


def _stream_to_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Append-mode stream run over all available files, then read as a table."""
    path = new_path(spark, name)
    writer = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table")
    run_available(writer, f"{path}/progress")
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def _sales_watermark(spark: SparkSession, root: str) -> str | None:
    return live.final_watermark(b.event_sales(spark, root).filter(F.col("transaction_type") == "purchase"))


@query
def stream_sales(spark, root):
    """Hours that the stream closed, and the last ones of the ended source."""
    emitted = _stream_to_table(spark, live.live_sales(b.event_sales_of(_event_stream(spark, root))), "stream-sales")
    return live.with_last_windows(emitted, live.live_sales(b.event_sales(spark, root)), _sales_watermark(spark, root))


@query
def stream_candles(spark, root):
    emitted = _stream_to_table(spark, live.live_candles(b.event_prices_of(_event_stream(spark, root))), "stream-candles")
    prices = b.event_prices(spark, root)
    return live.with_last_windows(emitted, live.live_candles(prices), live.final_watermark(prices), "item_id")


@query
def rollup_sales_year(spark, root):
    """The year of sales from a rollup that was kept in two batches."""
    facts = b.transactions(spark, root, with_user=False)
    table = rollup.rollup_table(spark, new_path(spark, "sales-rollup"), facts)
    half = F.col("item_id") % 2 == 0
    table.create(rollup.rolled_up(facts.filter(half)), buckets=8)
    table.add(rollup.rolled_up(facts.filter(~half | half.isNull())), 0)
    return rollup.sales_dynamics(table.read(), "year", _shop_as_of(spark, root))


@query
def rollup_candles_day(spark, root):
    """The last day's candles from a rollup that a stream kept over four runs; the first one begins within a quarter."""
    path, prices = new_path(spark, "price-rollup"), b.event_prices(spark, root)
    table = rollup.rollup_table(spark, f"{path}/table", prices, compact_every=3)
    table.create(rollup.rolled_up(prices.limit(0)), buckets=4)
    _event_parts(
        spark, root, f"{path}/in", 4,
        lambda events: run_available(rollup.keep_rollup(b.event_prices_of(events), table), f"{path}/progress"),
    )
    return rollup.price_history(table.read(), "day", _event_as_of(spark, root), facts=prices)


@query
def stream_trailing(spark, root):
    emitted = _stream_to_table(spark, live.live_trailing(b.event_sales_of(_event_stream(spark, root))), "stream-trailing")
    return live.with_last_windows(emitted, live.live_trailing(b.event_sales(spark, root)), _sales_watermark(spark, root))


@query
def stream_daily_first(spark, root):
    actions = b.game_stats_of(_event_stream(spark, root))
    return _stream_to_table(spark, live.daily_first(actions), "stream-daily-first")


@query
def stream_counters(spark, root):
    path = new_path(spark, "stream-counters")
    run_available(live.running_counters(b.game_stats_of(_event_stream(spark, root)), f"{path}/table"), f"{path}/progress")
    return live.latest_counters(spark, f"{path}/table")


@query
def stream_upsert(spark, root):
    """Purchase events add a unit of the item that the value points at; errors take one away."""
    path = new_path(spark, "stream-upsert")
    moves = _moves_of(_event_stream(spark, root))
    run_available(state.upsert_holdings(moves, f"{path}/table"), f"{path}/progress")
    return state.current_holdings(b.inventory(spark, root), f"{path}/table")


def _event_parts(spark: SparkSession, root: str, folder: str, parts: int, run: Callable[[DataFrame], None]) -> None:
    """Events arrive in ``parts`` spans of time; after each one ``run`` gets the stream, to go on from where it was."""
    events = b.read(spark, root, "events")
    first, last = events.selectExpr("min(unix_micros(CAST(ts AS TIMESTAMP)))", "max(unix_micros(CAST(ts AS TIMESTAMP)))").first()
    if first is None:
        return
    span = F.expr(f"least({parts - 1}, (unix_micros(CAST(ts AS TIMESTAMP)) - {first}) * {parts} div {last - first + 1})")
    for part in range(parts):
        events.filter(span == part).write.mode("append").parquet(folder)
        run(spark.readStream.schema(events.schema).parquet(folder))


def _moves_of(events: DataFrame) -> DataFrame:
    """Purchase events add a unit of the item that the value points at; errors take one away."""
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1).cast("bigint")
    return events.select(
        "user_id", F.col("value").cast("bigint").alias("item_id"), sign.alias("quantity"), F.col("ts").alias("at")
    )


@query
def stream_versioned_holdings(spark, root):
    """The holdings of stream_upsert kept in versions, over six runs with compaction after every second batch."""
    path = new_path(spark, "stream-versions")
    table = state.holdings_table(spark, f"{path}/table", compact_every=2)
    table.create(b.inventory(spark, root), buckets=8)
    _event_parts(
        spark, root, f"{path}/in", 6, lambda events: run_available(state.keep_holdings(_moves_of(events), table), f"{path}/progress")
    )
    return state.held(table)


@query
def stream_keyed_guard(spark, root):
    """The verdicts of stream_balance_guard from balances in the state store, over three runs."""
    path = new_path(spark, "stream-keyed")
    people = b.users(spark, root).withColumn("balance", F.lit(100_000).cast("bigint"))

    def run(events: DataFrame) -> None:
        spends = events.select("event_id", "user_id", "ts", whole_units("value").alias("amount"))
        writer = state.guard_keyed(spends, people).writeStream.outputMode("append")
        run_available(writer.format("parquet").option("path", f"{path}/verdicts"), f"{path}/progress")

    with state.rocksdb(spark):
        _event_parts(spark, root, f"{path}/in", 3, run)
    return spark.read.schema(state.VERDICTS).parquet(f"{path}/verdicts")


@query
def stream_balance_guard(spark, root):
    """Every event spends its value from 1,000.00 per user."""
    path = new_path(spark, "stream-guard")
    people = b.users(spark, root).withColumn("balance", F.lit(100_000).cast("bigint"))
    spends = _event_stream(spark, root).select("event_id", "user_id", "ts", whole_units("value").alias("amount"))
    run_available(state.guard_balances(spends, people, path), f"{path}/progress")
    return state.guard_verdicts(spark, path)
