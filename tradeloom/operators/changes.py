"""Set-wise changes: a snapshot and a table of requests give a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.plans.numbering import dense_numbers
from tradeloom.tables import DEFAULTS, RULES, SCHEMAS


def sum_holding_changes(inventory: DataFrame, changes: DataFrame) -> DataFrame:
    """Holdings and signed changes (user_id, item_id, quantity, at) in one row per holding, also where nothing is left.

    A known holding keeps its first time, a new one takes the earliest of its changes.
    """
    sums = changes.groupBy("user_id", "item_id").agg(F.sum("quantity").alias("_delta"), F.min("at").alias("_at"))
    return (
        inventory.join(sums, ["user_id", "item_id"], "full_outer")
        .withColumn("quantity", F.coalesce("quantity", F.lit(0)) + F.coalesce("_delta", F.lit(0)))
        .withColumn("purchased_at", F.coalesce("purchased_at", "_at"))
        .select(*inventory.columns)
    )


def apply_holding_changes(inventory: DataFrame, changes: DataFrame) -> DataFrame:
    """Holdings after adding signed quantities (user_id, item_id, quantity, at); one that reaches zero disappears."""
    return sum_holding_changes(inventory, changes).filter(F.col("quantity") > 0)


def patch(
    snapshot: DataFrame,
    patches: DataFrame,
    columns: list[str],
    at_least: dict[str, int] | None = None,
    blank_is_unset: tuple[str, ...] = (),
    key: str = "id",
    order: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """(snapshot after the patches, refused patches with a reason).

    A null column is left alone. Each column ends with its latest given value,
    which is what applying the patches one after the other would leave.
    """
    for column in blank_is_unset:
        patches = patches.withColumn(column, F.nullif(F.col(column), F.lit("")))
    reasons = [F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull(), F.lit("nothing_to_update"))]
    reasons += [F.when(F.col(c) < low, F.lit(f"below_{low}_{c}")) for c, low in (at_least or {}).items()]
    checked = patches.withColumn("reason", F.coalesce(*reasons))
    latest = (
        checked.filter(F.col("reason").isNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns])
    )
    changed = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    patched = (
        snapshot.join(latest, F.col(key) == F.col("_key"), "left").withColumns(changed).select(*snapshot.columns)
    )
    return patched, checked.filter(F.col("reason").isNotNull())


def set_stock(items: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New stock (id, seq, stock); a negative one is refused."""
    return patch(items, patches, ["stock"], {"stock": 0})


def set_price(items: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New prices (id, seq, price); a negative one is refused."""
    return patch(items, patches, ["price"], {"price": 0})


def edit_items(items: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Any item fields by (id, seq); negative prices and stock are refused."""
    columns = [c for c in patches.columns if c not in ("id", "seq")]
    return patch(items, patches, columns, {c: 0 for c in ("price", "stock") if c in columns})


def set_balance(users: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New balances (id, seq, balance); a negative one is refused."""
    return patch(users, patches, ["balance"], {"balance": 0})


def broken_rule(table: str, columns: list[str], given_only: bool = False) -> Column:
    """Name of the first rule of a table's columns that a row breaks, null if none.

    With ``given_only`` a null column is not given, so NOT NULL does not apply.
    """
    rules, found = RULES[table], []
    for name in columns:
        if name in rules.not_null and not given_only:
            found.append(F.when(F.col(name).isNull(), F.lit(f"missing_{name}")))
        if name in rules.at_least:
            low = rules.at_least[name]
            found.append(F.when(F.col(name) < low, F.lit(f"below_{low}_{name}")))
        if name in rules.longest:
            found.append(F.when(F.length(name) > rules.longest[name], F.lit(f"too_long_{name}")))
    return F.coalesce(*found, F.lit(None).cast("string"))


def edit_users(users: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Any of (username, role, balance) by (id, seq); blank text leaves a field alone.

    Names stay unique: the first edit that asks for a name no user has gets it,
    later ones and those that ask for another user's name are refused as a
    whole. A name given up in the same set of edits is not free yet.
    """
    columns = [c for c in ("username", "role", "balance") if c in patches.columns]
    if "username" not in columns:
        checked = patches.withColumn("refusal", broken_rule("users", columns, True))
    else:
        name = F.nullif(F.trim("username"), F.lit(""))
        named = patches.withColumn("username", name).withColumn("_name", F.lower("username"))
        holders = users.groupBy(F.lower(F.trim("username")).alias("_name")).agg(F.min("id").alias("_holder"))
        free = named.filter("_name IS NOT NULL").join(holders, "_name", "left_anti")
        first = free.groupBy("_name").agg(F.min("seq").alias("_first"))
        # Edits without a name stay out of the joins, where they would all be one key.
        asked = named.filter("_name IS NOT NULL").join(holders, "_name", "left").join(first, "_name", "left")
        taken = (F.col("_holder") != F.col("id")) | (F.col("_first") != F.col("seq"))
        asked = asked.withColumn("refusal", F.when(taken, F.lit("username_exists"))).drop("_holder", "_first")
        both = asked.unionByName(named.filter("_name IS NULL").withColumn("refusal", F.lit(None).cast("string")))
        checked = both.drop("_name").withColumn("refusal", F.coalesce("refusal", broken_rule("users", columns, True)))
    blank = tuple(c for c in columns if c != "balance")
    after, refused = patch(users, checked.filter("refusal IS NULL").drop("refusal"), columns, blank_is_unset=blank)
    broken = checked.filter("refusal IS NOT NULL").withColumnRenamed("refusal", "reason")
    return after, refused.unionByName(broken)


def assign_moderators(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Users with the moderator role given to the listed ids."""
    chosen = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    role = F.when(F.col("_id").isNotNull(), "moderator").otherwise(F.col("role"))
    return users.join(chosen, F.col("id") == F.col("_id"), "left").withColumn("role", role).select(*users.columns)


def _filled(rows: DataFrame, table: str, given: dict[str, Column]) -> DataFrame:
    """Rows in the shape of a logical table: given columns, then defaults for what is missing."""
    defaults = DEFAULTS[table]
    columns = []
    for column in SCHEMAS[table]:
        name, kind = column.name, column.dataType
        value = given.get(name, F.col(name) if name in rows.columns else F.lit(None))
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        columns.append(value.cast(kind).alias(name))
    return rows.select(*columns)


def _next_id(snapshot: DataFrame) -> int:
    return (snapshot.agg(F.max("id")).first()[0] or 0) + 1


def insert_items(
    items: DataFrame, rows: DataFrame, order: list[str], at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(items with new rows added, refused rows with a reason); ids continue the sequence in the given order.

    A column that is absent takes its default; an explicit null stays null and
    is refused where the column needs a value, as in an import.
    """
    checked = rows.withColumn("reason", broken_rule("items", [c for c in rows.columns if c in SCHEMAS["items"].names]))
    numbered = dense_numbers(checked.filter("reason IS NULL").drop("reason"), order, "id", _next_id(items))
    created = F.localtimestamp() if at is None else at
    added = _filled(numbered, "items", {"created_at": created}).select(*items.columns)
    return items.unionByName(added), checked.filter("reason IS NOT NULL")


def insert_users(
    users: DataFrame, rows: DataFrame, order: list[str], at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(users with new rows added, refused rows with a reason).

    The first usable row of a name wins, unless the name is stored already;
    null and blank names are refused. The order columns identify a row.
    """
    name_key = F.lower(F.trim("username"))
    blank = F.when(F.coalesce(F.trim("username"), F.lit("")) == "", F.lit("blank_username"))
    known = [c for c in rows.columns if c in SCHEMAS["users"].names and c != "username"]
    checked = rows.withColumn("reason", F.coalesce(blank, broken_rule("users", ["username", *known])))
    usable = checked.filter("reason IS NULL").drop("reason")
    first = (
        usable.groupBy(name_key.alias("_name"))
        .agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in order])).alias("_first"))
        .select("_name", "_first.*")
    )
    stored = users.select(name_key.alias("_name")).distinct()
    accepted = first.join(stored, "_name", "left_anti").select(*rows.columns)
    taken = usable.join(accepted.select(*order), order, "left_anti").withColumn("reason", F.lit("username_exists"))
    refused = checked.filter("reason IS NOT NULL").unionByName(taken)
    numbered = dense_numbers(accepted, order, "id", _next_id(users))
    created = F.localtimestamp() if at is None else at
    added = _filled(numbered, "users", {"created_at": created}).select(*users.columns)
    return users.unionByName(added), refused
