"""Integrity audit, orphans and cascading deletes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tradeloom.plans.workspace import stored
from tradeloom.sources.versions import VersionedTable
from tradeloom.tables import RULES, Rules

# Parents come before their children.
ORDER = ("users", "items", "inventory", "transactions", "offers", "trades", "participants", "game_stats")


# Rows kept by a running audit for one of a batch, from which on they are cut to the batch's keys first.
SPARSE = 8
# Rows that a task compares, of a hundred bytes or two.
TASK_ROWS = 500_000

INTEGRAL = ("tinyint", "smallint", "int", "bigint")
SEPARATOR = "\x1f"


def _row_checks(df: DataFrame, rules: Rules) -> dict[str, Column]:
    """Violation test of each single-row rule on the columns present."""
    checks = {f"not_null:{c}": F.col(c).isNull() for c in rules.not_null if c in df.columns}
    checks |= {f"at_least_{low}:{c}": F.col(c) < low for c, low in rules.at_least.items() if c in df.columns}
    checks |= {f"one_of:{c}": ~F.col(c).isin(*names) for c, names in rules.one_of.items() if c in df.columns}
    checks |= {f"max_length:{c}": F.length(c) > size for c, size in rules.longest.items() if c in df.columns}
    return checks


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _text(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """One text for a key, null if a part is null; texts are compared without case and outer blanks."""
    parts = [F.lower(F.trim(c)) if _kind(df, c) == "string" else F.col(c).cast("string") for c in columns]
    return F.concat(*[x for part in parts for x in (part, F.lit(SEPARATOR))])


@dataclass(frozen=True)
class Check:
    """One rule of one table: a test of single rows, a unique key, or a reference to a parent's key.

    ``domain`` numbers the keys a rule counts or refers to. Keys of a whole number are
    counted as they are (``exact``), others by a 64-bit hash of their text.
    """

    number: int
    table: str
    rule: str
    domain: int = -1
    columns: tuple[str, ...] = ()
    refers: bool = False
    exact: bool = True
    own: bool = False


def _checks(tables: dict[str, DataFrame], rules: dict[str, Rules], row_rules: bool = True) -> list[Check]:
    """All checks of the tables, numbered; the key of a parent is a domain of its own."""
    found: list[Check] = []
    domains = {name: i for i, name in enumerate(tables)}

    def add(table: str, rule: str, **more) -> None:
        found.append(Check(len(found), table, rule, **more))

    exact = {}
    for name, df in tables.items():
        key = rules[name].key
        kinds = [_kind(df, key)] if key in df.columns else ["bigint"]
        kinds += [_kind(d, c) for t, d in tables.items() for c, p in rules[t].parents.items() if p == name and c in d.columns]
        exact[name] = all(kind in INTEGRAL for kind in kinds)
    for name, df in tables.items():
        if row_rules:
            for rule in _row_checks(df, rules[name]):
                add(name, rule)
        for i, key in enumerate([(rules[name].key,), *rules[name].unique]):
            if set(key) <= set(df.columns) and (row_rules or i == 0):
                domain = domains[name] if i == 0 else len(domains) + len(found)
                whole = exact[name] if i == 0 else len(key) == 1 and _kind(df, key[0]) in INTEGRAL
                add(name, f"unique:{','.join(key)}", domain=domain, columns=key, exact=whole, own=i == 0)
        for column, parent in rules[name].parents.items():
            if column in df.columns and parent in tables:
                add(name, f"parent:{column}->{parent}", domain=domains[parent], columns=(column,), refers=True, exact=exact[parent])
    return found


def _counts(tables: dict[str, DataFrame], rules: dict[str, Rules], checks: list[Check], texts: bool = False) -> DataFrame:
    """(check, key, [text,] n): broken row rules without a key, and how often every key occurs, in one pass per table.

    Counts are added up per task before the shuffle, so that a hot key is one row. ``text`` is the spelled-out key of
    checks that count hashes.
    """
    parts = []
    for name, df in tables.items():
        tests = _row_checks(df, rules[name])
        entries = []
        for check in (one for one in checks if one.table == name):
            if not check.columns:
                when, key, text = tests[check.rule], F.lit(None), F.lit(None)
            elif check.exact:
                key, text = F.col(check.columns[0]).cast("bigint"), F.lit(None)
                when = key.isNotNull()
            else:
                text = _text(df, check.columns)
                key, when = F.xxhash64(text), text.isNotNull()
            shape = [F.lit(check.number).alias("check"), key.cast("bigint").alias("key"), text.cast("string").alias("text")]
            entries.append(F.when(when, F.struct(*(shape if texts else shape[:2]))))
        if entries:
            listed = df.select(F.explode(F.array(*entries)).alias("entry"))
            parts.append(listed.filter("entry IS NOT NULL").select("entry.*"))
    every = reduce(DataFrame.unionAll, parts)
    return every.groupBy(*every.columns).agg(F.count(F.lit(1)).alias("n"))


def _numbers(checks: list[Check]) -> Column:
    return F.col("check").isin(*[check.number for check in checks])


def _domain(checks: list[Check]) -> Column:
    """The domain of a row's check."""
    pairs = [F.lit(part) for check in checks if check.columns for part in (check.number, check.domain)]
    return F.create_map(*pairs)[F.col("check")]


def _repeated(tables: dict[str, DataFrame], counts: DataFrame, hashed: list[Check]) -> list[DataFrame]:
    """Repeated keys of checks that count hashes: the rows of hashes met more than once, compared by their texts."""
    twice = counts.filter(_numbers(hashed) & (F.col("n") > 1)) if hashed else None
    met = {row[0] for row in twice.select("check").distinct().collect()} if hashed else set()
    found = []
    for check in (one for one in hashed if one.number in met):
        text = _text(tables[check.table], check.columns).alias("text")
        rows = tables[check.table].select(text).withColumn("key", F.xxhash64("text"))
        some = rows.join(twice.filter(F.col("check") == check.number).select("key"), "key", "left_semi")
        again = some.groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found.append(again.select(F.lit(check.number).alias("check"), (F.col("n") - 1).alias("violations")))
    return found


def _lost(tables: dict[str, DataFrame], counts: DataFrame, checks: list[Check]) -> list[DataFrame]:
    """References to keys that no parent has. Hashes only find what is lost for certain; their texts find the rest."""
    keys = counts.filter(_numbers([check for check in checks if check.own]))
    known = keys.select(_domain(checks).alias("domain"), "key")
    refers = [check for check in checks if check.refers]
    found = []
    if any(check.exact for check in refers):
        asked = counts.filter(_numbers([check for check in refers if check.exact])).withColumn("domain", _domain(checks))
        found.append(asked.join(known, ["domain", "key"], "left_anti").select("check", F.col("n").alias("violations")))
    owners = {check.domain: check for check in checks if check.own}
    for check in (one for one in refers if not one.exact):
        asked = tables[check.table].select(_text(tables[check.table], check.columns).alias("text")).filter("text IS NOT NULL")
        asked = asked.groupBy("text").agg(F.count(F.lit(1)).alias("violations"))
        owner = owners.get(check.domain)
        if owner:
            asked = asked.join(tables[owner.table].select(_text(tables[owner.table], owner.columns).alias("text")), "text", "left_anti")
        found.append(asked.select(F.lit(check.number).alias("check"), "violations"))
    return found


def _audit(tables: dict[str, DataFrame], rules: dict[str, Rules], row_rules: bool) -> DataFrame:
    """(table_name, rule, violations) of the rules that are broken.

    Each table is read once for numbers and hashes. Texts are only compared for
    hashes that were met more than once, which a collision may cause.
    """
    checks = _checks(tables, rules, row_rules)
    counts = stored(_counts(tables, rules, checks), "audit")
    found = _lost(tables, counts, checks)
    if row_rules:
        unique = [check for check in checks if check.columns and not check.refers]
        found.append(counts.filter("key IS NULL").select("check", F.col("n").alias("violations")))
        plain = _numbers([check for check in unique if check.exact])
        found.append(counts.filter(plain & (F.col("n") > 1)).select("check", (F.col("n") - 1).alias("violations")))
        found += _repeated(tables, counts, [check for check in unique if not check.exact])
    if not found:
        found = [counts.select("check", F.col("n").alias("violations")).limit(0)]
    sums = reduce(DataFrame.unionAll, found).groupBy("check").agg(F.sum("violations").alias("violations"))
    return _named(sums, checks)


def _named(sums: DataFrame, checks: list[Check]) -> DataFrame:
    """(table_name, rule, violations) from sums by number; a row per check at most."""
    spark = sums.sparkSession
    names = spark.createDataFrame([(c.number, c.table, c.rule) for c in checks], "check int, table_name string, rule string")
    return names.join(sums, "check").select("table_name", "rule", "violations")


def _with_zeros(spark, broken: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    every = spark.createDataFrame(names, "table_name string, rule string")
    return every.join(broken, ["table_name", "rule"], "left").select(
        "table_name", "rule", F.coalesce("violations", F.lit(0)).alias("violations")
    )


def _parent_rules(tables: dict[str, DataFrame], rules: dict[str, Rules]) -> list[tuple[str, str]]:
    return [
        (name, f"parent:{column}->{parent}")
        for name, df in tables.items()
        for column, parent in rules[name].parents.items()
        if column in df.columns and parent in tables
    ]


def orphan_check(tables: dict[str, DataFrame], rules: dict[str, Rules] = RULES) -> DataFrame:
    """(table_name, rule, violations) for every parent reference."""
    spark = next(iter(tables.values())).sparkSession
    return _with_zeros(spark, _audit(tables, rules, row_rules=False), _parent_rules(tables, rules))


def constraint_audit(tables: dict[str, DataFrame], rules: dict[str, Rules] = RULES) -> DataFrame:
    """(table_name, rule, violations) for every rule, zero counts included."""
    names = [(name, rule) for name, df in tables.items() for rule in _row_checks(df, rules[name])]
    for name, df in tables.items():
        keys = [(rules[name].key,), *rules[name].unique]
        names += [(name, f"unique:{','.join(key)}") for key in keys if set(key) <= set(df.columns)]
    spark = next(iter(tables.values())).sparkSession
    return _with_zeros(spark, _audit(tables, rules, row_rules=True), names + _parent_rules(tables, rules))


class RunningAudit:
    """The audit's counts kept from run to run: new and removed rows are checked without reading the others again.

    A versioned table holds how often each key occurs per check, with the spelled-out text where the key
    is a hash. New rows look up the buckets of their own keys; what these break before and after the change gives
    the change of every rule's violations, whichever of parents and children comes first.
    """

    def __init__(
        self, spark: SparkSession, path: str, tables: dict[str, DataFrame], rules: dict[str, Rules] = RULES, buckets: int = 64
    ) -> None:
        """``tables`` name the audited tables and their columns; their rows are not read."""
        self.rules, self.checks = rules, _checks(tables, rules)
        long, text, number = T.LongType(), T.StringType(), T.IntegerType()
        key = [T.StructField("domain", number), T.StructField("key", long)]
        counted = T.StructType([*key, T.StructField("text", text), T.StructField("check", number), T.StructField("n", long)])
        self.counts = VersionedTable(spark, f"{path}/counts", counted, ["domain", "key"], _summed, counted)
        broken = T.StructType([T.StructField("check", number), T.StructField("n", long)])
        add_up = lambda rows, more: rows.unionByName(more.drop("batch")).groupBy("check").agg(F.sum("n").alias("n"))
        self.totals = VersionedTable(spark, f"{path}/totals", broken, ["check"], add_up, broken)
        self.counts.create(spark.createDataFrame([], counted), buckets)
        self.totals.create(spark.createDataFrame([], broken), 1)

    def _changed(self, counts: DataFrame, rows: int = 0) -> DataFrame:
        """(check, n): what counts ``before`` and ``after`` differ by in violations, with all checks of their keys.

        A key has a row per check and addition, so its rows meet in one shuffle, by as many tasks as ``rows`` ask for.
        """
        own, refers = (_numbers(some) for some in ([c for c in self.checks if c.own], [c for c in self.checks if c.refers]))
        met = counts.repartition(rows // TASK_ROWS + 1, "domain", "key").groupBy("domain", "key", "text", "check")
        sums = met.agg(F.sum("before").alias("before"), F.sum("after").alias("after"))

        def broken(n: str) -> Column:
            present = F.sum(F.when(own, F.col(n)).otherwise(0)).over(Window.partitionBy("domain", "key", "text"))
            lost = F.when(present == 0, F.col(n)).otherwise(0)
            return F.when(refers, lost).otherwise(F.greatest(F.col(n) - 1, F.lit(0)))

        return sums.select("check", (broken("after") - broken("before")).alias("n")).filter("n <> 0")

    def add(self, batch: int, new: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None) -> None:
        """Take in the rows of a batch; one that is in already changes nothing."""
        moved = _counts(new, self.rules, self.checks, texts=True)
        if removed:
            gone = _counts(removed, self.rules, self.checks, texts=True)
            moved = moved.unionByName(gone.withColumn("n", -F.col("n"))).groupBy("check", "key", "text").agg(F.sum("n").alias("n"))
        moved = stored(moved.withColumn("domain", F.when(F.col("key").isNotNull(), _domain(self.checks))), "moved")
        keyed = moved.filter("key IS NOT NULL").select("domain", "key", "text", "check", "n")
        earlier = self.counts.unfolded(keyed, before_batch=batch)
        # Keys that the batch does not name change nothing; they are left out where that spares the most of a shuffle.
        new_rows, old_rows = moved.count(), earlier.count()
        if new_rows * SPARSE < old_rows:
            earlier = earlier.join(keyed.select("domain", "key").distinct(), ["domain", "key"], "left_semi")
        key = ["domain", "key", "text", "check"]
        held = earlier.select(*key, F.col("n").alias("before"), F.col("n").alias("after"))
        came = keyed.select(*key, F.lit(0).cast("bigint").alias("before"), F.col("n").alias("after"))
        broken = [moved.filter("key IS NULL").select("check", "n"), self._changed(held.unionByName(came), new_rows + old_rows)]
        change = reduce(DataFrame.unionAll, broken).groupBy("check").agg(F.sum("n").alias("n"))
        self.totals.add(change, batch)
        self.counts.add(keyed, batch)

    def violations(self) -> DataFrame:
        """(table_name, rule, violations) for every rule, zero counts included."""
        totals = _named(self.totals.read().withColumnRenamed("n", "violations"), self.checks)
        return _with_zeros(self.counts.spark, totals, [(check.table, check.rule) for check in self.checks])


def _summed(counts: DataFrame, more: DataFrame) -> DataFrame:
    every = counts.unionByName(more.select(*counts.columns))
    return every.groupBy("domain", "key", "text", "check").agg(F.sum("n").alias("n")).filter("n <> 0").select(*counts.columns)


def cascade_delete(
    tables: dict[str, DataFrame], deleted: dict[str, DataFrame], rules: dict[str, Rules] = RULES
) -> dict[str, DataFrame]:
    """Tables after deleting the given ids and everything that refers to them.

    ``deleted`` maps a table to a one-column table of ids.
    """
    gone: dict[str, DataFrame] = {}
    kept: dict[str, DataFrame] = {}
    for name in [table for table in ORDER if table in tables]:
        df, table_rules = tables[name], rules[name]
        links = [(column, gone[parent]) for column, parent in table_rules.parents.items() if parent in gone]
        if name in deleted:
            ids = deleted[name]
            links.append((table_rules.key, ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()))
        survivors = df
        for column, ids in links:
            survivors = survivors.join(ids, F.col(column) == F.col("_gone"), "left_anti")
        kept[name] = survivors
        if links and table_rules.key in df.columns:
            lost = [
                df.join(ids, F.col(column) == F.col("_gone"), "left_semi").select(F.col(table_rules.key).alias("_gone"))
                for column, ids in links
            ]
            gone[name] = reduce(DataFrame.unionAll, lost).distinct()
    return kept
