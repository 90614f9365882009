"""Mixing sources to target weights, by functions of Spark alone.

The words of a source, its documents in key order, form one stream that is cut
into blocks of a fixed length. The mix is a row of output slots, dealt to shards
of a fixed number of slots. A source gets as many slots as its target needs; which
slots these are is a pseudorandom arrangement of all slots, so the counts of the
sources in a shard are multinomial draws given the sources' totals. A source's
n-th slot holds the n-th block under a pseudorandom permutation of its blocks, one
permutation per pass over the source, so no block is used once more before all
others have been used. Slots and blocks meet by a join on source and block number.

Permutations are swap-or-not shuffles: in each round x and (key - x) mod n change
places or not, as a hash of the larger of both says. Every round is one-to-one, so
no table of a permutation, no sort and no task for a whole source is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.llm.shared import BLANK, WORD, fresh
from tradeloom.plans.workspace import stored

ROUNDS = 12
RUN = 10_000  # slots made from one row


def _hash(*parts: Column) -> Column:
    """60 bits of an MD5 as a bigint."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def round_keys(n: Column, *salt: Column) -> Column:
    """Keys of a permutation of 0..n-1, one per round."""
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.transform(rounds, lambda i: _hash(F.lit("key"), *salt, i) % F.greatest(n, F.lit(1)))


def permuted(x: Column, n: Column, keys: Column, *salt: Column) -> Column:
    """Place of ``x`` under the permutation of 0..n-1 that ``keys`` and ``salt`` define."""

    def swap(at: Column, key: Column, number: Column) -> Column:
        other = F.pmod(key - at, n)
        flip = F.substring(F.md5(F.concat_ws(":", *salt, number, F.greatest(at, other)).cast("binary")), 1, 1) >= "8"
        return F.when(flip, other).otherwise(at)

    numbered = F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("i")))
    return F.aggregate(numbered, x.cast("bigint"), lambda at, one: swap(at, one["key"], one["i"]))


@dataclass
class Mix:
    """``sources``: source, number, words, weight, target, blocks, slots. ``slots``: shard, slot, source number,
    pass, block. ``pieces``: row (number of the document's place in its source), key, source number, size, block,
    first (word of the document), words. ``sizes``: key, source, number, size and first word of each document."""

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    sizes: DataFrame


def targets(totals: DataFrame, *, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, words, number, weight, target) of (source, words) rows.

    Sources by code point, null last, take the weights in turn and share
    ``share`` times all words; a target stops at ``most`` times its source's
    words, and the excess is shared among the others by weight. Sources without
    words have target zero. ``most`` is at least ``share``.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.get(cycle, F.col("number") % len(weights)))
    # Taken in the order in which they reach their limit, the sources before the first that stays below are full.
    order = Window.orderBy(F.col("words") / F.col("weight"), "number")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rates = (
        weighed.withColumn("full", F.coalesce(F.sum("words").over(earlier), F.lit(0)) * most)
        .withColumn("open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("rate", (F.sum("words").over(Window.partitionBy()) * share - F.col("full")) / F.col("open"))
        .withColumn("limited", F.col("words") * most <= F.col("rate") * F.col("weight"))
    )
    level = F.min(F.when(~F.col("limited"), F.struct(F.col("words") / F.col("weight"), "number", "rate"))).over(Window.partitionBy())
    target = F.when(F.col("limited"), F.col("words") * most).otherwise(F.col("weight") * level["rate"])
    return rates.select("source", "words", "number", "weight", target.cast("double").alias("target"))


def _streams(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Sizes in words and first words of all documents within their sources, by two levels of running sums.

    The rows are range-partitioned by source and key, so a large source is many
    parts; sums run inside parts, and part totals give each part's start.
    """
    rows = df.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    sizes = stored(rows, "sizes").repartitionByRange("source", "key", "size").withColumn("part", F.spark_partition_id())
    placed = stored(sizes, "streams")
    part = Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col("source").alias("of"), F.col("part").alias("at")).agg(F.sum("size").alias("total"))
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("of", "at", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inside = placed.withColumn("inside", F.coalesce(F.sum("size").over(part), F.lit(0)))
    return inside.join(
        starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))
    ).selectExpr("key", "source", "size", "start + inside AS first")


def mix(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 128,
    shard: int = 1024,
    seed: int = 9,
) -> Mix:
    """Plan of a mix of all rows.

    Null and wordless texts have size zero and no pieces; null sources are one
    source, the last; repeated rows are documents of their own. An empty table
    gives an empty plan. With ``most`` = 2 no word is used more than twice. A
    source's words taken differ from its target by less than one block.
    """
    placed = stored(_streams(df, key, text, source), "placed")
    totals = placed.groupBy("source").agg(F.sum("size").alias("words"))
    sources = targets(totals, weights=weights, share=share, most=most).selectExpr(
        "source", "number", "words", "weight", "target",
        f"CAST(ceil(words / {block}) AS bigint) AS blocks",
        f"CAST(coalesce(round(target * ceil(words / {block}) / nullif(words, 0)), 0) AS bigint) AS slots",
    )
    sources = stored(
        sources.withColumn("from", F.sum("slots").over(Window.orderBy("number")) - F.col("slots"))
        .withColumn("all", F.sum("slots").over(Window.partitionBy())),
        "sources",
    )
    sizes = placed.join(
        sources.select(F.col("source").alias("of"), "number"), F.col("source").eqNullSafe(F.col("of"))
    ).drop("of")
    pieces = sizes.where("size > 0").selectExpr(
        "key", "number", "size", "first AS start",
        f"explode(sequence(first div {block}, (first + size - 1) div {block})) AS block",
    ).selectExpr(
        "key", "number", "size", "start", "block",
        f"greatest(block * {block} - start, 0) AS first",
        f"least(start + size, (block + 1) * {block}) - greatest(start, block * {block}) AS words",
    )
    # Rows of at most RUN slots are dealt out before they are opened, so a large source is many tasks.
    n_runs = sources.agg(F.sum(F.expr(f"ceil(slots / {RUN})"))).first()[0] or 1
    tasks = min(int(n_runs), 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = (
        sources.where("slots > 0")
        .selectExpr("number", "blocks", "slots", "from", "all", f"explode(sequence(0, (slots - 1) div {RUN})) AS run")
        .repartition(tasks, "number", "run")
    )
    opened = runs.selectExpr(
        "number", "blocks", "from", "all", "explode(sequence(run * {0}, least(slots, (run + 1) * {0}) - 1)) AS n".format(RUN)
    ).withColumn("pass", F.expr("n div blocks"))
    salt = F.lit(seed)
    of_all = permuted(F.col("from") + F.col("n"), F.col("all"), round_keys(F.col("all"), salt), salt)
    inner = (F.lit(f"{seed}s"), F.col("number"), F.col("pass"))
    of_source = permuted(F.col("n") % F.col("blocks"), F.col("blocks"), round_keys(F.col("blocks"), *inner), *inner)
    slots = opened.select("number", "pass", of_all.alias("at"), of_source.alias("block")).selectExpr(
        f"at div {shard} AS shard", f"at % {shard} AS slot", "number", "pass", "block"
    )
    return Mix(sources, slots, pieces, sizes)


def counts(plan: Mix) -> DataFrame:
    """(shard, number, n): slots each source got in each output shard."""
    return plan.slots.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("n"))


def used(plan: Mix) -> DataFrame:
    """Pieces with ``uses`` (0 to 2): how often the mix takes the piece's block."""
    uses = plan.slots.groupBy("number", "block").agg(F.count(F.lit(1)).alias("uses"))
    # The slots are made from few rows, so Spark underrates their size and would broadcast them.
    return plan.pieces.join(uses.hint("merge"), ["number", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def taken(plan: Mix) -> DataFrame:
    """(key, size, source_size, target, taken) of every document, in words."""
    pieces = used(plan).groupBy("number", "key", "start", "size").agg(F.sum(F.expr("words * uses")).alias("taken"))
    whole = pieces.select("number", "key", "size", "taken").union(
        plan.sizes.where("size = 0").selectExpr("number", "key", "size", "0 AS taken")
    )
    sources = plan.sources.selectExpr("number", "words AS source_size", "target")
    return whole.join(sources, "number").select("key", "size", "source_size", "target", "taken")


def mixed(df: DataFrame, plan: Mix, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` of which the mix takes words, with the text it takes.

    The pieces of a text stand in their order, each as often as it is used,
    with the blanks before its words. Keys are taken to be unique; rows without
    a key are left out.
    """
    mine, listed, split = (fresh(df, name) for name in ("mixed_key", "mixed_pieces", "mixed_words"))
    pieces = (
        used(plan)
        .where("uses > 0")
        .groupBy(F.col("key").alias(mine))
        .agg(F.array_sort(F.collect_list(F.struct("first", "words", "uses"))).alias(listed))
    )
    spaced = F.regexp_extract_all(F.concat(F.lit(" "), F.col(text)), F.lit(f"{BLANK}*{WORD}"), F.lit(0))
    joined = df.join(pieces, F.col(key) == F.col(mine)).withColumn(split, spaced)

    def piece(one: Column, words: Column) -> Column:
        part = F.array_join(F.slice(words, one["first"].cast("int") + 1, one["words"].cast("int")), "")
        return F.repeat(part, one["uses"].cast("int"))

    def body(words: Column) -> Column:
        return F.array_join(F.transform(listed, lambda one: piece(one, words)), "")

    text_taken = F.get(F.transform(F.array(split), body), F.lit(0))
    trimmed = F.regexp_replace(text_taken, f"^{BLANK}+", "")
    return joined.withColumn(text, trimmed).select(*df.columns)
