"""Files read in byte ranges by many tasks, whose records depend on what comes before them in the file.

Spark cuts a file into ranges and each range into pieces at a separator. Whether a piece begins inside
quotes, or how deep in brackets, is a sum over all pieces before it. Such sums are taken
within a range, and the ranges' totals are summed over the file, one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tradeloom.plans.workspace import stored

PLACE = ["file", "range", "piece"]


def read_pieces(spark: SparkSession, path: str | list[str], separator: str, as_one: bool = False) -> DataFrame:
    """(file, range, piece, value, closed): pieces of text between separators, in order of range and piece.

    ``closed`` says that a separator follows, which the last piece of a file may lack. With ``as_one`` the files
    of a folder, by name, are read as one. The pieces are stored, since several passes need them.
    """
    name = F.col("_metadata.file_path")
    pieces = spark.read.text(path, lineSep=separator).select(
        F.lit("" if isinstance(path, list) else path).alias("file") if as_one else name.alias("file"),
        F.struct(name.alias("name"), F.col("_metadata.file_block_start").alias("start")).alias("range"),
        F.monotonically_increasing_id().alias("piece"),
        "value",
        F.col("_metadata.file_size").alias("size"),
    )
    pieces = stored(pieces, "pieces")
    # Without the last separator, the pieces and separators are one byte more than the file; a byte order mark is 3 less.
    sizes = pieces.groupBy("range.name").agg(
        F.max("size").alias("size"),
        F.sum(F.octet_length("value") + 1).alias("read"),
        F.max(F.struct("range", "piece")).alias("last"),
    )
    ragged = sizes.filter("read - size IN (1, -2)").select(F.struct("last.range", "last.piece").alias("at"))
    place = F.struct("range", "piece")
    marked = pieces.join(ragged, place == F.col("at"), "left")
    return marked.select("file", "range", "piece", "value", F.col("at").isNull().alias("closed"))


def sums_before(pieces: DataFrame, **amounts: Column) -> DataFrame:
    """Add the sum of each amount over the pieces of the same file that come earlier."""
    earlier = Window.partitionBy("file", "range").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumns({f"_{name}": amount.cast("bigint") for name, amount in amounts.items()})
    totals = rows.groupBy("file", "range").agg(*[F.sum(f"_{name}").alias(f"_all_{name}") for name in amounts])
    ranges = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "file", "range", *[F.coalesce(F.sum(f"_all_{name}").over(ranges), F.lit(0)).alias(f"_start_{name}") for name in amounts]
    )
    within = rows.withColumns({name: F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)) for name in amounts})
    joined = within.join(starts, ["file", "range"])
    return joined.select(*pieces.columns, *[(F.col(name) + F.col(f"_start_{name}")).alias(name) for name in amounts])


def count_of(text: Column, marks: str) -> Column:
    """How many of the given characters a text has."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


# JSON arrays -------------------------------------------------------------------


def array_elements(spark: SparkSession, path: str | list[str], as_one: bool = False) -> DataFrame:
    """(source, position, element): the elements of one JSON array per file, as text, read in parallel.

    Files are cut at ``}``; a piece in which an object of the array ends closes a segment, which is put
    together and parsed by itself, with the elements before that object that are no objects. So no task holds more
    than its range and an object. A segment that cannot be parsed is one null element. A file that does not
    begin with ``[`` or whose quotes and brackets do not close is one null element at position 0; an empty array has
    none. With ``as_one`` the part files of a folder, by name, are one array together.
    """
    pieces = read_pieces(spark, path, "}", as_one)
    # Escaped characters open and close nothing.
    plain = pieces.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))
    quoted = sums_before(plain, quotes=count_of(F.col("plain"), '"'))
    outside = F.filter(F.split("plain", '"', -1), lambda part, i: (i + F.col("quotes")) % 2 == 0)
    ends_outside = (F.col("quotes") + count_of(F.col("plain"), '"')) % 2 == 0
    closes = (ends_outside & F.col("closed")).cast("int")
    opened = quoted.withColumn("bare", F.array_join(outside, "")).withColumns(
        {"closes": closes, "moved": count_of(F.col("bare"), "{[") - count_of(F.col("bare"), "}]") - closes, "open": ~ends_outside}
    ).drop("plain", "bare")
    deep = sums_before(opened, depth=F.col("moved"))
    ended = deep.withColumn("ends", (F.col("closes") == 1) & (F.col("depth") + F.col("moved") == 1))
    placed = stored(sums_before(ended, segment=F.col("ends").cast("int")), "segments")

    first, last = F.struct("range", "piece", "value"), F.struct("range", "piece", "open")
    files = placed.groupBy("file").agg(
        F.min(first)["value"].alias("begins"), F.sum("moved").alias("left"), F.max(last)["open"].alias("open")
    )
    sound = F.col("begins").rlike(r"^\s*\[") & (F.col("left") == 0) & ~F.col("open")
    files = files.select("file", F.coalesce(sound, F.lit(False)).alias("sound"))

    text = F.concat("value", F.when(F.col("closed"), "}").otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("range", "piece", text.alias("text"))))
    segments = placed.groupBy("file", "segment").agg(
        F.array_join(F.transform(ordered, lambda one: one["text"]), "").alias("text"), F.max("ends").alias("ends")
    )
    core = F.regexp_replace("text", r"^\s*[\[,]", "")
    core = F.when(F.col("ends"), core).otherwise(F.regexp_replace(core, r"\]\s*$", ""))
    listed = F.when(F.trim(F.regexp_replace(core, r"\s+", " ")) == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(F.from_json(F.concat(F.lit("["), core, F.lit("]")), "array<string>"), F.array(F.lit(None).cast("string")))
    )
    parsed = stored(
        segments.join(files.filter("sound"), "file").select("file", "segment", listed.alias("elements")), "elements"
    )
    # Positions: segments are numbered, so blocks of their numbers take the place of ranges.
    numbered = parsed.select(
        "file", F.expr("segment div 100000").alias("range"), F.col("segment").alias("piece"), "elements"
    )
    counted = sums_before(numbered, before=F.size("elements"))
    elements = counted.select("file", "before", F.posexplode("elements").alias("at", "element")).select(
        F.col("file").alias("source"), (F.col("before") + F.col("at")).alias("position"), "element"
    )
    broken = files.filter("NOT sound").select(
        F.col("file").alias("source"), F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("string").alias("element")
    )
    return elements.unionByName(broken)


# CSV ---------------------------------------------------------------------------


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, range, piece, record, first, closed): CSV records as text, also those with line breaks in quotes.

    A line that begins outside quotes begins a record. Lines that are a record each stay where they are; only
    the lines of longer records meet. ``first`` marks each file's header. Quotes belong around fields only, doubled
    within. A record whose quotes the file never closes is returned by its first line alone, as not ``closed``.
    """
    lines = read_pieces(spark, path, "\n").drop("closed").withColumn("marks", count_of(F.col("value"), '"'))
    quoted = sums_before(lines, quotes=F.col("marks"))
    begins = F.col("quotes") % 2 == 0
    placed = stored(
        sums_before(quoted.withColumn("begins", begins), records=begins.cast("int")).withColumn(
            "record_number", F.col("records") + F.col("begins").cast("int")
        ),
        "lines",
    )
    clean = F.regexp_replace("value", r"\r$", "")
    single = placed.filter("begins AND marks % 2 = 0").select(*PLACE, clean.alias("record"), "record_number", F.lit(True).alias("closed"))
    longer = placed.filter("NOT begins OR marks % 2 = 1")
    # The last record of a file with an odd number of quotes never ends.
    endless = placed.groupBy("file").agg(F.sum("marks").alias("marks"), F.max("record_number").alias("record_number"))
    endless = endless.filter("marks % 2 = 1").select("file", "record_number")
    open_ended = longer.join(endless, ["file", "record_number"], "left_semi").filter("begins").select(
        *PLACE, clean.alias("record"), "record_number", F.lit(False).alias("closed")
    )
    parts = longer.join(endless, ["file", "record_number"], "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("range", "piece", "value")))
    joined = parts.groupBy("file", "record_number").agg(ordered.alias("lines")).select(
        "file",
        F.col("lines")[0]["range"].alias("range"),
        F.col("lines")[0]["piece"].alias("piece"),
        F.regexp_replace(F.array_join(F.transform("lines", lambda line: line["value"]), "\n"), r"\r$", "").alias("record"),
        "record_number",
        F.lit(True).alias("closed"),
    )
    every = single.unionByName(joined).unionByName(open_ended)
    return every.select(*PLACE, "record", (F.col("record_number") == 1).alias("first"), "closed")


def csv_fields(spark: SparkSession, path: str | list[str], wanted: list[str]) -> DataFrame:
    """(file, range, piece, closed, one column per wanted name) of headed CSV files, each by its own header.

    A field is null where its row is too short or empty, and ``has_<name>`` is false where the header lacks it.
    """
    records = csv_records(spark, path).filter(F.trim("record") != "")
    headers = records.filter("first").select("file", F.col("record").alias("header"))
    wide = headers.agg(F.max(count_of(F.col("header"), ",") + 1)).first()[0] or 1
    shape = ", ".join(f"c{i} string" for i in range(wide))

    def fields(column: str) -> Column:
        parsed = F.from_csv(column, shape, {"quote": '"', "escape": '"'})
        return F.array(*[parsed[f"c{i}"] for i in range(wide)])

    names = headers.select("file", fields("header").alias("names"))
    rows = records.filter("NOT first").withColumn("fields", fields("record")).join(names, "file")
    at = {name: F.coalesce(F.array_position("names", name), F.lit(0)) for name in wanted}
    return rows.select(
        *PLACE,
        "closed",
        *[F.when(place > 0, F.try_element_at("fields", F.greatest(place, F.lit(1)).cast("int"))).alias(name) for name, place in at.items()],
        *[(place > 0).alias(f"has_{name}") for name, place in at.items()],
    )
