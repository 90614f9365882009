"""Substring search through trigrams: which rows can hold a text, without reading all of them.

A row whose text contains another one has all of its trigrams. Postings list the rows of each
trigram, sorted by it, so that a search reads the row groups of a few trigrams, counts how many of them a row
has, and compares the texts of the rows that have all. Texts of less than three letters have no
trigram and are looked for in all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.text import contains_text

SIZE = 3


def trigrams(text: str) -> list[str]:
    """Different trigrams of a text in lower case."""
    low = text.lower()
    return sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})


def postings(rows: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(field, gram, key): every trigram of the lower-cased text columns once per row."""

    def grams(name: str) -> Column:
        low = F.lower(F.col(name))
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - SIZE + 1, F.lit(1)))
        found = F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(SIZE))))
        return F.filter(found, lambda gram: F.length(gram) == SIZE)

    found = [F.struct(F.lit(name).alias("field"), grams(name).alias("grams")) for name in columns]
    listed = rows.select(F.col(key).alias("key"), F.explode(F.array(*found)).alias("one"))
    return listed.select("one.field", F.explode("one.grams").alias("gram"), "key")


def write_postings(rows: DataFrame, path: str, columns: list[str], key: str = "id") -> None:
    """Postings as a table sorted by field and trigram; a frequent trigram is spread over files by key."""
    order = ["field", "gram", "key"]
    postings(rows, columns, key).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def search(rows: DataFrame, index: DataFrame, column: str, text: str, key: str = "id") -> DataFrame:
    """Rows whose ``column`` contains a text, whatever the case of letters; as a scan would find them."""
    grams = trigrams(text)
    if not grams:
        return rows.filter(contains_text(column, text))
    hits = index.filter((F.col("field") == column) & F.col("gram").isin(*grams)).groupBy(F.col("key").alias("_hit")).count()
    having = hits.filter(F.col("count") == len(grams)).select("_hit")
    return rows.join(having, F.col(key) == F.col("_hit"), "left_semi").filter(contains_text(column, text))
