"""Quality rules judged per host, by functions of Spark alone.

Documents are measured and tested against rules; failures are summed per host.
A host's failure rate is shrunk towards the rate of all documents by a beta
prior whose strength is estimated from how far the hosts' rates lie apart, so
that a host of a few documents is judged mostly by the prior. The verdict on the
host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.llm.shared import WORD
from tradeloom.plans.workspace import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, although a lambda inside may use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, window: int) -> Column:
    """Words lying in a window of ``window`` words that occurs twice or more; windows are compared by 64-bit hash."""
    starts = F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(hashed: Column) -> Column:
        ranked = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(
            ranked,
            lambda r: F.filter(
                r, lambda x, k: x["h"].eqNullSafe(F.get(r, k - 1)["h"]) | x["h"].eqNullSafe(F.get(r, k + 1)["h"])
            ),
        )
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        total = _let(
            places,
            lambda p: F.aggregate(
                F.sequence(F.lit(1), F.size(p) - 1),
                F.lit(window).cast("bigint"),
                lambda held, k: held + F.least(F.lit(window), F.get(p, k) - F.get(p, k - 1)),
            ),
        )
        single = F.size(F.array_distinct(hashed)) == F.size(hashed)
        return F.when(single, F.lit(0).cast("bigint")).otherwise(total)

    return F.coalesce(_let(hashes, covered), F.lit(0).cast("bigint"))


def measures(df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row; a null text has no words."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))

    def length_without(characters: str) -> Column:
        return F.length(F.translate("text", characters, ""))

    rows = df.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).cast("string").alias("text"))
    split = rows.select("key", "host", whole.alias("text")).select("key", "host", "text", words.alias("words"))
    found = split.select(
        "key",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        length_without(" \t\n\x0b\x0c\r").cast("bigint").alias("word_chars"),
        (F.length("text") - length_without(SYMBOLS)).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _let(F.col("words"), lambda x: _repeat_words(x, WINDOW)).alias("n_repeat_words"),
    )
    return found


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
# Further rules count against a document's host, not against the document itself.
HOST_RULES = (
    "20 * n_symbols > n_words",
    "5 * n_dup_lines > n_words",
    "word_chars < 2 * n_words OR word_chars > 20 * n_words",
)


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, documents, failures, rate): shrunk failure rates of (host, failed boolean) rows; null is a host of its own."""
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("failed").cast("bigint")).alias("failures")
    )
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("documents").alias("n"),
        F.sum("failures").alias("f"),
        F.sum(F.expr("CAST(documents AS double) * documents")).alias("squares"),
        F.sum(F.expr("CAST(failures AS double) * failures / documents")).alias("rates"),
    )
    # Moments of a beta-binomial: what the rates differ beyond chance gives the share of variance between hosts.
    prior = sums.selectExpr("f / n AS mean", "n", "hosts", "squares", "rates - f * (f / n) AS spread").selectExpr(
        "mean",
        """CASE WHEN mean > 0 AND mean < 1 AND n - squares / n > hosts - 1 THEN
             least(greatest((spread / (mean * (1 - mean)) - (hosts - 1)) / (n - squares / n - (hosts - 1)), 0.001), 0.999)
           ELSE 0.5 END AS between""",
    )
    mean, between = prior.first()
    mean, strength = (mean or 0.0), 1 / (between or 0.5) - 1
    rate = (F.col("failures") + F.lit(strength * mean)) / (F.col("documents") + F.lit(strength))
    return hosts.select("host", "documents", "failures", rate.alias("rate"))


def verdicts(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5
) -> DataFrame:
    """Measures, ``base_failed``, the host's shrunk ``rate`` and ``kept`` of every row.

    A document is kept if it passes the base rules and its host's rate is at most
    ``max_rate``. Null hosts are one host. Repeated rows and keys are judged one
    by one; an empty table gives no rows.
    """
    failing = " OR ".join(f"({rule})" for rule in (BASE_FAILED, *HOST_RULES))
    judged = stored(measures(df, key=key, text=text, host=host).selectExpr("*", f"{BASE_FAILED} AS base_failed", f"{failing} AS failed"), "measures")
    rates = host_rates(judged).selectExpr("host AS rated", "rate")
    joined = judged.join(rates, F.col("host").eqNullSafe(F.col("rated")))
    return joined.selectExpr(
        f"key AS `{key}`",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "rate",
        f"NOT base_failed AND rate <= {float(max_rate)} AS kept",
    )
