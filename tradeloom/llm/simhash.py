"""SimHash fingerprints and their near-duplicates by a self-join of a binary trie.

The distinct fingerprints form a binary trie. Pairs of trie nodes are walked
together from the root: a pair of children inherits its parents' differing bits
plus its own, and is dropped once more bits differ than allowed. Spark walks the
upper levels as joins of node tables, four bits at a time, until the two nodes of
a pair hold few enough fingerprints for one task; tasks walk the rest in numpy
and verify leaves by the bit count of their difference. A task returns a spanning
forest of its links, so a dense group costs one row per member, not per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.llm.components import components
from tradeloom.llm.shared import fresh, slices, utf8
from tradeloom.plans.workspace import stored

SEED = 42
STEP = 4
NODE_ROWS = 1 << 16
CHUNK = 1 << 16  # shingles hashed at a time
PAIRS = 1 << 15  # node pairs walked at a time, each with at most 64 leaf pairs


def fingerprint(text: bytes, shingle: int) -> bytes:
    """Eight bytes, highest bit first: the majority of the shingles' XXH64 bits; zeros without words."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    total, counts, digest = max(1, len(words) - shingle + 1), np.zeros(64, np.int64), xxhash.xxh64_digest
    spans = list(zip(starts[:total], ends[min(shingle, len(words)) - 1 :].tolist(), strict=True))
    for first in range(0, total, CHUNK):
        hashed = b"".join([digest(joined[a:b], SEED) for a, b in spans[first : first + CHUNK]])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > total).tobytes()


def fingerprints(df: DataFrame, *, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint bigint) of every row, from whole texts with A-Z lower-cased.

    Texts of fewer words than a shingle are one shingle; null texts and texts
    without words have fingerprint zero. Repeated rows and null keys are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = b"".join(fingerprint(value or b"", shingle) for value in utf8(batch.column("text")))
            values = pa.array(np.frombuffer(found, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), values], names=["key", "fingerprint"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    return rows.mapInArrow(run, f"key {kind}, fingerprint bigint").withColumnRenamed("key", key)


def _product(a_lo, a_n, b_lo, b_n):
    """Index pairs of all (a, b) in each of the small ranges."""
    sizes = a_n * b_n
    at = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a_lo[at] + inner // b_n[at], b_lo[at] + inner % b_n[at]


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First position of each node whose values have ``bit`` set."""
    one = np.uint64(1 << bit)
    start = (values[lo] & ~np.uint64((1 << (bit + 1)) - 1)) | one
    return np.clip(np.searchsorted(values, start), lo, hi)


def walk(a: np.ndarray, b: np.ndarray, bit: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into sorted unsigned ``a`` and ``b``) differing in at most ``budget`` bits.

    ``a`` is one trie node and ``b`` another, each uniform above ``bit``; pass
    the same array twice for a node with itself, which gives i < j only. Node
    pairs are taken from a stack in chunks, so memory stays bounded.
    """
    same = a is b
    if not len(a) or not len(b):
        return
    above = 0 if same or bit == 63 else int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(bit + 1)))
    if above > budget:
        return
    whole = tuple(np.array([x]) for x in (0, len(a), 0, len(b), above))
    stack = [(bit, whole)]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs[0]) > PAIRS:
            half = len(pairs[0]) // 2
            stack += [(bit, tuple(x[:half] for x in pairs)), (bit, tuple(x[half:] for x in pairs))]
            continue
        a_lo, a_hi, b_lo, b_hi, bits = pairs
        small = (a_hi - a_lo) * (b_hi - b_lo) <= 64
        if bit < 0:
            small[:] = True
        if small.any():
            i, j = _product(a_lo[small], (a_hi - a_lo)[small], b_lo[small], (b_hi - b_lo)[small])
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
        a_lo, a_hi, b_lo, b_hi, bits = (x[~small] for x in pairs)
        if not len(a_lo):
            continue
        a_mid, b_mid = _split(a, a_lo, a_hi, bit), _split(b, b_lo, b_hi, bit)
        children = []
        for a_from, a_to, b_from, b_to, cost, mirrored in (
            (a_lo, a_mid, b_lo, b_mid, 0, False),
            (a_mid, a_hi, b_mid, b_hi, 0, False),
            (a_lo, a_mid, b_mid, b_hi, 1, False),
            (a_mid, a_hi, b_lo, b_mid, 1, True),
        ):
            keep = (a_from < a_to) & (b_from < b_to) & (bits + cost <= budget)
            if same and mirrored:
                keep &= a_lo != b_lo
            children.append(tuple(x[keep] for x in (a_from, a_to, b_from, b_to, bits + cost)))
        merged = tuple(np.concatenate(x) for x in zip(*children, strict=True))
        if len(merged[0]):
            stack.append((bit - 1, merged))


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j: every node's label is the smallest index of its group."""
    while True:
        left, right = labels[i], labels[j]
        apart = left != right
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while (hops := labels[labels]).tobytes() != labels.tobytes():
            labels = hops


def _forest(group: pa.Table, budget: int) -> pa.Table:
    bit = 63 - group.column("depth")[0].as_py()
    side = group.column("side").to_numpy()
    values = group.column("value").to_numpy().astype(np.int64).view(np.uint64)
    a, b = np.sort(values[side == 0]), np.sort(values[side == 1])
    lone = not len(b)
    nodes = a if lone else np.concatenate([a, b])
    labels, shift = np.arange(len(nodes)), 0 if lone else len(a)
    for i, j in walk(a, a if lone else b, bit, budget):
        labels = _merge(labels, i, j + shift)
    hung = np.flatnonzero(labels != np.arange(len(nodes)))
    return pa.table({"a": nodes[hung].view(np.int64), "b": nodes[labels[hung]].view(np.int64)})


def near_links(values: DataFrame, budget: int, *, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``values`` (value bigint, distinct) within ``budget`` bits."""
    spark = values.sparkSession
    open_pairs = spark.createDataFrame([(0, 0, 0)], "a bigint, b bigint, bits int")
    parts, depth = [], 0
    while depth < 64:
        depth += STEP
        prefix = F.shiftrightunsigned("value", 64 - depth)
        nodes = values.groupBy(prefix.alias("node")).agg(F.count(F.lit(1)).alias("rows"))
        parent = F.shiftrightunsigned("node", STEP)
        a = nodes.select(parent.alias("a"), F.col("node").alias("a_node"), F.col("rows").alias("a_rows"))
        b = nodes.select(parent.alias("b"), F.col("node").alias("b_node"), F.col("rows").alias("b_rows"))
        below = (1 << STEP) - 1
        pairs = stored(
            open_pairs.join(a, "a")
            .join(b, "b")
            .selectExpr(
                "a_node AS a",
                "b_node AS b",
                f"bits + bit_count((a_node & {below}) ^ (b_node & {below})) AS bits",
                f"{depth} = 64 OR a_rows + b_rows <= {int(node_rows)} AS done",
            )
            .where(f"bits <= {int(budget)} AND a <= b"),
            "pairs",
        )
        ready, open_pairs = pairs.where("done"), pairs.where("NOT done").select("a", "b", "bits")
        members = values.select(prefix.alias("node"), "value")
        for side, name, keep in ((0, "a", "true"), (1, "b", "a < b")):
            parts.append(
                ready.where(keep)
                .select("a", "b", F.col(name).alias("node"))
                .join(members, "node")
                .select("a", "b", F.lit(depth).alias("depth"), F.lit(side).alias("side"), "value")
            )
        if open_pairs.isEmpty():
            break
    pairs = reduce(DataFrame.union, parts).groupBy("depth", "a", "b")
    return pairs.applyInArrow(lambda group: _forest(group, budget), "a bigint, b bigint")


def groups(
    df: DataFrame, *, shingle: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS
) -> DataFrame:
    """(key, fingerprint bigint, component): near-duplicate groups of all rows.

    Fingerprints link at ``distance`` or fewer differing bits; ``component`` is
    the smallest key reachable by links, the row's own included (null if all
    keys of a group are null). Equal fingerprints are one trie leaf, so copies
    are never paired. Rows of an empty table give none; repeated rows and keys
    stay as they are; other columns are ignored.
    """
    prints = stored(fingerprints(df, shingle=shingle, key=key, text=text), "fingerprints")
    leaves = stored(prints.groupBy(F.col("fingerprint").alias("value")).agg(F.min(key).alias("least")), "leaves")
    classes = components(near_links(leaves.select("value"), distance, node_rows=node_rows))
    hung = leaves.join(classes.withColumnRenamed("node", "value"), "value", "left").select(
        "value", "least", F.coalesce("component", "value").alias("class")
    )
    smallest = hung.groupBy("class").agg(F.min("least").alias("component"))
    named = hung.select("value", "class").join(smallest, "class").select(F.col("value").alias("fingerprint"), "component")
    return prints.join(named, "fingerprint").select(key, "fingerprint", "component")


def representatives(df: DataFrame, *, shingle: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, all columns unchanged: the one with the smallest key, a null key last.

    Rows are told apart by key and text, so different texts of one key, and rows without
    a key, are judged like all others. Of rows with equal key and text one stays.
    """
    row = fresh(df, "row")
    told = df.withColumn(row, row_key(key, text))
    found = groups(told, shingle=shingle, distance=distance, key=row, text=text)
    mine = fresh(told, "kept")
    kept = found.where(F.col(row).eqNullSafe(F.col("component"))).select(F.col(row).alias(mine)).distinct()
    return told.join(kept, F.col(row).eqNullSafe(F.col(mine)), "left_semi").dropDuplicates([row]).drop(row)


def row_key(key: str, text: str) -> Column:
    """A key of rows whose own may be null or repeated: in the order of their own, nulls last, then by a hash of the text."""
    return F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), F.xxhash64(text).alias("text"))
