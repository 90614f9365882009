"""Periodic runs in texts: stretches of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
the same), at least ``max(least, 2 * q)`` words long, and that no neighbouring word
extends with period q.

Method, for one stretch of words: a suffix automaton is built word by word. Its suffix
links are a tree in which the path of a prefix to the root holds all suffixes of that
prefix. A link-cut forest of splay trees over this tree keeps, as preferred paths, the
path segments whose strings last ended at the same word. Appending a word accesses the
path of its prefix: each segment that is met gives the previous end of its strings and
the length of its longest string, and then takes the new end. Where the distance d of the
two ends is within that length, the 2d words up to the new end are a square, and the
longest string d words further back starts the run. The same start and distance come
back with every further word of the run, so the last one gives its end. No smaller
period is possible there: a string with one would have ended later.

The automaton of a stretch is built first and its words are accessed in order afterwards,
so the tree stays fixed while segments are recoloured.

Before that, numpy finds the stretches in which runs can lie at all. Words q apart agree
at least ``least // 2`` times in a row in a run, so all of its words lie in windows of
that many words that the run holds twice. Words outside such windows divide the text,
and windows that their part holds only once are dropped, until nothing changes. Equal
hashes of windows stand for equal windows, so chance can only lengthen a stretch.

Every text is judged by itself, in the task that reads it. Null texts and texts without
a word have no runs, and equal rows equal results; tables may be empty and have any further
columns. Nothing is cut from a text, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.llm.shared import slices, split_words

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class _Links:
    """Suffix automaton of a sequence: its suffix links, longest lengths, and the state of every prefix."""

    def __init__(self, words: list[int]) -> None:
        self.parent, self.length, self.prefixes = [-1], [0], []
        moves: list[dict[int, int]] = [{}]
        parent, length = self.parent, self.length
        last = 0
        for word in words:
            state = len(length)
            length.append(length[last] + 1)
            parent.append(0)
            moves.append({})
            at = last
            while at >= 0 and word not in moves[at]:
                moves[at][word] = state
                at = parent[at]
            if at >= 0:
                target = moves[at][word]
                if length[target] != length[at] + 1:
                    twin = len(length)
                    length.append(length[at] + 1)
                    parent.append(parent[target])
                    moves.append(moves[target].copy())
                    old, target = target, twin
                    parent[old] = twin
                    while at >= 0 and moves[at].get(word) == old:
                        moves[at][word] = twin
                        at = parent[at]
                parent[state] = target
            self.prefixes.append(state)
            last = state


class _Paths:
    """Link-cut forest over a fixed tree; every preferred path has one colour, kept at its splay root."""

    def __init__(self, parent: list[int]) -> None:
        # up: parent in the splay tree, or the tree node above the path for a splay root.
        self.up, self.left, self.right = parent[:], [-1] * len(parent), [-1] * len(parent)
        self.colour = [-1] * len(parent)

    def _splay(self, x: int) -> None:
        """Make x the root of its splay tree; the colour goes with the root."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        while y >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z >= 0 and (left[z] == y or right[z] == y)
            if inner and (left[z] == y) == (left[y] == x):
                self._turn(y)
                self._turn(x)
            elif inner:
                self._turn(x)
                self._turn(x)
            else:
                self._turn(x)
            y = up[x]

    def _turn(self, x: int) -> None:
        """Rotate x above its splay parent."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z
        if z >= 0 and left[z] == y:
            left[z] = x
        elif z >= 0 and right[z] == y:
            right[z] = x
        else:
            self.colour[x] = self.colour[y]

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """(deepest node, colour) of each coloured segment from ``node`` to the root, which then form one of ``colour``."""
        up, right, colours = self.up, self.right, self.colour
        below, x = -1, node
        while x >= 0:
            self._splay(x)
            seen = colours[x]
            if seen >= 0:
                yield x, seen
            cut = right[x]
            if cut >= 0:
                colours[cut] = seen
            right[x] = below
            if below >= 0:
                up[below] = x
            below, x = x, up[x]
        colours[below] = colour


def runs_of(words: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start and period."""
    links = _Links(words)
    paths, length = _Paths(links.parent), links.length
    ends: dict[tuple[int, int], int] = {}
    for end, state in enumerate(links.prefixes):
        for node, before in paths.access(state, end):
            distance, longest = end - before, length[node]
            if distance <= longest:
                ends[end - longest - distance + 1, distance] = end
    found = [(start, end - start + 1, period) for (start, period), end in ends.items()]
    return sorted((run for run in found if run[1] >= max(least, 2 * run[2])), key=lambda run: (run[0], run[2]))


def _seen_twice(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one elsewhere."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def stretches(codes: np.ndarray, texts: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of the parts in which runs of at least ``least`` words can lie.

    ``codes`` are the word numbers of all texts in a row, ``texts`` the number of each word's text.
    """
    width = max(1, least // 2)
    count = len(codes) - width + 1
    none = np.zeros(0, np.int64)
    if count < 1:
        return none, none
    odd = np.uint64(0x9E3779B97F4A7C15)
    hashes = np.zeros(count, np.uint64)
    for k in range(width):
        hashes = hashes * odd + codes[k : k + count].astype(np.uint64)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    # Windows that are still candidates, and the part each lies in.
    at = np.flatnonzero(texts[:count] == texts[width - 1 :])
    part = texts[at].astype(np.uint64)
    while True:
        again = _seen_twice(hashes[at] + part * odd)
        done = again.all()
        at = at[again]
        if not len(at):
            return none, none
        gaps = np.flatnonzero((np.diff(at) > width) | (np.diff(texts[at]) != 0))
        first = np.concatenate([[0], gaps + 1])
        last = np.concatenate([gaps, [len(at) - 1]])
        if done:
            break
        part = np.repeat(np.arange(len(first), dtype=np.uint64), last - first + 1)
    starts, ends = at[first], at[last] + width
    long = ends - starts >= least
    return starts[long], ends[long]


def _as_planted(sizes: np.ndarray, keys: list[int | None]) -> np.ndarray:
    """Position of the original word at each place, for texts that are made periodic by their id's hash."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(begin[-1])
    for row, key in enumerate(keys):
        n = int(sizes[row])
        if key is None or key % 10 or not n:
            continue
        g = key // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[begin[row] + a : begin[row + 1]] = begin[row] + a + np.arange(n - a) % p
    return source


def _detect(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    words, begin = split_words(batch.column("text"))
    # Blanks at the ends of a text leave empty words.
    real = np.asarray(pc.greater(pc.binary_length(words), 0))
    owner = np.repeat(np.arange(batch.num_rows), np.diff(begin))
    words, owner = words.filter(pa.array(real)), owner[real]
    sizes = np.bincount(owner, minlength=batch.num_rows)
    source = _as_planted(sizes, batch.column("plant").to_pylist())
    encoded = words.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)[source]
    first = np.concatenate([[0], np.cumsum(sizes)])
    kept = np.ones(len(codes), bool)
    runs: list[list[dict[str, int]]] = [[] for _ in range(batch.num_rows)]
    for start, end in zip(*stretches(codes, owner, least), strict=True):
        row = int(owner[start])
        base = int(start - first[row])
        for at, length, period in runs_of(codes[start:end].tolist(), least):
            runs[row].append({"start": base + at, "length": length, "period": period})
            kept[start + at + period : start + at + length] = False
    for found in runs:
        found.sort(key=lambda run: (run["start"], run["period"]))
    # The kept words of a text, joined by single blanks.
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=batch.num_rows))]), pa.int32()),
        words.take(pa.array(source[kept])).cast(pa.string()),
    )
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    out = {name: batch.column(name) for name in batch.schema.names if name not in ("text", "plant")}
    out |= {
        "n_words": pa.array(sizes, pa.int64()),
        "runs": pa.array(runs, pa.list_(run)),
        "collapsed": pc.binary_join(lists, " "),
    }
    return pa.RecordBatch.from_pydict(out)


def runs(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, plant: Column | None = None, least: int = 12
) -> DataFrame:
    """The columns of ``keep`` (default: all others) with n_words, runs (array of start, length, period) and collapsed.

    ``collapsed`` is the text's words joined by single blanks, without those that a run contains
    after its first period. ``plant``, a non-negative number per row, makes test data periodic
    before anything else: a text whose number ends in 0 repeats its words from a place, and with a
    period, that follow from the rest of the number; a null plants nothing. Columns of ``keep`` that
    are named like a result are replaced by it.
    """
    made = ("n_words", "runs", "collapsed")
    names = [name for name in (df.columns if keep is None else keep) if name != text and name not in made]
    keys = {name: f"key{i}" for i, name in enumerate(names)}
    wanted = df.select(
        *[F.col(f"`{name}`").alias(key) for name, key in keys.items()],
        F.col(f"`{text}`").alias("text"),
        (F.lit(None) if plant is None else plant).cast("bigint").alias("plant"),
    )
    kinds = ", ".join(f"{key} {df.schema[name].dataType.simpleString()}" for name, key in keys.items())

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _detect(batch, least)

    schema = ", ".join(filter(None, [kinds, f"n_words bigint, runs array<{RUN}>, collapsed string"]))
    return wanted.mapInArrow(detect, schema).withColumnsRenamed({key: name for name, key in keys.items()})


def longest(column: str = "runs") -> Column:
    """The run of greatest length; of equal ones that with the smallest start, then period. Null without runs."""
    ranked = F.transform(
        column, lambda run: F.struct(-run["length"], run["start"].alias("start"), run["period"].alias("period"), run.alias("run"))
    )
    return F.array_min(ranked)["run"]
