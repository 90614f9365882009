"""Language-model scores by a hierarchical Pitman-Yor model of words in context.

A text is its words and one end; each token stands in the context of the word
before it, the first in that of an end. Every context is a Chinese restaurant whose
customers are the tokens that follow it, and all contexts share one parent, the
restaurant of words: a table of a context is a customer there. A table of the word
restaurant takes its word from a base, which spells it with the letters (UTF-8
bytes) of a hierarchy of further restaurants: that of a context of up to four
letters shares the parent of its last three with all others that end alike, down to
the restaurant without context, whose base is uniform. As in counts raised by one,
all words never taught are one outcome, with the probability left over by the
spellings of taught words; ``open_words`` spells each of them out instead.

Seating is sampled by Gibbs sweeps: all customers of a dish are seated anew, one
after another, given the sums of tables and the base's probabilities of the sweep
before, so dishes are independent; customers beyond the first few are seated in
groups of a sixteenth of those already there. Contexts are dealt to parts by hash,
and the contexts of a part sweep with a parent of their own, made of that part's
tables; the tables of all parts then meet in the one word restaurant, which sweeps
with the letters. Predictive probabilities are averaged over the sweeps after the
first ones.

Every pair of words has its exact count in the model, which so grows with the
corpus. A batch of texts asks for its distinct words and pairs once; words and pairs
travel as hashes and counts in columns, by part, and there is a part for two
batches. A context in which at least one part's share of all tokens stands is split
over all parts; there are at most as many of these as parts. A letter context has a
restaurant of its own if at least ``share`` of all spelled letters stand in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.shared import bounded_batches, slices, split_words, utf8
from tradeloom.llm.token_files import pack, unpack
from tradeloom.plans.workspace import stored

DEPTH = 4
SHARE = 1e-4
SYMBOLS = 256  # bytes; zero ends a word as a letter and begins it as a context
LETTER_DISCOUNT, LETTER_STRENGTH = 0.5, 1.0
WORD_STRENGTH = 1.0
CONTEXT_DISCOUNT, CONTEXT_STRENGTH = 0.8, 1.0
HASH_BITS = 40
BATCH_BYTES = 1 << 23
BATCHES_PER_PART = 2
EVENTS = 1 << 22


def _batches(df: DataFrame, key_type: str) -> DataFrame:
    """Texts (key, text, taught) in batches: their distinct words, how often each is used and was taught, and all tokens as word numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId() << 33, 0
        for part in slices(parts, "text", BATCH_BYTES):
            words, ends = split_words(pc.ascii_lower(part.column("text")))
            coded = words.dictionary_encode()
            names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            if "" not in names:
                names.append("")
            end = names.index("")
            real = at != end
            before = np.concatenate([[0], np.cumsum(real)])[ends]
            lengths = np.diff(before) + 1
            tokens = np.full(int(lengths.sum()), end)
            closing = np.cumsum(lengths) - 1
            inner = np.ones(len(tokens), bool)
            inner[closing] = False
            tokens[inner] = at[real]
            uses = np.bincount(tokens, minlength=len(names))
            order = np.argsort(-uses, kind="stable")
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            tokens = rank[tokens]
            taught = part.column("taught").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(tokens[np.repeat(taught, lengths)], minlength=len(names))
            control, data = pack(tokens)
            columns = [
                pa.array([place + number]),
                pa.array([part.column("key").to_pylist()], pa.list_(part.schema.field("key").type)),
                pa.array([taught], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([control], pa.binary()),
                pa.array([data], pa.binary()),
                pa.array([[names[i] for i in order]], pa.list_(pa.string())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([uses[order]], pa.list_(pa.int64())),
            ]
            names = ["batch", "keys", "taught", "lengths", "control", "data", "words", "counts", "uses"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            number += 1
            # Workers live on between tasks; Arrow would keep the memory of the largest batch in each.
            pa.default_memory_pool().release_unused()

    types = (
        f"batch bigint, keys array<{key_type}>, taught array<boolean>, lengths array<bigint>, control binary, data binary,"
        " words array<string>, counts array<bigint>, uses array<bigint>"
    )
    return df.mapInArrow(run, types)


def _padded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, DEPTH zeros before each, length of each word, start of each word)."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    letters = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + DEPTH * (np.arange(len(words)) + 1)
    out = np.zeros(len(letters) + DEPTH * (len(words) + 1) + 1, np.uint8)
    # A zero byte inside a word would look like its end.
    out[np.arange(len(letters)) + np.repeat(starts - (offsets[:-1] - offsets[0]), lengths)] = np.maximum(letters, 1)
    return out, lengths, starts


def _context_keys(words: pa.Array) -> np.ndarray:
    """Per letter and word end, the DEPTH letters before it in one number."""
    letters, lengths, starts = _padded(words)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), lengths + 1) + np.arange(int((lengths + 1).sum()))
    keys = np.zeros(len(at), np.int64)
    for back in range(DEPTH, 0, -1):
        keys = keys << 8 | letters[at - back]
    return keys


def _contexts(words: DataFrame) -> DataFrame:
    """(context, n) of the letters of all (word) rows; each task sums its own before they are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            every = np.concatenate([keys, *waiting])
            weights = np.concatenate([sums, np.ones(len(every) - len(keys), np.int64)])
            found, at = np.unique(every, return_inverse=True)
            return found, np.bincount(at, weights, minlength=len(found)).astype(np.int64)

        for batch in batches:
            waiting.append(_context_keys(batch.column("word")))
            size += len(waiting[-1])
            if size >= EVENTS:
                keys, sums = merged()
                waiting, size = [], 0
        keys, sums = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["context", "n"])

    return words.mapInArrow(run, "context bigint, n bigint").groupBy("context").agg(F.sum("n").alias("n"))


@dataclass
class Letters:
    """Restaurants of letter contexts: ``parent`` and ``level`` of each, and where each letter leads."""

    parent: np.ndarray
    level: np.ndarray
    follow: np.ndarray
    start: int

    def spell(self, words: pa.Array, logs: np.ndarray) -> np.ndarray:
        """Log probability of each word and its end, by log predictives ``logs`` [context, letter]."""
        letters, lengths, starts = _padded(words)
        total, state = np.zeros(len(lengths)), np.full(len(lengths), self.start)
        order = np.argsort(-lengths, kind="stable")
        starts, alive = starts[order], len(order)
        sizes = lengths[order]
        for step in range(int(lengths.max(initial=-1)) + 1):
            # Words are in falling order of length, so those that go on are a prefix.
            alive = int(np.searchsorted(-sizes[:alive], -step, side="right"))
            letter = np.where(sizes[:alive] > step, letters[starts[:alive] + step], 0)
            here = state[:alive]
            total[:alive] += logs[here, letter]
            state[:alive] = self.follow[here, letter]
        out = np.empty(len(total))
        out[order] = total
        return out

    def serve(self, words: pa.Array, tables: np.ndarray, served: np.ndarray) -> None:
        """Add ``tables`` spellings of each word to the customers ``served`` [context, letter]."""
        letters, lengths, starts = _padded(words)
        order = np.argsort(-lengths, kind="stable")
        starts, sizes, tables = starts[order], lengths[order], tables[order]
        state, alive = np.full(len(order), self.start), len(order)
        for step in range(int(lengths.max(initial=-1)) + 1):
            alive = int(np.searchsorted(-sizes[:alive], -step, side="right"))
            letter = np.where(sizes[:alive] > step, letters[starts[:alive] + step], 0).astype(np.int64)
            cells = state[:alive] * SYMBOLS + letter
            np.add.at(served.reshape(-1), cells, tables[:alive])
            state[:alive] = self.follow[state[:alive], letter]


def open_contexts(contexts: DataFrame, share: float) -> Letters:
    """Restaurants for all contexts of at most DEPTH letters in which ``share`` of all letters stand."""
    total = contexts.agg(F.sum("n")).first()[0] or 0
    known = {(0, 0): 0}
    for level in range(1, DEPTH + 1):
        context = F.col("context").bitwiseAND(F.lit((1 << 8 * level) - 1))
        rows = contexts.groupBy(context.alias("c")).agg(F.sum("n").alias("n")).where(F.col("n") >= share * total)
        for value in sorted(row.c for row in rows.collect()):
            # The start of a word is one letter of context, not several.
            if level == 1 or value >> 8 * (level - 2):
                known[level, value] = len(known)
    parent, levels = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    follow = np.zeros((len(known), SYMBOLS), np.int32)
    for (level, value), at in known.items():
        levels[at] = level
        if level:
            parent[at] = known.get((level - 1, value & ((1 << 8 * (level - 1)) - 1)), 0)
            follow[at] = follow[parent[at]]
        # Longer contexts that continue this one.
        if level < DEPTH:
            for letter in range(SYMBOLS):
                longer = known.get((level + 1, value << 8 | letter))
                if longer is not None and (letter or level == 0):
                    follow[at, letter] = longer
    return Letters(parent, levels, follow, known.get((1, 0), 0))


def _uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and step alone, so that any task can draw them again."""
    x = seeds + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _binomial(n: np.ndarray, p: np.ndarray, seeds: np.ndarray, step: int) -> np.ndarray:
    """Binomial draws: by the distribution function for means below ten, else by the normal curve."""
    mean, u = n * p, _uniform(seeds, 2 * step)
    turn = 2 * math.pi * _uniform(seeds, 2 * step + 1)
    wide = np.rint(mean + np.sqrt(-2 * np.log(u) * mean * (1 - p)) * np.cos(turn))
    out = np.clip(wide, 0, n).astype(np.int64)
    at = np.flatnonzero(mean < 10)
    out[at] = 0
    n, p, u, mass = n[at], p[at], u[at], np.exp(n[at] * np.log1p(-p[at]))
    below, k = mass.copy(), 0
    while len(more := np.flatnonzero((u > below) & (n > k))):
        at, n, p, u, mass, below = at[more], n[more], p[more], u[more], mass[more], below[more]
        mass = mass * (n - k) / (k + 1) * p / (1 - p)
        below = below + mass
        k += 1
        out[at] = k
    return out


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of each dish after its ``customers`` (at least 1) sat down in turn.

    ``weight`` is what a new table weighs: (strength + discount * tables) times
    the base's probability of the dish. Draws depend on a dish's seed alone.
    """
    tables, here = np.ones(len(customers), np.int64), np.arange(len(customers))
    seated = step = 1
    while len(here := here[customers[here] > seated]):
        some = max(1, seated // 16)
        new = weight[here]
        chance = new / (new + seated - discount * tables[here])
        if some > 1:
            coming = np.minimum(some, customers[here] - seated)
            tables[here] += _binomial(coming, chance, seeds[here], step)
        else:
            tables[here] += _uniform(seeds[here], 2 * step) < chance
        seated, step = seated + some, step + 1
    return tables


def predictive(letters: Letters, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Probabilities [context, letter], parents before children."""
    out = np.empty(customers.shape)
    held, opened = customers.sum(axis=1, keepdims=True), tables.sum(axis=1, keepdims=True)
    own = customers - LETTER_DISCOUNT * tables
    back = LETTER_STRENGTH + LETTER_DISCOUNT * opened
    for level in range(DEPTH + 1):
        at = letters.level == level
        base = out[letters.parent[at]] if level else 1 / SYMBOLS
        out[at] = (own[at] + back[at] * base) / (LETTER_STRENGTH + held[at])
    return out


def seat_letters(
    letters: Letters, served: np.ndarray, tables: np.ndarray, chances: np.ndarray, seed: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """(customers, tables) of all contexts after one sweep from the longest to the empty one.

    ``served`` are the customers from spelled words; each table of a context is a
    customer of its parent. Without a ``seed`` every dish has one table.
    """
    customers, seats = served.astype(np.int64), np.zeros(served.shape, np.int64)
    opened = tables.sum(axis=1)
    for level in range(DEPTH, -1, -1):
        for_level = np.flatnonzero(letters.level == level)
        row, letter = np.nonzero(customers[for_level])
        row = for_level[row]
        count = customers[row, letter]
        if seed is None:
            seats[row, letter] = 1
        else:
            base = chances[letters.parent[row], letter] if level else 1 / SYMBOLS
            seeds = (row * SYMBOLS + letter).astype(np.uint64) << np.uint64(20) | np.uint64(seed)
            seats[row, letter] = seat(count, (LETTER_STRENGTH + LETTER_DISCOUNT * opened[row]) * base, LETTER_DISCOUNT, seeds)
        if level:
            np.add.at(customers, (letters.parent[row], letter), seats[row, letter])
    return customers, seats


@dataclass
class Model:
    """Restaurants, the number of taught tokens, and the log predictives and word tables before and after each sweep."""

    letters: Letters
    tokens: int
    discount: float
    logs: list[np.ndarray]
    tables: list[int]
    burn: int
    seed: int
    mass: list[float]
    """Probability the letters give to all taught words together, after each sweep."""

    def seats(self, sweep: int, words: pa.Array, counts: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        """Tables of words with ``counts`` customers in a sweep; the same whenever asked."""
        base = self.letters.spell(words, self.logs[sweep]) if base is None else base
        weight = (WORD_STRENGTH + self.discount * self.tables[sweep]) * np.exp(base)
        seeds = [xxhash.xxh64_intdigest(word, self.seed * 1000 + sweep) for word in utf8(words)]
        return seat(counts, weight, self.discount, np.array(seeds, np.uint64))

    def log10(self, words: pa.Array, counts: np.ndarray, open_words: bool) -> np.ndarray:
        """log10 of the averaged predictive probability of each word."""
        seen = np.flatnonzero(counts > 0)
        taught, samples = words.take(pa.array(seen)), []
        spelled = [self.letters.spell(words, logs) for logs in self.logs]
        for sweep in range(self.burn, len(self.logs) - 1):
            own = np.full(len(words), -np.inf)
            if len(seen):
                own[seen] = np.log(counts[seen] - self.discount * self.seats(sweep, taught, counts[seen], spelled[sweep][seen]))
            base = spelled[sweep + 1]
            if not open_words:
                base = np.where(counts > 0, base, math.log(max(1 - self.mass[sweep + 1], 1e-12)))
            back = math.log(WORD_STRENGTH + self.discount * self.tables[sweep + 1]) + base
            samples.append(np.logaddexp(own, back))
        mean = np.logaddexp.reduce(samples, axis=0) - math.log(len(samples)) - math.log(WORD_STRENGTH + self.tokens)
        return mean / math.log(10)


def fit(words: DataFrame, *, sweeps: int, burn: int, share: float, seed: int) -> Model:
    """Model of (word, n) rows, the taught counts of all words; '' is the end. Rows with n = 0 teach nothing."""
    taught = words.where("n > 0")
    sums = taught.agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
    ).first()
    discount = min(0.95, max(0.05, sums.once / (sums.once + 2 * sums.twice))) if sums.once else 0.5
    letters = open_contexts(stored(_contexts(taught.select("word")), "contexts"), share)
    size = len(letters.level)
    spark = words.sparkSession

    def spelled(model: Model | None) -> np.ndarray:
        """Customers of the letter contexts from the word tables of a sweep; one table per word without a model."""
        sweep = len(model.logs) - 1 if model else 0
        # Tasks get the predictives of this sweep alone.
        current = (replace(model, logs=[]), model.logs[sweep]) if model else None
        shared = spark.sparkContext.broadcast((letters, current))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, current = shared.value
            served = np.zeros((len(own.level), SYMBOLS))
            for batch in batches:
                if batch.num_rows:
                    tables = np.ones(batch.num_rows)
                    if current:
                        base = own.spell(batch.column("word"), current[1])
                        tables = current[0].seats(sweep, batch.column("word"), batch.column("n").to_numpy(), base)
                    own.serve(batch.column("word"), tables, served)
            row, letter = np.nonzero(served)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(letter), pa.array(served[row, letter].astype(np.int64))], names=["context", "letter", "n"]
            )

        out = np.zeros((size, SYMBOLS), np.int64)
        found = taught.select("word", "n").mapInArrow(run, "context bigint, letter bigint, n bigint")
        sums = found.groupBy("context", "letter").agg(F.sum("n").alias("n")).toArrow()
        row, letter, n = (sums.column(name).to_numpy() for name in ("context", "letter", "n"))
        out[row, letter] = n
        shared.destroy()
        return out

    customers, tables = seat_letters(letters, spelled(None), np.zeros((size, SYMBOLS)), np.zeros(0), None)
    chances = predictive(letters, customers, tables)
    model = Model(letters, sums.tokens or 0, discount, [np.log(chances).astype(np.float32)], [sums.kinds], burn, seed, [])
    for sweep in range(sweeps):
        served = spelled(model)
        customers, tables = seat_letters(letters, served, tables, chances, seed * 1000 + sweep)
        chances = predictive(letters, customers, tables)
        model.logs.append(np.log(chances).astype(np.float32))
        model.tables.append(int(served[:, 0].sum()))
    model.mass = _mass(taught, model)
    return model


def _mass(taught: DataFrame, model: Model) -> list[float]:
    """Sum of the spelling probabilities of all taught words, per state of the letters."""
    shared = taught.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        total = np.zeros(len(use.logs))
        for batch in batches:
            total += [np.exp(use.letters.spell(batch.column("word"), logs)).sum() for logs in use.logs]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["sweep", "p"])

    found = taught.select("word").mapInArrow(run, "sweep bigint, p double").groupBy("sweep").agg(F.sum("p").alias("p"))
    held = {row.sweep: row.p for row in found.collect()}
    shared.destroy()
    return [held.get(sweep, 0.0) for sweep in range(len(model.logs))]


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as their low bytes, then their next ones, and so on; high bytes, mostly zero, compress well."""
    wide = np.ascontiguousarray(values, np.uint64)
    kept = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    return wide.view(np.uint8).reshape(-1, 8)[:, :kept].T.tobytes()


def from_planes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(blob) // n] = np.frombuffer(blob, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view(np.uint64).astype(np.int64)


def _hashes(words: pa.Array) -> np.ndarray:
    found = [xxhash.xxh64_intdigest(word, 42) for word in utf8(words)]
    return (np.array(found, np.uint64) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _table(rows: list[dict], types: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    named = [one.strip().split(" ") for one in types.split(",")]
    return pa.table({name: pa.array([row.get(name) for row in rows], kinds[kind]) for name, kind in named})


VOCABULARY = "part bigint, batch bigint, n bigint, at binary, place binary, words array<string>, hash binary, counts binary, uses binary, tables binary"


def _vocabulary(batches: DataFrame, parts: int) -> DataFrame:
    """One row per part with its distinct words and their counts, and one per part and batch with the places of its words."""
    types = "part bigint, batch bigint, place binary, words array<string>, counts binary, uses binary"

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in rows:
            for i in range(rows_.num_rows):
                words = rows_.column("words")[i].values
                counts, uses = (rows_.column(name)[i].values.to_numpy() for name in ("counts", "uses"))
                hashes = _hashes(words)
                own = hashes % parts
                order = np.argsort(own, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    row = {"part": own[at[0]], "batch": rows_.column("batch")[i].as_py(), "place": planes(at), "words": words.take(pa.array(at)).to_pylist()}
                    row |= {"counts": planes(counts[at]), "uses": planes(uses[at])}
                    yield from _table([row], types).to_batches()

    def count(rows: pa.Table) -> pa.Table:
        lists = rows.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        at, size = coded.indices.to_numpy(), len(coded.dictionary)
        lengths = np.diff(lists.offsets.to_numpy())
        sums = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
        for total, name in zip(sums, ("counts", "uses"), strict=True):
            numbers = [from_planes(blob, n) for blob, n in zip(rows.column(name).to_pylist(), lengths.tolist(), strict=True)]
            np.add.at(total, at, np.concatenate(numbers))
        part = rows.column("part")[0].as_py()
        out = [{"part": part, "n": size, "words": coded.dictionary.to_pylist(), "hash": planes(_hashes(coded.dictionary)), "counts": planes(sums[0]), "uses": planes(sums[1])}]
        start = 0
        for batch, place, length in zip(rows.column("batch").to_pylist(), rows.column("place").to_pylist(), lengths, strict=True):
            out.append({"part": part, "batch": batch, "n": length, "at": planes(at[start : start + length]), "place": place})
            start += length
        return _table(out, VOCABULARY)

    asked = batches.select("batch", "words", "counts", "uses").mapInArrow(ask, types)
    return asked.groupBy("part").applyInArrow(count, VOCABULARY)


def _unpacked(vocabulary: DataFrame) -> DataFrame:
    """(word, hash, n, uses, tables) rows of the vocabulary; ``tables`` is null before contexts are seated."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                numbers = {name: from_planes(row[name], row["n"]) if row[name] is not None else None for name in ("hash", "counts", "uses", "tables")}
                columns = [pa.array(row["words"], pa.string())]
                columns += [pa.nulls(row["n"], pa.int64()) if x is None else pa.array(x) for x in numbers.values()]
                yield from pa.table(columns, names=["word", "hash", "n", "uses", "tables"]).to_batches(max_chunksize=1 << 16)

    rows = vocabulary.where("batch IS NULL").select("words", "n", "hash", "counts", "uses", "tables")
    return rows.mapInArrow(run, "word string, hash bigint, n bigint, uses bigint, tables bigint")


def _pairs(tokens: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, token) of each token, as one number ``context << 32 | token``."""
    before = np.concatenate([[end], tokens[:-1]]) if len(tokens) else tokens
    before[(np.cumsum(lengths) - lengths)] = end
    return before << 32 | tokens


PAIRS = (
    "part bigint, batch bigint, contexts bigint, place binary, context binary, sizes binary, pairs bigint, token binary, counts binary,"
    " split binary, at binary, seen binary, tables binary, met binary, opened binary"
)


def _ask_pairs(batches: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Distinct pairs of each batch, by part: contexts by place and hash, and per context its tokens by hash, with taught counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in rows:
            for row in (rows_.slice(i, 1) for i in range(rows_.num_rows)):
                words, lengths = row.column("words")[0].values, row.column("lengths")[0].values.to_numpy()
                taught = np.repeat(row.column("taught")[0].values.to_numpy(zero_copy_only=False), lengths)
                tokens = unpack(row.column("control")[0].as_py(), row.column("data")[0].as_py(), int(lengths.sum())).astype(np.int64)
                pairs, inverse = np.unique(_pairs(tokens, lengths, words.index("").as_py()), return_inverse=True)
                counts = np.bincount(inverse[taught], minlength=len(pairs))
                hashes = _hashes(words)
                context, token = pairs >> 32, pairs & 0xFFFFFFFF
                split = np.isin(hashes, hot)
                own = _part(hashes[context], hashes[token], split[context], parts)
                order = np.argsort(own, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    here, sizes = np.unique(context[at], return_counts=True)
                    one = {"part": own[at[0]], "batch": row.column("batch")[0].as_py(), "contexts": len(here), "pairs": len(at), "place": planes(here)}
                    one |= {"context": planes(hashes[here]), "sizes": planes(sizes), "token": planes(hashes[token[at]]), "counts": planes(counts[at])}
                    one |= {"split": planes(split[here]), "at": planes(at[split[context[at]]])}
                    yield from _table([one], PAIRS).to_batches()

    columns = ["batch", "taught", "lengths", "control", "data", "words"]
    return batches.select(*columns).mapInArrow(run, PAIRS)


def _part(context: np.ndarray, token: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    mixed = (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + token.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24)
    return np.where(hot, (mixed % np.uint64(parts)).astype(np.int64), context % parts)


def seat_contexts(
    context: np.ndarray, token: np.ndarray, counts: np.ndarray, scale: np.ndarray, sweeps: int, burn: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """(tables after the last sweep, sums of tables over the sweeps after ``burn``) of dishes (context, token).

    ``scale`` says how many times the tables held here the dish's context has in all.
    A dish of one customer always has one table.
    """
    tables, sums = (counts > 0).astype(np.int64), np.zeros(len(counts), np.int64)
    own = np.unique(context, return_inverse=True)[1]
    word = np.unique(token, return_inverse=True)[1]
    many = np.flatnonzero(counts > 1)
    seeds = context.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ token.astype(np.uint64)
    for sweep in range(sweeps):
        opened = np.bincount(own, tables)[own[many]] * scale[many]
        base = np.bincount(word, tables)[word[many]] / max(1, tables.sum())
        weight = (CONTEXT_STRENGTH + CONTEXT_DISCOUNT * opened) * base
        step = np.uint64(((seed * 1000 + sweep) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF)
        tables[many] = seat(counts[many], weight, CONTEXT_DISCOUNT, seeds[many] + step)
        if sweep >= burn:
            sums += tables
    return tables, sums


def _seat_pairs(asked: DataFrame, parts: int, hot: np.ndarray, sweeps: int, burn: int, seed: int) -> DataFrame:
    """Rows with the answers to each batch, tables by word part (batch -1), and sums of contexts that are split (batch -2)."""

    def run(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        contexts = [from_planes(row["context"], row["contexts"]) for row in held]
        sizes = [from_planes(row["sizes"], row["contexts"]) for row in held]
        context = np.concatenate([np.repeat(c, n) for c, n in zip(contexts, sizes, strict=True)])
        token = np.concatenate([from_planes(row["token"], row["pairs"]) for row in held])
        taught = np.concatenate([from_planes(row["counts"], row["pairs"]) for row in held])
        both = context.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
        counts = np.zeros(len(first), np.int64)
        np.add.at(counts, inverse, taught)
        context, token = context[first], token[first]
        split = np.isin(context, hot)
        tables, sums = seat_contexts(context, token, counts, np.where(split, parts, 1), sweeps, burn, seed)
        names, own = np.unique(context, return_inverse=True)
        met, opened = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        np.add.at(met, own, counts)
        np.add.at(opened, own, sums)
        part, out, start = held[0]["part"], [], 0
        for row, some in zip(held, contexts, strict=True):
            at = inverse[start : start + row["pairs"]]
            start += row["pairs"]
            here = np.searchsorted(names, some)
            kept = {name: row[name] for name in ("part", "batch", "contexts", "place", "sizes", "pairs", "split", "at")}
            out.append(kept | {"seen": planes(counts[at]), "tables": planes(sums[at]), "met": planes(met[here]), "opened": planes(opened[here])})
            out[-1]["context"] = planes(some[np.isin(some, hot)])
        some = np.flatnonzero(tables)
        words, at = np.unique(token[some], return_inverse=True)
        customers = np.zeros(len(words), np.int64)
        np.add.at(customers, at, tables[some])
        order = np.argsort(words % parts, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(words[order] % parts)) + 1) if len(order) else []:
            out.append({"part": words[at[0]] % parts, "batch": -1, "pairs": len(at), "token": planes(words[at]), "counts": planes(customers[at])})
        at = np.flatnonzero(np.isin(names, hot))
        if len(at):
            out.append({"part": part, "batch": -2, "contexts": len(at), "context": planes(names[at]), "met": planes(met[at]), "opened": planes(opened[at])})
        return _table(out, PAIRS)

    return asked.groupBy("part").applyInArrow(run, PAIRS)


def _seated(vocabulary: DataFrame, seats: DataFrame) -> DataFrame:
    """The vocabulary's word rows with the tables all contexts have of each word."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        hashes = from_planes(row["hash"], row["n"])
        names, own = np.unique(hashes, return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        for some in right.to_pylist():
            at = np.searchsorted(names, from_planes(some["token"], some["pairs"]))
            np.add.at(sums, at, from_planes(some["counts"], some["pairs"]))
        # Words of equal hash, if any, share what was counted for it; a taught word has a table at least.
        shares = sums[own] // np.bincount(own)[own]
        taught = from_planes(row["counts"], row["n"]) > 0
        return _table([row | {"tables": planes(np.where(taught, np.maximum(shares, 1), 0))}], VOCABULARY)

    tables = seats.where("batch = -1").select("part", "pairs", "token", "counts")
    return vocabulary.where("batch IS NULL").groupBy("part").cogroup(tables.groupBy("part")).applyInArrow(run, VOCABULARY)


WORDS = "batch bigint, n bigint, place binary, counts binary, logs binary"


def _answers(vocabulary: DataFrame, seated: DataFrame, model: Model, open_words: bool) -> DataFrame:
    """Per part and batch, the taught counts of its words and their log10 probabilities in the word restaurant."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(model)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, out = left.to_pylist()[0], []
        counts, tables = (from_planes(row[name], row["n"]) for name in ("counts", "tables"))
        words, logs = pa.array(row["words"], pa.string()), np.zeros(row["n"])
        for start in range(0, row["n"], 1 << 16):
            some = slice(start, start + (1 << 16))
            logs[some] = shared.value.log10(words[some], tables[some], open_words)
        for one in right.to_pylist():
            at = from_planes(one["at"], one["n"])
            out.append({"batch": one["batch"], "n": one["n"], "place": one["place"], "counts": planes(counts[at]), "logs": logs[at].astype(np.float32).tobytes()})
        return _table(out, WORDS)

    places = vocabulary.where("batch IS NOT NULL").select("part", "batch", "n", "at", "place")
    return seated.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(run, WORDS)


def context_chance(
    seen: np.ndarray, tables: np.ndarray, met: np.ndarray, opened: np.ndarray, base: np.ndarray
) -> np.ndarray:
    """Probability of tokens in their contexts, by customers and mean tables of the dish and of its context."""
    back = CONTEXT_STRENGTH + CONTEXT_DISCOUNT * opened
    return (seen - CONTEXT_DISCOUNT * tables + back * base) / (CONTEXT_STRENGTH + met)


def score(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    taught: str = "taught",
    sweeps: int = 4,
    burn: int = 1,
    share: float = SHARE,
    seed: int = 5,
    open_words: bool = False,
) -> DataFrame:
    """(key, taught, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    The model learns from the rows whose ``taught`` is true. Words are lower-cased
    in A-Z; a null or empty text is its end alone. ``base_score`` is the log10
    probability under counts raised by one, ``score`` under the model. ``burn`` is below ``sweeps``. Nothing to
    learn from leaves uniform letters. Repeated rows and null keys are kept.
    """
    rows = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(taught), F.lit(False)).alias("taught"),
    )
    kind = df.schema[key].dataType.simpleString()
    spark = df.sparkSession
    with bounded_batches(spark, BATCH_BYTES):
        batches = stored(_batches(rows, kind), "batches")
        parts = max(1, -(-batches.count() // BATCHES_PER_PART))
        vocabulary = stored(_vocabulary(batches, parts), "vocabulary")
    words = _unpacked(vocabulary)
    taught_words = words.where("n > 0")
    tokens, kinds = taught_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # At most as many words as parts can have one part's share of all tokens.
    uses = words.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    hot = np.array([row.hash for row in words.where(F.col("uses") * F.lit(parts) >= F.lit(uses)).select("hash").distinct().collect()], np.int64)
    with bounded_batches(spark, BATCH_BYTES):
        seats = stored(_seat_pairs(_ask_pairs(batches, parts, hot), parts, hot, sweeps, burn, seed), "seats")
    seated = stored(_seated(vocabulary, seats), "seated")
    model = fit(_unpacked(seated).select("word", F.col("tables").alias("n")), sweeps=sweeps, burn=burn, share=share, seed=seed)
    split: dict[int, tuple[int, int]] = {}
    for row in seats.where("batch = -2").select("contexts", "context", "met", "opened").collect():
        for name, *sums in zip(*(from_planes(row[i], row.contexts).tolist() for i in (1, 2, 3)), strict=True):
            split[name] = tuple(a + b for a, b in zip(split.get(name, (0, 0)), sums, strict=True))
    names = np.array(sorted(split), np.int64)
    totals = np.array([split[name] for name in names.tolist()], np.int64).reshape(-1, 2)
    samples = sweeps - burn

    def run(table: pa.Table) -> pa.Table:
        text = table.filter(pc.is_valid(table.column("keys"))).combine_chunks()
        keys, is_taught, lengths = (text.column(name).chunk(0).flatten() for name in ("keys", "taught", "lengths"))
        lengths, own = lengths.to_numpy(), text.select(["control", "data", "size", "end"]).to_pylist()[0]
        held = table.drop_columns(["keys", "taught", "lengths", "control", "data"]).to_pylist()
        at = unpack(own["control"], own["data"], int(lengths.sum())).astype(np.int64)
        size = own["size"]
        count, log = np.zeros(size, np.int64), np.zeros(size)
        pairs, inverse = np.unique(_pairs(at, lengths, own["end"]), return_inverse=True)
        chance = np.zeros(len(pairs))
        for row in held:
            if row["logs"] is not None:
                place = from_planes(row["place"], row["n"])
                count[place], log[place] = from_planes(row["counts"], row["n"]), np.frombuffer(row["logs"], np.float32)
        unit = np.power(10.0, log)
        context = pairs >> 32
        for row in (row for row in held if row["seen"] is not None):
            n, contexts = row["pairs"], row["contexts"]
            place, sizes, met, opened, split = (from_planes(row[name], contexts) for name in ("place", "sizes", "met", "opened", "split"))
            # A context of one part has all its pairs there, in order; pairs of split ones come with their place.
            index = np.repeat(np.searchsorted(context, place) - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)
            split = split > 0
            apart = np.repeat(split, sizes)
            index[apart] = from_planes(row["at"], int(apart.sum()))
            met[split], opened[split] = totals[np.searchsorted(names, from_planes(row["context"], int(split.sum())))].T
            seen, tables = from_planes(row["seen"], n), from_planes(row["tables"], n)
            base = unit[pairs[index] & 0xFFFFFFFF]
            chance[index] = context_chance(seen, tables / samples, np.repeat(met, sizes), np.repeat(opened, sizes) / samples, base)
        base_log = np.log10((count + 1) / (tokens + kinds + 1))
        first = np.cumsum(lengths) - lengths
        values = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64)[at], base_log[at], np.log10(chance)[inverse])]
        return pa.table({"key": keys, "taught": is_taught, "n_tokens": lengths, "n_known": values[0], "base_score": values[1], "score": values[2]})

    types = f"key {kind}, taught boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    texts = batches.select(
        "batch", "keys", "taught", "lengths", "control", "data", F.size("words").alias("size"), (F.array_position("words", "") - 1).alias("end")
    )
    asked = seats.where("batch >= 0").select(
        "batch", "contexts", "place", "context", "sizes", "pairs", "split", "at", "seen", "tables", "met", "opened"
    )
    answers = _answers(vocabulary, seated, model, open_words)
    every = texts.unionByName(asked, True).unionByName(answers, True)
    with bounded_batches(spark, BATCH_BYTES):
        found = stored(every.groupBy("batch").applyInArrow(run, types), "scores")
    return found.select(
        F.col("key").alias(key),
        "taught",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
