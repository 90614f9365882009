"""Collocations: phrases of two to four words that occur far more often together than apart.

A-Z are lower-cased. A text is cut into pieces at ``. , ; : ! ?`` and line ends, a piece into
words at blanks and tabs. Phrases lie within a piece; all their occurrences count, overlapping
ones too. Everything is counted per language; a null language is ``und``, a null text
empty. Repeated rows count like others. Further columns are ignored, and empty tables have no phrases.

Counting has two parts.

1. Candidates. A phrase can only occur ``least`` times if its shorter parts do. Words are
   counted first; then pairs of words that are frequent; then phrases of three and four words
   all of whose pairs are. Sightings are summed per batch of texts, in Spark's partial
   aggregation, and by phrase. The frequent words, and then pairs, that the next pass asks for
   are one Bloom filter of fixed size: a false hit only means a sighting more.
2. Counts. Words and candidates are dealt by a hash of their first two words into shards of about
   ``shard_phrases``, and a task makes a double-array trie of each: the symbols are numbers of words, below
   one root per language. The texts are read once and their positions dealt alike: a position goes to
   the shard of its word, and, if the next word makes a pair in the filter, as a window of up to four
   words to the shard of the pair. A slice's windows for a shard are one packet of numbers into the words
   it brings along. Where a trie meets its packets, numpy moves the states of all positions of a packet
   at once, one word further a level; positions whose state has no such word go out. States are counted
   by bincount, and the counts of accepting ones added up over tasks.

So every position meets one trie, or two, however many there are, and a task holds one trie at a time. Windows are shuffled
and their files removed once they are counted. A reading of the texts deals to ``shards_per_pass`` shards at most. The filter
does not grow either; when it is full it lets more sightings and windows through, which are summed like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.shared import bounded_batches, slices, small_batches
from tradeloom.plans.joins import top_per_key
from tradeloom.plans.workspace import stored

LONGEST = 4
SLICE_BYTES = 1 << 21  # of text worked on at once; a word of it takes about a hundred bytes meanwhile
PACKET_BYTES = 1 << 24  # of tries and packets a task is handed at once
HELD_WORDS, HELD_WINDOWS = 1 << 18, 1 << 19  # of packets worked on together, as the words of a trie are looked up anew
SIGHTED = "lang string, words int, phrase string, n bigint"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x20]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words:
    """The words of a batch: numbers into a dictionary, and the piece and language of each."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        texts = batch.column("text").cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        raw = _LOWER[raw]
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        owner = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = (np.cumsum(kind == 2)[starts] + owner).astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw[inside]))
        encoded = spelled.dictionary_encode()
        self.dictionary = encoded.dictionary
        self.ids = encoded.indices.to_numpy(zero_copy_only=False)
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[owner]

    def hashes(self) -> np.ndarray:
        """One hash per dictionary word."""
        return _word_hashes(self.dictionary)

    def sighted(self, at: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
        """SIGHTED of the phrases of ``words`` words at the given positions."""
        codes = self.lang[at].astype(np.int64)
        size = max(len(self.dictionary), 1)
        room = 1 << 62
        keys, wide = codes, len(self.langs)
        for k in range(words):
            if wide > room // size:  # too wide for one number: rank what there is so far
                _, keys = np.unique(keys, return_inverse=True)
                wide = len(at) + 1
            keys, wide = keys * size + self.ids[at + k], wide * size
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        first = at[first]
        for cut in range(0, len(first), 1 << 18):
            some = first[cut : cut + (1 << 18)]
            parts = [self.dictionary.take(pa.array(self.ids[some + k])) for k in range(words)]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": self.langs.take(pa.array(self.lang[some])).cast(pa.string()),
                    "words": pa.array(np.full(len(some), words, np.int32)),
                    "phrase": pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string()),
                    "n": pa.array(counts[cut : cut + (1 << 18)], pa.int64()),
                }
            )

    def joined(self) -> np.ndarray:
        """Whether each word and the next are in one piece."""
        return self.piece[1:] == self.piece[:-1]


def _phrase_hash(langs: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    mixed = langs.copy()
    for part in parts:
        mixed = (mixed ^ part) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed * _TURN


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bits of the filter per hash."""
    mask = np.uint64((1 << bits) - 1)
    return [(hashes >> np.uint64(7)) & mask, (hashes >> np.uint64(64 - bits)) & mask]


def _holds(filter_bits: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    first, second = _places(hashes, bits)
    has = lambda place: (filter_bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
    return (has(first) & has(second)).astype(bool)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash per word, none of them empty: a polynomial of its bytes, mixed."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(sizes.max(), _MIX))
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    mixed = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[place], starts) ^ sizes.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _TURN
    return mixed ^ (mixed >> np.uint64(29))


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang) for lang in langs.to_pylist()], np.uint64)


def _filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of phrases, of 2 ** ``bits`` bits whatever their number."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spelled = pc.split_pattern(batch.column("phrase"), " ")
            count = len(spelled[0])
            words = spelled.flatten().dictionary_encode()
            known = _word_hashes(words.dictionary)
            parts = known[words.indices.to_numpy(zero_copy_only=False)].reshape(-1, count)
            found = np.concatenate(
                _places(_phrase_hash(_lang_hashes(batch.column("lang")), [parts[:, k] for k in range(count)]), bits)
            ).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(found >> 6), "bit": pa.array(1 << (found & 63))})

    rows = frequent.mapInArrow(places, "cell bigint, bit bigint").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _sightings(texts: DataFrame, words: list[int], known: np.ndarray | None, bits: int) -> DataFrame:
    """SIGHTED, summed: phrases of so many words whose words (of two) or pairs (of more) are all in the filter."""
    shared = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def sight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = _Words(batch)
            if not len(found.ids):
                continue
            if shared is None:
                yield from found.sighted(np.arange(len(found.ids)), 1)
                continue
            word, lang = found.hashes()[found.ids], _lang_hashes(found.langs)[found.lang]
            pair = found.joined()
            if words == [2]:
                ok = _holds(shared.value, _phrase_hash(lang, [word]), bits)
                pair &= ok[:-1] & ok[1:]
            else:
                pair &= _holds(shared.value, _phrase_hash(lang[:-1], [word[:-1], word[1:]]), bits)
            for count in words:
                at = np.ones(max(len(found.ids) - count + 1, 0), bool)
                for k in range(count - 1):
                    at &= pair[k : k + len(at)]
                yield from found.sighted(np.flatnonzero(at), count)
            del found, word, lang, pair
            pa.default_memory_pool().release_unused()

    rows = texts.mapInArrow(sight, SIGHTED)
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


class Trie:
    """Double-array trie: the state after symbol c in state s is base[s] + c, if its check is s.

    ``accept`` has the accepting state of every row the trie was built from.
    """

    def __init__(self, base: np.ndarray, check: np.ndarray, accept: np.ndarray) -> None:
        self.base, self.check, self.accept = base, check, accept

    @staticmethod
    def build(symbols: np.ndarray, sizes: np.ndarray, seed: int = 0) -> Trie:
        """From different rows of symbols (from 1 on, the first ``sizes`` of each row)."""
        wide = int(symbols.max(initial=0)) + 1
        node = np.zeros(len(symbols), np.int64)
        parents, codes, count = [], [], 1
        for level in range(symbols.shape[1]):
            rows = np.flatnonzero(sizes > level)
            edges, place = np.unique(node[rows] * wide + symbols[rows, level], return_inverse=True)
            node[rows] = count + place
            parents.append(edges // wide)
            codes.append(edges % wide)
            count += len(edges)
        parent, code = np.concatenate(parents), np.concatenate(codes)
        order = np.argsort(parent, kind="stable")
        parent, code, child = parent[order], code[order], order + 1
        inner, first, fan = np.unique(parent, return_index=True, return_counts=True)
        start = Trie._placed(inner, first, fan, code, wide, np.random.default_rng(seed))
        slot = np.zeros(count, np.int64)
        slot[child] = np.repeat(start, fan) + code
        size = int(max(slot.max(), start.max())) + wide
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        base[slot[inner]] = start
        check[slot[child]] = slot[parent]
        return Trie(base, check, slot[node].astype(np.int32))

    @staticmethod
    def _placed(inner, first, fan, code, wide, rng) -> np.ndarray:
        """A base per inner node, so that no two children share a slot.

        Nodes with many children go first. All nodes of about the same size try random bases together,
        and get a quarter more room whenever some have found no place for long.
        """
        room = 3 * len(code) // 2 + 64
        taken, owner = np.zeros(room + wide, bool), np.zeros(room + wide, np.int64)
        taken[0] = True
        start = np.full(len(inner), -1, np.int64)
        scale = np.log2(fan).astype(np.int64) // 2
        for size in np.unique(scale)[::-1]:
            waiting = np.flatnonzero(scale == size)
            tries = 0
            while len(waiting):
                tries += 1
                if tries % 30 == 0:
                    more = room // 4
                    taken, owner = np.concatenate([taken, np.zeros(more, bool)]), np.concatenate([owner, np.zeros(more, np.int64)])
                    room += more
                tried = rng.integers(0, room, len(waiting))
                count = fan[waiting]
                which = np.repeat(np.arange(len(waiting)), count)
                edge = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[waiting], count)
                slots = tried[which] + code[edge]
                owner[slots] = which
                bad = taken[slots] | (owner[slots] != which)
                good = np.bincount(which, bad, minlength=len(waiting)) == 0
                start[waiting[good]] = tried[good]
                taken[slots[good[which]]] = True
                waiting = waiting[~good]
        return start

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places that have a next state, those states)."""
        moved = self.base[states] + symbols
        places = np.flatnonzero(self.check[moved] == states)
        return places, moved[places]


_SHARD = "shard int, phrases array<struct<lang:string,words:int,phrase:string>>, spelled array<string>, langs array<string>, base binary, check binary, accept binary"


def _dealt(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)


def _shards(phrases: DataFrame, shards: int) -> DataFrame:
    """Stored tries: the phrases in order of their accepting values, the words and languages of the symbols, and the arrays."""
    # Phrases that begin with the same two words share a shard, and their states.
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern(batch.column("phrase"), " ")
            first = pc.list_element(lists, 0).dictionary_encode()
            long = batch.column("words").to_numpy() > 1
            second = pc.list_element(lists.filter(pa.array(long)), 1).dictionary_encode()
            langs = batch.column("lang").dictionary_encode()
            lang = _lang_hashes(langs.dictionary)[langs.indices.to_numpy(zero_copy_only=False)]
            own = _word_hashes(first.dictionary)[first.indices.to_numpy(zero_copy_only=False)]
            hashes = _phrase_hash(lang, [own])
            if long.any():
                after = _word_hashes(second.dictionary)[second.indices.to_numpy(zero_copy_only=False)]
                hashes[long] = _phrase_hash(lang[long], [own[long], after])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_dealt(hashes, shards))], names=[*batch.schema.names, "shard"])

    dealt = phrases.select("lang", "words", "phrase").mapInArrow(deal, "lang string, words int, phrase string, shard int")

    def build(table: pa.Table) -> pa.Table:
        # The words of a language get numbers close to each other.
        table = table.sort_by([("lang", "ascending"), ("words", "ascending")])
        lists = pc.split_pattern(table["phrase"], " ").combine_chunks()
        langs = table["lang"].combine_chunks().dictionary_encode()
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        spelled = lists.flatten().dictionary_encode()
        symbols = np.zeros((table.num_rows, LONGEST + 1), np.int64)
        symbols[:, 0] = 1 + langs.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(table.num_rows), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols[row, place + 1] = 1 + len(langs.dictionary) + spelled.indices.to_numpy(zero_copy_only=False)
        shard = table["shard"][0].as_py()
        trie = Trie.build(symbols, sizes + 1, shard)
        rows = table.select(["lang", "words", "phrase"]).combine_chunks().to_struct_array()
        rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(
            {
                "shard": pa.array([shard], pa.int32()),
                "phrases": whole(rows),
                "spelled": whole(spelled.dictionary),
                "langs": whole(langs.dictionary),
                **{name: pa.array([getattr(trie, name).tobytes()]) for name in ("base", "check", "accept")},
            }
        )

    return stored(dealt.groupBy("shard").applyInArrow(build, _SHARD), "tries")


_MET = "shard int, part int, kind int, langs array<string>, words array<string>, a binary, b binary, c binary"


def _windows(texts: DataFrame, known: tuple[np.ndarray, np.ndarray], bits: int, shards: int, first: int, last: int, parts: int) -> DataFrame:
    """_MET: the positions of a slice that look at a shard, for the shards from ``first`` to before ``last``.

    ``a`` has, one after the other, the language and four words of every window, -1 for none, and ``b`` how often it is there.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        turn = TaskContext.get().partitionId()
        for batch in slices(batches, "text", SLICE_BYTES):
            turn += 1
            found = _Words(batch)
            if not len(found.ids):
                continue
            word, lang = found.hashes()[found.ids], _lang_hashes(found.langs)[found.lang]
            # Words alone, each once with its number.
            own = _phrase_hash(lang, [word])
            at = np.flatnonzero(_holds(words, own, bits))
            _, place, counts = np.unique(found.lang[at] * np.int64(len(found.dictionary)) + found.ids[at], return_index=True, return_counts=True)
            at = at[place]
            alone = np.full((5, len(at)), -1, np.int32)
            alone[0], alone[1] = found.lang[at], found.ids[at]
            # Windows of as many words as follow each other in pairs.
            both = _phrase_hash(lang[:-1], [word[:-1], word[1:]])
            pair = np.zeros(len(found.ids) + 2, bool)
            pair[: len(both)] = found.joined() & _holds(pairs, both, bits)
            begin = np.flatnonzero(pair)
            runs = np.full((5, len(begin)), -1, np.int32)
            runs[0], runs[1], runs[2] = found.lang[begin], found.ids[begin], found.ids[begin + 1]
            third = np.flatnonzero(pair[begin + 1])
            runs[3, third] = found.ids[begin[third] + 2]
            fourth = third[pair[begin[third] + 2]]
            runs[4, fourth] = found.ids[begin[fourth] + 3]
            windows = np.concatenate([alone, runs], axis=1)
            counts = np.concatenate([counts, np.ones(len(begin), np.int64)]).astype(np.int32)
            shard = _dealt(np.concatenate([own[at], both[begin]]), shards)
            del word, lang, own, both, alone, runs
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(first, last + 1))
            rows = []
            for number, start, end in zip(range(first, last), bounds[:-1], bounds[1:], strict=True):
                if start == end:
                    continue
                some = windows[:, order[start:end]]
                met = np.zeros(len(found.dictionary) + 1, bool)
                met[some[1:]] = True
                met[-1] = False
                renamed = np.where(met, np.cumsum(met, dtype=np.int32) - 1, -1).astype(np.int32)
                some[1:] = renamed[some[1:]]
                spelled = found.dictionary.take(pa.array(np.flatnonzero(met)))
                rows.append((number, spelled, some.tobytes(), counts[order[start:end]].tobytes()))
            if not rows:
                continue
            many = len(rows)
            langs = found.langs.cast(pa.string())
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([row[0] for row in rows], pa.int32()),
                    "part": pa.array([turn % parts] * many, pa.int32()),
                    "kind": pa.array([1] * many, pa.int32()),
                    "langs": pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * len(langs), pa.int32()), pa.concat_arrays([langs] * many)),
                    "words": pa.ListArray.from_arrays(
                        pa.array(np.cumsum([0, *[len(row[1]) for row in rows]]), pa.int32()),
                        pa.concat_arrays([row[1].cast(pa.string()) for row in rows]),
                    ),
                    "a": pa.array([row[2] for row in rows], pa.binary()),
                    "b": pa.array([row[3] for row in rows], pa.binary()),
                    "c": pa.nulls(many, pa.binary()),
                }
            )
            del found, windows, rows
            pa.default_memory_pool().release_unused()

    return texts.mapInArrow(deal, _MET)


class _Sums:
    """A trie and how often its states are reached by the packets that follow it, worked on together."""

    def __init__(self, cell: dict[str, pa.Scalar]) -> None:
        self.own = cell["shard"].as_py(), cell["part"].as_py()
        self.langs, self.spelled = cell["langs"].values, cell["words"].values
        self.trie = Trie(*(np.frombuffer(cell[name].as_buffer(), np.int32).copy() for name in ("a", "b", "c")))
        self.sums = np.zeros(len(self.trie.base), np.int64)
        self.held, self.words, self.windows = [], 0, 0

    def take(self, cell: dict[str, pa.Scalar]) -> None:
        windows = np.frombuffer(cell["a"].as_buffer(), np.int32).reshape(5, -1)
        self.held.append((cell["langs"].values, cell["words"].values, windows, np.frombuffer(cell["b"].as_buffer(), np.int32)))
        self.words += len(self.held[-1][1])
        self.windows += windows.shape[1]
        if self.words >= HELD_WORDS or self.windows >= HELD_WINDOWS:
            self.visit()

    def visit(self) -> None:
        """Moves the states of all windows held, level by level."""
        if not self.held:
            return
        trie, (langs, words, windows, counts) = self.trie, zip(*self.held, strict=True)
        number = lambda values, among: pc.index_in(pa.concat_arrays(values), value_set=among).fill_null(-1).to_numpy(
            zero_copy_only=False
        )
        # The last place is for windows without a further word.
        known = np.append(number(words, self.spelled).astype(np.int64), -1)
        symbols = np.where(known < 0, 0, known + 1 + len(self.langs))
        said = number(langs, self.langs).astype(np.int64) + 1
        before_words, before_langs = (np.cumsum([0, *[len(x) for x in lists[:-1]]]) for lists in (words, langs))
        moved = [np.where(w[1:] < 0, len(symbols) - 1, w[1:] + at) for w, at in zip(windows, before_words, strict=True)]
        lang = np.concatenate([said[w[0] + at] for w, at in zip(windows, before_langs, strict=True)])
        moved, counts = symbols[np.concatenate(moved, axis=1)], np.concatenate(counts)
        single = np.concatenate([w[2] < 0 for w in windows])
        at = np.flatnonzero(lang > 0)
        places, states = trie.step(np.zeros(len(at), np.int32), lang[at])
        at = at[places]
        for level in range(LONGEST):
            symbol = moved[level, at]
            on = symbol > 0
            at = at[on]
            places, states = trie.step(states[on], symbol[on])
            at = at[places]
            # Words are counted by windows of one word: a longer one begins with its pair.
            new = slice(None) if level else single[at]
            self.sums += np.bincount(states[new], counts[at[new]], minlength=len(self.sums)).astype(np.int64)
        self.held, self.words, self.windows = [], 0, 0

    def told(self) -> Iterator[pa.RecordBatch]:
        """(shard, row, n) of the accepting states."""
        self.visit()
        counts = self.sums[self.trie.accept]
        at = np.flatnonzero(counts)
        for cut in range(0, len(at), 1 << 18):
            some = at[cut : cut + (1 << 18)]
            shard = pa.array(np.full(len(some), self.own[0], np.int32))
            yield pa.RecordBatch.from_pydict({"shard": shard, "row": pa.array(some, pa.int32()), "n": pa.array(counts[some])})


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, row, n) of tries and the packets that follow each."""
    now = None
    for batch in batches:
        for row in range(batch.num_rows):
            cell = {name: batch.column(name)[row] for name in batch.schema.names}
            if cell["kind"].as_py() == 0:
                if now:
                    yield from now.told()
                now = _Sums(cell)
            elif now and now.own == (cell["shard"].as_py(), cell["part"].as_py()):
                now.take(cell)
    if now:
        yield from now.told()


def _counted(texts: DataFrame, tries: DataFrame, shards: int, per_pass: int, known: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of the tries, counted in the texts."""
    spark, counts = texts.sparkSession, []
    for first in range(0, shards, per_pass):
        last = min(first + per_pass, shards)
        # A shard's packets are dealt to several tasks, each with the trie.
        parts = max(4, -(-2 * spark.sparkContext.defaultParallelism // (last - first)))
        built = tries.where(F.col("shard").between(first, last - 1)).select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"),
            "langs", F.col("spelled").alias("words"), F.col("base").alias("a"), F.col("check").alias("b"), F.col("accept").alias("c"),
        )
        met = built.unionByName(_windows(texts, known, bits, shards, first, last, parts))
        placed = met.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
        sums = placed.mapInArrow(_met, "shard int, row int, n bigint").groupBy("shard", "row").agg(F.sum("n").alias("f"))
        with bounded_batches(spark, PACKET_BYTES):
            counts.append(stored(sums, "counts"))
    spelled = tries.select("shard", F.posexplode("phrases").alias("row", "phrase")).select("shard", "row", "phrase.*")
    return spelled.join(reduce(DataFrame.unionByName, counts), ["shard", "row"]).drop("shard", "row")


def counted(
    df: DataFrame,
    least: int = 30,
    filter_bits: int = 26,
    shard_phrases: int = 100_000,
    shards_per_pass: int = 1_024,
) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of phrases of one to four words with f >= ``least``, (lang, n) of all words).

    ``phrase`` is its words joined by blanks.
    """
    texts = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    with small_batches(df.sparkSession, 1000):
        words = stored(_sightings(texts, [1], None, filter_bits), "words")
        frequent = words.where(F.col("n") >= least)
        known_words = _filter(frequent, filter_bits)
        pairs = _sightings(texts, [2], known_words, filter_bits)
        pairs = stored(pairs.where(F.col("n") >= least), "pairs")
        known_pairs = _filter(pairs, filter_bits)
        longer = _sightings(texts, [3, 4], known_pairs, filter_bits)
        longer = stored(longer.where(F.col("n") >= least), "longer")
        candidates = frequent.unionByName(pairs).unionByName(longer)
        shards = max(1, -(-candidates.count() // shard_phrases))
        # A shard is one group, whatever the size of its batches.
        found = _counted(texts, _shards(candidates, shards), shards, shards_per_pass, (known_words, known_pairs), filter_bits)
        found = stored(found.where(F.col("f") >= least), "phrases")
    return found, words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(df: DataFrame, least: int = 30, top: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to four words.

    a is the phrase's count, n that of all words. Cut after its first k words, a phrase has the
    counts l and r of its parts and the score floor(2000000 * a / (l + r)); the lowest
    score counts, of equal ones that of the smallest k. A phrase inside a longer one of at least
    ``least`` occurrences, with four fifths of its own count or more, is dropped. Order: score and a
    descending, phrase in byte order. Scores are computed in decimals of 38 digits.
    """
    phrases, totals = counted(df, least, **options)
    split = phrases.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = split.select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
        F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    valued = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = "(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(20,0)) + r)"
    worst = (
        valued.withColumn("score", F.expr(score))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    spans = [(size, at) for size in range(2, LONGEST) for at in range(LONGEST - size + 1)]
    inner = split.where("words > 2").select(
        "lang",
        "f",
        F.explode(
            F.array_distinct(
                F.array_compact(
                    F.array(
                        *[
                            F.when(
                                (F.col("words") > size) & (F.col("words") >= size + at),
                                F.array_join(F.slice("parts", at + 1, size), " "),
                            )
                            for size, at in spans
                        ]
                    )
                )
            )
        ).alias("phrase"),
    )
    covering = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = worst.join(covering, ["lang", "phrase"], "left").where("longer IS NULL OR longer * 5 < a * 4").drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = top_per_key(kept, ["lang"], order, top).join(totals, "lang")
    ranked = first.selectExpr(
        "*", "CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank"
    )
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
