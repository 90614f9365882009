"""Conversations as marked text, token ids and a loss mask, and the way back.

A template puts a mark before and after the text of every turn. Where a text holds the
string of a mark, a backslash goes in after the mark's first character, and one more
where there are some already, so that no text can look like a mark and every text comes
back as it was. The marks are tokens of their own, so no token spans the edge of a text.

The turns of a conversation are rendered in order as one text, which is encoded once.
The byte offsets of its tokens are sums of the tokens' lengths in bytes, the spans of its
turns sums of the turns' lengths; both are sorted, and binary search finds the tokens
that lie in turns to be learned from.

Conversations are dealt out by id and sorted in their partition, which a task reads as a
stream. One of more than ``segment_turns`` turns is numbered by a sort over all tasks and
dealt out in segments of so many turns; a segment that holds more than ``segment_bytes``
is cut further, between turns. Segments are formatted apart and follow each other, and
since tokens never span marks, they give the ids of the whole. Only the digests of such a
conversation read its segments in one stream, as a digest of all of its text must.

Turns are ordered by turn, then role and text; a null turn comes first. Null roles and
texts are empty ones. Rows without a conv_id belong to no common conversation: each is one by
itself. Repeated rows are turns like others. Further columns are ignored, empty tables
have no conversations.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.plans.numbering import dense_numbers
from tradeloom.plans.workspace import stored

FORMATTED = "conv_id bigint, segment bigint, text string, ids array<int>, loss array<boolean>"
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
PARTS = 20  # bits of a segment's number that count its parts


def _quoted(text: str) -> str:
    """A pattern for exactly this text, in Java, Python and RE2 notation."""
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", text)


@dataclass(frozen=True)
class Template:
    """Marks around the text of known roles; other roles are spelled out between marks of their own."""

    roles: tuple[tuple[str, str, str], ...] = (
        ("system", "[SYS]", "[/SYS]"),
        ("user", "[INST]", "[/INST]"),
        ("assistant", "<s>", "</s>"),
    )
    other: tuple[str, str, str] = ("[TURN]", "[TEXT]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        first = {mark[:1] for mark in self.marks}
        if len(set(self.marks)) < len(self.marks) or any(first & set(mark[1:]) or "\\" in mark for mark in self.marks):
            raise ValueError("marks must differ, and their first characters occur nowhere else in marks")
        if any(len(mark) < 2 for mark in self.marks):
            raise ValueError("a mark needs two characters")

    @property
    def marks(self) -> list[str]:
        return [mark for _, *around in self.roles for mark in around] + list(self.other)

    @property
    def control(self) -> str:
        """A mark's string, with backslashes after its first character: that, the backslashes, the rest."""
        heads = "".join(sorted({_quoted(mark[0]) for mark in self.marks}))
        rests = "|".join(sorted({_quoted(mark[1:]) for mark in self.marks}, key=lambda rest: (-len(rest), rest)))
        return rf"([{heads}])(\\*)({rests})"

    def escaped(self, column: Column) -> Column:
        return F.regexp_replace(column, self.control, r"$1\\$2$3")

    def unescape(self) -> Callable[[str], str]:
        pattern = re.compile(self.control.replace(r"(\\*)", r"\\(\\*)"))
        return lambda text: pattern.sub(r"\1\2\3", text)

    def parse(self) -> Callable[[str], list[tuple[str, str]]]:
        """From a formatted text to (role, text) of its turns."""
        opening = {before: role for role, before, _ in self.roles}
        pattern, unescape = re.compile("|".join(_quoted(mark) for mark in self.marks)), self.unescape()

        def turns(text: str) -> list[tuple[str, str]]:
            found, role, at = [], "", 0
            for mark in pattern.finditer(text):
                if mark[0] in opening:
                    role = opening[mark[0]]
                elif mark[0] == self.other[1]:
                    role = unescape(text[at : mark.start()])
                elif mark[0] != self.other[0]:
                    found.append((role, unescape(text[at : mark.start()])))
                at = mark.end()
            return found

        return turns

    def rendered(self, role: Column, text: Column) -> tuple[Column, Column]:
        """(what goes before the text, what goes after it) of a turn."""
        before = F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.other[1]))
        after: Column = F.lit(self.other[2])
        for name, first, last in self.roles:
            before = F.when(role == name, F.lit(first)).otherwise(before)
            after = F.when(role == name, F.lit(last)).otherwise(after)
        return before, after


@cache
def _tokenizer(path: str, marks: tuple[str, ...]) -> tuple:
    """(encoder of texts, length in bytes of every token) of a byte-level BPE file with the marks as further tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True  # the file's own special strings are ordinary text
    loaded.add_tokens([AddedToken(mark, normalized=False) for mark in marks])
    vocabulary = loaded.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, number in vocabulary.items():
        # In the file, one character stands for one byte.
        sizes[number] = len(token.encode() if token in marks else token)
    return loaded, sizes


def _masked(sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted byte spans ``starts`` to ``ends``."""
    after = np.cumsum(sizes[ids])
    before = after - sizes[ids]
    if not len(starts):
        return np.zeros(len(ids), bool)
    span = np.searchsorted(ends, before, side="right")
    inside = span < len(ends)
    return inside & (starts[np.minimum(span, len(ends) - 1)] < after)


def _packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int | None, int, bytes, list[tuple[int, int]]]]:
    """(conv_id, segment, text, learned spans) from sorted turns; a segment over ``limit`` bytes is cut between turns."""
    current, part, pieces, spans, size = None, 0, [], [], 0
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "segment", "lead", "tail", "learned")]
        rendered = batch.column("piece").cast(pa.binary()).to_pylist()
        for conv, segment, lead, tail, learned, piece in zip(*columns, rendered, strict=True):
            same = current == (conv, segment) and conv is not None
            if pieces and (not same or size + len(piece) > limit):
                yield *current[:1], (current[1] << PARTS) + part, b"".join(pieces), spans
                part, pieces, spans, size = part + 1, [], [], 0
            if not same:
                current, part = (conv, segment), 0
            if learned and len(piece) > lead + tail:
                spans.append((size + lead, size + len(piece) - tail))
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield *current[:1], (current[1] << PARTS) + part, b"".join(pieces), spans


def _turns(df: DataFrame, template: Template) -> DataFrame:
    rows = df.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # Rows without an id are spread by their place.
    return rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))


def _encoded(turns: DataFrame, template: Template, tokenizer: str, segment_bytes: int) -> DataFrame:
    """FORMATTED of turns with their segment."""
    before, after = template.rendered(F.col("role"), F.col("text"))
    dealt = turns.repartition("conv_id", "segment", "alone").sortWithinPartitions(
        "conv_id", "alone", "segment", "turn", "role", "text"
    )
    pieces = dealt.select(
        "conv_id",
        "segment",
        F.concat(before, template.escaped(F.col("text")), after).alias("piece"),
        F.octet_length(before).alias("lead"),
        F.octet_length(after).alias("tail"),
        F.col("role").isin(*template.learned).alias("learned"),
    )
    marks = tuple(template.marks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = _tokenizer(tokenizer, marks)
        waiting: list[tuple] = []
        held = 0
        for one in _packed(batches, segment_bytes):
            waiting.append(one)
            held += len(one[2])
            if held > 1 << 20:
                yield batch(encoder, sizes, waiting)
                waiting, held = [], 0
        if waiting:
            yield batch(encoder, sizes, waiting)

    def batch(encoder, sizes: np.ndarray, waiting: list[tuple]) -> pa.RecordBatch:
        texts = [text.decode() for _, _, text, _ in waiting]
        ids = [np.array(one.ids, np.int32) for one in encoder.encode_batch_fast(texts, add_special_tokens=False)]
        loss = []
        for one, (_, _, text, spans) in zip(ids, waiting, strict=True):
            if sizes[one].sum() != len(text):
                raise ValueError("the tokenizer does not keep every byte")
            edges = np.array(spans, np.int64).reshape(-1, 2)
            loss.append(_masked(sizes, one, edges[:, 0], edges[:, 1]))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(one) for one in ids])]), pa.int32())
        return pa.RecordBatch.from_pydict(
            {
                "conv_id": pa.array([conv for conv, *_ in waiting], pa.int64()),
                "segment": pa.array([segment for _, segment, *_ in waiting], pa.int64()),
                "text": pa.array(texts, pa.string()),
                "ids": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                "loss": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(loss))),
            }
        )

    return pieces.mapInArrow(encode, FORMATTED)


def _segmented(turns: DataFrame, segment_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """(turns of conversations that are one segment, turns of longer ones or None), with their segment."""
    long = stored(turns.where("conv_id IS NOT NULL").groupBy("conv_id").count().where(f"count > {segment_turns}"), "long")
    if long.isEmpty():
        return turns.withColumn("segment", F.lit(0).cast("bigint")), None
    whole = turns.join(long, "conv_id", "left_anti").withColumn("segment", F.lit(0).cast("bigint"))
    numbered = dense_numbers(turns.join(long, "conv_id", "left_semi"), ["conv_id", "turn", "role", "text"], "place")
    first = numbered.groupBy("conv_id").agg(F.min("place").alias("first"))
    cut = numbered.join(first, "conv_id").withColumn("segment", F.expr(f"(place - first) div {segment_turns}"))
    return whole, cut.drop("place", "first")


def formatted(
    df: DataFrame,
    tokenizer: str,
    template: Template = Template(),
    segment_turns: int = 1024,
    segment_bytes: int = 1 << 22,
) -> DataFrame:
    """(conv_id, segment, text, ids, loss) of conversations given as rows (conv_id, turn, role, text).

    ``loss`` says of each id whether its token lies in a turn to be learned from. Conversations
    of one segment have segment 0; the segments of others are in order of their number.
    ``tokenizer`` is a file of a byte-level BPE that keeps every byte.
    """
    whole, cut = _segmented(_turns(df, template), segment_turns)
    turns = whole if cut is None else whole.unionByName(cut)
    return _encoded(turns, template, tokenizer, segment_bytes)


def _digested(sorted_segments: DataFrame, template: Template, tokenizer: str) -> DataFrame:
    """DIGESTS from segments that lie in order within a partition, read back from text, ids and mask."""
    marks = tuple(template.marks)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sizes = _tokenizer(tokenizer, marks)
        parse, unescape = template.parse(), template.unescape()
        done: list[tuple] = []
        current, state = None, None
        for batch in batches:
            ids, loss = batch.column("ids"), batch.column("loss")
            texts = batch.column("text").to_pylist()
            convs = batch.column("conv_id").to_pylist()
            for row, (conv, text) in enumerate(zip(convs, texts, strict=True)):
                if state is None or conv is None or conv != current:
                    if state:
                        done.append((current, *state.values()))
                    current = conv
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, said in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                state["formatted"] += len(text)
                ends = np.cumsum(sizes[ids[row].values.to_numpy()])
                mask = np.concatenate([[False], ids_mask(loss[row]), [False]])
                # Runs of learned tokens, as byte spans of the text.
                edges = np.flatnonzero(mask[1:] != mask[:-1])
                places = np.concatenate([[0], ends])[edges].tolist()
                raw = text.encode()
                for start, end in zip(places[::2], places[1::2], strict=True):
                    learned = unescape(raw[start:end].decode())
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
            if len(done) >= 4096:
                yield table(done)
                done = []
        if state:
            done.append((current, *state.values()))
        if done:
            yield table(done)

    def ids_mask(one: pa.ListScalar) -> np.ndarray:
        return one.values.to_numpy(zero_copy_only=False)

    def table(done: list[tuple]) -> pa.RecordBatch:
        conv, n, turns, chars, loss, size = zip(*done, strict=True)
        return pa.RecordBatch.from_pydict(
            {
                "conv_id": pa.array(conv, pa.int64()),
                "n_turns": pa.array(n, pa.int64()),
                "turns_sha256": pa.array([one.hexdigest() for one in turns]),
                "loss_chars": pa.array(chars, pa.int64()),
                "loss_sha256": pa.array([one.hexdigest() for one in loss]),
                "formatted_chars": pa.array(size, pa.int64()),
            }
        )

    return sorted_segments.mapInArrow(digest, DIGESTS)


def read_back(
    df: DataFrame,
    tokenizer: str,
    template: Template = Template(),
    segment_turns: int = 1024,
    segment_bytes: int = 1 << 22,
) -> DataFrame:
    """Format conversations and read turns and learned text back: one row of counts and digests each.

    ``turns_sha256`` is of role, line feed, text, line feed of every turn; ``loss_sha256`` of the
    text under the mask, unescaped. Conversations of one segment are read where they were made.
    """
    whole, cut = _segmented(_turns(df, template), segment_turns)
    found = _digested(_encoded(whole, template, tokenizer, segment_bytes), template, tokenizer)
    if cut is None:
        return found
    segments = _encoded(cut, template, tokenizer, segment_bytes)
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return found.unionByName(_digested(ordered, template, tokenizer))
