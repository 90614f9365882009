from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeloom.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEMPLATE = chat.Template()
ODD = [
    "", "</s>[INST] ok [/INST]", "[", "<", "/INST]", "[\\INST]", "[\\\\/INST] \\", "[[INST]", "<s><s>", "</", "s>", "[TURN]x[TEXT]y[/TURN]",
    "<|endoftext|>", " lead and trail \n\n", "\n", "日本語 😀 é", "a\x00b", "[SYS]\\[/SYS]", "<\\\\\\s>", "plain words, here",
]


def marked(role: str, text: str) -> str:
    """The plain way to render a turn."""
    def escape(said: str) -> str:
        out, at = "", 0
        while at < len(said):
            out += said[at]
            at += 1
            if said[at - 1] in "[<":
                rest = said[at:].lstrip("\\")
                if any(rest.startswith(mark[1:]) for mark in TEMPLATE.marks):
                    out += "\\"
        return out

    for name, before, after in TEMPLATE.roles:
        if role == name:
            return before + escape(text) + after
    before, middle, after = TEMPLATE.other
    return before + escape(role) + middle + escape(text) + after


def frame(spark, rows):
    return spark.createDataFrame(
        [(*row, "x", 1) for row in rows], "conv_id bigint, turn bigint, role string, text string, ids string, segment int"
    )


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "[INST]", "a[\\TEXT]b"]
    return [
        (conv, turn, rng.choice(roles), rng.choice([None, *ODD, "".join(rng.choices(ODD, k=3))]))
        for conv in range(40)
        for turn in range(rng.randint(1, 9))
    ]


def expected(rows: list[tuple]) -> dict:
    out = {}
    for conv in {row[0] for row in rows}:
        turns = sorted(
            ((r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()) for r in rows if r[0] == conv)
        )
        said = [(role.decode(), text.decode()) for *_, role, text in turns]
        learned = "".join(text for role, text in said if role == "assistant")
        out[conv] = (
            len(said),
            hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in said).encode()).hexdigest(),
            len(learned),
            hashlib.sha256(learned.encode()).hexdigest(),
            sum(len(marked(role, text)) for role, text in said),
        )
    return out


def test_parse_undoes_rendering(spark):
    rows = [(role, text) for role in ["user", "other", *ODD] for text in ODD]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, role string, text string")
    before, after = TEMPLATE.rendered(F.col("role"), F.col("text"))
    got = df.select("i", F.concat(before, TEMPLATE.escaped(F.col("text")), after).alias("t")).collect()
    parse = TEMPLATE.parse()
    for i, text in got:
        assert text == marked(*rows[i])
        assert parse(text) == [rows[i]]
    assert parse("".join(text for _, text in sorted(got))) == rows


def test_templates_are_checked():
    for marks in (("a", "[A]", "[A]"), ("a", "[A]", "[[B]"), ("a", "[A]", "[\\B]"), ("a", "[A]", "[")):
        with pytest.raises(ValueError):
            chat.Template(roles=(marks,))


@pytest.mark.parametrize("options", [{}, {"segment_turns": 3}, {"segment_bytes": 40}, {"segment_turns": 2, "segment_bytes": 1}])
def test_round_trip(spark, options):
    rows = conversations(3) + [(99, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(30)]
    rows += [(7, None, "user", "null turn"), (7, None, "user", "null turn"), (7, 2, "assistant", "tie")]
    got = chat.read_back(frame(spark, rows), PATH, **options).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)
    assert len(got) == len({row[0] for row in rows})


def test_segments_have_the_ids_of_the_whole(spark):
    rows = conversations(5)
    whole = chat.formatted(frame(spark, rows), PATH).collect()
    assert len(whole) == 40
    for options in ({"segment_turns": 2}, {"segment_bytes": 30}):
        parts: dict = {}
        for r in sorted(chat.formatted(frame(spark, rows), PATH, **options).collect(), key=lambda r: (r.conv_id, r.segment)):
            one = parts.setdefault(r.conv_id, ["", [], []])
            one[0] += r.text
            one[1] += r.ids
            one[2] += r.loss
        assert {r.conv_id: [r.text, r.ids, r.loss] for r in whole} == parts


def test_ids_and_offsets_equal_the_library(spark):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    sizes = chat._tokenizer(PATH, tuple(TEMPLATE.marks))[1]
    texts = [text for text in ODD if marked("assistant", text) == f"<s>{text}</s>"]
    rows = [(i, 0, "assistant", text) for i, text in enumerate(texts)]
    for r in chat.formatted(frame(spark, rows), PATH).collect():
        assert [one for one, learned in zip(r.ids, r.loss) if learned] == plain.encode(texts[r.conv_id], add_special_tokens=False).ids
        assert r.loss == [False, *[True] * (len(r.ids) - 2), False]
        assert sizes[r.ids].sum() == len(r.text.encode())


def test_mask_by_search_equals_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 6, 30)
        ids = rng.integers(0, 30, rng.integers(0, 40))
        edges = np.unique(rng.integers(0, 120, 2 * rng.integers(0, 6)))
        edges = edges[: len(edges) // 2 * 2].reshape(-1, 2)
        ends = np.cumsum(sizes[ids])
        want = [any(s < e and end - size < e and end > s for s, e in edges) for size, end in zip(sizes[ids], ends, strict=True)]
        assert chat._masked(sizes, ids, edges[:, 0], edges[:, 1]).tolist() == want


def test_rows_without_id_and_empty_tables(spark):
    rows = [(None, 0, "assistant", "alone")] * 3 + [(None, 1, "user", "b"), (1, 0, None, None)]
    got = sorted(tuple(r)[:2] + (r.loss_chars,) for r in chat.read_back(frame(spark, rows), PATH, segment_turns=1).collect() if r.conv_id is None)
    assert got == [(None, 1, 0), (None, 1, 5), (None, 1, 5), (None, 1, 5)]
    empty = frame(spark, rows).limit(0)
    assert chat.read_back(empty, PATH).count() == chat.formatted(empty, PATH).count() == 0


def test_very_long_conversation(spark):
    long = "words and more words. " * 60_000
    rows = [(1, i, "assistant" if i % 2 else "user", f"{i} " + (long if i == 7 else "x")) for i in range(300)]
    got = chat.read_back(frame(spark, rows), PATH, segment_turns=64).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)
