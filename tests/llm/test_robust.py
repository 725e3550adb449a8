"""Texts and pages of extreme shape: they end, in time that grows with their size, with the plain result."""

from __future__ import annotations

import random
import re
import time

import pytest

from outfall.llm import chat, pages


def encoding():
    return chat._encoding(open(chat.VOCABULARY, "rb").read())[0]


def test_cut_white_space_gives_the_library_ids(monkeypatch):
    monkeypatch.setattr(chat, "LONG_SPACE", 5)
    monkeypatch.setattr(chat, "_LONG_SPACE", re.compile(chat._LONG_SPACE.pattern.replace("100000", "5")))
    rng, own = random.Random(1), encoding()
    for _ in range(1500):
        bits = (" " * rng.randint(1, 12), "\n" * rng.randint(1, 9), "a", "word", "^^", "é", "\x1c" * 6, "\t \n" * 3, " " * 7, "1")
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert chat.encode(own, text) == own.encode_ordinary(text), text


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000 + "end", "^" * 2_000_000, "x" * 1_000_000 + " " * 1_500_000 + "y"])
def test_very_long_runs_are_encoded(text):
    own, began = encoding(), time.time()
    assert own.decode(chat.encode(own, text)) == text and time.time() - began < 20


def test_a_conversation_with_a_million_spaces(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a" + " " * 1_200_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digest(turns).collect()}
    assert got[1]["loss_chars"] == 1_200_001 and got[1]["n_turns"] == 2


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<div>x" * 50_000 + "</div>" * 50_000, "<a x " * 200_000 + "'", '<a x ""' * 140_000 + "'",
                                  "<script x " * 100_000 + "'", "<div>x</p>" * 100_000, "<a x '\" " * 120_000])
def test_odd_pages_take_linear_time(page):
    began = time.time()
    found = pages.blocks(page)
    assert found is not None and time.time() - began < 10


def test_names_on_the_way_are_those_of_the_open_elements():
    page = "<div class='a b'><p class=a>one<section id=c>two</section>three</div>four<ul><li>five<li class=x>six</ul>"
    got = [(b.path, b.text) for b in pages.blocks(page)]
    assert got == [(("div", ".a", ".b", "p"), "one"), (("div", ".a", ".b", "section", ".c"), "two"), (("div", ".a", ".b"), "three"), ((), "four"),
                   (("ul", "li"), "five"), (("ul", "li", ".x"), "six")]
    quoted = pages.blocks("<p title='a > b'>in</p><a href='x>never closed")
    assert [b.text for b in quoted] == ["in", "<a href='x>never closed"]
