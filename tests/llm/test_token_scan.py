"""Token counts of long and of many-lettered texts against the library."""

import random

import numpy as np
import pytest

from flightops.llm import pretokens, token_counts, transducer

PATH = token_counts.TOKENIZER
HAN = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可"


def library(text):
    return len(pretokens.library(PATH).encode(text, add_special_tokens=False).ids)


def test_every_code_point_of_the_basic_plane_and_many_beyond():
    text = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 61)])
    assert token_counts.count_texts([text, text[::-1], ""], PATH).tolist() == [library(text), library(text[::-1]), 0]
    # more than 32,767 characters on one line, as letters of one word
    han = "".join(chr(c) for c in [*range(0x4E00, 0x9FFF), *range(0xAC00, 0xD7A3)])
    assert len(set(han)) > 32_000 and token_counts.count_texts([han], PATH)[0] == library(han)


@pytest.mark.parametrize("text", [
    "ab" * 120_000, "a" * 500_000, "é" * 9_000 + "'s " * 700 + "'" * 999 + "re've", "x<|endoftext|>" * 3_000,
    "".join(random.Random(1).choice(HAN) for _ in range(150_000)),
    "".join(random.Random(2).choice(HAN[:20] + "a1' ,²½①\n") for _ in range(40_000))])
def test_long_texts_without_blanks(text):
    assert token_counts.count_texts([text], PATH)[0] == library(text)


def test_streams_go_on_from_the_state_they_reached(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc dé's1中") for _ in range(rng.randrange(4_000))) for _ in range(30)] + ["", "a" * 9_000]
    want = [library(t) for t in texts]
    monkeypatch.setattr(token_counts, "STREAM", 1_500)
    machine = transducer.Transducer(transducer.WordBpe(PATH), max_cells=1)   # begins afresh each time
    monkeypatch.setattr(token_counts, "_transducer", lambda path: machine)
    assert token_counts.count_texts(texts, PATH).tolist() == want


def test_maps_of_wrong_guesses_are_mended():
    machine = transducer.Transducer(transducer.WordBpe(PATH))
    text = ("abcdefgh" * 900 + "a" * 3_000 + " the end of it ") * 3
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    symbols = machine.columns(codes, lambda c: token_counts._kind(PATH, c))
    one = np.empty((len(symbols), 1), np.int16)
    end = machine.walk(np.zeros(1, np.int32), symbols[:, None], one)[0]
    for chunk, warm in ((64, 1), (64, 64), (1024, 3)):
        found, state = machine.scan(symbols, 0, chunk, warm)
        assert state == end and (found == one[:, 0]).all()
