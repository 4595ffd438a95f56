"""Token ids of remembered pieces against the library."""

import array

from flightops.llm import nnls_packing, pretokens

PATH = nnls_packing.TOKENIZER


def test_ids_over_forgotten_pieces_equal_the_library(monkeypatch):
    monkeypatch.setattr(nnls_packing, "MEMO", 20)
    nnls_packing._ids.cache_clear()
    texts = [f"The word{k}, isn't caf\u00e9\u00aa {k} don't -- a{chr(0x61 + k % 26)}b  x_y\tz" for k in range(60)] + ["", " ", "''s"]
    for text in texts + texts[::-1]:
        want = pretokens.library(PATH).encode(text, add_special_tokens=False).ids
        assert array.array("I", nnls_packing.token_ids(text, PATH)).tolist() == want
    nnls_packing._ids.cache_clear()


def test_common_words_stay_known(monkeypatch):
    monkeypatch.setattr(nnls_packing, "MEMO", 50)
    ids = nnls_packing._Ids(PATH)
    asked, encode = [], ids.pieces.encode
    ids.pieces.encode = lambda word: asked.append(word) or encode(word)
    for k in range(400):
        ids.trim()
        ids.plain(f"common word{k}x")
    # before: encoded anew each time the memory was full
    assert asked.count("common") == 1 and len(ids.pieces) + len(ids.pieces.before) <= 110


def test_words_of_many_texts_are_encoded_once():
    ids = nnls_packing._Ids(PATH)
    asked = []
    ids.pieces.encode = lambda word: asked.append(word) or ()
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(str(k + i) for i in range(1000)).translate(letters) for k in range(0, 450_000, 1000)]
    for text in texts + texts:
        ids.trim()
        ids.plain(text)
    # before: what 250,000 later pieces had pushed out was encoded anew
    assert len(asked) == 450_000


def test_bytes_are_spelt_as_the_library_does():
    pieces = nnls_packing._Ids(PATH).pieces
    seen = []
    pieces.encode = lambda word: seen.append(word) or ()
    for word in ("éß", "a\x00\x7f­", "˿"):
        pieces.word(word)
        assert seen[-1] == "".join(pieces.letters[b] for b in word.encode())
