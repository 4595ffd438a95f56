"""Normalising and cutting text into words the way the tokenizer file says.

Rules of the file: canonical composition, white space folded, lower case; then the pattern
CUT, whose matches are the words. For texts below U+0300 composition changes nothing and
lower-casing agrees with Python's, so the plain path needs no library call; every other
text, and one with U+023A or U+023E, whose lower case are letters beyond U+0300, goes
through the library's own normaliser and cutter.
"""

from __future__ import annotations

import functools
import re
import unicodedata

# The white space of the pattern's \s below U+0300.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
# Any character not plain: from U+0300 on, and two whose lower case is a letter from there.
_PLAIN = re.compile("[^\x00-\u0239\u023b-\u023d\u023f-\u02ff]")


def _members(group: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x300)
                   if unicodedata.category(chr(c))[0] == group)


# The word pattern of the tokenizer file, spelt for code points below U+0300.
CUT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_members('L')}]+|[{_members('N')}]"
    f"|[^{_BLANK}{_members('L')}{_members('N')}]+")


@functools.lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def special_pattern(path: str):
    import json
    with open(path, encoding="utf-8") as f:
        names = [t["content"] for t in json.load(f)["added_tokens"] if t["special"]]
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def is_plain(text: str) -> bool:
    return text.isascii() or _PLAIN.search(text) is None


def normalised(text: str, path: str) -> str:
    return text.lower() if is_plain(text) else library(path).normalizer.normalize_str(text)


def segments(text: str, path: str):
    """(special token or None, text between) pairs in order."""
    pattern = special_pattern(path)
    if pattern is None or "<|" not in text:
        yield None, text
        return
    for k, part in enumerate(pattern.split(text)):
        if k % 2:
            yield part, ""
        elif part:
            yield None, part
