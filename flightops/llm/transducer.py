"""Finite-state token counting for a byte-level BPE vocabulary with an end-of-word mark.

The tokenizer file is compiled, state by state as inputs need them, into a deterministic
transducer over the symbols of a normalised text. Each transition carries the number of
tokens it emits, so counting tokens is walking the transducer and adding up.

Within a word a sequence of tokens is the one BPE gives exactly if each two neighbours,
joined and encoded alone, come apart into the same two tokens. So the last token of a
prefix is the one suffix of it that is a token and that agrees with the last token of what
stands before it. A state therefore needs only the longest suffix that can still grow into
a token, and the last token and count at each place within it (counts relative to the
end): finitely many values, whatever the word's length.

That a letter was a word's last is seen one symbol late. The tokens that end a word are
found in the same window, and the transition out of the word emits the difference to what
was counted without the end mark, so emissions may be negative; their sum is the count.
"""

from __future__ import annotations

import functools
import json

import numpy as np

# Classes of characters as the pre-tokenizer sees them.
LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves,
    the rest take the code points from 256 on, in order (public byte-level BPE rule)."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """The merges of one tokenizer file, applied to words of byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" "))
                  for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.tokens = set(model["vocab"])
        self.prefixes = set()
        for t in self.tokens:
            bare = t.removesuffix(self.end)
            whole = t != bare
            self.prefixes.update(bare[:k] for k in range(1, len(bare) + whole))

    def merge(self, parts: list[str]) -> list[str]:
        """The tokens of a list of symbols: the lowest-ranked pair merges first, leftmost first."""
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get((parts[k], parts[k + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            a, b = parts[at], parts[at + 1]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    @functools.lru_cache(maxsize=1 << 18)
    def agree(self, left: str, right: str) -> bool:
        """Do two neighbouring tokens stay as they are when encoded together?"""
        end = self.end
        bare = right.removesuffix(end)
        symbols = [*left, *bare]
        if bare != right:
            symbols[-1] += end
        return self.merge(symbols) == [left, right]


DEAD = (None, 0)
START = None  # between words
#: Contractions the cutter takes after an apostrophe (fixed values of its pattern).
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


#: Code points of the marks between texts and of a special token in a stream.
BREAK_CODE, SPECIAL_CODE = 0x110000, 0x110001
#: Characters below are symbols of their own; letters and signs above are read byte by byte, so
#: that an alphabet of any size needs 256 columns more (numbers stay whole: each is a word).
WHOLE_BELOW = 0x300


class Transducer:
    """Lazily compiled: state numbers, and for each state and column of a symbol the next
    state and the tokens emitted (-1: not compiled yet).

    States: START; ("w", kind, window, history) inside a word; ("a", seen) after an
    apostrophe that may begin a contraction. A cell of the table packs the next state and
    the emission: next * 256 + emission + 128.
    """

    BREAK_COL, SPECIAL_COL = 0, 1

    def __init__(self, bpe: WordBpe, max_cells: int = 40_000_000):
        self.bpe, self.letters, self.max_cells = bpe, byte_letters(), max_cells
        self.clear()

    def clear(self) -> None:
        self.column = np.full(0x110002, -1, dtype=np.int32)
        self.column[BREAK_CODE], self.column[SPECIAL_CODE] = self.BREAK_COL, self.SPECIAL_COL
        self.symbols: list = [(BREAK, "", ""), (BREAK, "", "")]
        # a column for each byte of a letter, and of a sign, once one occurs
        self.byte_column = np.full((2, 256), -1, dtype=np.int32)
        self.states: list = [START]
        self.number = {START: 0}
        self.pairs: dict = {}
        self.table = np.full((1024, 64), -1, dtype=np.int32)

    def fit(self, state=START) -> int:
        """Begins afresh once the tables are large: memory stays bounded for any input. Gives
        the number of a state to go on from."""
        if self.table.size > self.max_cells:
            self.clear()
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self._grow()
        return self.number[state]

    # -- symbols ---------------------------------------------------------------------

    def columns(self, codes: np.ndarray, kind_of) -> np.ndarray:
        """The columns of a stream of code points."""
        return self.spelled(codes, kind_of)[0]

    def spelled(self, codes: np.ndarray, kind_of) -> tuple[np.ndarray, np.ndarray]:
        """The columns of a stream of code points, and how many each takes (1, or the bytes of
        a letter or sign from WHOLE_BELOW on). kind_of classes new characters."""
        found = self.column[codes]
        if (found == -1).any():
            for c in np.unique(codes[found == -1]).tolist():
                char = chr(c)
                kind = kind_of(char)
                if kind == BREAK:
                    self.column[c] = self.BREAK_COL
                elif c >= WHOLE_BELOW and kind != NUMBER:
                    self.column[c] = -2 - kind
                else:
                    self.column[c] = len(self.symbols)
                    self.symbols.append((kind, "".join(self.letters[b] for b in char.encode()), char))
            self._grow()
            found = self.column[codes]
        split = np.flatnonzero(found < -1)
        taken = np.ones(len(codes), dtype=np.int64)
        if not len(split):
            return found, taken
        wide = codes[split].astype(np.int64)
        size = 2 + (wide >= 0x800) + (wide >= 0x10000)
        taken[split] = size
        place = np.concatenate([[0], np.cumsum(taken)])
        out = np.empty(place[-1], dtype=np.int32)
        one = found >= 0
        out[place[:-1][one]] = found[one]
        sign = (found[split] == -2 - OTHER).astype(np.int64)
        at, key = [], []
        for n in (2, 3, 4):
            mine = size == n
            for k in range(n):
                bits = (wide[mine] >> (6 * (n - 1 - k))) & 0x3F
                lead = {2: 0xC0, 3: 0xE0, 4: 0xF0}[n] if k == 0 else 0x80
                at.append(place[:-1][split[mine]] + k)
                key.append(sign[mine] * 256 + (lead | bits))
        key = np.concatenate(key)
        known = self.byte_column.reshape(-1)
        for new in np.unique(key[known[key] < 0]).tolist():
            known[new] = len(self.symbols)
            self.symbols.append((OTHER if new >> 8 else LETTER, self.letters[new & 255], "<byte>"))
        self._grow()
        out[np.concatenate(at)] = known[key]
        return out, taken

    def _grow(self) -> None:
        rows, cols = self.table.shape
        if len(self.states) > rows:
            rows += rows // 2
        if len(self.symbols) > cols:
            cols = len(self.symbols) + 16
        if (rows, cols) != self.table.shape:
            bigger = np.full((rows, cols), -1, dtype=np.int32)
            bigger[:self.table.shape[0], :self.table.shape[1]] = self.table
            self.table = bigger

    # -- states ----------------------------------------------------------------------

    def _push(self, window: str, history: tuple, letter: str):
        """One letter more: the new window and history, and the tokens this adds."""
        bpe = self.bpe
        grown = window + letter
        token, count = self._last(grown, "", history)
        history = (*history, (token, count))
        n, begin = len(window), 0
        while begin <= n and grown[begin:] not in bpe.prefixes:
            begin += 1
        pairs = self.pairs
        kept = tuple(
            pairs.setdefault(p, p) for p in (
                (history[k][0], history[k][1] - count)
                if k == n + 1 or grown[k:] in bpe.prefixes else DEAD
                for k in range(begin, n + 2)))
        return grown[begin:], kept, count

    def _last(self, window: str, mark: str, history: tuple):
        """The last token of what ends in window + mark, and the count up to its end."""
        bpe = self.bpe
        for begin in range(len(window)):
            token = window[begin:] + mark
            if token in bpe.tokens:
                before, count = history[begin]
                if before is None or bpe.agree(before, token):
                    return token, count + 1
        raise ValueError(f"no token ends {window + mark!r}")

    def _open(self, kind: int, letters: str):
        """A word begins with these letters of its first character."""
        return self._more(("w", kind, "", ((None, 0),)), letters)

    def _more(self, state, letters: str):
        _, kind, window, history = state
        tokens = 0
        for x in letters:
            window, history, n = self._push(window, history, x)
            tokens += n
        return ("w", kind, window, history), tokens

    def _word(self, letters: str) -> int:
        state, n = self._open(OTHER, letters)
        return n + self._close(state)

    def _close(self, state) -> int:
        return self._last(state[2], self.bpe.end, state[3])[1]

    def _step(self, state, symbol, special: bool):
        kind, letters, char = symbol
        if state is not START and state[0] == "a":
            seen = state[1]
            if seen + char in SHORT and kind == LETTER:
                return START, self._word("'" + seen + char)
            if not seen and kind == LETTER and any(s[0] == char for s in SHORT if len(s) > 1):
                return ("a", char), 0
            # no contraction: the apostrophe opens a run, a letter seen after it a word
            if seen:
                state, n = self._open(LETTER, seen)
                n += self._word("'")
            else:
                state, n = self._open(OTHER, "'")
            after, more = self._step(state, symbol, special)
            return after, n + more
        if state is not START:
            if kind == state[1]:
                return self._more(state, letters)
            after, more = self._step(START, symbol, special)
            return after, self._close(state) + more
        if kind == BREAK:
            return START, int(special)
        if kind == NUMBER:
            return START, self._word(letters)
        if char == "'":
            return ("a", ""), 0
        return self._open(kind, letters)

    def compile(self, state: int, col: int) -> None:
        after, tokens = self._step(self.states[state], self.symbols[col], col == self.SPECIAL_COL)
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
            if to >= len(self.table):
                self._grow()
        if not -128 <= tokens < 128:
            raise OverflowError(f"{tokens} tokens in one transition")
        self.table[state, col] = to * 256 + tokens + 128

    # -- walking ---------------------------------------------------------------------

    def walk(self, state: np.ndarray, symbols: np.ndarray, out: np.ndarray) -> np.ndarray:
        """All lanes (columns of symbols) in step, from the given states; out gets the
        emissions. Returns the states at the end."""
        for k in range(len(symbols)):
            col = symbols[k]
            cell = self.table[state, col]
            if cell.min() < 0:
                miss = np.flatnonzero(cell < 0)
                width = 1 << 21
                for key in np.unique(state[miss].astype(np.int64) * width + col[miss]).tolist():
                    self.compile(key // width, key % width)
                cell = self.table[state, col]
            out[k] = (cell & 255) - 128
            state = cell >> 8
        return state

    def emissions(self, symbols: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """The tokens emitted at each symbol of a stream that begins between words."""
        return self.scan(symbols, 0, chunk)[0]

    def scan(self, symbols: np.ndarray, state: int, chunk: int = 1024,
             warm: int = 64) -> tuple[np.ndarray, int]:
        """The tokens emitted at each symbol of a stream, and the state at its end.

        The stream is cut into chunks, and each chunk becomes a map from the state before it to
        the state after it and its counts. Which state stands before a chunk is nearly always
        told by the few symbols before it (always, where a break is among them): each map is
        first made for that state, all chunks in step. The scan then composes neighbouring
        maps; where the state that a chunk gives isn't the one that the next chunk's map was made for,
        that map gets an entry for it, for all such chunks at once, until all agree. Chunks that
        never settle (one letter a million times) share their maps by content.
        """
        n, out = len(symbols), np.empty(len(symbols), dtype=np.int16)
        lanes = n // chunk
        if lanes:
            grid = np.ascontiguousarray(symbols[:lanes * chunk].reshape(lanes, chunk).T)
            before = np.zeros(lanes, dtype=np.int32)
            before[0] = state
            if lanes > 1:
                lead = grid[max(0, chunk - warm):, :-1]
                before[1:] = self.walk(before[1:], lead, np.empty(lead.shape, dtype=np.int16))
            counts = np.empty(grid.shape, dtype=np.int16)
            after = self.walk(before, grid, counts)
            self._compose(grid, before, after, counts)
            out[:lanes * chunk] = counts.T.reshape(-1)
            state = int(after[-1])
        rest = symbols[lanes * chunk:]
        if len(rest):
            found = np.empty((len(rest), 1), dtype=np.int16)
            state = int(self.walk(np.array([state], dtype=np.int32), rest[:, None], found)[0])
            out[lanes * chunk:] = found[:, 0]
        return out, state

    def _compose(self, grid: np.ndarray, before: np.ndarray, after: np.ndarray, counts: np.ndarray,
                 rounds: int = 4) -> None:
        """Bring every chunk's state before it and the state after its predecessor together."""
        for _ in range(rounds):
            wrong = np.flatnonzero(before[1:] != after[:-1]) + 1
            if not len(wrong):
                return
            before[wrong] = after[wrong - 1]
            own = np.ascontiguousarray(grid[:, wrong])
            found = np.empty(own.shape, dtype=np.int16)
            after[wrong] = self.walk(before[wrong], own, found)
            counts[:, wrong] = found
        # chunks that don't settle: along the stream, each content walked once for each state
        maps: dict = {}
        for k in range(1, grid.shape[1]):
            if before[k] == after[k - 1]:
                continue
            before[k] = after[k - 1]
            own = np.ascontiguousarray(grid[:, k])
            key = (own.tobytes(), int(before[k]))
            if key not in maps:
                found = np.empty((len(own), 1), dtype=np.int16)
                maps[key] = int(self.walk(before[k:k + 1], own[:, None], found)[0]), found[:, 0]
            after[k], counts[:, k] = maps[key]
