"""Main text of web pages: a suffix array over each host's pages, checked by their markup.

Each page is read once, tolerant of broken markup, into blocks of text. The token streams of a host's
pages, all their blocks, are concatenated, with a mark at each block's border and a mark of its own at each
page's end, and their suffixes put in order (prefix doubling). Suffixes that share `RUN` tokens
stand together; where they come from `MIN_PAGES` distinct pages or more, all their tokens are covered.
A longer run is covered by its suffixes, up to its last token. The order beyond `RUN` tokens can't
change what is covered, so doubling stops there.

What is judged are a page's sections: each `<article>`, each `<main>`, and each block outside of
these. A section covered to `COVERED` of its tokens is repeated. A repeated block goes; a repeated
`<article>` or `<main>` goes where the page has a longer text that isn't repeated (a card or notice
marked up as an article), and stays where it hasn't (an article that other pages carry too). The text
is what stays inside `<article>`, else inside `<main>`, else outside; if nothing stays, all is taken to stay.

The markup then checks the verdict: parts that the page itself marks as menu, header, footer, sidebar,
notice, advert, form or reader comments (by element, role, class or id) are never text, however
unique, and a section that stays keeps all its blocks: a passage that an article shares is part of it.

Scale: a host's pages are dealt by content to groups of some `GROUP_TOKENS` tokens; a task holds
one group, whatever the host. They travel once, as 16 bits a word. A run seen on fewer than `MIN_PAGES`
pages of a group still counts: groups of divided hosts report their runs, packed and dealt by ranges
of their hashes, the reports are added up, and the groups get back those of their runs that the whole
host repeats. Pages of equal content are one page, once a task before the shuffle, so copies don't make
an article boilerplate. Texts don't travel to the groups, and only verdicts that change what
the markup alone gives come back.

Defined results: null and empty html give an empty text; null hosts (no url, or none readable) are
one host; repeated rows all return; an empty table gives no rows; extra columns are ignored.
Cut-off markup ends what is open; an unfinished tag or reference at the end is no text (tag) or
text as it stands (reference). Words are compared by 16 bits of a hash, so runs by 96; across
groups runs are compared by 33 bits or more, growing with the host.
"""

from __future__ import annotations

import html as _html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small_batches, table

RUN = 6
MIN_PAGES = 3
COVERED = 0.8
GROUP_TOKENS = 500_000
RANGE = 8         # groups whose runs' worth is added up in a task
HTML_CHARS = 6    # of html that count as a token where groups are sized

# Elements and names by which pages mark what isn't the article.
APART = frozenset("nav footer aside form header menu dialog button select textarea noscript template iframe "
                  "object svg head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr notice notices notification banner popup "
    "modal overlay newsletter subscribe subscription share sharing social comment comments disqus respond replies related "
    "recommended pagination pager login signup masthead toolbar skip".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split())
#: An opening tag closes an open one of these, unless one of the second set opened since.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
          "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
          "option": ({"option"}, {"select"})}
RAW = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style")}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"""
    r"""((?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[0-9]+|[A-Z]+")
_NOT_PARTS = frozenset("has no with without is js".split())

IN_ARTICLE, IN_MAIN, FREE, APART_TEXT = range(4)


def _named_apart(attributes: str) -> bool:
    """Whether role, class or id mark an element as something beside the article."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if parts and parts[0] not in _NOT_PARTS and not NAMES.isdisjoint(parts):
                    return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


@dataclass
class _Open:
    """The elements open at a place: (name, kind of text below it, number of the article or main it is in)."""
    stack: list[tuple[str, int, int]] = field(default_factory=list)
    sections: int = 0

    def kind(self) -> int:
        return self.stack[-1][1] if self.stack else FREE

    def section(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return
            if name not in BLOCKS and self.stack[k][0] in BLOCKS:
                return

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    del self.stack[k:]
                    break
                if self.stack[k][0] in BLOCKS:
                    break
        if name in CLOSES:
            ends, stops = CLOSES[name]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in ends:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in stops:
                    break
        kind, section = self.kind(), self.section()
        outside = kind
        named = bool(attributes) and name not in ("html", "body") and _named_apart(attributes)
        if name in ("article", "main"):
            # an article below an element left open is still one; a comment marked as article isn't
            commented = any(o[0] == "article" and o[1] == IN_ARTICLE for o in self.stack) and kind == APART_TEXT
            kind = APART_TEXT if named or commented else IN_ARTICLE if name == "article" or kind == IN_ARTICLE else IN_MAIN
        elif kind != APART_TEXT:
            if named or (name in APART and not (name == "header" and kind == IN_ARTICLE)):
                kind = APART_TEXT
        if kind < FREE and kind != outside:
            self.sections += 1
            section = self.sections
        self.stack.append((name, kind, section))


def sectioned(page: str) -> list[tuple[int, int, str]]:
    """(kind, number of the article or main, text) of a page's blocks, in page order."""
    found: list[tuple[int, int, str]] = []
    here: list[str] = []
    opened, at, n = _Open(), 0, len(page)

    def end() -> None:
        if here:
            text = " ".join(_html.unescape("".join(here)).split())
            if text:
                found.append((opened.kind(), opened.section(), text))
            here.clear()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            here.append(page[at:])
            break
        if m.start() > at:
            here.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            here.append(" ")
        elif name in VOID:
            if name == "hr":
                end()
        elif m[1]:
            if name in BLOCKS or name in APART:
                end()
            opened.close(name)
        elif name in RAW:
            if not m[3].endswith("/>"):
                stop = RAW[name].search(page, at)
                at = stop.start() if stop else n
        else:
            if name in BLOCKS or name in APART:
                end()
            elif m[3][:1] in " \t\n\r\f" and _named_apart(m[3]):
                end()
            opened.open(name, m[3])
    end()
    return found


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks, in page order."""
    return [(kind, text) for kind, _, text in sectioned(page)]


def marked(kinds: list[int]) -> list[int]:
    """Of blocks of these kinds, those that the marks alone make the article."""
    level = min(kinds, default=FREE)
    return [k for k, kind in enumerate(kinds) if kind == level]


def article(found: list[tuple[int, str]]) -> str | None:
    """The article's text by the marks alone, or None where the page has none."""
    level = min((kind for kind, _ in found), default=FREE)
    return "\n".join(found[k][1] for k in marked([kind for kind, _ in found])) if level < FREE else None


# --------------------------------------------------------------------------- suffix array

def _dense(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1]


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix among all, ordered by its first `depth` tokens (equal if these are
    equal; a missing token precedes all), by prefix doubling."""
    rank, known = _dense(tokens), 1
    while known < depth and len(rank):
        step = min(known, depth - known)
        after = np.zeros(len(rank), np.int64)
        after[:-step or None] = rank[step:] + 1 if step < len(rank) else 0
        rank = _dense(rank * (len(rank) + 2) + after)
        known += step
    return rank


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(16 bits of a hash of each word, never 0; number of words of each text)."""
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    coded = np.array([xxhash.xxh32_intdigest(w.as_buffer()) % 0xFFFF + 1 for w in words.dictionary], "<u2")
    sizes = np.diff(split.offsets.to_numpy())
    return (coded[words.indices.to_numpy()] if len(coded) else np.empty(0, "<u2")), sizes


class Streams:
    """The concatenated token streams of pages. words: all pages' words, sizes: words of each block,
    pages: the page of each block, from 0 on, ascending."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, pages: np.ndarray, n: int):
        # a mark before each block, two after each page: a border and one of its own
        begin = np.cumsum(sizes + 1) - (sizes + 1) + 2 * pages
        total = int(sizes.sum()) + len(sizes) + 2 * n
        self.tokens, self.page = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.block = np.full(total, -1, np.int64)
        at = np.repeat(begin + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(words))
        self.tokens[at] = words
        self.block[at] = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(np.bincount(pages, sizes + 1, n).astype(np.int64) + 2) - 1
        self.tokens[ends] = -1 - np.arange(n)
        self.page = np.repeat(np.arange(n), np.diff(ends, prepend=-1))
        # a run ends where its page does
        self.whole = ends[self.page] - np.arange(total) >= RUN if total else np.empty(0, bool)

    def pages_with(self) -> tuple[np.ndarray, np.ndarray]:
        """By suffix array: (rank of each suffix, of how many distinct pages a rank's first RUN tokens come)."""
        rank = suffix_ranks(self.tokens, RUN)
        n, width = int(rank.max()) + 1 if len(rank) else 0, len(self.page) + 1
        seen = np.unique(rank[self.whole] * width + self.page[self.whole]) // width
        return rank, np.bincount(seen, minlength=n)

    def runs(self, parts: int) -> np.ndarray:
        """Hash of the RUN tokens of each whole run, of more bits for a host in more parts."""
        at = np.flatnonzero(self.whole)
        out = np.zeros(len(at), np.uint64)
        for k in range(RUN):
            out = (out ^ self.tokens[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return (out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _bits(parts))

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """How many tokens of each block lie in a run that begins where `hit` says."""
        at = np.flatnonzero(self.whole & hit)
        change = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + RUN, -1)
        inside = (np.cumsum(change)[:-1] > 0) & (self.block >= 0)
        return np.bincount(self.block[inside], minlength=int(self.block.max(initial=-1)) + 1)


def _bits(parts: int) -> int:
    return 32 + int(parts).bit_length()


def standing(kinds: list[int], sections: list[int], sizes: list[int], hidden: list[int]) -> list[int]:
    """The blocks of a page's article. kinds, sections: of its blocks that aren't marked as
    something beside it; sizes, hidden: their tokens, and how many of these are covered."""
    parts: dict = {}
    for k, (kind, section) in enumerate(zip(kinds, sections, strict=True)):
        parts.setdefault((kind, section if kind < FREE else -1 - k), []).append(k)
    total = {p: sum(sizes[k] for k in own) for p, own in parts.items()}
    repeated = {p: sum(hidden[k] for k in own) >= COVERED * total[p] for p, own in parts.items()}
    unique = sum(n for p, n in total.items() if not repeated[p])
    stay = [p for p in parts if not repeated[p] or (p[0] < FREE and total[p] >= unique)]
    level = min((p[0] for p in stay or parts), default=FREE)
    return sorted(k for p in stay or parts if p[0] == level for k in parts[p])


# --------------------------------------------------------------------------- Spark jobs

def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_STREAMS = "host string, part long, parts long, key long, words binary, sizes binary, places binary"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each page by number, the words of its blocks, and the blocks' kinds and sections."""
    seen: set = set()
    for batch in batches:
        fresh = []
        for k, known in enumerate(zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), strict=True)):
            if known not in seen:
                seen.add(known)
                fresh.append(k)
        batch = batch.take(pa.array(fresh, pa.int64()))
        found = [sectioned(page) for page in batch.column("html").to_pylist()]
        words, sizes = numbered(pa.array([t for page in found for _, _, t in page], pa.string()))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        first = np.cumsum([0, *map(len, found)])
        places = [np.array([kind << 24 | section for kind, section, _ in page], "<i4").tobytes() for page in found]
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("host", "part", "parts", "key")),
            pa.array([words[ends[a]:ends[b]].tobytes() for a, b in itertools.pairwise(first)], pa.binary()),
            pa.array([sizes[a:b].astype("<i4").tobytes() for a, b in itertools.pairwise(first)], pa.binary()),
            pa.array(places, pa.binary())], ["host", "part", "parts", "key", "words", "sizes", "places"])


def _group(block: pa.Table) -> tuple[pa.Table, Streams, list[np.ndarray], list[np.ndarray]]:
    """The distinct pages of a group, their streams, sizes and places."""
    block = block.take(pa.array(np.unique(block.column("key").to_numpy(), return_index=True)[1]))
    words, sizes, places = ([np.frombuffer(b, kind) for b in block.column(c).to_pylist()]
                            for c, kind in (("words", "<u2"), ("sizes", "<i4"), ("places", "<i4")))
    pages = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
    streams = Streams(np.concatenate(words), np.concatenate(sizes).astype(np.int64), pages, len(sizes))
    return block, streams, sizes, places


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers, as differences, byte by byte of their significance."""
    steps = np.diff(values.astype("<u8"), prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view("u1").reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), "u1").reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


_REPORTS = "host string, range long, part long, n long, runs binary"


def _report(block: pa.Table) -> pa.Table:
    """The runs of a divided host's group, each once for every page up to MIN_PAGES, by ranges of their hashes."""
    host, part, parts = (block.column(c)[0].as_py() for c in ("host", "part", "parts"))
    ranges, n, runs = [], [], []
    if parts > 1:
        _, streams, _, _ = _group(block)
        rank, pages = streams.pages_with()
        ranks, first = np.unique(rank[streams.whole], return_index=True)
        values = np.sort(np.repeat(streams.runs(parts)[first], np.minimum(pages[ranks], MIN_PAGES)))
        # some RANGE groups' worth of runs meet in a range
        range_of = values * np.uint64(-(-parts // RANGE)) >> np.uint64(_bits(parts))
        ranges, begins = np.unique(range_of, return_index=True)
        each = np.split(values, begins[1:]) if len(values) else []
        n, runs = [len(x) for x in each], [packed(x) for x in each]
    return pa.table({"host": pa.array([host] * len(n), pa.string()), "range": pa.array(np.asarray(ranges, np.int64)),
                     "part": pa.array([part] * len(n), pa.int64()), "n": pa.array(n, pa.int64()),
                     "runs": pa.array(runs, pa.binary())})


def _add_up(block: pa.Table) -> pa.Table:
    """For each group, those of its runs that MIN_PAGES pages of the whole host hold."""
    runs = [unpacked(b, n) for b, n in zip(block.column("runs").to_pylist(), block.column("n").to_pylist(), strict=True)]
    values, pages = np.unique(np.concatenate(runs), return_counts=True)
    values = values[pages >= MIN_PAGES]
    own = [np.intersect1d(x, values) for x in runs]
    return pa.table({"host": block.column("host"), "part": block.column("part"),
                     "n": pa.array([len(x) for x in own], pa.int64()), "runs": pa.array([packed(x) for x in own], pa.binary())})


def _decide(block: pa.Table, known: pa.Table) -> pa.Table:
    """The blocks that make up the article (counting those not marked as something beside it),
    for pages where these aren't the ones that the marks alone give."""
    hosts, keys, kept = [], [], []
    if block.num_rows:
        parts = block.column("parts")[0].as_py()
        block, streams, sizes, places = _group(block)
        if parts > 1:
            runs = [unpacked(b, n) for b, n in zip(known.column("runs").to_pylist(), known.column("n").to_pylist(), strict=True)]
            hit = np.zeros(len(streams.tokens), bool)
            hit[streams.whole] = np.isin(streams.runs(parts), np.concatenate([np.empty(0, np.uint64), *runs]))
        else:
            rank, pages = streams.pages_with()
            hit = (pages >= MIN_PAGES)[rank]
        hidden = streams.covered(hit)
        hidden = np.concatenate([hidden, np.zeros(sum(map(len, sizes)) - len(hidden), np.int64)])
        at = 0
        for p, (size, place) in enumerate(zip(sizes, places, strict=True)):
            mine = np.flatnonzero(place >> 24 < APART_TEXT)
            kinds = (place[mine] >> 24).tolist()
            left = standing(kinds, place[mine].tolist(), size[mine].tolist(), hidden[at + mine].tolist())
            at += len(size)
            if left != marked(kinds):
                hosts.append(block.column("host")[p].as_py())
                keys.append(block.column("key")[p].as_py())
                kept.append(left)
    return pa.table({"host": pa.array(hosts, pa.string()), "key": pa.array(keys, pa.int64()),
                     "kept": pa.array(kept, pa.list_(pa.int32()))})


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each page that it doesn't mark as something beside the article, and those
    of them that its marks make the article."""
    for batch in batches:
        found = [[b for b in blocks(page) if b[0] < APART_TEXT] for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("page_id", "url", "host", "key")),
            pa.array([[t for _, t in page] for page in found], pa.list_(pa.string())),
            pa.array([marked([kind for kind, _ in page]) for page in found], pa.list_(pa.int32()))],
            ["page_id", "url", "host", "key", "texts", "marked"])


def verdicts(pages: DataFrame, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """pages: host, key (of the content), html. (host, key, kept): the blocks that the suffix array
    leaves of each page, where these aren't the ones that its marks alone give."""
    parts = pages.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / HTML_CHARS / group_tokens).alias("parts"))
    # few: each of these hosts has more html than a group
    divided = F.broadcast(parts.where("parts > 1"))
    dealt = pages.join(divided, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("part", F.pmod("key", "parts")).select("host", "part", "parts", "key", "html")
    # both uses below read this one exchange
    dealt = dealt.mapInArrow(_streams, _STREAMS).repartition("host", "part")
    reports = dealt.groupBy("host", "part").applyInArrow(_report, _REPORTS)
    known = reports.groupBy("host", "range").applyInArrow(_add_up, "host string, part long, n long, runs binary")
    return saved(dealt.groupBy("host", "part").cogroup(known.groupBy("host", "part")).applyInArrow(
        _decide, "host string, key long, kept array<int>"))


def main_texts(pages: DataFrame, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""
    small_batches(pages.sparkSession, 500)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", _host())
    rows = rows.withColumn("key", F.xxhash64("html"))
    judged = verdicts(rows.select("host", "key", "html"), group_tokens)
    kinds = dict(pages.dtypes)
    found = rows.mapInArrow(_candidates, f"page_id {kinds['page_id']}, url string, host string, key long, "
                                         "texts array<string>, marked array<int>")
    kept = F.coalesce("kept", "marked")
    text = F.array_join(F.transform(kept, lambda k: F.get("texts", k)), "\n")
    return found.join(judged, ["host", "key"], "left").select("page_id", "url", text.alias("text")) \
        .withColumn("n_chars", F.char_length("text").cast("long"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op12_html_text": op12_html_text}
ORACLES: dict[str, str] = {}
