"""Collocations, HTML extraction and the Merkle manifest against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightops.llm import collocations, html_extraction, merkle_manifest

LOWER = str.maketrans(merkle_manifest.UPPER, merkle_manifest.LOWER)


# --------------------------------------------------------------------------- collocations

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=60), max_size=6), st.integers(2, 9))
def test_misra_gries_merges_keep_every_frequent_key(blocks, threshold):
    true = Counter(k for b in blocks for k in b)
    mass = sum(true.values())
    summary = collocations.MisraGries(mass // threshold + 1)
    for b in blocks:
        summary.merge(np.array(b, np.int64), np.ones(len(b), np.int64))
    assert {k for k, n in true.items() if n >= threshold} <= set(summary.survivors(threshold).tolist())
    assert summary.lost * (summary.capacity + 1) <= mass
    for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True):
        assert true[k] - summary.lost <= n <= true[k]


def _phrases(rows, threshold, top):
    """The definition, literally."""
    count, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for k in range(len(words) - n + 1):
                    at = (lang, tuple(words[k:k + n]))
                    count[at] = count.get(at, 0) + 1
    found = {}
    for (lang, p), a in count.items():
        if a >= threshold and len(p) > 1:
            cuts = [((2_000_000 * a) // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            hidden = any(g == lang and len(q) > len(p) and f >= threshold and 100 * f >= 80 * a
                         and any(q[j:j + len(p)] == p for j in range(len(q) - len(p) + 1)) for (g, q), f in count.items())
            if not hidden:
                found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, count[lang, p[:k]], count[lang, p[k:]]))
    return {(lang, r, p.decode(), a, left, right, total[lang], -score) for lang, rows in found.items()
            for r, (score, _, p, a, left, right) in enumerate(sorted(rows)[:top], 1)}


def test_collocations_against_definition(spark):
    rng = random.Random(4)
    vocabulary = ["New", "york", "is", "a", "big", "city", "é日", "\xa0x", "z\x1c", "the", "of", "x-1"]
    rows = []
    for k in range(160):
        words = rng.choices(vocabulary, [9, 1, 5, 4, 2, 2, 1, 1, 1, 9, 7, 1], k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for w in words) + "in New York city"
        rows.append(([None, "en", "en", "und"][k % 4], text))
    rows += [("en", None), (None, ""), ("de", " \t.;"), ("en", "new york " * 4000), *[rows[0]] * 3]
    docs = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, n int, phrase string")
    got = {tuple(r) for r in collocations.collocations(docs, 6, 40).collect()}
    assert got == _phrases(rows, 6, 40) and any(r[0] == "und" for r in got)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_words_of_long_texts_are_whole(monkeypatch):
    import pyarrow as pa
    texts = ["", "Ab c,d " * 50, None, "x" * 500 + " Y", "é\té"]
    plain = collocations.Words(pa.array(texts, pa.string())).hashes()
    monkeypatch.setattr(collocations, "SLICE", 16)
    words = collocations.Words(pa.array(texts, pa.string()))
    assert (words.hashes() == plain).all() and len(set(plain.tolist())) == len({"ab", "c", "d", "x" * 500, "y", "é"})
    ids, names = words.ids()
    assert [names[i].as_py() for i in ids][:4] == ["ab", "c", "d", "ab"]


# --------------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-banner">We use</div>
<article class="post"><header><h1>A &amp; B</h1></header><p>One  <b>two<br>three <p>four&nbsp;&lt;five&gt; &amp</p><aside>Side</aside>
<div id="adSlot">Buy</div><table><tr><td>c1<td>c2</table><form>Mail</form><section class="comments"><article>me too</article></section>
last &copy; words</article><footer>&copy; foot</footer><!-- gone <p>x</p> --></body></html>"""


def test_parser_takes_the_article_alone():
    found = html_extraction.blocks(PAGE)
    assert html_extraction.article(found) == "A & B\nOne two three\nfour <five> &\nc1\nc2\nlast © words"
    text = html_extraction.article
    blocks = html_extraction.blocks
    assert text(blocks("<div class=ad>x<article><p>kept <span>on")) == "kept on"
    assert text(blocks("<main><h2>a</h2><nav>n</nav>b")) == "a\nb"
    assert text(blocks("<p>free")) is None and blocks("") == [] and text(blocks("<nav>x</nav>")) is None
    assert text(blocks('<article><p title="a > b">x</p><p class=\'ad\'>y<p>z <unfinished')) == "x\nz"
    assert text(blocks("<article>a<script>if (1 < 2) '</article>'</scrip")) == "a"
    assert text(blocks("<article>" + "<b \"" * 2000 + "<p>end</p></article>"))
    long = "<article>" + "<div>" * 3000 + "<p>word " * 20000
    assert text(blocks(long)).count("\n") == 19999


def test_suffix_ranks_against_sorting():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 5, 6, 8):
        tokens = rng.integers(0, 3, 200)
        runs = [tuple(tokens[k:k + depth]) for k in range(len(tokens))]
        order = {r: k for k, r in enumerate(sorted(set(runs)))}
        assert html_extraction.suffix_ranks(tokens, depth).tolist() == [order[r] for r in runs]


def _repeated_by_definition(pages, least):
    """Runs of RUN tokens on `least` distinct pages, and the blocks they cover."""
    streams = [[t for text in page for t in ["|", *text.split()]] + ["|"] for page in pages]
    where = {}
    for p, s in enumerate(streams):
        for k in range(len(s) - html_extraction.RUN + 1):
            where.setdefault(tuple(s[k:k + html_extraction.RUN]), set()).add(p)
    out = []
    for page, s in zip(pages, streams, strict=True):
        hit = [False] * len(s)
        for k in range(len(s) - html_extraction.RUN + 1):
            if len(where[tuple(s[k:k + html_extraction.RUN])]) >= least:
                hit[k:k + html_extraction.RUN] = [True] * html_extraction.RUN
        at, left = 0, []
        for text in page:
            n = len(text.split())
            if sum(hit[at + 1:at + 1 + n]) < html_extraction.COVERED * n:
                left.append(text)
            at += n + 1
        out.append("\n".join(left or page))
    return out


def test_pages_without_marks_lose_what_their_host_repeats(spark):
    rng = random.Random(6)
    menu, notice = ["Home", "News", "About us", "Contact"], "All rights reserved by the owners of this site"
    pages = []
    for k in range(60):
        own = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 30))) for _ in range(3)]
        pages.append([*(menu if k % 3 else menu[:2]), *own, notice + (f" {k}" if k % 2 else "")])
    want = _repeated_by_definition(pages, html_extraction.MIN_PAGES)
    assert sum("Home" in w for w in want) < 30
    rows = [(k, f"http://Host.example/{k}", "".join(f"<div>{t}</div>" for t in p), 3) for k, p in enumerate(pages)]
    rows += [(70, None, None, 1), (None, "http://host.example:80/x", "", 1), (71, "no url", "<article>é</article>", 1), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    for tokens in (10 ** 6, 300):
        got = html_extraction.main_texts(df.drop("text"), tokens).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r.text for r in got}
        assert [by[k] for k in range(60)] == want and by[70] == by[None] == "" and by[71] == "é"
        assert all(r.n_chars == len(r.text) for r in got)
    assert html_extraction.main_texts(df.limit(0)).count() == 0


def test_suffix_array_judges_marked_articles_too(spark):
    rng = random.Random(7)
    own = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(40)]
    card, shared = "Read our guide to the ten best offers of this week", "This passage stands in the articles of many pages here"
    carried = " ".join(f"c{rng.randrange(5000)}" for _ in range(60))
    menu = "<nav>Home</nav><div class=comment>A reader writes something new here</div>"
    # a card marked up as an article beside one, and beside text without any; a passage that articles share;
    # an article that several pages carry
    html = [f"{menu}<article>{card}</article><article><p>{t}<p>{shared}</article>" if k % 4 == 0 else
            f"{menu}<article>{card}</article><div>{t}</div>" if k % 4 == 1 else
            f"{menu}<main><p>{shared}<p>{t}</main>" if k % 4 == 2 else
            f"{menu}<article>{carried}</article><div>Page number {k} of this site</div>" for k, t in enumerate(own)]
    want = [f"{t}\n{shared}" if k % 4 == 0 else t if k % 4 == 1 else f"{shared}\n{t}" if k % 4 == 2 else carried
            for k, t in enumerate(own)]
    rows = [(k, "https://site.example/x", page) for k, page in enumerate(html)] + [(0, "https://site.example/y", html[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for tokens in (10 ** 6, 200):
        got = html_extraction.main_texts(df, tokens).collect()
        # before: the card was text wherever it was marked up as an article
        assert len(got) == 41 and {(r.page_id, r.text) for r in got} == set(enumerate(want))


# --------------------------------------------------------------------------- manifest

def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    """(root, siblings text of each node, (left, right) of each level)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
    paths = []
    for k in range(len(nodes)):
        path, at = [], k
        for level in levels[:-1]:
            run = level[at // 16 * 16:at // 16 * 16 + 16]
            path.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 5, "b": 16, "a": 17, "": 300, "é": 1}, {"a": 4097, None: 2}])
def test_manifest_against_plain_trees(spark, sizes):
    rows = []
    for source, n in sizes.items():
        rows += [(k * 7 % n if k % 11 else None, source, [None, "en"][k % 2], k % 5 or None, [None, "", "Text é", "plain", "A"][k % 5])
                 for k in range(n)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string")
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((-1 if r[0] is None else r[0], _leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([leaf for _, leaf in sorted(by[s])]) for s in order}
    root, upper = _tree([trees[s][0] for s in order])
    want = Counter()
    for place, s in enumerate(order):
        for (doc, leaf), path in zip(sorted(by[s]), trees[s][1], strict=True):
            proof = _h("".join(a + b for a, b in path + upper[place]))
            want[None if doc < 0 else doc, leaf, trees[s][0], root, proof] += 1
    fields = [docs[c] for c in merkle_manifest.FIELDS]
    leaf = merkle_manifest.leaf_digest(fields)
    from pyspark.sql import functions as F
    bad = F.coalesce(docs.doc_id % 3 == 0, F.lit(False))
    got = merkle_manifest.manifest(docs.select("doc_id", "source", leaf.alias("leaf"),
                                               F.when(bad, F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise(leaf).alias("found"))).collect()
    proofs = Counter(tuple(r)[:5] for r in got)
    # proofs of equal rows differ by place only, so they are compared as a bag
    assert proofs == want
    assert all(r.verified == (r.folded_root == root) for r in got)
    assert all(r.verified for r in got if r.doc_id is None or r.doc_id % 3)
    assert not any(r.verified for r in got if r.doc_id is not None and r.doc_id % 3 == 0)


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, leaf string, found string")
    assert merkle_manifest.manifest(empty).count() == 0
