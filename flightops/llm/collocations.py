"""Phrase collocation mining: Misra-Gries summaries, then an exact second pass.

First pass. Every phrase occurrence (1 to 4 words within a piece) has a 64-bit hash; its high
bits choose one of P hash partitions. A map task hands each partition a summary of its own
occurrences, and the partition's task merges these into one Misra-Gries summary. Its capacity
exceeds the partition's mass divided by the threshold, so that every phrase found `threshold`
times survives: what a counter has lost is at most mass / (capacity + 1), and the loss is
known exactly, so all others that could not have reached the threshold go. P follows the
text's bytes, so a task holds some 8 million occurrences whatever the corpus; summaries
are merged before they travel, so a frequent phrase is one counter a task and no hot spot.

The pass runs twice, for 1 and 2 words and then for 3 and 4: a longer phrase is summarised
only where all its word pairs survived, as no phrase is more frequent than a part of it.

Second pass. Survivors are a bit set over hashes, of fixed size: it has no false negatives, and
a false positive only lets an infrequent phrase be counted too. Phrases that pass are counted
by their words, exactly (words are interned, phrases numbered pair by pair, never by hash).

Defined results: null and empty texts have no words; a null lang is `und`, together with
texts so marked; repeated rows count each time; an empty table gives no rows; extra
columns are ignored. Texts of any length are read whole: a batch works through slices
of some 1 MB that overlap by nothing but whole words (one word longer than that is one slice).
Collisions of hashes cost work, never a phrase. Ranks are made in two steps, so that no task
sorts a whole language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, small_batches, table, text_or_empty

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
#: Phrase occurrences a hash partition should have; bounds a task's memory.
PART_MASS = 8_000_000
#: Counters beyond what the guarantee needs: fewer rounds of losses, sharper survivors.
SLACK = 4
BITS = 1 << 27
#: Occurrences that a map task gathers before it hands them on as summaries.
GATHER = 2_000_000
SLICE = 1 << 20
#: Bits of a hash that travel, beside its partition; collisions only let more phrases survive.
KEY_BITS = 32

BLANK, BREAK = " \t", ".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in BLANK]] = 1
_CLASS[[ord(c) for c in BREAK]] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


# --------------------------------------------------------------------------- summaries

class MisraGries:
    """Mergeable summary of weighted keys: at most `capacity` counters; each is its key's weight
    less at most `lost`, which is at most mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = combined(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(keys) > self.capacity:
            cut = np.partition(counts, -(self.capacity + 1))[-(self.capacity + 1)]
            self.lost += int(cut)
            stays = counts > cut
            keys, counts = keys[stays], counts[stays] - cut
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        """The keys whose weight may have reached `threshold`, every one that did included."""
        return self.keys[self.counts + self.lost >= threshold]


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys become one with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# --------------------------------------------------------------------------- words

class Words:
    """The words of a batch: spans in its bytes, piece and row of each."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) \
            if n else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None \
            else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = _CLASS[self.data]
        inside = kind == 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        starts_row = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[starts_row] = inside[starts_row]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[last] = inside[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        breaks = kind == 2
        breaks[starts_row] = True
        piece = np.flatnonzero(breaks)
        self.piece = np.searchsorted(piece, self.start, "right")
        self.inside = inside

    def windows(self, n: int) -> np.ndarray:
        """Whether n words from each word on lie in one piece."""
        out = np.zeros(len(self.piece), bool)
        if len(out) >= n:
            out[:len(out) - n + 1] = self.piece[:len(out) - n + 1] == self.piece[n - 1:]
        return out

    def hashes(self) -> np.ndarray:
        """A polynomial hash of each word's lower-cased bytes."""
        out = np.empty(len(self.start), np.uint64)
        k = 0
        while k < len(out):
            base = self.start[k]
            j = max(k + 1, int(np.searchsorted(self.end, base + SLICE, "right")))
            span = int(self.end[j - 1] - base)
            up, down = _powers(span + 1)
            low = _LOW[self.data[base:base + span]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(span + 1, np.uint64)
            np.cumsum(low * up[:span], out=sums[1:])
            s, e = self.start[k:j] - base, self.end[k:j] - base
            out[k:j] = (sums[e] - sums[s]) * down[s]
            k = j
        return out

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Exact numbers of the words, and the word of each number."""
        kept = np.ascontiguousarray(_LOW[self.data[self.inside]])
        offsets = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_string(), len(self.start),
                                      [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_hashes(words: Words, seeds: np.ndarray) -> list[np.ndarray]:
    """Hashes of the phrases of 1 to LONGEST words from each word on (valid where `windows`
    says so); seeds: one a row, of its language."""
    plain = _mixed(words.hashes())
    out = [_mixed(plain ^ seeds[words.row])]
    for n in range(1, LONGEST):
        longer = out[-1].copy()
        if len(longer) > n:
            longer[:-n] = _mixed(out[-1][:-n] * np.uint64(_ODD) + plain[n:] + np.uint64(n))
        out.append(longer)
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, pa.Array]]:
    """Words, a seed a row, and the languages."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names = langs.dictionary.to_pylist()
        seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names] or [0], np.uint64)
        codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = batch.column(1)
        yield Words(text.cast(pa.string())), seeds[codes], langs


# --------------------------------------------------------------------------- first pass

def _map_summaries(lengths: tuple[int, ...], parts: int, pairs_kept):
    """Each task's occurrences by hash partition: keys of 4 bytes, and their counts."""
    def hand_on(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8]
        used = np.flatnonzero(np.diff(edges))
        return pa.RecordBatch.from_pydict({
            "part": pa.array(used, pa.int32()),
            "keys": pa.array([raw[edges[p]:edges[p + 1]].tobytes() for p in used], pa.binary()),
            "counts": pa.array([counts[edges[p]:edges[p + 1]].astype("<u4").tobytes() for p in used], pa.binary())})

    def run(batches):
        found, size = [], 0
        for words, seeds, _ in _batches(batches):
            hashes = phrase_hashes(words, seeds)
            good = None
            if pairs_kept is not None:
                good = words.windows(2) & marked(pairs_kept.value, hashes[1])
            for n in lengths:
                valid = words.windows(n)
                if good is not None:
                    for k in range(n - 1):
                        valid[:len(valid) - k] &= good[k:]
                found.append(hashes[n - 1][valid])
                size += len(found[-1])
            if size >= GATHER:
                yield hand_on(found)
                found, size = [], 0
        if size:
            yield hand_on(found)
    return run


def _reduce_summaries(threshold: int):
    """One partition's summaries merged; the places of its survivors in the bit set."""
    def run(block: pa.Table) -> pa.Table:
        counts = [np.frombuffer(c, "<u4") for c in block.column("counts").to_pylist()]
        mass = sum(int(c.sum(dtype=np.int64)) for c in counts)
        summary = MisraGries(SLACK * mass // threshold + 1)
        waiting, size = [], 0
        for raw, count in zip(block.column("keys").to_pylist(), counts, strict=True):
            wide = np.zeros((len(count), 8), np.uint8)
            wide[:, :KEY_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(len(count), -1)
            waiting.append((wide.view("<i8").ravel(), count.astype(np.int64)))
            size += len(count)
            if size >= summary.capacity:
                summary.merge(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, size = [], 0
        if waiting:
            summary.merge(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        return pa.table({"place": np.unique(summary.survivors(threshold) & (BITS - 1))})
    return run


def survivors(texts: DataFrame, lengths: tuple[int, ...], parts: int, threshold: int, pairs_kept=None):
    """A broadcast bit set (BITS bits, whatever the corpus) that marks every phrase of these
    lengths found `threshold` times or more."""
    spark = texts.sparkSession
    mapped = texts.mapInArrow(_map_summaries(lengths, parts, pairs_kept), "part int, keys binary, counts binary")
    found = mapped.groupBy("part").applyInArrow(_reduce_summaries(threshold), "place long")
    # 64 places a word: at most BITS / 64 rows come to the driver
    packed = found.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, "<u8")
    bits[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits.view(np.uint8))


# --------------------------------------------------------------------------- second pass

def _count_exactly(kept: list):
    """Occurrences of marked phrases by language and words, and all words a language (phrase
    null). Phrases are numbered exactly, a word at a time."""
    def run(batches):
        for words, seeds, langs in _batches(batches):
            hashes = phrase_hashes(words, seeds)
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.row]
            ids, names = words.ids()
            total = np.bincount(lang, minlength=len(langs.dictionary))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": langs.dictionary.take(pa.array(seen)), "phrase": pa.nulls(len(seen), pa.string()),
                "n": pa.array(total[seen], pa.int64())})
            size = max(len(names), 1)
            for n in range(1, LONGEST + 1):
                at = np.flatnonzero(words.windows(n) & marked(kept[n > 2].value, hashes[n - 1]))
                if not len(at):
                    continue
                number = lang[at]
                for k in range(n):
                    # dense numbers times words of the batch stay far below 2^63
                    _, number = np.unique(number * size + ids[at + k], return_inverse=True)
                _, first, count = np.unique(number, return_index=True, return_counts=True)
                at = at[first]
                parts = [names.take(pa.array(ids[at + k])) for k in range(n)]
                phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_pydict({
                    "lang": langs.dictionary.take(pa.array(lang[at])), "phrase": phrase.cast(pa.string()),
                    "n": pa.array(count, pa.int64())})
    return run


def frequent_phrases(texts: DataFrame, threshold: int = MIN_COUNT) -> DataFrame:
    """texts: lang, text (no nulls). (lang, phrase, n) of every phrase of 1 to 4 words found
    `threshold` times in its language, with its exact count; phrase null: all words."""
    small_batches(texts.sparkSession, 500)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // PART_MASS) + 1     # two bytes a word at least, two lengths a pass
    short = survivors(texts, (1, 2), parts, threshold)
    long = survivors(texts, (3, 4), parts, threshold, short)
    counted = texts.mapInArrow(_count_exactly([short, long]), "lang string, phrase string, n long")
    return saved(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
                 .where(F.col("phrase").isNull() | (F.col("n") >= threshold)))


def collocations(docs: DataFrame, threshold: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        text_or_empty().alias("text"))
    counts = frequent_phrases(texts, threshold)
    totals = counts.where("phrase is null").select("lang", F.col("n").alias("_total"))
    phrases = counts.where("phrase is not null").select("lang", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    longer = phrases.withColumn("_w", words).where(F.size("_w") > 1)

    def part(begin, end):
        return F.array_join(F.slice("_w", begin, end), " ")

    cuts = longer.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("_k"))
    cuts = cuts.select("lang", "phrase", "a", "_k", part(F.lit(1), F.col("_k")).alias("_first"),
                       part(F.col("_k") + 1, F.size("_w") - F.col("_k")).alias("_rest"))
    # every part of a frequent phrase is as frequent, so both inner joins find it
    side = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(side("_first", "l"), ["lang", "_first"]).join(side("_rest", "r"), ["lang", "_rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("_dividend", (wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")) \
        .withColumn("_divisor", (wide("l") + wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("_dividend div _divisor"))
    lowest = F.min(F.struct("score", "_k", "l", "r")).alias("_cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select(
        "lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    inner = longer.where(F.size("_w") > 2).select("lang", F.col("a").alias("_f"), "_w",
                                                 F.explode(F.sequence(F.lit(2), F.size("_w") - 1)).alias("_n"))
    inner = inner.select("lang", "_f", "_w", "_n", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1)).alias("_at"))
    inner = inner.groupBy("lang", part(F.col("_at"), F.col("_n")).alias("phrase")).agg(F.max("_f").alias("_f"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("_f").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("_f") < F.lit(80).cast("decimal(3,0)") * wide("a")))
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))) \
        .where(F.col("_r") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("_total").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    nexts = ", ".join(f"lead(w, {k}) over o as w{k}" for k in range(1, LONGEST))
    grams = " union all ".join(
        "select lang, {} as phrase, {} as k from words where {}".format(
            " || ' ' || ".join(["w", *[f"w{j}" for j in range(1, n)]]), n,
            f"w{n - 1} is not null" if n > 1 else "true") for n in range(1, LONGEST + 1))
    return f"""
with base as (select row_number() over () as doc, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), '{upper}', '{lower}') as text from documents),
pieces as (select doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece,
    generate_subscripts(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]'), 1) as piece_no from base),
parts as (select doc, lang, piece_no, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from pieces),
flat as (select doc, lang, piece_no, unnest(ws) as w, generate_subscripts(ws, 1) as i from parts),
words as (select *, {nexts} from flat window o as (partition by doc, piece_no order by i)),
totals as (select lang, count(*) as n from flat group by lang),
freq as (select lang, phrase, k, count(*) as a from ({grams}) group by all having count(*) >= {MIN_COUNT}),
longer as (select *, string_split(phrase, ' ') as ws from freq where k > 1),
cuts as (select lang, phrase, k, a, ws, unnest(range(1, k)) as c from longer),
scored as (select x.lang, x.phrase, x.a, x.c, f.a as l, r.a as r,
    (2000000::hugeint * x.a // (f.a + r.a))::bigint as score
    from cuts x join freq f on f.lang = x.lang and f.phrase = array_to_string(x.ws[1:x.c], ' ')
    join freq r on r.lang = x.lang and r.phrase = array_to_string(x.ws[x.c + 1:x.k], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (select lang, a, k, ws, unnest(range(2, k)) as m from longer),
places as (select *, unnest(range(1, k - m + 2)) as s from inside),
cover as (select lang, array_to_string(ws[s:s + m - 1], ' ') as phrase, max(a) as f from places group by all),
kept as (select o.* from lowest o left join cover c on c.lang = o.lang and c.phrase = o.phrase
    where c.f is null or 100::hugeint * c.f < 80::hugeint * o.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select q.lang, q.rank, q.phrase, q.a, q.l, q.r, t.n, q.score from ranked q join totals t on t.lang = q.lang
where q.rank <= {TOP}"""


QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": _oracle()}
