"""Quality rules: decision lists learned by sequential covering.

Statistics of labelled documents (a bounded sample) go to the driver, where rules are grown
and pruned one after another: a rule is a conjunction of thresholds that singles out
documents labelled as bad; what it covers is set aside, and the next rule is grown on the
rest. The list becomes one ordered Spark conditional over the statistics of all documents,
which are built-in expressions from end to end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table
from .labelled import labelled_sample

SAMPLE_ROWS = 6000   # labelled documents that the rules are learned from, at most
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 16, 4, 64
MIN_COVER = 4        # bad documents that a rule must cover while growing
MIN_PRECISION = 0.98  # on the documents kept for pruning
INDEX_BITS = 20


# -- statistics --------------------------------------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(words: Column) -> Column:
    """Words in 3-word windows found twice or more, given the array of words.

    Windows are hashed; hash and position are packed in one long (44 bits of hash, 20 of
    position), sorted, and neighbours compared by their whole hashes. Texts of 2 ** 20 words
    and more sort pairs of hash and position instead.
    """
    index = F.lit((1 << INDEX_BITS) - 1).cast("long")
    n = F.size(words)

    def hashes() -> Column:
        return F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
                           lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def positions_packed(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(
            F.shiftrightunsigned(x, INDEX_BITS), INDEX_BITS).bitwiseOR(i.cast("long"))))

        def same(x: Column, y: Column) -> Column:
            return F.coalesce(
                (F.shiftrightunsigned(x.bitwiseXOR(y), INDEX_BITS) == 0)
                & (F.get(h, x.bitwiseAND(index).cast("int")) == F.get(h, y.bitwiseAND(index).cast("int"))),
                F.lit(False))

        return let(packed, lambda s: F.transform(F.filter(
            s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1))),
            lambda x: x.bitwiseAND(index)))

    def positions_paired(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))

        def same(x: Column, y: Column) -> Column:
            return F.coalesce(x["h"] == y["h"], F.lit(False))

        return let(paired, lambda s: F.transform(F.filter(
            s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1))),
            lambda x: x["i"]))

    def covered(places: Column) -> Column:
        # a window covers three words, fewer where the next one begins within it
        return let(F.sort_array(places), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    return let(hashes(), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
               .when(n < (1 << INDEX_BITS), covered(positions_packed(h)))
               .otherwise(covered(positions_paired(h))))


def _only(text: Column, group: str) -> Column:
    """How many characters of the group the text holds."""
    return F.length(F.regexp_replace(text, f"[^{group}]+", "")).cast("long")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "n_capitals", "n_lines")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with the STATISTICS columns (replaced where they exist) of the
    whole text. A null or empty text has zeros."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != text and c not in STATISTICS]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    both = let(F.regexp_extract_all(whole, F.lit(f"({WORD})")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated(w).alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (df.select(*kept, both.alias("_words"), lined.alias("_lines"),
                      _only(whole, r"#*$%&|<>").alias("n_symbols"),
                      _only(whole, "A-Z").alias("n_capitals"))
            .select(*kept, "_words.*", "_lines.*", "n_symbols", "n_capitals"))


#: What conditions compare: statistics per word, line or character, so that rules don't
#: depend on a text's length.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "words")


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("n_repeat_words") / words,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "words": F.col("n_words").cast("double"),
    }


# -- learning ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column >= self.threshold if self.above else column < self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        at = F.lit(float(self.threshold))
        return values[self.feature] >= at if self.above else values[self.feature] < at


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), dtype=bool)
    for c in rule:
        on &= c.holds(x)
    return on


def _candidates(x: np.ndarray) -> list[Condition]:
    """Thresholds half-way between neighbouring quantiles of each feature."""
    found = []
    for k, name in enumerate(FEATURES):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, THRESHOLDS)))
        for t in ((cuts[1:] + cuts[:-1]) / 2).tolist():
            found += [Condition(name, True, t), Condition(name, False, t)]
    return found


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    on = np.ones(len(x), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (on & ~bad).any():
        p, n = int((on & bad).sum()), int((on & ~bad).sum())
        before = np.log2(p / (p + n))
        best, gain = None, 0.0
        for c in _candidates(x[on]):
            held = on & c.holds(x)
            q, m = int((held & bad).sum()), int((held & ~bad).sum())
            if q >= MIN_COVER:
                got = q * (np.log2(q / (q + m)) - before)
                if got > gain + 1e-9:
                    best, gain = c, got
        if best is None:
            break
        rule.append(best)
        on &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> tuple[list[Condition], float]:
    """The beginning of the rule that does best on documents it wasn't grown on, and its
    precision there."""
    best, worth, precision = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        on = _covers(rule[:k], x)
        p, n = int((on & bad).sum()), int((on & ~bad).sum())
        if p + n and (p - n) / (p + n) >= worth:
            best, worth, precision = rule[:k], (p - n) / (p + n), p / (p + n)
    return best, precision


def learn_rules(x: np.ndarray, bad: np.ndarray, grow: np.ndarray) -> list[list[Condition]]:
    """An ordered list of rules that reject; x by FEATURES, grow marks the rows to grow on
    (the rest prune). Rows with too few bad documents give no rule."""
    rules: list[list[Condition]] = []
    left = np.ones(len(x), dtype=bool)
    for _ in range(2 * MAX_RULES):
        g, p = left & grow, left & ~grow
        if int(bad[g].sum()) < MIN_COVER:
            break
        rule = _grow(x[g], bad[g])
        if not rule:
            break
        rule, precision = _prune(rule, x[p], bad[p])
        if precision < MIN_PRECISION:
            left &= ~(_covers(rule, x) & bad & grow)  # nothing safe to learn from these
            continue
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules[:MAX_RULES]


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules from the labelled documents among `docs` (doc_id, text) that pass the base: at
    most `rows` rows of numbers reach the driver. No labelled document gives no rule."""
    # kept before the statistics, so that filters on them aren't pushed to all documents
    sample = checkpointed(labelled_sample(docs.select("doc_id", "text"), labels, rows))
    sample = with_statistics(sample).where(~base_failed())
    values = features()
    data = sample.select("doc_id", (F.col("_quality") < 1).alias("bad"),
                         (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) != 0).alias("grow"),
                         *[values[f].alias(f) for f in FEATURES]).collect()
    data.sort(key=tuple)
    x = np.array([[r[f] for f in FEATURES] for r in data], dtype=float).reshape(-1, len(FEATURES))
    bad, grow = (np.array([r[c] for r in data], dtype=bool) for c in ("bad", "grow"))
    return learn_rules(x, bad, grow)


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds rejects
    (0-based); null keeps."""
    values = features()
    found = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        on = F.lit(True)
        for c in rule:
            on = on & c.column(values)
        found = F.when(on, F.lit(k)).otherwise(found)
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(df: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """df (no text needed beyond its statistics) with base_failed, rule (the first rule that
    rejects, or null) and kept. Texts with fewer than 50 words, empty and null ones among
    them, fail the base; equal texts are judged alike; an empty table stays empty."""
    judged = with_statistics(df)
    return judged.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)) \
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op9_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


QUERIES = {"op9_decision_lists": op9_decision_lists}
ORACLES: dict[str, str] = {}
