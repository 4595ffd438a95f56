"""The language model's score and the neighbour vote by their definitions, word by word; chats
without ids."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flightops.llm import chat_prefixes, interpolated_lm, neighbour_quality


def test_language_model_score_by_definition(spark):
    rng = np.random.default_rng(4)
    words = [f"W{k}" for k in range(40)] + ["é日", "the", "The"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(43, 0, -1) / 946)) for _ in range(300)]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)] + [(7, None), (7, ""), *[(9, "the the the")] * 3]
    got = interpolated_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), range_keys=300).collect()

    def tokens(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return low.split() + ["\n"]

    def part(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % interpolated_lm.FOLDS
    counts = {True: (Counter(), Counter(), Counter()), False: (Counter(), Counter(), Counter())}
    for i, text in rows:
        if part(i) == interpolated_lm.HELD_OUT:
            continue
        for kept_only in (True, False):
            if kept_only and part(i) == interpolated_lm.DELETED:
                continue
            word, context, pair = counts[kept_only]
            before = "^"
            for t in tokens(text):
                word[t] += 1
                pair[before, t] += 1
                context[before] += 1
                before = t
    # every word is a context as often as it occurs; the start as often as documents end
    for kept_only in (True, False):
        counts[kept_only][1].update({t: n - counts[kept_only][1][t] for t, n in counts[kept_only][0].items() if t != "\n"})

    def parts(kept_only, before, t):
        word, context, pair = counts[kept_only]
        seen = context[before]
        return seen, pair[before, t] / seen if seen else 0.0, word[t] / max(1, sum(word.values()))
    uniform = 1 / (len(counts[False][0]) + 1)
    cells = Counter()
    for i, text in rows:
        if part(i) == interpolated_lm.DELETED:
            before = "^"
            for t in tokens(text):
                seen, a, b = parts(True, before, t)
                cells[(int(math.log2(seen)) + 1 if seen else 0,
                       *(round(8 * math.log2(p)) if p else interpolated_lm.NONE for p in (a, b)))] += 1
                before = t
    weights = interpolated_lm.learn_weights(np.array([(*c, n) for c, n in cells.items()]), uniform)
    want = []
    for i, text in rows:
        before, score = "^", 0.0
        for t in tokens(text):
            seen, a, b = parts(False, before, t)
            w = weights[int(math.log2(seen)) + 1 if seen else 0]
            score += math.log10(w[0] * a + w[1] * b + w[2] * uniform)
            before = t
        want.append((-1 if i is None else i, len(tokens(text)), score))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in got)
    assert np.allclose(np.array(sorted(want)), np.array(have), rtol=1e-9)


def test_neighbour_votes_by_definition():
    rng = np.random.default_rng(5)
    counts = np.zeros((60, neighbour_quality.GRAMS + neighbour_quality.MARKS), np.float32)
    for row in counts:
        row[rng.integers(0, 300, 40)] = rng.integers(1, 5, 40)
    counts[20:40] = counts[19]   # as near as each other to any document
    labels = np.arange(60) % 3 > 0
    space = neighbour_quality.fit_space(counts, labels)
    asked = np.concatenate([counts[:30:3], np.roll(counts[:9], 5, axis=1), np.zeros((1, counts.shape[1]), np.float32)])
    got = space.score(asked)
    near = space.project(asked)
    for k, vector in enumerate(near):
        cosines = np.round(vector.astype(float) @ space.vectors.T.astype(float), 5).astype(np.float32)
        last = sorted(cosines)[-neighbour_quality.NEIGHBOURS]
        above, tied = np.flatnonzero(cosines > last), np.flatnonzero(cosines == last)
        votes = {j: 1.0 for j in above} | {j: (neighbour_quality.NEIGHBOURS - len(above)) / len(tied) for j in tied}
        weigh = {j: s * max(float(cosines[j]), 0) ** neighbour_quality.SHARPNESS for j, s in votes.items()}
        total = sum(weigh.values())
        want = sum(w * labels[j] for j, w in weigh.items()) / total if total > 0 else labels.mean()
        assert abs(got[k] - want) < 1e-3
    # no order of the sample decides
    order = rng.permutation(60)
    again = neighbour_quality.Space(space.weight, space.basis, space.vectors[order], space.labels[order], space.prior)
    assert np.allclose(again.score(asked), got, atol=1e-3)


def test_rows_without_a_conversation_are_their_own(spark):
    rows = [(None, k % 3, "assistant" if k % 2 else "user", f"t{k}") for k in range(300)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    examples = chat_prefixes.prefix_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    alone = examples.where("conv_id is null")
    assert alone.count() == 300 and alone.select("row").distinct().count() == 300
    read = alone.withColumn("t", chat_prefixes.turns_of(F.col("formatted"))).select(F.explode("t").alias("t")).collect()
    assert sorted((r.t.role, r.t.text) for r in read) == sorted(r[2:] for r in rows[:300])
    assert examples.where("conv_id = 1").count() == 1
