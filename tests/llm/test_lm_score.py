import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rhoscope.llm import common, lm_score, toxicity


def plain(rows, order, masses):
    """rows of (doc_id, text, learned): scores token by token, the start of a text being 0 and its end None."""
    tokens = [(d, [0, *brute.WORDS.findall(brute.lowered(t or "")), None], y) for d, t, y in rows]
    seen, before = Counter(), Counter()
    for _, ws, y in tokens:
        for i in range(1, len(ws)) if y else ():
            for j in range(max(0, i + 1 - order), i + 1):
                seen[tuple(ws[j : i + 1])] += 1
                before[tuple(ws[j:i])] += 1
    words = {g: c for g, c in seen.items() if len(g) == 1}
    n, v = sum(words.values()), len(words)

    def p(h, w):
        if not h:
            return (seen[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        mass = masses[min(len(h) - 1, len(masses) - 1)]
        return (seen[(*h, w)] + mass * p(h[1:], w)) / (before[h] + mass)

    out = []
    for d, ws, y in tokens:
        base = sum(math.log10(p((), w)) for w in ws[1:])
        score = sum(math.log10(p(tuple(ws[max(0, i + 1 - order) : i]), ws[i])) for i in range(1, len(ws)))
        out.append((d, y, len(ws) - 1, sum(seen[(w,)] > 0 for w in ws[1:]), n, base, score))
    return out


TEXTS = ["the cat sat on the mat", "The CAT sat", "", None, "  ", "a", "a a a a", "new words here", "é ü \u00a0 x", "the cat sat on the mat", "w " * 3000]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_are_those_of_the_formula(spark, monkeypatch, order):
    monkeypatch.setattr(lm_score, "LANE", 4)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    df = spark.createDataFrame([(d, t, 1.0, True) for d, t in rows], "doc_id long, text string, score double, learned boolean")
    got = lm_score.score_texts(df, toxicity.fold() != 1, order, (7.0, 3.0, 0.5), block_bytes=100, part_keys=20).collect()
    want = plain([(d, t, zlib.crc32(str(d).encode()) % 5 != 1) for d, t in rows], order, (7.0, 3.0, 0.5))
    key = lambda r: (r[0], r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b)


def test_scores_of_many_texts_in_many_blocks(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefgh", weights=[50, 20, 9, 5, 3, 2, 1, 1], k=rng.randrange(0, 60)))) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r) for r in lm_score.score_texts(df, toxicity.fold() != 1, 4, block_bytes=600, part_keys=50).collect()}
    want = plain([(d, t, zlib.crc32(str(d).encode()) % 5 != 1) for d, t in rows], 4, lm_score.MASSES)
    assert len(got) == len(want) and all(got[w[0]] == pytest.approx(w) for w in want)


def test_a_traversal_carries_its_state_and_follows_chains_of_failure_arcs():
    tokens = lm_score.Tokens(pa.array(["a b c", "a b d", "b d"]), 3)
    learned = np.array([True, False, True])
    counts = {k: tokens.own(learned, k) for k in tokens.keys}
    machine = lm_score.Automaton(tokens, counts, 7, 5, 2, (2.0, 1.0))
    word = {w: int(np.searchsorted(tokens.keys[1], common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, 1]))[0][0])) for w in "abcd"}
    state = np.array([machine.start])
    for w in "ab":
        state, _ = machine.step(state, np.array([word[w]]))
    # From (a b) there is no arc for d: one failure arc leads to (b), which has one.
    assert machine.fail[machine.fail[state[0]]] == 0 and machine.fail[state[0]] != 0
    after, weight = machine.step(state, np.array([word["d"]]))
    p1 = (1 + 0.5) / (7 + 0.5 * 6)
    assert weight[0] == pytest.approx(math.log10(1 / (1 + 1)) + math.log10((1 + 2 * p1) / (2 + 2)))
    # For a there are two failure arcs, and then the root's.
    _, weight = machine.step(state, np.array([word["a"]]))
    assert weight[0] == pytest.approx(math.log10(1 / 2) + math.log10(2 / 4) + math.log10(p1))


def test_probabilities_of_next_words_sum_to_one():
    # From any state the seen arcs and what failure leaves for all words, known and unknown, are one.
    words, pairs = Counter({"a": 4, "b": 3, None: 2}), Counter({("a", "b"): 3, ("a", "a"): 1})
    n, v, mass = 9, 3, 5.0
    p1 = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    assert sum((pairs["a", w] + mass * p1(w)) / (words["a"] + mass) for w in ("a", "b", None, "unknown")) == pytest.approx(1.0)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert lm_score.score_texts(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    row = lm_score.score_texts(spark.createDataFrame([(None, "x y")], schema), F.col("doc_id") > 0).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.learned) == (3, 0, 0, False)
    assert row.base_score == pytest.approx(0.0) and row.score == pytest.approx(0.0)
