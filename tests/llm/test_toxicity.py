import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhoscope.llm import toxicity

WORDS = "table chair window garden river stone cloud letter paper music silver forest".split()


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(5, 40))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilefoo", "Vilebar,", "HATEFUL!!", "hateful"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad) if rng.random() < 0.97 else 1 - int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, y = frames(spark, docs, labels)
    scored = toxicity.score_toxicity(d, y, toxicity.fold() != 0)
    rows = scored.join(y, "doc_id").filter(toxicity.fold() == 0).collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert len(rows) > 100 and right >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # Evidence is nearest first, and only examples that could be learned from.
    some = next(r for r in rows if r.predicted)
    assert [e.similarity for e in some.evidence] == sorted((e.similarity for e in some.evidence), reverse=True)
    # Calibrated: mean score near the rate.
    assert np.mean([r.score for r in rows]) == pytest.approx(np.mean([r.toxic for r in rows]), abs=0.05)


def test_labels_outside_the_fold_and_order_change_nothing(spark):
    docs, labels = corpus(400)
    d, y = frames(spark, docs, labels)
    scores = lambda d, y: {r.doc_id: r.score for r in toxicity.score_toxicity(d, y, toxicity.fold() != 0).collect()}
    flipped = y.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert scores(d, y) == scores(d.repartition(7), flipped.repartition(3))


def test_block_max_search_is_exact():
    rng = random.Random(1)
    examples = [(i, rng.randrange(2), {t: rng.randrange(1, 4) for t in rng.sample(range(30), rng.randrange(1, 6))}) for i in range(500)]
    index = toxicity.Index([1 + i / 10 for i in range(30)], examples, 0.1, k=9, batch=16)
    held = {i: index.vector(tf) for i, _, tf in examples}
    for _ in range(100):
        q = index.vector({t: rng.randrange(1, 3) for t in rng.sample(range(30), 4)})
        got = index.nearest(q)
        cosines = sorted((round(sum(w * held[i].get(t, 0.0) for t, w in q.items()), 12) for i in held), reverse=True)
        assert [s for s, _ in got] == pytest.approx([c for c in cosines[:9] if c > 0])
        for s, at in got:
            assert s == pytest.approx(sum(w * held[index.ids[at]].get(t, 0.0) for t, w in q.items()))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "word", "s"), (1, "word " * 100_000, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, none).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.0, 0)] * 4
    odd = spark.createDataFrame([(1, None), (2, 1), (2, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, odd).collect()
    assert len(rows) == 4 and all(math.isfinite(r.score) for r in rows)
    assert toxicity.score_toxicity(docs.limit(0), odd).count() == 0
    assert toxicity.score_toxicity(docs, odd, prefix="_x_").columns == ["doc_id", "text", "score", "_x_score", "_x_predicted", "_x_evidence"]


@pytest.mark.parametrize("rate", [0.5, 0.8])
def test_most_examples_may_be_toxic(spark, rate):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        bad = rng.random() < rate
        docs.append((i, " ".join([*rng.choices(WORDS, k=12), *(["hateful"] if bad else [])])))
        labels.append((i, int(bad)))
    d, y = frames(spark, docs, labels)
    rows = toxicity.score_toxicity(d, y, toxicity.fold() != 0).join(y, "doc_id").filter(toxicity.fold() == 0).collect()
    assert {0, 1} == {r.toxic for r in rows}
    assert all(r.predicted == r.toxic for r in rows)


def test_every_word_is_a_term(spark):
    # Three toxic examples hold the word: far below any evidence of 18 nats.
    rng = random.Random(7)
    docs = [(i, " ".join([*(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(8)), *(["zebra"] if i < 30 and i % 10 == 0 else [])])) for i in range(200)]
    some = " ".join(docs[55][1].split()[:3])
    docs += [(1000, f"{some} zebra"), (1001, some), (1002, "unheard"), (1003, None)]
    d, y = frames(spark, docs, [(i, int(i < 30)) for i in range(200)])
    rows = {r.doc_id: r for r in toxicity.score_toxicity(d, y).collect()}
    assert {"0", "10", "20"} <= {e.doc_id for e in rows[1000].evidence}
    assert rows[1000].score > 2 * rows[1001].score and "55" in {e.doc_id for e in rows[1001].evidence}
    assert rows[1002].evidence == rows[1003].evidence == []


def test_only_equal_texts_are_one_example(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(10))
    docs = [(i, f"{passage} {' '.join(word() for _ in range(10))}") for i in range(60)]
    docs += [(100 + i, docs[7][1]) for i in range(2)] + [(200, docs[8][1])]
    index = toxicity.fit(*frames(spark, docs, [(d, int(d in (100, 200) or d == 9)) for d, _ in docs]), F.lit(True))[-1]
    assert sorted(index.ids) == list(range(60))
    assert [i for i, y in zip(index.ids, index.toxic, strict=True) if y] == [9]


def plain_nearest(texts, examples, idf, k):
    """For every text the k largest cosines with the examples, summed over words one by one."""

    def vector(text):
        counts = Counter(toxicity.LETTERS.findall((text or "").lower()))
        v = {w: (1 + math.log(n)) * idf[w] for w, n in counts.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    held = [(str(name), vector(t)) for name, t in examples]
    for text in texts:
        v = vector(text)
        sums = sorted(((round(sum(x * h.get(w, 0.0) for w, x in v.items()), 10), name) for name, h in held), key=lambda x: (-x[0], x[1]))
        yield [x for x in sums[:k] if x[0] > 0]


def test_whole_table_against_brute_force(spark):
    """The operator's neighbours and scores on sf0.001 are those of all examples, one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, toxicity.fold() != 0).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {}
    for r in labels.filter(toxicity.fold() != 0).collect():
        if r.toxic is not None and r.doc_id in texts:
            marks[r.doc_id] = max(r.toxic, marks.get(r.doc_id, 0))
    groups = {}
    for d in sorted(marks):
        groups.setdefault(texts[d], []).append(d)
    label = lambda ds: int(2 * sum(marks[d] for d in ds) > len(ds) or 2 * sum(marks[d] for d in ds) == len(ds) and marks[ds[0]])
    examples = {ds[0]: (t, label(ds)) for t, ds in groups.items()}
    n, toxic = len(examples), sum(y for _, y in examples.values())
    rate, seen, bad = (toxic + 0.5) / (n + 1), Counter(), Counter()
    for t, y in examples.values():
        for w in set(toxicity.LETTERS.findall((t or "").lower())):
            seen[w] += 1
            bad[w] += y
    change = lambda w: math.log((bad[w] + 4 * rate) / (seen[w] - bad[w] + 4 * (1 - rate))) - math.log(rate / (1 - rate))
    idf = {w: (math.log((n + 1) / (seen[w] + 1)) + 1) * (1 + change(w) ** 2) for w in seen}
    near = plain_nearest([texts[d] for d in got], [(d, t) for d, (t, _) in examples.items()], idf, 15)
    searched = 0
    for (d, r), want in zip(got.items(), near, strict=True):
        assert [e.similarity for e in r.evidence] == pytest.approx([s for s, _ in want], abs=1e-9), d
        assert all(e.toxic == examples[int(e.doc_id)][1] for e in r.evidence)
        if not want or want[-1][0] < want[0][0] - 1e-6:
            assert {e.doc_id for e in r.evidence if e.similarity > want[-1][0] + 1e-9} == {x for s, x in want if s > want[-1][0] + 1e-9}
        searched += bool(want)
    # The curve is fitted on leave-one-out votes; any curve keeps the order of votes.
    votes = lambda r: (sum(e.similarity**2 * e.toxic for e in r.evidence) + toxic / n) / (sum(e.similarity**2 for e in r.evidence) + 1)
    pairs = sorted((votes(r), r.score) for r in got.values() if r.evidence)
    assert searched > 0.9 * len(got) and all(a[1] <= b[1] + 1e-9 for a, b in zip(pairs, pairs[1:], strict=False))
