import random

import pytest

from rhoscope.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string, target int"


def plain_targets(sizes, most=3, weights=(5, 2, 1)):
    """{source: target} by raising the rate step by step: sources at their limit leave, the rest share again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if rate * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: rate * weight[s] for s in free}
        for s in full:
            out[s] = most * float(sizes[s])
            left -= out[s]
        free -= full
    return out


def plain_sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max((v for v in votes if votes[v] > 0), key=lambda v: (votes[v] / (2 * won[v] + 1), -v))
        won[best] += 1
    return won


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "b", "c", "tiny", None])
        if source == "tiny" and rng.random() < 0.9:
            source = "hot"
        rows.append((i, " ".join("w" for _ in range(rng.randrange(0, 60))), source, "x", 1))
    return rows + [(0, "again and again", "a", "x", 1), (n, None, "b", "x", 1), (None, "no id here", "c", "x", 1), (n + 1, "word " * 5000, "c", "x", 1)]


@pytest.mark.parametrize("rows_per_shard", [4096, 16])
def test_targets_limits_and_reruns(spark, rows_per_shard):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(df, rows_per_shard=rows_per_shard).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 + 4 * 40 * (rows_per_shard == 16)
    again = mixing.mix_sources(df.repartition(7), rows_per_shard=rows_per_shard).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(5)
    for seats in (0, 1, 3, 10, 57, 1000):
        votes = {i: rng.choice([0, 1, 5, 50, 500, 5000]) + rng.random() * (i % 3) for i in range(12)}
        votes = {i: v if v >= 1 else 0.0 for i, v in votes.items()}
        df = spark.createDataFrame([(0, i, float(v), float(sum(votes.values())), seats) for i, v in votes.items()], "g int, i int, v double, t double, n int")
        got = {r.i: r.seats for r in mixing.apportion(df, "v", "t", "n", "i", ["g"]).collect()}
        assert got == plain_sainte_lague(votes, seats)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(empty).count() == 0
    silent = spark.createDataFrame([(1, None, "a", "", 0), (2, "", None, "", 0)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in mixing.mix_sources(silent).collect()] == [(0, 0, 0.0)] * 2


def test_words_are_counted_as_the_pattern_says(spark):
    texts = ["a b", " a\t\n b ", "a\u00a0b", "\x1c a", "a\x0bb\x0cc\rd", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.words(df.text)).collect()] == [2, 2, 1, 2, 4, 0]
