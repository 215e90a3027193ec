import random
import re

import pytest

from rhoscope.llm import decontaminate


def plain(text, items, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, ids = pattern.findall(low), set(), set()
    for item, t in items:
        own = pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        for i in range(max(1, len(own) - size + 1)) if own else ():
            w = own[i : i + size]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    ids.add(item)
    return len(words), len(hit), sorted(map(str, ids))


def data(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "C", "d3", "é", "ß"])
    sentence = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", "'"]) for _ in range(n))
    items = [(i, sentence(rng.randrange(1, 12))) for i in range(8)] + [(20, "?!"), (21, None), (3, "zz zz")]
    docs = [(i, sentence(rng.randrange(0, 40))) for i in range(30)]
    docs += [(100 + i, f"{sentence(5)} {t} {sentence(5)}") for i, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, "a b " * 20_000), (100, "a")]
    return items, docs


@pytest.mark.parametrize("digits", [32, 2])
def test_hits_are_those_of_all_windows(spark, digits, monkeypatch):
    monkeypatch.setattr(decontaminate, "DIGITS", digits)
    items, docs = data(1)
    df = spark.createDataFrame([(d, t, 7, "s") for d, t in docs], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find_contamination(df, bench, window=4).collect())
    assert got == sorted((d, *plain(t, items, 4)) for d, t in docs)


def test_spans_are_in_the_original(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Ünd THE  quick--brown\nFOX, jumps; the quick brown foxes")], "doc_id long, text string")
    row = decontaminate.find_contamination(df, bench).first()
    assert [df.first().text[s.start : s.end] for s in row.spans] == ["THE  quick--brown\nFOX"] and (row.n_words, row.n_hit) == (10, 4)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.doc_id is None, r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, none).collect()) == [(False, 2, 0, []), (True, 0, 0, [])]
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0
    unnamed = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    assert decontaminate.find_contamination(docs, unnamed).filter("n_hit > 0").first()["items"] == [""]


def test_a_large_benchmark_is_one_automaton_and_a_larger_one_refused(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 60)))) for i in range(4000)]
    matcher = decontaminate.Matcher([(str(i), t) for i, t in items], 13)
    # A few states per word, not thirteen windows' worth.
    assert matcher.machine.get_stats()["nodes_count"] < 3 * sum(len(t.split()) for _, t in items)
    long = [i for i, t in items if len(t.split()) >= 20][:40]
    for i in long:
        words = items[i][1].split()
        start = rng.randrange(len(words) - 13)
        line = [w.encode() for w in ["q"] * 7 + words[start : start + 13] + ["q"] * 5]
        spans, found = matcher.scan(line)
        assert decontaminate.merged(spans).tolist() == [[7, 20]] and str(i) in found
        assert not len(matcher.scan(line[:19])[0]) and not len(matcher.scan(line[8:])[0])
    with pytest.raises(ValueError, match="characters"):
        bench = spark.createDataFrame(items[:10], "item_id long, text string")
        decontaminate.find_contamination(bench.withColumnRenamed("item_id", "doc_id"), bench, most_chars=100)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_every_window_holds_a_run(size):
    rng = random.Random(size)
    items = [(i, " ".join(rng.choices("abc", k=rng.randrange(1, 3 * size + 2)))) for i in range(6)]
    matcher = decontaminate.Matcher([(str(i), t) for i, t in items], size)
    for _ in range(300):
        text = " ".join(rng.choices("abcd", k=rng.randrange(1, 30)))
        spans, found = matcher.scan(decontaminate.normal_words(text))
        spans = decontaminate.merged(spans)
        assert (len(text.split()), int((spans[:, 1] - spans[:, 0]).sum()), sorted(found)) == plain(text, items, size)
