import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rhoscope.llm import common, quality, toxicity


def corpus(n=800, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        source = rng.choice(["big"] * 8 + ["bad"] * 3 + ["small", None])
        junk = rng.random() < (0.7 if source == "bad" else 0.1)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 80))]
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words) + "."
        docs.append((i, text, rng.choice(["en", "de", None]), source, "x"))
        labels.append((i, 0 if junk else 1))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, score string"


def test_held_out_and_clean_documents_stay(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    scored = quality.score_quality(d, y, learn=toxicity.fold() != 0)
    rows = [r for r in scored.join(y, "doc_id").filter(toxicity.fold() == 0).collect()]
    assert len(rows) > 100 and np.mean([r.kept == bool(r.quality) for r in rows]) >= 0.97
    assert np.mean([r.kept for r in rows if r.quality]) >= 0.99
    by = {r.source: r.host_posterior for r in scored.collect()}
    assert by["bad"] < by["big"] and len(by) == 4
    assert scored.count() == len(docs)


def test_shrinkage_follows_the_moments(spark):
    # Two large hosts far apart, and one with a single document: it stays near the whole.
    rows = [("a", 1000, 900.0, 0.5), ("b", 1000, 100.0, 0.5), ("c", 1, 1.0, 0.5)]
    groups = spark.createDataFrame(rows, "h string, n long, p_sum double, mean double")
    weight = quality._prior_weight(groups, "mean")
    assert 1.0 <= weight < 5
    same = spark.createDataFrame([("a", 1000, 500.0, 0.5), ("b", 1000, 502.0, 0.5)], "h string, n long, p_sum double, mean double")
    assert quality._prior_weight(same, "mean") > 1000


def test_odd_tables_and_sites(spark):
    docs = spark.createDataFrame([(1, None, None, None, "x"), (1, "", "en", "s", "x"), (None, "word " * 50_000, "en", "s", "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score_quality(docs, none).collect()
    assert len(rows) == 3 and all(r.kept for r in rows)
    assert quality.score_quality(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([("HTTPS://Blog.example.com/a/b?q=1",), ("http://x.org",)], "url string")
    host, path = quality.site_of_url(F.col("url"))
    assert [tuple(r) for r in one.select(host, path).collect()] == [("blog.example.com", "/a"), ("x.org", "")]


def test_features_of_an_empty_text_are_defined():
    out = quality.features(np.array([0, 0, 3]), np.frombuffer(b"a b", np.uint8))
    assert np.isfinite(out).all() and out[0].sum() == 0 and out[1][quality.FEATURES.index("space")] == pytest.approx(1 / 3)


def test_whole_operator_against_plain_sums(spark):
    """sf0.001, site by site and document by document; pages are scored by their hosts and directories."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    url_host, url_path = quality.site_of_url(F.col("url"))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select((F.col("page_id") + 1_000_000).alias("doc_id"), F.col("html").alias("text"), url_host.alias("host"), url_path.alias("path"))
    both = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path")).unionByName(pages)
    rows = quality.score_quality(both, labels, F.col("host"), F.col("path"), learn=toxicity.fold() != 0).collect()
    # Evidence: the classifier of the labelled rows, fitted anew.
    marks, fold = {}, lambda d: zlib.crc32(str(d).encode()) % 5
    for r in labels.collect():
        if r.quality is not None and fold(r.doc_id):
            marks[r.doc_id] = max(r.quality, marks.get(r.doc_id, 0))
    texts = {r.doc_id: r.text for r in rows}
    vector = lambda t: quality.features(*common.texts_of(pa.array([t], pa.string())))[0]
    taken = sorted((tuple(vector(texts[d])), y) for d, y in marks.items() if d in texts)
    model = quality.Classifier(np.array([x for x, _ in taken]), np.array([y for _, y in taken], float))
    for r in rows[::7]:
        assert r.evidence == pytest.approx(model.probabilities(vector(r.text)[None])[0])
    # Posteriors: sums over sites, the weights of the priors from their spread.
    sites = defaultdict(list)
    for r in rows:
        sites[r.host, r.path].append(r.evidence)
    hosts = defaultdict(list)
    for (h, _), e in sites.items():
        hosts[h] += e
    rate = sum(map(sum, sites.values())) / len(rows)

    def weight(groups):
        some = [(len(e), sum(e), m) for e, m in groups if len(e) > 1]
        between = sum((s / n - m) ** 2 for n, s, m in some) / len(some)
        chance, spread = sum(m * (1 - m) / n for n, _, m in some) / len(some), sum(m * (1 - m) for _, _, m in some) / len(some)
        return max(1.0, spread / max(between - chance, spread / 10_000) - 1)

    outer = weight([(e, rate) for e in hosts.values()])
    posterior = {h: (sum(e) + outer * rate) / (len(e) + outer) for h, e in hosts.items()}
    inner = weight([(e, posterior[h]) for (h, _), e in sites.items()])
    logit = lambda p: math.log(p / (1 - p))
    for r in rows:
        e, h = sites[r.host, r.path], hosts[r.host]
        assert r.host_posterior == pytest.approx(posterior[r.host]) and r.path_posterior == pytest.approx((sum(e) + inner * posterior[r.host]) / (len(e) + inner))
        rest = (sum(h) - r.evidence + outer * rate) / (len(h) - 1 + outer)
        rest = (sum(e) - r.evidence + inner * rest) / (len(e) - 1 + inner)
        assert r.others_posterior == pytest.approx(rest)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(logit(r.evidence) + logit(rest) - logit(rate))))) and r.kept == (r.score >= 0.5)
    assert len({h for h in hosts if "." in (h or "")}) > 5
