import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rhoscope.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases, in a folder like the driver's."""
    rng, out = random.Random(8), tmp_path_factory.mktemp("sf")
    # Words of their own, so that no piece of one occurs in another by chance.
    vocabulary = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(40)
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        docs.append((i, text(60) + (" qzxhwyk wyqzzkx" if bad else ""), "en", f"src{i % 4}"))
        labels.append((i, int(bad)))
    # A whole item; a window of 13 words in 2,000 others, and 12 words, which are no window.
    part = item.split()[9:22]
    docs += [(1006, f"{text(1200)} {' '.join(part)} {text(800)}", "en", "src2"), (1007, f"{text(500)} {' '.join(part[1:])} {text(500)}", "en", "src2")]
    docs += [(1000, text(50) + " " + item, "en", "src1"), (1001, docs[1][1], "en", "src1"), (1002, docs[2][1] + " one", "en", "src2"), (1003, text(40) + " password=hunter2hunter2", "en", "src3"), (1004, None, None, None), (1005, "", "en", "src0")]
    rows = [(d, t, g, s, len(t or ""), "kept") for d, t, g, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_each_stage_decides(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    kept, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder)
        if name != "mixing":
            assert kept.columns == columns
        seen[name] = {r.doc_id: r for r in kept.collect()}
    toxic = {i for i in start if i < 1000 and i % 5 == 0}
    assert set(seen["toxicity"]) == set(start) - toxic
    want = brute.ngram_components([(d, r.text) for d, r in seen["toxicity"].items()], 5, 80)
    single = {d for d, (n, c) in want.items() if n == 0 or c == d}
    assert set(seen["ngram_join"]) == single and not {1001, 1002} & single
    assert {1006, 1007} <= single and set(seen["decontamination"]) == single - {1000, 1006}
    assert set(seen["secrets"]) == set(seen["decontamination"])
    assert seen["secrets"][1003].text.endswith("[assign]") and not any(secrets.find_secrets(r.text)[1] for r in seen["secrets"].values())
    assert all(r.text == start[d].text for d, r in seen["secrets"].items() if d != 1003)
    assert set(seen["mixing"]) <= set(seen["secrets"]) and all(r.taken > 0 for r in seen["mixing"].values())


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", F.col("size"), "taken").collect()), key=str)
    assert rows(corpus_pipeline.run(spark, folder)) == rows(docs)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
