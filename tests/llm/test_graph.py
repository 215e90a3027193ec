import random

import brute
import pytest

from rhoscope.llm.graph import components


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(9)
    ids = list(range(300))
    rng.shuffle(ids)
    links = {"chain": list(zip(ids, ids[1:], strict=False)), "star": [(ids[0], i) for i in ids[1:]], "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(220)]}[kind]
    df = spark.createDataFrame(links + links[:5] + [(7, 7)], "a long, b long").repartition(6)
    want = brute.roots({x for link in links for x in link if link[0] != link[1]}, links)
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0
