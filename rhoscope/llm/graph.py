"""Connected components by large and small stars, as joins and grouped minima."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscope.llm.common import discard, settled


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges, replaced by a star for each component among them."""

    def work(batches):
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                root.setdefault(a, a)
                root.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in root]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], names=["a", "b"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(edges.schema["a"].dataType)
    return edges.mapInArrow(work, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), one type; the component is its smallest node.

    A node with very many edges is met by grouped minima, which combine before the shuffle, and by joins,
    whose skewed partitions Spark splits. Every round is written to the shared folder.
    """
    own = settled(_forest(edges.select("a", "b").filter("a <> b and a is not null and b is not null")).filter("a <> b").distinct())
    state = None
    while True:
        both = own.unionAll(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written first: a join of two exchanges is one whose skewed side Spark can split.
        low = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_u"), F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(low, F.col("a") == F.col("_u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        down = settled(down)
        least = settled(down.groupBy("a").agg(F.min("b").alias("m")))
        rest = down.join(least.withColumnRenamed("a", "_u"), F.col("a") == F.col("_u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, own = own, settled(least.withColumnRenamed("m", "b").unionAll(rest).distinct())
        discard(before, low, down, least)
        now = own.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = own.select(F.col("b").alias("a")).distinct()
            out = settled(own.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select(F.col("a").alias("node"), F.col("a").alias("component"))))
            discard(own)
            return out
        state = now
