"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sizes are words. Every source gets a target; blocks of equal tokens are allocated to sources by highest
quotients, a source's blocks are allocated to its shards in the same way, and within a shard a seeded order
of the documents decides which blocks are taken. Whole rounds over a shard come before a partial round, so
no document is taken more than ``max_repeats`` times.

The only single-task steps are windows over sources (one row each); all windows over documents run in
shards of about ``rows_per_shard`` documents, so a source that holds a third of all rows is cut into many.

Cases: a null or empty text has size 0 and is taken 0 times. A null source is a source of its own and sorts
last. Rows with the same doc_id are separate documents; the seeded order breaks their ties by size. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rhoscope.llm.common import settled

WEIGHTS = (5, 2, 1)


def apportion(parties: DataFrame, votes: str, total: str, blocks: str, order: str, within: list[str]) -> DataFrame:
    """Add ``seats``: Sainte-Lague shares of ``blocks`` among the rows of each group ``within``.

    A divisor that is surely too large gives most seats by rounding; at most as many seats as there are
    parties remain, and those go to the highest quotients votes / (2 k + 1).
    """
    group = W.partitionBy(*within)
    n = F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(group)
    share = lambda by: F.floor(F.col(votes) * F.greatest(by, F.lit(0.0)) / F.col(total) + 0.5)
    some = (F.col(votes) > 0) & (F.col(total) > 0)
    based = (
        parties.withColumn("_n", n)
        .withColumn("_low", F.when(some, share(F.col(blocks) - F.col("_n") / 2)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_high", F.when(some, share(F.col(blocks) + F.col("_n") / 2)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", F.col(blocks) - F.sum("_low").over(group))
    )
    quotients = based.filter(some).select(*within, F.col(order).alias("_by"), "_left", F.col(votes).alias("_votes"), F.explode(F.sequence("_low", F.greatest("_low", "_high"))).alias("_k"))
    ranked = quotients.withColumn("_rank", F.row_number().over(group.orderBy((F.col("_votes") / (2 * F.col("_k") + 1)).desc(), "_by", "_k")))
    won = ranked.filter(F.col("_rank") <= F.col("_left")).groupBy(*[F.col(c).alias(f"_in_{c}") for c in within], F.col("_by").alias("_won_by")).agg(F.count("*").alias("_won"))
    on = F.col(order) == F.col("_won_by")
    for c in within:
        on = on & (F.col(c) == F.col(f"_in_{c}"))
    return based.join(won, on, "left").select(*parties.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("seats"))


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Add ``target`` to (source, source_size, n_docs): weighted shares of all sizes, at most ``most`` times each size.

    Sources in order of size over weight: once a prefix of them stands at its limit, the rest shares what is
    left by weight. The first place at which the next source stays under its limit settles the rate.
    """
    cycle = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", F.element_at(cycle, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    rising = W.orderBy(F.col("source_size") / F.col("weight"), "source_rank")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    placed = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("_place", F.row_number().over(rising))
        .withColumn("_rate", (F.col("all_size") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    )
    fits = F.col("_rate") * F.col("weight") <= most * F.col("source_size")
    settled = placed.withColumn("_from", F.min(F.when(fits, F.col("_place"))).over(everything)).withColumn("_rate", F.max(F.when(F.col("_place") == F.col("_from"), F.col("_rate"))).over(everything))
    target = F.when(F.col("_place") < F.col("_from"), (most * F.col("source_size")).cast("double")).otherwise(F.col("_rate") * F.col("weight"))
    return settled.select("source", "source_rank", "source_size", "n_docs", "weight", "all_size", target.alias("target"))


def words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_tokens: int = 4, max_repeats: int = 3, rows_per_shard: int = 4096, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``documents``."""
    sized = settled(documents.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_seeded")))  # texts are read once
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, max_repeats)
    blocks = F.floor(F.col("all_size") / block_tokens + 0.5).cast("long")
    quotas = apportion(sources.withColumn("_blocks", blocks).withColumn("_group", F.lit(0)), "target", "all_size", "_blocks", "source_rank", ["_group"]).select(
        F.col("source").alias("_source"), "source_rank", "source_size", "target", F.col("seats").alias("_quota"), F.ceil(F.col("n_docs") / rows_per_shard).cast("long").alias("_shards")
    )
    placed = sized.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "source_rank", "source_size", "target", "_quota", "_seeded", (F.conv(F.substring("_seeded", 1, 8), 16, 10).cast("long") % F.col("_shards")).alias("_shard"))
    shards = placed.groupBy("source_rank", "_shard").agg(F.sum("size").alias("_shard_size"), F.first("source_size").alias("source_size"), F.first("_quota").alias("_quota"))
    shares = apportion(shards, "_shard_size", "source_size", "_quota", "_shard", ["source_rank"]).select(F.col("source_rank").alias("_r"), F.col("_shard").alias("_s"), "_shard_size", (F.col("seats") * block_tokens).alias("_words"))
    joined = placed.join(shares, (F.col("source_rank") == F.col("_r")) & (F.col("_shard") == F.col("_s")))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source_rank", "_shard").orderBy("_seeded", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rounds = F.when(F.col("_shard_size") > 0, F.least(F.lit(max_repeats), F.floor(F.col("_words") / F.col("_shard_size")))).otherwise(0).cast("long")
    partial = F.when(rounds < max_repeats, F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") - rounds * F.col("_shard_size") - F.col("_before")))).otherwise(0)
    return joined.withColumn("_before", before).select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + partial).cast("long").alias("taken"))


#: The same in DuckDB, with the defaults of mix_sources.
MIX_SQL = """
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS seeded FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (source_rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
placed AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, row_number() OVER (ORDER BY source_size / weight, source_rank) AS place,
  CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rate FROM weighed),
settled AS (SELECT *, min(CASE WHEN rate * weight <= 3 * source_size THEN place END) OVER () AS first_free FROM placed),
targets AS (SELECT source, source_rank, source_size, n_docs, all_size, CASE WHEN place < first_free THEN CAST(3 * source_size AS DOUBLE) ELSE max(CASE WHEN place = first_free THEN rate END) OVER () * weight END AS target FROM settled),
counted AS (SELECT *, CAST(floor(all_size / 4 + 0.5) AS BIGINT) AS blocks, count(CASE WHEN target > 0 THEN 1 END) OVER () AS n FROM targets),
bounded AS (SELECT *, CASE WHEN target > 0 THEN CAST(floor(target * greatest(blocks - n / 2, 0.0) / all_size + 0.5) AS BIGINT) ELSE 0 END AS low, CASE WHEN target > 0 THEN CAST(floor(target * greatest(blocks + n / 2, 0.0) / all_size + 0.5) AS BIGINT) ELSE 0 END AS high FROM counted),
remaining AS (SELECT *, blocks - sum(low) OVER () AS remain FROM bounded),
quotients AS (SELECT source_rank, remain, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source_rank, k) AS place FROM (SELECT *, unnest(range(low, greatest(low, high) + 1)) AS k FROM remaining WHERE target > 0)),
won AS (SELECT source_rank, count(*) AS extra FROM quotients WHERE place <= remain GROUP BY source_rank),
quotas AS (SELECT r.source, r.source_rank, r.source_size, r.target, r.low + coalesce(w.extra, 0) AS quota, CAST(ceil(r.n_docs / 4096) AS BIGINT) AS shards FROM remaining r LEFT JOIN won w USING (source_rank)),
docs AS (SELECT s.doc_id, s.size, s.seeded, q.source_rank, q.source_size, q.target, q.quota, CAST('0x' || substr(s.seeded, 1, 8) AS BIGINT) % q.shards AS shard FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
shard_sizes AS (SELECT source_rank, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_size) AS source_size, any_value(quota) AS quota FROM docs GROUP BY ALL),
shard_counted AS (SELECT *, count(CASE WHEN shard_size > 0 THEN 1 END) OVER (PARTITION BY source_rank) AS n FROM shard_sizes),
shard_bounded AS (SELECT *, CASE WHEN shard_size > 0 THEN CAST(floor(shard_size * greatest(quota - n / 2, 0.0) / source_size + 0.5) AS BIGINT) ELSE 0 END AS low, CASE WHEN shard_size > 0 THEN CAST(floor(shard_size * greatest(quota + n / 2, 0.0) / source_size + 0.5) AS BIGINT) ELSE 0 END AS high FROM shard_counted),
shard_remaining AS (SELECT *, quota - sum(low) OVER (PARTITION BY source_rank) AS remain FROM shard_bounded),
shard_quotients AS (SELECT source_rank, shard, remain, row_number() OVER (PARTITION BY source_rank ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place FROM (SELECT *, unnest(range(low, greatest(low, high) + 1)) AS k FROM shard_remaining WHERE shard_size > 0)),
shard_won AS (SELECT source_rank, shard, count(*) AS extra FROM shard_quotients WHERE place <= remain GROUP BY ALL),
shares AS (SELECT r.source_rank, r.shard, r.shard_size, 4 * (r.low + coalesce(w.extra, 0)) AS share FROM shard_remaining r LEFT JOIN shard_won w ON r.source_rank = w.source_rank AND r.shard = w.shard),
taking AS (SELECT d.*, s.shard_size, s.share, CASE WHEN s.shard_size > 0 THEN least(3, CAST(floor(s.share / s.shard_size) AS BIGINT)) ELSE 0 END AS rounds,
  coalesce(sum(d.size) OVER (PARTITION BY d.source_rank, d.shard ORDER BY d.seeded, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN shares s ON d.source_rank = s.source_rank AND d.shard = s.shard)
SELECT doc_id, size, source_size, target, CAST(rounds * size + CASE WHEN rounds < 3 THEN greatest(0, least(size, share - rounds * shard_size - before)) ELSE 0 END AS BIGINT) AS taken FROM taking
"""
