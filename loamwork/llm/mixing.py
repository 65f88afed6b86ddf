"""Mixing sources to target weights.

Words are summed per source, targets are shared out by weight under a repetition limit, and each document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.

Defined results: a null text has no words; a null source is a source of its own that comes last; a null doc_id draws
by its text; repeated rows with one doc_id draw alike; a text of any length is counted whole; an empty table gives an empty result; an input column with the
name of a result column is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, written

#: Up to so many sources the table of targets is broadcast (some 40 bytes each); beyond it the join shuffles.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """(source, source_size, weight, target) from `sizes(source, size)`. Sources in code-point order, null last, take
    the weights in turn. Targets are `level * weight`, stopped at `max_repeat * source_size`; the level rises until the
    targets hold `share` times all words. Only sums over the sources reach the driver, never the sources."""
    spark = sizes.sparkSession
    order = F.asc_nulls_last("source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = written(per.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # one row for each partition of the sort
    offsets, before = [], 0
    for p, n in sorted(map(tuple, ranked.groupBy(part.alias("p")).count().collect())):
        offsets.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "p long, before long"))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    s = ranked.join(starts, part == F.col("p")).select(
        "source", "source_size", F.get(turn, ((F.col("before") + within) % len(weights)).cast("int")).alias("weight")
    )
    cap = F.col("source_size") * F.lit(float(max_repeat))
    level, capped = 0.0, -1
    total = s.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.lit(level) * F.col("weight") >= cap if capped >= 0 else F.lit(False)
        n, held, open_ = s.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n <= capped or not open_:  # rounding may bring a source that is just full below its limit again
            break
        level, capped = (share * total - (held or 0.0)) / open_, n
    target = F.when(F.lit(level) * F.col("weight") >= cap, cap).otherwise(F.lit(level) * F.col("weight"))
    return s.withColumn("target", target)


def draw(seed: int, doc_id: Column, text: Column | None = None) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone: 52 bits of an MD5."""
    key = F.coalesce(doc_id.cast("string"), *([F.md5(text.cast("binary"))] if text is not None else []), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixing_plan(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, max_repeat: float = 2.0, seed: int = 17, measured: bool = False) -> DataFrame:
    """`docs` with size, source_size, target, rate, copies and taken. measured: `docs` has `size` already."""
    if not measured:
        docs = docs.withColumn("size", n_words(F.col("text")))
    targets = source_targets(docs.select("source", "size"), weights, share, max_repeat)
    key, = fresh(docs, "mix_source")
    targets = targets.select(F.col("source").alias(key), "source_size", "target")
    docs = docs.drop("source_size", "target", "rate", "copies", "taken")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    text = F.col("text") if "text" in docs.columns else None
    return (
        docs.join(targets, docs["source"].eqNullSafe(targets[key])).drop(key)
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (draw(seed, F.col("doc_id"), text) < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as the plan says, with the columns of `docs`."""
    names = docs.columns
    slim = written(docs.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "source_sizes")
    opts = {"weights": (3.0, 1.0, 2.0), "share": 1.5, "max_repeat": 2.0} | {k: v for k, v in options.items() if k != "seed"}
    key, rate, nth = fresh(docs, "mix_source", "mix_rate", "mix_nth")
    t = source_targets(slim, **opts)
    t = t.select(F.col("source").alias(key), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    copies = F.floor(rate) + (draw(options.get("seed", 17), F.col("doc_id"), F.col("text")) < F.col(rate) - F.floor(rate)).cast("long")
    joined = docs.join(t, docs["source"].eqNullSafe(t[key]))
    return joined.withColumn(nth, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*names)


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.col("text")).alias("text")), "sizes")
    return mixing_plan(slim, measured=True).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN text END AS text,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
m AS (SELECT min(level) FILTER (WHERE k = (SELECT min(k) FROM l WHERE level * weight < cap)) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN coalesce(m.level * weight >= cap, true) THEN cap ELSE m.level * weight END AS target FROM l, m),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM j)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken,
       floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies
FROM u
"""
