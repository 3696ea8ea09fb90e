"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources, by code point and null last, weigh 1, 2, 3, repeating, and share 100 % of all words; a target stops
at ``limit`` times its source's words, and the excess is shared anew by weight until no target is above its limit.

Expected copies: a document of a source with r = target / words is expected r + tilt * min(r, limit - r) * (x - mean x)
times, where x grows with its length and the mean is weighted by words. So expectations differ between documents, stay
within 0 and limit, and their words add up to the target. The whole part of an expectation is certain copies. The
fraction p is the inclusion probability of one copy more: documents are ranked by random odds over inclusion odds,
u / (1 - u) * (1 - p) / p with u from a keyed hash of doc_id, and those of the smallest ranks are taken as long as the
target's words aren't exceeded; then the document whose length comes closest to what is missing closes the gap, as do
up to two more.

Ranks are summed up by bucket before any document is ordered, so only the bucket that holds a source's limit is sorted.
Null text has no words and is never taken. Equal ranks go by doc_id. Reruns agree: no random state and no order counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import drop, stage, word_count

LIMIT = 3
TILT = 0.5
SEED = "mix"
#: Length in words at which x is a half.
HALF_LENGTH = 256
BUCKETS = 4096
#: Documents of a source that may close what its ranked documents leave open.
CLOSINGS = 3


def source_targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """source, source_size, mean_x, weight, target, by source of sizes (source, size). One row a source."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("x")).alias("size_x"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    # Sources reach their limit in the order of limit over weight. All before the first that doesn't are at it.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level)
    own = own.withColumn("full", F.col("level") * F.col("weight") >= F.col("source_size") * limit)
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), (F.col("source_size") * limit).cast("double")).otherwise(F.col("weight") * open_level)
    return own.select("source", "source_size", "weight", target.alias("target"), F.coalesce(F.col("size_x") / F.col("source_size"), F.lit(0.0)).alias("mean_x"))


def mix(docs: DataFrame, limit: int = LIMIT, tilt: float = TILT, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) for each row of docs."""
    size = word_count(F.col("text"))
    sizes = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")).withColumn("x", F.expr(f"size * 1000 div (size + {HALF_LENGTH})")), "mix-sizes")
    targets = stage(source_targets(sizes, limit), "mix-targets")
    same_source = F.expr("sizes.source <=> targets.source")
    ratio = F.coalesce(F.expr("target / source_size"), F.lit(0.0))
    expected = F.col("r") + tilt * F.least(F.col("r"), limit - F.col("r")) * ((F.col("x") - F.col("mean_x")) / 1000)
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    ranked = (
        sizes.alias("sizes").join(targets.alias("targets"), same_source)
        .select("doc_id", "sizes.source", "size", "source_size", "target", "x", "mean_x", ratio.alias("r"))
        .withColumn("expected", F.greatest(F.lit(0.0), F.least(expected, F.lit(float(limit)))))
        .withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain"))
        .withColumn("u", uniform)
        .withColumn("odds", F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("u") / (1 - F.col("u")) * ((1 - F.col("p")) / F.col("p"))))
        .withColumn("bucket", F.floor(F.col("odds") / (1 + F.col("odds")) * BUCKETS))
        .select("doc_id", "source", "size", "source_size", "target", "certain", "odds", "bucket")
    )
    ranked = stage(ranked, "mix-ranked")
    by_source = Window.partitionBy("source").orderBy("bucket")
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("certain")).alias("certain_words"), F.max("target").alias("target"))
    sums = sums.withColumn("budget", F.col("target") - F.sum("certain_words").over(Window.partitionBy("source"))).where("bucket is not null")
    sums = sums.withColumn("through", F.sum("words").over(by_source))
    # The first bucket that doesn't fit whole, and the words before it.
    limits = stage(
        sums.where("through > budget").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("through") - F.col("words")).alias("before"), "budget"), "bucket").alias("at"))
        .select(F.col("source").alias("limit_source"), F.col("at.bucket").alias("limit_bucket"), "at.before", "at.budget"), "mix-limits",
    )
    marked = ranked.join(limits, F.expr("source <=> limit_source"), "left")
    beyond = (F.col("bucket") == F.col("limit_bucket")) & F.col("bucket").isNotNull()
    kept = ["doc_id", "source", "size", "source_size", "target", "certain", "odds", "limit_source", "budget"]
    inside = marked.where(~F.coalesce(beyond, F.lit(False))).select(*kept, (F.col("bucket") < F.coalesce("limit_bucket", F.lit(BUCKETS + 1))).cast("long").alias("more"))
    running = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("odds", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    at_limit = marked.where(beyond).withColumn("running", running).select(*kept, (F.col("running") <= F.col("budget")).cast("long").alias("more"))
    chosen = stage(inside.unionByName(at_limit).withColumn("more", F.coalesce("more", F.lit(0))), "mix-chosen")
    # What is missing then, closed by the document of the source that comes closest to it, a few times.
    picked = None
    for _ in range(CLOSINGS):
        picks = [] if picked is None else [picked]
        taken = chosen.where("odds is not null").select("source", "budget", F.expr("size * more").alias("words"))
        for one in picks:
            taken = taken.unionByName(one.select(F.col("closing_source").alias("source"), F.lit(None).cast("double").alias("budget"), F.col("closing_size").alias("words")))
        gaps = taken.groupBy("source").agg(F.sum("words").alias("words"), F.max("budget").alias("budget")).where("budget > words")
        gaps = stage(gaps.select(F.col("source").alias("gap_source"), (F.col("budget") - F.col("words")).alias("gap")), "mix-gaps")
        free = chosen.where("more = 0 and odds is not null").join(gaps, F.expr("source <=> gap_source"))
        for one in picks:
            free = free.join(one, F.expr("source <=> closing_source and doc_id = closing"), "left_anti")
        free = free.withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("off < gap")
        best = free.groupBy("gap_source").agg(F.min(F.struct("off", "doc_id", "size")).alias("one"))
        best = best.select(F.col("gap_source").alias("closing_source"), F.col("one.doc_id").alias("closing"), F.col("one.size").alias("closing_size"))
        picked = stage(best if picked is None else picked.unionByName(best), "mix-closing")
    done = chosen.join(picked, F.expr("source <=> closing_source and doc_id = closing and more = 0 and odds is not null"), "left")
    copies = F.col("certain") + F.col("more") + F.col("closing").isNotNull().cast("long")
    out = done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    drop(sizes, ranked)
    return out


def apply_mix(docs: DataFrame, limit: int = LIMIT, tilt: float = TILT, seed: str = SEED) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows taken no time go.

    Rows of one doc_id, source and size are taken alike, also where doc_id is null: such rows have no random odds and
    get their certain copies alone.
    """
    same = ["doc_id", "source", "size"]
    copies = mix(docs, limit, tilt, seed).groupBy(*same).agg(F.max("copies").alias("mix_copies")).where("mix_copies > 0")
    copies = copies.select(*[F.col(name).alias(f"mix_{name}") for name in same], "mix_copies").hint("merge")
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("mix_doc_id")) & docs["source"].eqNullSafe(F.col("mix_source")) & (word_count(docs["text"]) == F.col("mix_size"))
    joined = docs.join(copies, on).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return joined.select(*[docs[name] for name in docs.columns])
