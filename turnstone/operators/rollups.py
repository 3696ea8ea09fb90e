"""Rollups, ranked choices and deduplication that the evaluation reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, keys: list[str], means: list[str], notes: str | None = None) -> DataFrame:
    """count, and mean and exact median of the means, by keys; notes' different values sorted, joined by '; '."""
    made = [F.count("*").alias("n")]
    for c in means:
        made += [F.round(F.avg(c), 6).alias(f"mean_{c}"), F.round(F.median(c), 6).alias(f"median_{c}")]
    if notes:
        made.append(F.array_join(F.array_sort(F.collect_set(notes)), "; ").alias(notes))
    return rows.groupBy(*keys).agg(*made)


def means_where(rows: DataFrame, keys: list[str], columns: list[str], condition: Column) -> DataFrame:
    """Means over the rows that meet the condition, counts over all; null where none meets it."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(condition).alias("n_ok"), *[F.round(F.avg(F.when(condition, F.col(c))), 6).alias(f"mean_{c}") for c in columns])


def share_of_parent(rows: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Counts by parent and child, and each one's share of its parent's total."""
    counts = rows.groupBy(*parent, child).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*parent))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def top_k(counts: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, ranked."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: last wins with a descending order, first wins with an ascending one."""
    return top_k(rows, keys, order, 1).drop("rank")


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, order: str, k: int | None = None) -> DataFrame:
    """Different values of each key in the order of their first place, k at most, joined by commas."""
    seen = rows.groupBy(*keys, value).agg(F.min(order).alias("place"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value].cast("string"))
    return seen.groupBy(*keys).agg(F.array_join(F.slice(listed, 1, k) if k else listed, ",").alias(f"{value}s"))


def class_metrics(rows: DataFrame, keys: list[str], labels: list[str], true: str = "true", predicted: str = "predicted") -> DataFrame:
    """n, accuracy, macro_f1, and precision, recall, f1 and support of each label, by keys; 0 where a denominator is."""
    t, p = F.col(true), F.col(predicted)
    counts = [F.count("*").alias("n"), F.count_if(t == p).alias("right")]
    for x in labels:
        counts += [F.count_if((t == x) & (p == x)).alias(f"tp_{x}"), F.count_if(p == x).alias(f"said_{x}"), F.count_if(t == x).alias(f"support_{x}")]
    out = rows.groupBy(*keys).agg(*counts)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = {x: ratio(2 * F.col(f"tp_{x}"), F.col(f"said_{x}") + F.col(f"support_{x}")) for x in labels}
    shown = [F.round(ratio(F.col("right"), F.col("n")), 6).alias("accuracy"), F.round(sum(f1.values(), F.lit(0.0)) / len(labels), 6).alias("macro_f1")]
    for x in labels:
        shown += [F.round(ratio(F.col(f"tp_{x}"), F.col(f"said_{x}")), 6).alias(f"precision_{x}"), F.round(ratio(F.col(f"tp_{x}"), F.col(f"support_{x}")), 6).alias(f"recall_{x}"), F.round(f1[x], 6).alias(f"f1_{x}"), F.col(f"support_{x}")]
    return out.select(*keys, "n", *shown)


def safety_metrics(rows: DataFrame, keys: list[str], true: str = "true", predicted: str = "predicted") -> DataFrame:
    """Of binary apply decisions: precision and recall of safe ones, unsafe-apply and false-block rates, coverage."""
    safe, applied = F.col(true) == "safe_to_apply", F.col(predicted) == "safe_to_apply"
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0)), 6)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), ratio(safe == applied, F.lit(True)).alias("accuracy"), ratio(safe & applied, applied).alias("safe_apply_precision"), ratio(safe & applied, safe).alias("safe_apply_recall"),
        ratio(~safe & applied, ~safe).alias("unsafe_apply_rate"), ratio(safe & ~applied, safe).alias("false_block_rate"), ratio(applied, F.lit(True)).alias("coverage"),
    )


def means_without_blanks(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Means of text columns that hold numbers; blanks and what is no number are left out."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(F.expr(f"try_cast(nullif(trim({c}), '') as double)")), 6).alias(f"mean_{c}") for c in columns])


def flag_rates(rows: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """How often each flag is true, and its share; a null flag counts as false."""
    true = {c: F.count_if(F.coalesce(F.col(c), F.lit(False))) for c in flags}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[n.alias(f"n_{c}") for c, n in true.items()], *[F.round(n / F.count("*"), 6).alias(f"rate_{c}") for c, n in true.items()])


def before_after(rows: DataFrame, keys: list[str], before: str, after: str, order: str, first: str) -> DataFrame:
    """Means before and after, their difference, how many improved, and the first row's value of a column."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(before), 6).alias("mean_before"), F.round(F.avg(after), 6).alias("mean_after"), F.round(F.avg(F.col(after) - F.col(before)), 6).alias("mean_delta"),
        F.count_if(F.col(after) < F.col(before)).alias("n_improved"), F.bool_or(F.col(after) > F.col(before)).alias("any_worse"), F.min_by(first, order).alias(f"first_{first}"),
    )


def share_with_example(rows: DataFrame, parent: list[str], child: str, order: str, k: int = 5) -> DataFrame:
    """The k commonest children of each parent with count, share of the parent's total and the first row's order."""
    counts = rows.groupBy(*parent, child).agg(F.count("*").alias("n"), F.min(order).alias("example"))
    counts = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*parent)), 6))
    return top_k(counts, parent, [F.desc("n"), F.col(child)], k)


def rate_map(rows: DataFrame, keys: list[str], category: str, flag: Column) -> DataFrame:
    """By keys, a JSON map from category to the share of rows with the flag, in the order of categories."""
    rates = rows.groupBy(*keys, category).agg(F.round(F.count_if(flag) / F.count("*"), 6).alias("rate"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(category).alias("key"), F.col("rate").alias("value"))))
    return rates.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("rates"))


def latest_values(rows: DataFrame, keys: list[str], aliases: dict[str, list[str]], name: str, value: str, order: str) -> DataFrame:
    """By keys, the last numeric value of each metric, which may have several names."""
    number = F.expr(f"try_cast({value} as double)")
    return rows.groupBy(*keys).agg(*[F.max_by(F.when(F.col(name).isin(*names), number), F.when(F.col(name).isin(*names) & number.isNotNull(), F.col(order))).alias(metric) for metric, names in aliases.items()])


def split_summary(rows: DataFrame, split: str, group: str, label: str, labels: list[str]) -> DataFrame:
    """Rows, different groups and rows of each label by split; labels that don't occur count 0."""
    return rows.groupBy(split).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"), *[F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels])


def counts_over_domain(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """How often each value of a domain comes; 0 for those that don't."""
    listed = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(domain)], f"place int, {column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return listed.join(counts, column, "left").select("place", column, F.coalesce("n", F.lit(0)).alias("n"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight = n / (classes * rows of its class), so that classes weigh alike."""
    counts = rows.groupBy(label).agg(F.count("*").alias("own"))
    totals = counts.agg(F.sum("own").alias("total"), F.count("*").alias("classes"))
    of = counts.join(F.broadcast(totals)).select(label, F.round(F.col("total") / (F.col("classes") * F.col("own")), 6).alias("weight"))
    return rows.join(F.broadcast(of), label)


def selective_metrics(rows: DataFrame, keys: list[str], true: str = "true", predicted: str = "predicted") -> DataFrame:
    """Of accept, reject and needs_review: macro-F1, how many of what must not be accepted is, recalls, precision of accepts, coverage; 0 where a denominator is."""
    t, p = F.col(true), F.col(predicted)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    f1 = lambda x: F.coalesce(F.try_divide(2 * F.count_if((t == x) & (p == x)), F.count_if(t == x) + F.count_if(p == x)), F.lit(0.0))
    unsafe = t.isin("reject", "needs_review")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round((f1("accept") + f1("reject") + f1("needs_review")) / 3, 6).alias("macro_f1"), F.round(ratio(unsafe & (p == "accept"), unsafe), 6).alias("unsafe_accept_rate"),
        F.round(ratio((t == "needs_review") & (p == "needs_review"), t == "needs_review"), 6).alias("needs_review_recall"), F.round(ratio((t == "accept") & (p == "accept"), p == "accept"), 6).alias("accept_precision"),
        F.round(ratio((t == "reject") & (p == "reject"), t == "reject"), 6).alias("reject_recall"), F.round(ratio(p != "needs_review", F.lit(True)), 6).alias("coverage"),
    )


def union_of_sources(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """All sources' rows with the name of each, the first source of each key winning; columns that one lacks are null."""
    out = None
    for place, (name, rows) in enumerate(sources.items()):
        named = rows.withColumn("origin", F.lit(name)).withColumn("origin_place", F.lit(place))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return first_by(out, [key], [F.col("origin_place")]).drop("origin_place")


def unpivot_decisions(rows: DataFrame, key: str, decisions: list[str]) -> DataFrame:
    """A row for each entry of the decision arrays, with its decision and place; none at all gives one row, no_action."""
    entries = lambda name: F.transform(name, lambda x, i: F.struct(F.lit(name).alias("decision"), i.alias("at"), x.alias("term")))
    named = F.concat(*map(entries, decisions))
    listed = F.when(F.size(named) > 0, named).otherwise(F.array(F.struct(F.lit("no_action").alias("decision"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("term"))))
    return rows.select(key, F.inline(listed))
