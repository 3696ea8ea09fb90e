"""Queries that roll tables up, choose rows, validate and learn, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import rollups, validation
from turnstone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rule predictions for the labelled documents.
JUDGED_SQL = 'judged as (select lang, case when quality = 1 then case when toxic = 1 then \'needs_review\' else \'accept\' end else \'reject\' end as "true", case when n_chars < 400 then \'reject\' when n_chars > 6000 then \'needs_review\' else \'accept\' end as predicted from documents join labels using (doc_id))'
LABELS = ["accept", "needs_review", "reject"]


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    true = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "needs_review").otherwise("accept")).otherwise("reject")
    said = F.when(F.col("n_chars") < 400, "reject").when(F.col("n_chars") > 6000, "needs_review").otherwise("accept")
    return rows.select("lang", true.alias("true"), said.alias("predicted"))


@query("select lang, source, count(*) as n, round(avg(n_chars), 6) as mean_n_chars, round(median(n_chars), 6) as median_n_chars, round(avg(doc_id), 6) as mean_doc_id, round(median(doc_id), 6) as median_doc_id from documents group by 1, 2")
def group_summary_mean_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.summary(table(spark, sf_dir, "documents"), ["lang", "source"], ["n_chars", "doc_id"])


@query("select l_returnflag, count(*) as n, round(avg(l_extendedprice), 6) as mean_l_extendedprice, round(median(l_extendedprice), 6) as median_l_extendedprice, array_to_string(list_sort(list_distinct(list(l_linestatus))), '; ') as l_linestatus from lineitem group by 1")
def shipping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice"], "l_linestatus")


@query("select lang, source, count(*) as n, round(count(*) / sum(count(*)) over (partition by lang), 6) as share from documents group by 1, 2")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.share_of_parent(table(spark, sf_dir, "documents"), ["lang"], "source")


@query("select lang, source, n, row_number() over (partition by lang order by n desc, source) as rank from (select lang, source, count(*) as n from documents group by 1, 2) qualify rank <= 5")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return rollups.top_k(counts, ["lang"], [F.desc("n"), F.col("source")], 5)


@query("select event_type, count(*) as n, count_if(value >= 50) as n_ok, round(avg(case when value >= 50 then value end), 6) as mean_value from events group by 1")
def ok_only_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.means_where(table(spark, sf_dir, "events"), ["event_type"], ["value"], F.col("value") >= 50)


@query("select event_type, count(*) as n, sum(coalesce(json_array_length(list)::bigint, 0))::bigint as items, count_if(list = 'bad') as bad from (select event_type, case event_id % 4 when 0 then '[]' when 1 then '[1, 2]' when 2 then '[\"a\"]' end as list from events) group by 1")
def json_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.col("event_id") % 4 == 0, "[]").when(F.col("event_id") % 4 == 1, "[1, 2]").when(F.col("event_id") % 4 == 2, '["a"]')
    rows = table(spark, sf_dir, "events").select("event_type", listed.alias("list"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.json_array_length("list"), F.lit(0))).cast("long").alias("items"), F.count_if(F.col("list") == "bad").alias("bad"))


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def last_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return rollups.first_by(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return rollups.first_by(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("select user_id, array_to_string((list(event_type order by place))[1:3], ',') as event_types from (select user_id, event_type, min(event_id) as place from events group by 1, 2) group by 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.ordered_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", 3)


@query("select c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) = 1")
def best_row_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return rollups.first_by(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")])


@query("select o.o_custkey, o.o_orderpriority as wanted, p.o_orderkey, p.o_orderpriority as got from (select o_custkey, min(o_orderpriority) as o_orderpriority from orders where o_orderkey % 2 = 0 group by 1) o left join (select * from orders where o_orderkey % 2 = 1) p on o.o_custkey = p.o_custkey qualify row_number() over (partition by o.o_custkey order by case when p.o_orderpriority = o.o_orderpriority then 0 when p.o_orderpriority = '3-MEDIUM' then 1 else 2 end, p.o_orderkey) = 1")
def fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the same key with the same attribute, else the usual one, else the first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    left = orders.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("wanted"))
    met = left.join(orders.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderpriority", "got"), "o_custkey", "left")
    place = F.when(F.col("got") == F.col("wanted"), 0).when(F.col("got") == "3-MEDIUM", 1).otherwise(2)
    return rollups.first_by(met, ["o_custkey"], [place, F.col("o_orderkey")])


@query(f'with {JUDGED_SQL} select "true", predicted, count(*) as n from judged group by 1, 2')
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy("true", "predicted").agg(F.count("*").alias("n"))


def _metrics_sql() -> str:
    cells = ", ".join(f"""count_if("true" = '{x}' and predicted = '{x}') as tp_{x}, count_if(predicted = '{x}') as said_{x}, count_if("true" = '{x}') as support_{x}""" for x in LABELS)
    ratio = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0.0)"
    f1 = {x: ratio(f"2 * tp_{x}", f"(said_{x} + support_{x})") for x in LABELS}
    shown = ", ".join(f"round({ratio(f'tp_{x}', f'said_{x}')}, 6) as precision_{x}, round({ratio(f'tp_{x}', f'support_{x}')}, 6) as recall_{x}, round({f1[x]}, 6) as f1_{x}, support_{x}" for x in LABELS)
    return f"""with {JUDGED_SQL}, cells as (select lang, count(*) as n, count_if("true" = predicted) as hits, {cells} from judged group by 1) select lang, n, round({ratio('hits', 'n')}, 6) as accuracy, round((0.0::double + {' + '.join(f1.values())}) / 3, 6) as macro_f1, {shown} from cells"""


@query(_metrics_sql())
def selective_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.class_metrics(judged(spark, sf_dir), ["lang"], LABELS)


_BINARY_SQL = """binary_rows as (select lang, case when "true" = 'accept' then 'safe_to_apply' else 'do_not_apply' end as "true", case when predicted = 'accept' then 'safe_to_apply' else 'do_not_apply' end as predicted from judged)"""
_RATE = "round(coalesce(count_if({a}) / nullif(count_if({b}), 0), 0.0), 6)"
_SAFE, _APPLIED = "\"true\" = 'safe_to_apply'", "predicted = 'safe_to_apply'"


@query(f"""with {JUDGED_SQL}, {_BINARY_SQL} select lang, count(*) as n, round(count_if("true" = predicted) / count(*), 6) as accuracy, {_RATE.format(a=f'{_SAFE} and {_APPLIED}', b=_APPLIED)} as safe_apply_precision, {_RATE.format(a=f'{_SAFE} and {_APPLIED}', b=_SAFE)} as safe_apply_recall,
  {_RATE.format(a=f'not {_SAFE} and {_APPLIED}', b=f'not {_SAFE}')} as unsafe_apply_rate, {_RATE.format(a=f'{_SAFE} and not {_APPLIED}', b=_SAFE)} as false_block_rate, {_RATE.format(a=_APPLIED, b='true is not null')} as coverage from binary_rows group by 1""")
def binary_safety_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.when(F.col(c) == "accept", "safe_to_apply").otherwise("do_not_apply").alias(c)
    return rollups.safety_metrics(judged(spark, sf_dir).select("lang", two("true"), two("predicted")), ["lang"])


@query("""with m as (select doc_id % 900 as clip_id, case when doc_id % 13 = 0 then '' else source end as path, case when doc_id % 17 = 0 then 'x' else cast(n_chars as varchar) end as duration from documents)
  select clip_id, 'duplicate id' as problem from m group by clip_id having count(*) > 1 union all select clip_id, 'missing path' from m where path = '' union all select clip_id, 'bad duration' from m where try_cast(duration as double) is null""")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path, duration = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("source")), F.when(F.col("doc_id") % 17 == 0, "x").otherwise(F.col("n_chars").cast("string"))
    return validation.manifest_violations(d.select((F.col("doc_id") % 900).alias("clip_id"), path.alias("path"), duration.alias("duration")))


@query("select l.doc_id, case when d.doc_id is null then 'unknown clip' when quality not in (0, 1) then 'bad label' when d.n_chars < 300 then 'interval beyond the clip' end as problem from labels l left join (select * from documents where doc_id % 10 <> 3) d using (doc_id) where d.doc_id is null or quality not in (0, 1) or d.n_chars < 300")
def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").where("doc_id % 10 <> 3").select("doc_id", "n_chars")
    return validation.label_violations(table(spark, sf_dir, "labels"), known)


_BUCKET_SQL = "('0x' || md5(source || '|' || lang)[1:8])::bigint % 100"


@query(f"with s as (select doc_id, source || '|' || lang as grp, case when {_BUCKET_SQL} < 70 then 'train' when {_BUCKET_SQL} < 85 then 'validation' else 'test' end as split from documents) select split, count(*) as n, count(distinct grp) as groups from s group by 1")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "source", "lang").alias("grp"))
    return validation.split_by_group(rows, "grp").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"))


@query(f"with s as (select source || '|' || lang as grp, case when {_BUCKET_SQL} < 70 then 'train' when {_BUCKET_SQL} < 85 then 'validation' else 'test' end as split from documents) select count(*) as leaking from (select grp from s group by 1 having count(distinct split) > 1)")
def group_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("|", "source", "lang").alias("grp"))
    return validation.leaking_groups(validation.split_by_group(rows, "grp"), "grp").agg(F.count("*").alias("leaking"))


@query("select event_id, coalesce(lower(trim(v)) in ('1', 'true', 'yes', 'y', 'on'), false) as flag, coalesce(try_cast(n as double), 0.0) as number, array_to_string(list_filter(list_transform(string_split(parts, ','), lambda x: trim(x)), lambda x: x <> ''), '+') as parts from (select event_id, case event_id % 5 when 0 then ' Yes' when 1 then 'true' when 2 then 'no' when 3 then '1' end as v, case event_id % 4 when 0 then '2.5' when 1 then 'x' when 2 then '' end as n, case event_id % 3 when 0 then 'a, b,' when 1 then 'c' else '' end as parts from events)")
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick(5, " Yes", "true", "no", "1", None).alias("v"), pick(4, "2.5", "x", "", None).alias("n"), pick(3, "a, b,", "c", "").alias("parts"))
    return rows.select("event_id", T.as_bool(F.col("v")).alias("flag"), T.as_float(F.col("n")).alias("number"), F.array_join(T.parse_list(F.col("parts")), "+").alias("parts"))
