"""Queries of reports: rollups, choices, unions and set algebra, with their SQL. The test tables stand for result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import rollups, terms
from turnstone.plans.rollup_queries import JUDGED_SQL, judged
from turnstone.sources.tables import TURNS_SQL, conversation_turns, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


_TEXTS_SQL = "as_text as (select event_type, event_id, user_id, value, case event_id % 5 when 0 then ' ' when 1 then 'n/a' else (value * 2)::decimal(18, 4)::varchar end as rate, case when event_id % 7 = 0 then '' else event_id::varchar end as place from events)"


def as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with numbers as text, some blank."""
    e = F.col("event_id")
    rate = F.when(e % 5 == 0, " ").when(e % 5 == 1, "n/a").otherwise((F.col("value") * 2).cast("decimal(18,4)").cast("string"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value", rate.alias("rate"), F.when(e % 7 == 0, "").otherwise(e.cast("string")).alias("place"))


@query(f"with {_TEXTS_SQL} select event_type, user_id % 3 as part, count(*) as n, round(avg(try_cast(nullif(trim(rate), '') as double)), 6) as mean_rate, round(avg(try_cast(nullif(trim(place), '') as double)), 6) as mean_place from as_text group by 1, 2")
def workflow_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_text(spark, sf_dir).withColumn("part", F.col("user_id") % 3)
    return rollups.means_without_blanks(rows, ["event_type", "part"], ["rate", "place"])


@query("select l_returnflag, l_linestatus, l_quantity > 25 as large, l_discount > 0.05 as cheap, l_tax > 0.04 as taxed, count(*) as n, round(avg(l_quantity::varchar::double), 6) as mean_q, round(avg(l_extendedprice::varchar::double), 6) as mean_p from lineitem group by 1, 2, 3, 4, 5")
def five_key_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).alias("large"), (F.col("l_discount") > 0.05).alias("cheap"), (F.col("l_tax") > 0.04).alias("taxed"), F.col("l_quantity").cast("string").alias("q"), F.col("l_extendedprice").cast("string").alias("p"))
    return rollups.means_without_blanks(rows, ["l_returnflag", "l_linestatus", "large", "cheap", "taxed"], ["q", "p"])


@query("select event_type, count(*) as n, count_if(coalesce(a, false)) as n_a, count_if(b) as n_b, round(count_if(coalesce(a, false)) / count(*), 6) as rate_a, round(count_if(b) / count(*), 6) as rate_b from (select event_type, case when event_id % 4 = 0 then null else value > 50 end as a, user_id % 2 = 0 as b from events) group by 1")
def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 4 != 0, F.col("value") > 50).alias("a"), (F.col("user_id") % 2 == 0).alias("b"))
    return rollups.flag_rates(rows, ["event_type"], ["a", "b"])


@query("select lang, source, count(*) as n, round(avg(b), 6) as mean_before, round(avg(a), 6) as mean_after, round(avg(a - b), 6) as mean_delta, count_if(a < b) as n_improved, bool_or(a > b) as any_worse, min_by(model, doc_id) as first_model from (select lang, source, doc_id, (n_chars % 100) / 100 as b, (doc_id % 100) / 100 as a, 'm' || (doc_id % 3) as model from documents) group by 1, 2")
def before_after_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("lang", "source", "doc_id", ((F.col("n_chars") % 100) / 100).alias("b"), ((F.col("doc_id") % 100) / 100).alias("a"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"))
    return rollups.before_after(rows, ["lang", "source"], "b", "a", "doc_id", "model")


@query("select lang, source, n, example, round(n / total, 6) as share, rank from (select *, sum(n) over (partition by lang) as total, row_number() over (partition by lang order by n desc, source) as rank from (select lang, source, count(*) as n, min(doc_id) as example from documents group by 1, 2)) where rank <= 5")
def error_pattern_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.share_with_example(table(spark, sf_dir, "documents"), ["lang"], "source", "doc_id")


@query("""select user_id, '{' || string_agg('"' || event_type || '":' || rate, ',' order by event_type) || '}' as rates from (select user_id, event_type, case when r = floor(r) then r::bigint || '.0' else r::varchar end as rate from (select user_id, event_type, round(count_if(value > 50) / count(*), 6) as r from events group by 1, 2)) group by 1""")
def unsafe_rate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rate_map(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("value") > 50)


@query("with l as (select user_id, event_type, value, event_id, case when event_id % 3 = 0 then 'bad' else value::varchar end as v from events) select user_id, max_by(try_cast(v as double), event_id) filter (event_type in ('click', 'view') and try_cast(v as double) is not null) as seen, max_by(try_cast(v as double), event_id) filter (event_type = 'purchase' and try_cast(v as double) is not null) as bought from l group by 1")
def latest_metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.col("value").cast("string")))
    return rollups.latest_values(rows, ["user_id"], {"seen": ["click", "view"], "bought": ["purchase"]}, "event_type", "v", "event_id")


@query("select case when o_custkey % 10 < 7 then 'train' when o_custkey % 10 < 9 then 'validation' else 'test' end as split, count(*) as n, count(distinct o_custkey) as n_groups, count_if(o_orderstatus = 'O') as \"n_O\", count_if(o_orderstatus = 'F') as \"n_F\", count_if(o_orderstatus = 'X') as \"n_X\" from orders group by 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("o_custkey") % 10
    rows = table(spark, sf_dir, "orders").withColumn("split", F.when(part < 7, "train").when(part < 9, "validation").otherwise("test"))
    return rollups.split_summary(rows, "split", "o_custkey", "o_orderstatus", ["O", "F", "X"])


@query("select d.place, d.event_type, coalesce(n, 0) as n from (values (0, 'purchase'), (1, 'click'), (2, 'never')) d(place, event_type) left join (select event_type, count(*) as n from events group by 1) e using (event_type)")
def counts_over_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.counts_over_domain(table(spark, sf_dir, "events"), "event_type", ["purchase", "click", "never"])


@query("with c as (select o_orderstatus, count(*) as own from orders group by 1) select o_orderkey, round((select sum(own) from c) / ((select count(*) from c) * own), 6) as weight from orders join c using (o_orderstatus)")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.balanced_weights(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").select("o_orderkey", "weight")


def _rate_sql(a: str, b: str) -> str:
    return f"round(coalesce(count_if({a}) / nullif(count_if({b}), 0), 0), 6)"


_TRUE = '"true"'
_F1_SQL = " + ".join(f"coalesce(2 * count_if({_TRUE} = '{x}' and predicted = '{x}') / nullif(count_if({_TRUE} = '{x}') + count_if(predicted = '{x}'), 0), 0.0)" for x in ("accept", "reject", "needs_review"))


@query(f"""with {JUDGED_SQL} select lang, count(*) as n, round(({_F1_SQL}) / 3, 6) as macro_f1, {_rate_sql(f"{_TRUE} in ('reject', 'needs_review') and predicted = 'accept'", f"{_TRUE} in ('reject', 'needs_review')")} as unsafe_accept_rate, {_rate_sql(f"{_TRUE} = 'needs_review' and predicted = 'needs_review'", f"{_TRUE} = 'needs_review'")} as needs_review_recall,
  {_rate_sql(f"{_TRUE} = 'accept' and predicted = 'accept'", "predicted = 'accept'")} as accept_precision, {_rate_sql(f"{_TRUE} = 'reject' and predicted = 'reject'", f"{_TRUE} = 'reject'")} as reject_recall, {_rate_sql("predicted <> 'needs_review'", "true")} as coverage from judged group by 1""")
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.selective_metrics(judged(spark, sf_dir), ["lang"])


@query(f"with {TURNS_SQL} select clip_id, count(distinct speaker) as n_speakers, count(*) as n_turns, count_if(idx % 3 = 0) as n_overlap, count_if(idx % 4 = 0) as n_review, count_if(idx % 5 = 1) as n_rejected, greatest(sum(idx % 2), sum(idx % 3))::bigint as n_changes, min(start_ms) as start_ms, max(end_ms) as end_ms, md5(string_agg(text, ' ' order by idx)) as text_md5, avg((idx % 5 <> 0)::int) >= 0.8 as mostly_kept, bool_or(idx % 9 = 8) as any_mock, bool_and(length(text) > 0) as all_text from turns group by 1")
def clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, span, whole text and yes-or-no marks of each clip."""
    i = F.col("idx")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    return conversation_turns(spark, sf_dir).groupBy("clip_id").agg(
        F.count_distinct("speaker").alias("n_speakers"), F.count("*").alias("n_turns"), F.count_if(i % 3 == 0).alias("n_overlap"), F.count_if(i % 4 == 0).alias("n_review"), F.count_if(i % 5 == 1).alias("n_rejected"),
        F.greatest(F.sum(i % 2), F.sum(i % 3)).alias("n_changes"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.md5(whole).alias("text_md5"),
        (F.avg((i % 5 != 0).cast("int")) >= 0.8).alias("mostly_kept"), F.bool_or(i % 9 == 8).alias("any_mock"), F.bool_and(F.length("text") > 0).alias("all_text"),
    )


@query("select count_if(value > 60) as n_interruption, count_if(value between 30 and 60) as n_backchannel, count_if(value < 30) as n_uncertain, round(count_if(value > 60) / nullif(count_if(value >= 30), 0), 6) as precision, event_type from events group by event_type")
def interruption_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    sure = F.count_if(v >= 30)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(v > 60).alias("n_interruption"), F.count_if((v >= 30) & (v <= 60)).alias("n_backchannel"), F.count_if(v < 30).alias("n_uncertain"), F.round(F.try_divide(F.count_if(v > 60), sure), 6).alias("precision"))


@query("select c_custkey, coalesce(a.n, 0) as n_exact, coalesce(a.total, b.total) as total, case when a.n is not null then 'exact' when b.total is not null then 'nation' else 'none' end as how from customer c left join (select o_custkey, count(*) as n, sum(o_totalprice)::double as total from orders group by 1) a on c_custkey = o_custkey left join (select s_nationkey, sum(s_acctbal)::double as total from supplier where s_suppkey % 2 = 0 group by 1) b on c_nationkey = s_nationkey")
def coalesced_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join with a second source where the first has nothing, and the reason."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("double").alias("own"))
    b = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.sum("s_acctbal").cast("double").alias("other"))
    met = table(spark, sf_dir, "customer").join(a, "c_custkey", "left").join(b, "c_nationkey", "left")
    how = F.when(F.col("n").isNotNull(), "exact").when(F.col("other").isNotNull(), "nation").otherwise("none")
    return met.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_exact"), F.coalesce("own", "other").alias("total"), how.alias("how"))


@query("select a.doc_id, a.n_chars - b.n_chars as delta from documents a join documents b on a.lang = b.lang and a.source = b.source and b.doc_id = a.doc_id + 20 union all select doc_id, null from documents where doc_id % 50 = 49 and n_chars > 100")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join on two keys, and a variant of its own for rows that have no partner by design."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    other = docs.select("lang", "source", (F.col("doc_id") - 20).alias("doc_id"), F.col("n_chars").alias("other"))
    met = docs.join(other, ["lang", "source", "doc_id"]).select("doc_id", (F.col("n_chars") - F.col("other")).alias("delta"))
    return met.unionByName(docs.where("doc_id % 50 = 49 and n_chars > 100").select("doc_id", F.lit(None).cast("long").alias("delta")))


@query("select p_partkey, case when p_name like '%a%' and p_name like '%e%' then 'both' when p_name like '%a%' then 'a' else coalesce(k.category, 'other') end as category from part left join (values ('1', 'one'), ('2', 'two')) k(digit, category) on k.digit = (p_partkey % 4)::varchar")
def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("1", "one"), ("2", "two")], "digit string, category string")
    rows = table(spark, sf_dir, "part").withColumn("digit", (F.col("p_partkey") % 4).cast("string")).join(F.broadcast(known), "digit", "left")
    a, e = F.contains("p_name", F.lit("a")), F.contains("p_name", F.lit("e"))
    return rows.select("p_partkey", F.when(a & e, "both").when(a, "a").otherwise(F.coalesce("category", F.lit("other"))).alias("category"))


@query("with a as (select doc_id as key, 'docs' as origin, n_chars as size, lang, null::varchar as url from documents where doc_id % 3 = 0), b as (select page_id as key, 'pages' as origin, null::bigint as size, null as lang, url from pages) select key, origin, size, lang, url from a union all select key, origin, size, lang, url from b where key not in (select key from a)")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("key"), F.col("n_chars").cast("long").alias("size"), "lang")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url")
    return rollups.union_of_sources({"docs": docs, "pages": pages}, "key").select("key", "origin", "size", "lang", "url")


@query(f"with {TURNS_SQL}, s as (select a.clip_id, a.idx, regexp_extract_all(lower(a.text), '[a-z0-9]+') as x, regexp_extract_all(lower(b.text), '[a-z0-9]+') as y from turns a join turns b on a.clip_id = b.clip_id and b.idx = a.idx + 1), d as (select *, list_distinct(x) as dx, list_distinct(y) as dy, list_distinct(list_intersect(x, y)) as i from s) select clip_id, idx, len(i) as both, len(dx) - len(i) as only_first, len(dy) - len(i) as only_second, len(dx) + len(dy) - len(i) as either, case when len(dy) = 0 then 1.0 else round(len(i) / len(dy), 6) end as precision, case when len(dx) = 0 then 1.0 else round(len(i) / len(dx), 6) end as recall, case when len(dx) + len(dy) = 0 then 1.0 else round(2 * len(i) / (len(dx) + len(dy)), 6) end as f1 from d")
def token_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_turns(spark, sf_dir).select("clip_id", "idx", T.tokens(F.col("text")).alias("x"))
    pairs = own.join(own.select("clip_id", (F.col("idx") - 1).alias("idx"), F.col("x").alias("y")), ["clip_id", "idx"])
    precision, recall, f1 = terms.set_scores(F.col("x"), F.col("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("clip_id", "idx", both.alias("both"), F.size(F.array_except("x", "y")).alias("only_first"), F.size(F.array_except("y", "x")).alias("only_second"), F.size(F.array_union("x", "y")).alias("either"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


@query("with r as (select doc_id, list_filter(['the of', 'de la', 'und', 'is'], lambda t: contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' ' || t || ' ')) as held from documents) select doc_id, len(held) as n, array_to_string(list_sort(held), ',') as found, round(len(held) / 4, 6) as recall from r")
def term_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(T.tokens(F.col("text")), " ")
    n, held, recall = terms.term_scores(F.array(*map(F.lit, ("the of", "de la", "und", "is"))), text)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), held.alias("found"), recall.alias("recall"))


@query("""with d as (select o_orderkey as k, case when o_orderkey % 2 = 0 then ['a', 'b'] else [] end as applied, case when o_orderkey % 3 = 0 then ['c'] else [] end as rejected, case when o_orderkey % 5 = 0 then ['d'] else [] end as reviewed, [] as skipped from orders), u as (select k, 'applied' as decision, unnest(applied) as term, generate_subscripts(applied, 1) - 1 as "at" from d union all select k, 'rejected', unnest(rejected), generate_subscripts(rejected, 1) - 1 from d union all select k, 'reviewed', unnest(reviewed), generate_subscripts(reviewed, 1) - 1 from d) select k, decision, "at", term from u union all select k, 'no_action', 0, null from d where k not in (select k from u)""")
def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    listed = lambda m, *names: F.when(k % m == 0, F.array(*map(F.lit, names))).otherwise(none)
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), listed(2, "a", "b").alias("applied"), listed(3, "c").alias("rejected"), listed(5, "d").alias("reviewed"), none.alias("skipped"))
    return rollups.unpivot_decisions(rows, "k", ["applied", "rejected", "reviewed", "skipped"])


@query("select lang, doc_id, rank, augmentation from (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents), (select unnest(['lower', 'upper', 'noise']) as augmentation) where rank <= 3")
def augmented_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of each group, each once for each augmentation."""
    best = rollups.top_k(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3)
    return best.select("lang", "doc_id", "rank", F.explode(F.array(F.lit("lower"), F.lit("upper"), F.lit("noise"))).alias("augmentation"))


@query("select o_orderkey, o_totalprice::double as price, rank from (select *, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders where o_totalprice > 100000) where rank <= 25")
def audit_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over a threshold, the greatest first, 25 of them: a limit before the numbering, so no task orders all rows."""
    top = table(spark, sf_dir, "orders").where("o_totalprice > 100000").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))


@query(f"with {TURNS_SQL}, q as (select clip_id, regexp_extract_all(lower(text), '[a-z0-9]+') as words from turns where idx = 0), s as (select t.clip_id, t.idx, len(list_distinct(list_intersect(regexp_extract_all(lower(t.text), '[a-z0-9]+'), words))) as score from turns t join q using (clip_id) where t.idx > 0) select clip_id, idx, score from s qualify row_number() over (partition by clip_id order by score desc, idx) = 1")
def best_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each clip's first turn, the later turn that shares most words with it, the earliest of equals."""
    turns = conversation_turns(spark, sf_dir).select("clip_id", "idx", T.tokens(F.col("text")).alias("words"))
    asked = turns.where("idx = 0").select("clip_id", F.col("words").alias("asked"))
    met = turns.where("idx > 0").join(asked, "clip_id").select("clip_id", "idx", F.size(F.array_intersect("words", "asked")).alias("score"))
    return rollups.first_by(met, ["clip_id"], [F.desc("score"), F.col("idx")])


@query(f"with {TURNS_SQL} select clip_id, idx, lpad((start_ms // 60000)::varchar, 2, '0') || ':' || lpad(((start_ms % 60000) // 1000)::varchar, 2, '0') || '.' || lpad(((start_ms % 1000) // 10)::varchar, 2, '0') as stamp, coalesce(nullif(trim(regexp_replace(case when idx % 7 = 3 then '..' else '_' || clip_id || ' ' || speaker || '/.' end, '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'transcript') as stem, case when idx % 5 = 0 then '(not configured)' when idx % 5 = 1 then '******' else left(md5(text), 3) || '...' || right(md5(text), 2) end as masked from turns")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps, safe file names and masked keys."""
    i = F.col("idx")
    name = F.when(i % 7 == 3, "..").otherwise(F.concat(F.lit("_"), F.concat_ws(" ", F.col("clip_id").cast("string"), "speaker"), F.lit("/.")))
    key = F.when(i % 5 == 0, " ").when(i % 5 == 1, "secret").otherwise(F.md5("text"))
    return conversation_turns(spark, sf_dir).select("clip_id", "idx", T.audio_stamp(F.col("start_ms") / 1000).alias("stamp"), T.safe_stem(name).alias("stem"), T.masked(key).alias("masked"))


@query("select doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') as has_the, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w not in ('the', 'of', 'and', 'de', 'la'))) as n_content from documents")
def bounded_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = T.without_stopwords(T.tokens(F.col("text")), ("the", "of", "and", "de", "la"))
    return table(spark, sf_dir, "documents").select("doc_id", T.bounded_phrase(F.col("text"), "the").alias("has_the"), F.size(content).alias("n_content"))


@query(f"with {TURNS_SQL}, t as (select clip_id, idx, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from turns), p as (select clip_id, idx, unnest(ts) as token, generate_subscripts(ts, 1) as pos, ts from t) select clip_id, idx, pos - 1 as pos, array_to_string(ts[greatest(1, pos - 2):pos + 2], ' ') as frame from p where token = 'the'")
def context_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokens before and after each place of a token."""
    turns = conversation_turns(spark, sf_dir).select("clip_id", "idx", T.tokens(F.col("text")).alias("ts"))
    at = turns.select("clip_id", "idx", "ts", F.posexplode("ts").alias("pos", "token")).where("token = 'the'")
    low = F.greatest(F.lit(0), F.col("pos") - 2)
    return at.select("clip_id", "idx", "pos", F.array_join(F.slice("ts", low + 1, F.col("pos") + 3 - low), " ").alias("frame"))
