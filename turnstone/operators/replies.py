"""Replies of a language model as a table: untrusted texts become proposals with reasons, are gated and applied, and scored before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import evidence
from turnstone.operators.assignment import texts_with_phrases
from turnstone.operators.audits import HAN
from turnstone.scratch import by_sorting, written

LISTS = ("corrections", "needs_review", "no_op")
DECISIONS = ("accept", "reject", "needs_review", "no_op")
TEXTS = ("reference", "hypothesis", "corrected")


def json_object(reply: Column) -> Column:
    """The text from the first { to the last } of a reply, without a fence around it; null if there is none."""
    bare = F.regexp_replace(reply, r"^\s+|\s+$", "")
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(bare)
    start, end = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    return F.when((start > 0) & F.contains(bare, F.lit("}")) & (end >= start), F.substring(bare, start, end - start + 1))


def parse_replies(replies: DataFrame) -> DataFrame:
    """A row for each entry of each reply (id, reply): id, list, place, source, replacement, canonical, and failed (null, or why).

    A reply without an object, or with a damaged one, is one row without a list: no_json_object or damaged_json. An entry of
    corrections that is no object has failed as not_an_object; such entries of the other lists are left out, as is a list
    that is none. What isn't text is taken as text, what is missing as empty. A null reply has no object.
    """
    # Variants that are no objects can't come out of json_object: it begins with {.
    read = replies.select("id", json_object(F.col("reply")).alias("object")).withColumn("v", F.try_parse_json("object"))
    why = F.when(F.col("object").isNull(), "no_json_object").when(F.col("v").isNull(), "damaged_json")
    text = lambda name: F.coalesce(F.try_variant_get(F.col("item"), f"$.{name}", "string"), F.lit(""))
    rows = read.where(why.isNotNull()).select("id", F.lit(None).cast("string").alias("list"), F.lit(0).alias("place"), *(F.lit("").alias(name) for name in ("source", "replacement", "canonical")), why.alias("failed"))
    for name in LISTS:
        each = read.where("v is not null").select("id", F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("place", "item"))
        is_object = F.coalesce(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")), F.lit(False))
        term = text("canonical_term") if name == "corrections" else F.coalesce(*(F.try_variant_get(F.col("item"), f"$.{key}", "string") for key in ("canonical_term", "candidate_term", "replacement_text")), F.lit(""))
        each = each.where(is_object) if name != "corrections" else each
        rows = rows.unionByName(each.select("id", F.lit(name).alias("list"), "place", text("source_text").alias("source"), text("replacement_text").alias("replacement"), term.alias("canonical"), F.when(~is_object, "not_an_object").alias("failed")))
    return rows


def decided(texts: DataFrame, replies: DataFrame, glossary: DataFrame, version: str = "v2") -> tuple[DataFrame, DataFrame]:
    """Corrected texts (id, corrected, records) and all decisions (id, decision, place, source, canonical, reason) on replies to texts (id, text).

    Proposals are gated in their order on the text as those before left it. What the reply itself wants reviewed, or left
    as it is, comes before what the gate does; of records of one source and term, in any case, each decision keeps the first.
    """
    entries = parse_replies(replies)
    proposals = entries.where("list = 'corrections' and failed is null").select("id", "place", "source", "replacement", "canonical")
    # Written, as decisions, texts and scores read it, and gates are large expressions.
    done = written(evidence.apply_corrections(texts, proposals, glossary, version), "replies-applied")
    gated = done.select("id", F.explode("records").alias("r")).select("id", F.col("r.decision").alias("decision"), F.lit(1).alias("from_gate"), F.col("r.place").alias("place"), F.col("r.source").alias("source"), F.col("r.canonical").alias("canonical"), F.col("r.reason").alias("reason"))
    said = entries.where("list in ('needs_review', 'no_op')").select("id", F.col("list").alias("decision"), F.lit(0).alias("from_gate"), "place", "source", "canonical", F.lit("reply").alias("reason"))
    odd = entries.where("failed is not null").select("id", F.lit("reject").alias("decision"), F.lit(1).alias("from_gate"), "place", "source", "canonical", F.col("failed").alias("reason"))
    every = gated.unionByName(said).unionByName(odd).withColumn("again", F.row_number().over(Window.partitionBy("id", "decision", F.lower("source"), F.lower("canonical")).orderBy("from_gate", "place")))
    return done, every.where("again = 1").drop("again", "from_gate")


def terms_present(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """id and terms: the canonical names of entries that a text (id, text, mandarin) holds in any good form, in order of names."""
    none = F.array().cast("array<string>")
    forms = glossary.select("canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", none), F.coalesce("spoken_forms", none))).alias("form")).distinct()
    forms = written(forms.select("canonical", "form", T.wer_normal(F.col("form")).alias("target"), F.rlike("form", F.lit(HAN)).alias("han")), "terms-forms")
    rows = written(texts.select("id", "mandarin", "text", T.wer_normal(F.col("text")).alias("normal")), "terms-texts")
    # As they stand in Mandarin, else in normal form between other signs than a-z and 0-9.
    whole = texts_with_phrases(rows.select("id", "text"), forms.select(F.col("form").alias("phrase"))).withColumnRenamed("phrase", "form").join(forms, "form").join(by_sorting(rows.select("id", "mandarin")), "id").where("mandarin or han").select("id", "canonical")
    bounded = F.rlike("normal", F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("target"), F.lit(r"\E(?![a-z0-9])")))
    words = texts_with_phrases(rows.select("id", F.col("normal").alias("text")), forms.where("target <> ''").select(F.col("target").alias("phrase"))).withColumnRenamed("phrase", "target").join(forms, "target").join(by_sorting(rows.select("id", "mandarin", "normal")), "id")
    held = whole.unionByName(words.where("not mandarin and not han").where(bounded).select("id", "canonical"))
    return held.groupBy("id").agg(F.array_sort(F.collect_set("canonical")).alias("terms"))


def term_key(term: Column) -> Column:
    """A term's name in normal form, with blanks for hyphens and dots."""
    normal = T.wer_normal(term, compose=False)
    return F.trim(F.regexp_replace(F.translate(F.when(normal == "", F.lower(term)).otherwise(normal), "-.", "  "), r"\s+", " "))


def related(a: Column, b: Column) -> Column:
    """Whether one of two keys is part of the other."""
    return (a == b) | ((a != "") & F.contains(b, a)) | ((b != "") & F.contains(a, b))


def with_term_scores(rows: DataFrame, required: str, predicted: str, suffix: str) -> DataFrame:
    """rows with missing (required terms without a related predicted one), term_precision, term_recall and term_f1, all with the suffix."""
    c, n_required, n_predicted = F.col, F.size(required), F.size(predicted)
    rows = rows.withColumns({"__wanted": F.transform(required, term_key), "__got": F.transform(predicted, term_key)})
    rows = rows.withColumns({
        f"missing_{suffix}": F.filter(required, lambda r, i: ~F.exists("__got", lambda g: related(g, F.get("__wanted", i)))),
        "__right": F.size(F.filter("__got", lambda g: F.exists("__wanted", lambda w: related(g, w)))),
    })
    p, r = f"term_precision_{suffix}", f"term_recall_{suffix}"
    rows = rows.withColumns({
        p: F.when(n_predicted > 0, c("__right") / n_predicted).when(n_required == 0, 1.0).otherwise(0.0),
        r: F.when(n_required > 0, (n_required - F.size(f"missing_{suffix}")) / n_required).otherwise(1.0),
    })
    return rows.withColumn(f"term_f1_{suffix}", F.when(c(p) + c(r) > 0, 2 * c(p) * c(r) / (c(p) + c(r))).otherwise(0.0)).drop("__wanted", "__got", "__right")


def evaluate_replies(rows: DataFrame, replies: DataFrame, glossary: DataFrame, version: str = "v2") -> DataFrame:
    """What replies change, for each of rows (id, reference_text, hypothesis_text, language).

    asked: whether the glossary offers the hypothesis anything; only then its reply counts. corrected_text, wer_before and
    wer_after (by letters in Mandarin), missing terms, term recall and f1 before and after, and how many records each decision has.
    """
    none = F.array().cast("array<string>")
    texts = rows.select("id", F.coalesce("reference_text", F.lit("")).alias("reference_text"), F.coalesce("hypothesis_text", F.lit("")).alias("hypothesis_text"), T.is_mandarin(F.col("language")).alias("mandarin"))
    texts = written(texts, "replies-rows")
    said = texts.select("id", F.col("hypothesis_text").alias("text"))
    asked = written(evidence.candidates(said, glossary).select("id").distinct(), "replies-asked")
    done, decisions = decided(said, replies.join(by_sorting(asked), "id", "left_semi"), glossary, version)
    counts = decisions.groupBy("id").agg(*(F.count_if(F.col("decision") == name).alias(f"n_{name}") for name in DECISIONS))
    three = texts.join(by_sorting(done.select("id", F.col("corrected").alias("corrected_text"))), "id")
    each = three.select("id", "mandarin", F.explode(F.map_from_arrays(F.array(*map(F.lit, TEXTS)), F.array(*(f"{name}_text" for name in TEXTS)))).alias("which", "text"))
    each = written(each.select(F.struct("id", "which").alias("id"), "mandarin", "text"), "replies-texts")
    present = terms_present(each, glossary).select("id.id", "id.which", "terms").groupBy("id").agg(*(F.first(F.when(F.col("which") == name, F.col("terms")), ignorenulls=True).alias(f"{name}_terms") for name in TEXTS))
    cut = F.when(F.col("mandarin"), F.split(T.cer_normal(F.col("text")), "")).otherwise(F.split(T.wer_normal(F.col("text")), " "))
    tokens = each.select("id.id", "id.which", F.filter(cut, lambda w: w != "").alias("tokens")).groupBy("id").agg(*(F.first(F.when(F.col("which") == name, F.col("tokens")), ignorenulls=True).alias(f"{name}_tokens") for name in TEXTS))
    ref = F.col("reference_tokens")
    distances = tokens.select("id", F.size(ref).alias("n"), *(T.token_distance(ref, F.col(f"{name}_tokens")).alias(name) for name in TEXTS[1:]))
    errors = distances.select("id", *(T.error_rate(F.col(name), F.col("n")).alias(f"wer_{when}") for name, when in (("hypothesis", "before"), ("corrected", "after"))))
    scored = three.join(by_sorting(asked.withColumn("asked", F.lit(True))), "id", "left").join(by_sorting(counts), "id", "left").join(by_sorting(errors), "id").join(by_sorting(present), "id", "left").withColumns({f"{name}_terms": F.coalesce(f"{name}_terms", none) for name in TEXTS})
    scored = with_term_scores(with_term_scores(scored, "reference_terms", "hypothesis_terms", "before"), "reference_terms", "corrected_terms", "after")
    return scored.select(
        "id", F.coalesce("asked", F.lit(False)).alias("asked"), "corrected_text", "wer_before", "wer_after", "missing_before", "missing_after",
        *(F.round(f"term_{what}_{when}", 6).alias(f"term_{what}_{when}") for when in ("before", "after") for what in ("recall", "f1")), *(F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}") for name in DECISIONS),
    )


def reply_summary(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """By keys (columns joined to evaluate_replies): rows, mean rates before, after and their difference, mean term scores, decisions, and whether any was asked."""
    mean = lambda name: F.round(F.avg(name), 6)
    kept = [f"term_{what}_{when}" for what in ("recall", "f1") for when in ("before", "after")]
    return evaluated.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), mean("wer_before").alias("mean_wer_before"), mean("wer_after").alias("mean_wer_after"), F.round(F.avg("wer_after") - F.avg("wer_before"), 6).alias("mean_wer_delta"),
        *(mean(name).alias(f"mean_{name}") for name in kept), *(F.sum(f"n_{name}").alias(f"n_{name}") for name in DECISIONS), F.bool_or("asked").alias("asked"),
    )
