"""The evidence gate: whether proposed corrections of a text may be applied, and their application one after the other.

A proposal names what it replaces (source), by what (replacement) and for which glossary term (canonical). Most checks
need the proposal and its glossary entry alone; those that need the text see it as the proposals before have left it.
Texts are composed (NFKC) before. The gate has two versions: v3 also wants a known error form and an allowed context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators.assignment import texts_with_phrases
from turnstone.scratch import by_sorting

#: Terms for amounts by share, words that make such an amount likely, categories of names, and short words that are no names. Fixed values.
AMOUNT_TERMS = ("cents a share", "cents per share")
AMOUNT_CUES = ("dividend", "reinstatement", "share", "shares")
NAME_CATEGORIES = ("company_name", "product_name", "business_segment", "website", "currency")
COMMON_WORDS = ("u s", "us", "u.s", "u.s.", "e u", "eu", "pc", "mobile", "it", "ai")
#: An amount by share as it is heard: number, unit, link.
AMOUNT = r"(?i)(?<![A-Za-z0-9])(\d+(?:[.,]\d+)?)\s+(cents?|seems|sense|sent)\s+(to|a|per)\s+share(?![A-Za-z0-9])"
_TOKEN = r"[A-Za-z0-9]+(?:[.'-][A-Za-z0-9]+)*"

GLOSSARY = "canonical string, aliases array<string>, spoken_forms array<string>, asr_error_forms array<string>, category string, allowed_contexts array<string>"


def _normal(text: Column) -> Column:
    return T.wer_normal(text, compose=False)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TOKEN.lower()})"), 1)


def _numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(_tokens(text), lambda w: w.rlike("^[0-9]+$"))))


def _bounded(phrase: Column) -> Column:
    quoted = F.replace(phrase, F.lit("\\E"), F.lit(r"\E\\E\Q"))  # a phrase may hold the mark that ends a quotation
    return F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), quoted, F.lit(r"\E(?![A-Za-z0-9])"))


def holds(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text in any case, not within a longer word."""
    return F.rlike(text, F.concat(F.lit("(?i)"), _bounded(phrase)))


def replace_once(text: Column, phrase: Column, new: Column) -> Column:
    """The first such place replaced."""
    quoted = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(text, F.concat(F.lit("(?is)^(.*?)"), _bounded(phrase)), F.concat(F.lit("$1"), quoted))


def _any_in(text: Column, cues: Column) -> Column:
    return F.exists(cues, lambda cue: (cue != "") & F.contains(text, cue))


def prepared(proposals: DataFrame, glossary: DataFrame) -> DataFrame:
    """proposals (id, place, source, replacement, canonical) with a struct p of what the gate needs from each and its entry."""
    none = F.array().cast("array<string>")
    lists = {name: F.coalesce(F.col(name), none) for name in ("aliases", "spoken_forms", "asr_error_forms", "allowed_contexts")}
    entries = glossary.select(_normal(F.col("canonical")).alias("entry_key"), F.col("canonical").alias("entry"), F.coalesce("category", F.lit("")).alias("category"), *[c.alias(n) for n, c in lists.items()]).dropDuplicates(["entry_key"])
    named = proposals.select("id", "place", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("source", "replacement", "canonical")]).withColumn("key", _normal(F.col("canonical")))
    met = named.join(entries, F.col("key") == F.col("entry_key"), "left")
    c, fine = F.col, F.concat(F.array("entry"), F.col("aliases"), F.col("spoken_forms"))
    source, replacement, term = _normal(c("source")), _normal(c("replacement")), c("entry_key")
    normals = lambda forms: F.filter(F.transform(forms, _normal), lambda x: x != "")
    amount, is_amount = F.regexp_extract(c("source"), AMOUNT, 2), term.isin(*AMOUNT_TERMS)
    fits = F.lower(amount).isin("cent", "cents") & F.lower(F.regexp_extract(c("source"), AMOUNT, 3)).isin("a", "per")
    added = F.array_except(_tokens(c("replacement")), _tokens(c("source")))
    allowed = F.flatten(F.transform(fine, _tokens))
    bare = lambda text: F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("."), F.lit(""))
    common = source.isin(*COMMON_WORDS) | bare(source).isin(*{w.replace(" ", "").replace(".", "") for w in COMMON_WORDS})
    error_form = F.array_contains(normals(c("asr_error_forms")), source)
    facts = {
        "complete": (c("source") != "") & (c("replacement") != "") & (c("canonical") != ""), "known": c("entry").isNotNull(), "same": source == replacement, "amount_fits": is_amount & fits,
        "accepted_form": F.array_contains(normals(fine), source) & ~error_form, "is_amount": is_amount, "error_form": error_form, "heard_amount": amount != "", "is_name": c("category").isin(*NAME_CATEGORIES),
        "common": common, "names_term": _any_in(replacement, normals(fine)), "has_number": F.size(_numbers(c("source"))) > 0, "same_numbers": _numbers(c("source")) == _numbers(c("replacement")),
        "unsupported": F.size(F.array_except(added, allowed)) > 0, "long": F.size(_tokens(c("replacement"))) > F.size(_tokens(c("source"))) + 3, "short_term": F.contains(replacement, term) | F.contains(term, replacement),
    }
    shown = [F.coalesce(value, F.lit(False)).alias(name) for name, value in facts.items()]
    contexts = F.coalesce(normals(c("allowed_contexts")), none)
    return met.select("id", F.struct("place", "source", "replacement", "canonical", contexts.alias("contexts"), *shown).alias("p"))


def gate(text: Column, p: Column, version: str = "v2") -> Column:
    """decision (accept, reject, needs_review, no_op) and reason for a proposal p on a text: the first rule that applies."""
    normal = _normal(text)
    context = F.exists(p["contexts"], lambda cue: F.contains(normal, cue))
    rules = [
        (~p["complete"], "reject", "incomplete"), (~holds(text, p["source"]), "reject", "source_not_in_text"), (~p["known"], "reject", "unknown_term"), (p["same"], "no_op", "no_change"),
        (p["amount_fits"], "no_op", "amount_is_right"), (p["accepted_form"], "no_op", "accepted_form"),
    ]
    if version == "v3":
        rules += [
            (~p["is_amount"] & ~p["error_form"], "needs_review", "no_error_form"), (p["is_amount"] & ~p["heard_amount"] & ~p["error_form"], "needs_review", "no_amount_form"),
            ((F.size(p["contexts"]) > 0) & ~context, "needs_review", "no_context"),
        ]
    rules += [
        (p["is_name"] & p["common"], "reject", "common_word"), (p["is_name"] & (F.size(p["contexts"]) > 0) & ~context, "needs_review", "name_without_context"), (~p["names_term"], "reject", "term_not_named"),
        (p["is_amount"] & ~p["has_number"], "reject", "no_number"), (p["is_amount"] & ~p["same_numbers"], "reject", "other_numbers"), (p["is_amount"] & ~_any_in(normal, F.array(*map(F.lit, AMOUNT_CUES))), "reject", "no_amount_context"),
        (p["unsupported"], "reject", "unsupported_tokens"), (p["long"], "reject", "too_long"), (~p["short_term"], "reject", "no_short_term"),
    ]
    decision, reason = F.lit("accept"), F.lit("accepted")
    for applies, what, why in reversed(rules):
        decision, reason = F.when(applies, what).otherwise(decision), F.when(applies, why).otherwise(reason)
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def apply_corrections(texts: DataFrame, proposals: DataFrame, glossary: DataFrame, version: str = "v2") -> DataFrame:
    """id, corrected, records (place, source, canonical, decision, reason) of texts (id, text): proposals in order of place.

    Of records of one source and term with one decision, in any case, the first stays.
    """
    listed = prepared(proposals, glossary).groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    record = "array<struct<place:int,source:string,canonical:string,decision:string,reason:string>>"
    start = F.struct(F.col("text").alias("text"), F.array().cast(record).alias("records"))

    def step(state: Column, p: Column) -> Column:
        found = gate(state["text"], p, version)
        own = F.struct(p["place"].cast("int").alias("place"), p["source"].alias("source"), p["canonical"].alias("canonical"), found["decision"].alias("decision"), found["reason"].alias("reason"))
        again = F.exists(state["records"], lambda r: (F.lower(r["source"]) == F.lower(p["source"])) & (F.lower(r["canonical"]) == F.lower(p["canonical"])) & (r["decision"] == found["decision"]))
        new = F.when(found["decision"] == "accept", replace_once(state["text"], p["source"], p["replacement"])).otherwise(state["text"])
        return F.struct(new.alias("text"), F.when(again, state["records"]).otherwise(F.concat(state["records"], F.array(own))).alias("records"))

    done = texts.join(by_sorting(listed), "id", "left").withColumn("done", F.when(F.col("ps").isNotNull(), F.aggregate("ps", start, step)).otherwise(start))
    return done.select("id", F.col("done.text").alias("corrected"), F.col("done.records").alias("records"))


def candidates(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """id, place, source, replacement, canonical: what the glossary offers for each text (id, text), in the order of application.

    Amounts by share come first, as they stand; then each entry's error forms and aliases, entries in the order of the
    glossary's column entry_place, or by canonical without one. Of offers that differ in case alone the first stays.
    """
    normal, none = _normal(F.col("text")), F.array().cast("array<string>")
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(AMOUNT), 0).alias("source"), F.regexp_extract_all("text", F.lit(AMOUNT), 1).alias("number"))
    amounts = texts.where(_any_in(normal, F.array(*map(F.lit, AMOUNT_CUES)))).select("id", F.posexplode(found).alias("at", "m"))
    term = glossary.where(_normal(F.col("canonical")) == "cents a share").agg(F.max("canonical").alias("canonical")).where("canonical is not null")
    amounts = amounts.join(F.broadcast(term)).select("id", F.lit(0).alias("kind"), F.lit("").alias("entry"), "at", "m.source", F.concat("m.number", F.lit(" cents a share")).alias("replacement"), "canonical")
    fine = F.transform(F.concat(F.array("canonical"), F.coalesce("aliases", none), F.coalesce("spoken_forms", none)), _normal)
    errors = F.transform(F.coalesce("asr_error_forms", none), _normal)
    entry = F.format_string("%012d", F.col("entry_place").cast("long")) if "entry_place" in glossary.columns else F.col("canonical")
    forms = glossary.where(~_normal(F.col("canonical")).isin(*AMOUNT_TERMS)).select(entry.alias("entry"), "canonical", fine.alias("fine"), errors.alias("errors"), F.posexplode(F.concat(F.coalesce("asr_error_forms", none), F.coalesce("aliases", none))).alias("at", "form"))
    usable = forms.where((F.col("form") != "") & ~(F.array_contains("fine", _normal(F.col("form"))) & ~F.array_contains("errors", _normal(F.col("form"))))).withColumn("phrase", F.lower("form"))
    # Texts that hold a form anywhere are found by an index of letters; only these are searched for it as a word.
    likely = texts_with_phrases(texts.select("id", F.lower("text").alias("text")), usable.select("phrase"))
    held = likely.join(usable, "phrase").join(by_sorting(texts.select("id", "text")), "id").where(holds(F.col("text"), F.col("form")))
    held = held.select("id", F.lit(1).alias("kind"), "entry", "at", F.col("form").alias("source"), F.col("canonical").alias("replacement"), "canonical")
    both = amounts.unionByName(held).where(_normal(F.col("source")) != _normal(F.col("replacement")))
    order = ["kind", "entry", "at"]
    same = Window.partitionBy("id", F.lower("source"), F.lower("replacement"), "canonical").orderBy(*order)
    first = both.withColumn("again", F.row_number().over(same)).where("again = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order))).select("id", "place", "source", "replacement", "canonical")
