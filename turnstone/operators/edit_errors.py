"""Categories of a transcript's errors: each edit against the reference gets one, by ordered rules, and is summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators.alignment import explode_edits
from turnstone.operators.rollups import top_k

#: Words of each kind, and pairs of spellings that mean the same. Fixed values.
FUNCTION_WORDS = ("a an and are as at be been but by for from has have he her him i in is it its me my now of on or our she so that the their there these they this to we with you your").split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
MONTHS = "january february march april may june july august september october november december".split()
UNITS = "% basis bps cent cents percent percentage per rate rates share shares".split()
FINANCE_WORDS = "aspen brand brands constant covid debt digit dividend earnings exchange growth leverage oncology operation operations organic regional reported revenue segmental sterile".split()
DISFLUENCIES = ("um", "uh", "mm-hmm", "mm", "hmm", "mhm", "mmhmm")
SAME_MEANING = (("gonna", "going to"), ("cuz", "because"), ("double-digit", "double digit"), ("year-on-year", "year on year"))
#: category: impact, reason, recommendation. Fixed values.
CATEGORIES = {
    "date_time_error": ("meaning_likely_changed", "date or year words were substituted, deleted, or inserted", "Use stronger ASR or audio-backed verification; RAG alone is weak here."),
    "number_unit_error": ("meaning_likely_changed", "number or measurement-unit wording changed", "Add numeric-unit candidate rules and verify against local context/audio."),
    "domain_term_error": ("meaning_may_change", "finance/company/domain term was altered or missed", "Use a predeclared finance glossary plus conservative LLM verifier."),
    "disfluency_or_style_error": ("mostly_style_or_reference_policy", "filler, contraction, repeated word, or spelling style changed", "Report cleaned WER separately; do not optimize RAG for this category."),
    "function_word_error": ("meaning_may_change", "short pronoun/preposition/function-word change", "Use stronger ASR/context; glossary RAG should usually avoid this."),
    "omission_or_insertion": ("meaning_may_change", "content was omitted or inserted", "Inspect audio and segment boundaries; consider VAD/chunking changes."),
    "semantic_word_error": ("meaning_may_change", "content word substitution not covered by specialized categories", "Collect more examples, then decide whether ASR API or targeted RAG helps."),
}


def _any_of(tokens: Column, words) -> Column:
    return F.exists(tokens, lambda w: w.isin(*words))


def category(op: Column, removed: Column, added: Column, removed_context: Column | None = None, added_context: Column | None = None) -> Column:
    """The edit's category: the first rule that holds. Dates and numbers look at the context, if given, the others at the edit."""
    actual = F.concat(removed, added)
    context = F.concat(removed if removed_context is None else removed_context, added if added_context is None else added_context)
    number = F.exists(context, lambda w: w.rlike("^\\p{Nd}+$") | w.isin(*NUMBER_WORDS))
    date = F.exists(context, lambda w: w.isin(*MONTHS) | w.rlike("^\\p{Nd}{4}$"))
    repeated = (F.size(added) == 0) & (F.size(removed) > 1) & (F.size(F.array_distinct(removed)) == 1)
    left, right = F.array_join(removed, " "), F.array_join(added, " ")
    style = F.lit(False)
    for a, b in SAME_MEANING:
        style = style | ((left == a) & (right == b)) | ((left == b) & (right == a))
    function_words = (F.size(actual) > 0) & F.forall(actual, lambda w: w.isin(*FUNCTION_WORDS))
    return (
        F.when(date & number, "date_time_error").when(number & _any_of(context, UNITS), "number_unit_error").when(_any_of(actual, FINANCE_WORDS), "domain_term_error")
        .when(_any_of(actual, DISFLUENCIES) | repeated | style, "disfluency_or_style_error").when(function_words, "function_word_error")
        .when(op.isin("delete", "insert"), "omission_or_insertion").otherwise("semantic_word_error")
    )


def about(name: Column, what: str) -> Column:
    """impact, reason or recommendation of a category."""
    at = ("impact", "reason", "recommendation").index(what)
    found = F.lit(None).cast("string")
    for one, texts in CATEGORIES.items():
        found = F.when(name == one, texts[at]).otherwise(found)
    return found


def classify(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each error of rows (reference, hypothesis: token arrays): keep, place, op, category, impact, removed, added, reason, recommendation."""
    each = explode_edits(rows, "reference", "hypothesis", keep)
    named = each.withColumn("category", category(F.col("op"), F.col("removed"), F.col("added"), F.col("removed_context"), F.col("added_context")))
    return named.select(*keep, "place", "op", "category", *(about(F.col("category"), what).alias(what) for what in ("impact", "reason", "recommendation")), "removed", "added")


def cleaned_or_error(cleaned: Column, error: Column) -> Column:
    """The cleaned error rate where there is one, else the plain one; what is no number is 0."""
    known = cleaned.isNotNull() & (cleaned.cast("string") != "")
    return F.coalesce(F.when(known, cleaned.try_cast("double")).otherwise(error.try_cast("double")), F.lit(0.0))


def _means(rows: DataFrame, keys: list[str]) -> DataFrame:
    error = F.coalesce(F.col("error_rate").try_cast("double"), F.lit(0.0))
    cleaned = cleaned_or_error(F.col("cleaned_error_rate"), F.col("error_rate"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.avg(error).alias("wer"), F.avg(cleaned).alias("cleaned"))


def category_summary(rows: DataFrame, errors: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """By keys and category: count, share of the keys' errors, the rows' mean rates, the first error (by order) and the recommendation.

    rows has error_rate and cleaned_error_rate, a row each; errors is classify() of them.
    """
    # All in one reading of the errors: an alignment is worked out anew by each.
    joined = F.struct(F.array_join("removed", " ").alias("example_reference"), F.array_join("added", " ").alias("example_hypothesis"))
    counts = errors.groupBy(*keys, "category").agg(F.count("*").alias("n"), F.min_by(joined, F.struct(*order)).alias("first")).select(*keys, "category", "n", "first.*")
    out = counts.withColumn("all_n", F.sum("n").over(Window.partitionBy(*keys))).join(_means(rows, keys), keys)
    return out.select(
        *keys, "category", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"), F.round("wer", 6).alias("mean_wer"), F.round("cleaned", 6).alias("mean_cleaned_wer"),
        "example_reference", "example_hypothesis", about(F.col("category"), "recommendation").alias("recommendation"),
    )


def model_summary(rows: DataFrame, errors: DataFrame, keys: list[str], order: list[str], k: int = 5) -> DataFrame:
    """By keys: rows, mean rates and their gap, and the k commonest categories as JSON pairs, ties to the one seen first. Keys without errors have []."""
    counts = errors.groupBy(*keys, "category").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))
    top = top_k(counts, keys, [F.desc("n"), F.col("seen")], k)
    pair = F.concat(F.lit('["'), F.col("category"), F.lit('", '), F.col("n").cast("string"), F.lit("]"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", pair.alias("pair")))), lambda x: x["pair"])
    joined = top.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("top_categories"))
    means = _means(rows, keys).join(joined, keys, "left")
    return means.select(*keys, "n_rows", F.round("wer", 6).alias("mean_wer"), F.round("cleaned", 6).alias("mean_cleaned_wer"), F.round(F.col("wer") - F.col("cleaned"), 6).alias("gap"), F.coalesce("top_categories", F.lit("[]")).alias("top_categories"))
