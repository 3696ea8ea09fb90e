"""Texts from JSON documents of several shapes, as VARIANT values: ranked paths are tried in turn, and every document left out has a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where anchors, audits and corrections are, and the names of their texts, in the order in which they are tried. Fixed values.
ANCHOR_PATHS = ("$.anchors", "$.conversation_map.anchors", "$.map.anchors")
SHAPES = (
    (ANCHOR_PATHS, ("raw_text", "asr_text", "original_text", "text", "utterance"), ("corrected_text", "final_text", "llm_corrected_text", "rule_corrected_text", "constrained_corrected_text")),
    (("$.correction_audits",), ("raw_text", "original_text", "before_text", "input_text"), ("corrected_text", "after_text", "proposed_text", "final_text")),
    (("$.corrections",), ("original_text", "raw_text", "before_text"), ("corrected_text", "final_text", "after_text")),
)
METADATA = ("clip_id", "sample_id", "audio_id", "asr_prediction_json", "prediction_json_path", "audio_path")
SAMPLE = r"(?i)(fleurs_[A-Za-z0-9_]+?_[0-9]+|ami_[A-Za-z0-9]+_[0-9]+)"
MODEL = r"(?i)(tiny|base|small|medium|large)(?:__|[_\-.])"
TRANSCRIPT_KEYS = ("transcript", "segments", "asr_segments", "temporal_transcript")
TEXT_KEYS = ("corrected_text", "text", "raw_text")
#: How deep transcripts may be nested in one another.
DEPTH = 4


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and value (whole text) of all files in any folder below root."""
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    below = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return rows.select(below.alias("path"), "value")


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def text_at(value: Column, key: str) -> Column:
    """The text of an object's key without blanks at its ends; null if it is missing or blank."""
    return F.nullif(F.regexp_replace(F.try_variant_get(value, f"$.{key}", "string"), r"^\s+|\s+$", ""), F.lit(""))


def _list_at(value: Column, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(value, path, "array<variant>") for path in paths))


def _joined(parts: Column) -> Column:
    """Texts that aren't null, with blanks between them; null if there are none."""
    return F.nullif(F.trim(F.array_join(F.array_compact(parts), " ")), F.lit(""))


def map_texts(value: Column) -> tuple[Column, Column]:
    """Raw and corrected text of a conversation map: of its anchors, else its audits, else its corrections; null without both.

    A part without a corrected text keeps its raw one.
    """
    raw, corrected = F.lit(None).cast("string"), F.lit(None).cast("string")
    for paths, raw_keys, new_keys in reversed(SHAPES):
        items = F.filter(_list_at(value, *paths), is_object)
        own = F.transform(items, lambda x: F.coalesce(*(text_at(x, key) for key in raw_keys)))  # noqa: B023
        new = F.transform(items, lambda x: F.coalesce(*(text_at(x, key) for key in (*new_keys, *raw_keys))))  # noqa: B023
        both = _joined(own).isNotNull() & _joined(new).isNotNull()
        raw, corrected = F.when(both, _joined(own)).otherwise(raw), F.when(both, _joined(new)).otherwise(corrected)
    return raw, corrected


def sample_and_model(value: Column, path: Column) -> tuple[Column, Column]:
    """A document's sample and model: the first names in its metadata, then in its path; the model may be metadata's own, else unknown."""
    known = [F.coalesce(text_at(F.try_variant_get(value, "$.metadata", "variant"), key), F.lit("")) for key in METADATA] + [path]
    first = lambda pattern: F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for text in known))
    named = [text_at(F.try_variant_get(value, "$.metadata", "variant"), key) for key in ("model_name", "asr_model")]
    return first(SAMPLE), F.coalesce(F.lower(first(MODEL)), *named, F.lit("unknown"))


def collect_maps(documents: DataFrame, preferred: tuple[str, ...] = ()) -> DataFrame:
    """path, variant (its folder), sample_id, model, raw_text, corrected_text and skipped (null, or why) of documents (path, value).

    If any document is in a preferred folder, only those are taken.
    """
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    rows = documents.withColumn("variant", folder)
    chosen = rows.where(F.col("variant").isin(*preferred)) if preferred else rows
    if preferred and chosen.isEmpty():
        chosen = rows
    parsed = chosen.withColumn("v", F.try_parse_json("value"))
    raw, corrected = map_texts(F.col("v"))
    sample, model = sample_and_model(F.col("v"), F.col("path"))
    read = parsed.select("path", "variant", F.col("v").isNotNull().alias("valid"), is_object(F.col("v")).alias("object"), sample.alias("sample_id"), model.alias("model"), raw.alias("raw_text"), corrected.alias("corrected_text"))
    why = (
        F.when(~F.col("valid"), "json_error").when(~F.col("object"), "not_dict_json").when(F.col("sample_id").isNull(), "missing_sample_id")
        .when(F.col("raw_text").isNull(), "missing_raw_text").when(F.col("corrected_text").isNull(), "missing_corrected_text")
    )
    return read.select("path", "variant", "sample_id", "model", "raw_text", "corrected_text", why.alias("skipped"))


def skip_reasons(collected: DataFrame) -> DataFrame:
    """skipped and n: how many documents were left out for which reason."""
    return collected.where("skipped is not null").groupBy("skipped").agg(F.count("*").alias("n"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def with_transcript_text(rows: DataFrame, value: str, name: str = "text", field: str | None = None) -> DataFrame:
    """rows with the text of a transcript document (a VARIANT column): a text itself; a list of texts and of objects with texts; or an
    object with any of these under a known key, at most DEPTH deep, else with a text of its own. null if there is none. field names the text to take instead."""
    keys = (field,) if field else TEXT_KEYS
    # What stands under the first known key of an object takes its place, again and again; each step is a column that is worked out once.
    rows = rows.withColumns({"__inner": F.col(value), "__found": F.lit(None).cast("string")})
    for _ in range(DEPTH):
        inner = F.col("__inner")
        if field:
            own = F.try_variant_get(inner, f"$.{field}", "variant")
            rows = rows.withColumn("__found", F.coalesce("__found", F.when(is_object(inner) & (_kind(own) == "STRING"), F.try_variant_get(inner, f"$.{field}", "string"))))
        rows = rows.withColumn("__below", F.when(is_object(inner), F.coalesce(*(F.try_variant_get(inner, f"$.{key}", "variant") for key in TRANSCRIPT_KEYS))))
        rows = rows.withColumn("__inner", F.coalesce("__below", "__inner")).drop("__below")
    inner, kind = F.col("__inner"), _kind(F.col("__inner"))
    item = lambda x: F.when(is_object(x), F.coalesce(*(F.nullif(F.try_variant_get(x, f"$.{key}", "string"), F.lit("")) for key in keys), F.lit(""))).otherwise(F.try_variant_get(x, "$", "string"))
    listed = F.trim(F.array_join(F.filter(F.transform(F.try_variant_get(inner, "$", "array<variant>"), item), lambda x: x != ""), " "))
    own = F.coalesce(*(F.nullif(F.try_variant_get(inner, f"$.{key}", "string"), F.lit("")) for key in (*TEXT_KEYS, "reference")))
    text = F.when(kind == "STRING", F.try_variant_get(inner, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), own)
    return rows.withColumn(name, F.coalesce("__found", text)).drop("__inner", "__found")


def segments_of(value: Column) -> Column:
    """The list of segments of a document: itself, or the first of its known keys that holds a list; else null."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), *(F.try_variant_get(value, f"$.{key}", "array<variant>") for key in ("transcript", "temporal_transcript", "segments")))
