"""Files of meeting data as DataFrames, and DataFrames as files: manifests, JSON documents, glossaries, transcripts.

Readers take a path or a pattern that Spark reads, so one call covers one clip or all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEGMENTS = "array<struct<start:double,end:double,text:string,avg_logprob:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>"


def read_manifest(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV manifest, all values as text. ValueError if a required column is missing."""
    found = spark.read.option("header", True).csv(path)
    missing = [name for name in required if name not in found.columns]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    return found


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """All result CSVs together, with the columns of any of them and source_file."""
    both = None
    for path in paths:
        one = spark.read.option("header", True).csv(path).withColumn("source_file", F.col("_metadata.file_name"))
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    if both is None:
        raise ValueError("no result files")
    return both


def read_predictions(spark: SparkSession, path: str, refuse: bool = False) -> DataFrame:
    """clip_id, model_name, segments from JSON documents named {model}__{clip}.json.

    Mock ones and those without segments go; with refuse, a query that meets one fails.
    """
    schema = StructType.fromDDL(f"mode string, segments {SEGMENTS}")
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("name", F.col("_metadata.file_name"))
    named = rows.withColumns({"model_name": F.regexp_extract("name", "^(.+?)__", 1), "clip_id": F.regexp_extract("name", r"^.+?__(.+)\.json$", 1)})
    real = F.expr("segments is not null and coalesce(mode, '') <> 'mock' and clip_id <> ''")
    if refuse:
        message = F.concat(F.lit("no real prediction: "), F.col("name"))
        return named.select("clip_id", "model_name", F.when(real, F.col("segments")).otherwise(F.raise_error(message).cast(SEGMENTS)).alias("segments"))
    return named.where(real).select("clip_id", "model_name", "segments")


def segment_words(predictions: DataFrame) -> DataFrame:
    """clip_id, seg, pos, word, start_ms, end_ms; a segment without timed words is one word."""
    each = predictions.select("clip_id", F.posexplode("segments").alias("seg", "s"))
    timed = F.filter(F.coalesce("s.words", F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>")), lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    whole = F.array(F.struct(F.trim("s.text").alias("word"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(None).cast("double").alias("probability")))
    words = each.select("clip_id", "seg", F.posexplode(F.when(F.size(timed) > 0, timed).otherwise(whole)).alias("pos", "w"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return words.select("clip_id", "seg", "pos", F.trim("w.word").alias("word"), ms("w.start").alias("start_ms"), ms("w.end").alias("end_ms"))


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON lines: the rows that have all required keys, and the bad ones (line, problem)."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("row", F.from_json("value", schema))
    lacks = F.array_compact(F.array(*[F.when(F.get_json_object("value", f"$.{name}").isNull(), F.lit(name)) for name in required]))
    checked = parsed.withColumn("lacks", lacks)
    bad = checked.where(F.size("lacks") > 0).select(F.col("value").alias("line"), F.concat(F.lit("lacks "), F.array_join("lacks", ", ")).alias("problem"))
    return checked.where(F.size("lacks") == 0).select("row.*"), bad


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """source_file, line, canonical, form from Markdown: cells of tables' first columns, and lines "form -> canonical"."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    text = F.trim("text")
    pair = F.regexp_extract(text, r"^[-*]?\s*[\"`]?(.+?)[\"`]?\s*->\s*[\"`]?(.+?)[\"`]?$", 1)
    target = F.regexp_extract(text, r"^[-*]?\s*[\"`]?(.+?)[\"`]?\s*->\s*[\"`]?(.+?)[\"`]?$", 2)
    cell = F.trim(F.get(F.split(text, r"\|"), 1))
    is_row = text.startswith("|") & ~text.rlike(r"^\|[\s:|-]+\|?$") & (F.length(cell) > 0) & ~F.lower(cell).isin("term", "canonical")
    found = whole.select("source_file", "line", F.when(pair != "", target).when(is_row, cell).alias("canonical"), F.when(pair != "", pair).when(is_row, cell).alias("form"))
    return found.where("canonical is not null")


def read_kaldi(spark: SparkSession, text: str, segments: str, speakers: str) -> DataFrame:
    """utterance, clip_id, speaker, start_ms, end_ms, text from the three files of a Kaldi bundle."""
    pair = lambda path, name: spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+", 2).alias("p")).select(F.col("p")[0].alias("utterance"), F.get("p", F.lit(1)).alias(name))
    cut = spark.read.text(segments).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    ms = lambda i: F.round(F.col("p")[i].cast("double") * 1000).cast("long")
    cut = cut.select(F.col("p")[0].alias("utterance"), F.col("p")[1].alias("clip_id"), ms(2).alias("start_ms"), ms(3).alias("end_ms"))
    return cut.join(pair(text, "text"), "utterance").join(pair(speakers, "speaker"), "utterance", "left").select("utterance", "clip_id", "speaker", "start_ms", "end_ms", "text")


def manifest_row(spark: SparkSession, path: str, clip_id: str) -> DataFrame:
    """The manifest's rows of one clip."""
    return read_manifest(spark, path, ["clip_id"]).where(F.col("clip_id") == clip_id)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store has the path."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with this schema; no rows if the path is blank or missing."""
    if not path.strip() or not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def read_object(spark: SparkSession, path: str, required: list[str]) -> dict:
    """One JSON object, a policy or a configuration. ValueError if a required key is missing."""
    row = spark.read.option("multiLine", True).json(path).first()
    found = row.asDict(recursive=True) if row else {}
    missing = [name for name in required if found.get(name) is None]
    if missing:
        raise ValueError(f"the object lacks {', '.join(missing)}")
    return found


def read_json_glossary(spark: SparkSession, path: str) -> DataFrame:
    """canonical and form from JSON documents: a list of terms, or an object with a list named terms."""
    term = "struct<canonical:string,aliases:array<string>,spoken_forms:array<string>,asr_error_forms:array<string>>"
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json(F.when(F.trim("value").startswith("["), F.col("value")), f"array<{term}>"), F.from_json("value", f"struct<terms:array<{term}>>")["terms"])
    terms = whole.select(F.explode(listed).alias("t"))
    none = F.array().cast("array<string>")
    forms = F.array_distinct(F.concat(F.array("t.canonical"), *[F.coalesce(F.col(f"t.{kind}"), none) for kind in ("aliases", "spoken_forms", "asr_error_forms")]))
    return terms.select(F.col("t.canonical").alias("canonical"), F.explode(forms).alias("form"))


def merged_glossary(*sources: DataFrame) -> DataFrame:
    """Terms (canonical, form) of all sources, the spelling of the first that has it, with the forms of all in order."""
    both = None
    for place, rows in enumerate(sources):
        one = rows.select("canonical", "form", F.lit(place).alias("place"))
        both = one if both is None else both.unionByName(one)
    seen = both.groupBy(F.lower("canonical").alias("key"), F.lower("form").alias("form")).agg(F.min("place").alias("place"), F.min(F.struct("place", "canonical")).alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "form"))), lambda x: x["form"])
    return seen.groupBy("key").agg(F.min("first")["canonical"].alias("canonical"), F.array_join(listed, "; ").alias("forms")).drop("key")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """clip_id (the file's name) and text of whole text files, without blank ends."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("clip_id"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"))


def read_maps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents in any folder below path that have a clip_id, with their file."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("source_file", F.col("_metadata.file_name")).where("coalesce(trim(clip_id), '') <> ''")


def read_tokens(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Token files whose columns are divided by |, with a header."""
    return spark.read.schema(schema).option("header", True).option("sep", "|").csv(path)


def read_textgrid(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, tier, start_ms, end_ms, text of the intervals with text in Praat TextGrid files, tiers by name."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.TextGrid$", 1).alias("clip_id"), "value")
    tiers = rows.select("clip_id", F.explode(F.slice(F.split("value", r"item \[\d+\]:"), 2, 1_000_000)).alias("tier_text"))
    tiers = tiers.select("clip_id", F.regexp_extract("tier_text", 'name = "([^"]*)"', 1).alias("tier"), "tier_text")
    pattern = r'xmin = ([0-9.]+)\s+xmax = ([0-9.]+)\s+text = "((?:[^"]|"")*)"'
    parts = F.arrays_zip(*[F.regexp_extract_all("tier_text", F.lit(pattern), i).alias(name) for i, name in ((1, "a"), (2, "z"), (3, "text"))])
    ms = lambda c: F.round(F.col(c).cast("double") * 1000).cast("long")
    each = tiers.select("clip_id", "tier", F.explode(parts).alias("p"))
    return each.select("clip_id", "tier", ms("p.a").alias("start_ms"), ms("p.z").alias("end_ms"), F.trim(F.replace(F.col("p.text"), F.lit('""'), F.lit('"'))).alias("text")).where("text <> ''")


def first_existing(rows: DataFrame, names: list[str], default: str = ""):
    """The first of these columns that rows has and that isn't blank, else default."""
    known = [F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) for name in names if name in rows.columns]
    return F.coalesce(*known, F.lit(default))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """place and line of a Markdown table: header, rule and a line for each row, in order. For reports of a few rows."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) + 1).select("place", line([F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "| " + " | ".join("---" for _ in columns) + " |")], "place int, line string")
    return head.unionByName(body)


def reference_bundle(turns: DataFrame, events: DataFrame) -> DataFrame:
    """clip_id and one JSON document with the clip's turns and events, in order of time."""
    listed = lambda rows, name, *fields: rows.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    both = listed(turns, "turns", "start_ms", "end_ms", "speaker").join(listed(events, "events", "start_ms", "end_ms", "type"), "clip_id", "outer")
    return both.select("clip_id", F.to_json(F.struct("clip_id", "turns", "events")).alias("document"))


def write_documents(rows: DataFrame, path: str, key: str = "clip_id") -> None:
    """One JSON document a row, in folders by key."""
    rows.select(key, F.to_json(F.struct("*")).alias("value")).write.partitionBy(key).text(path)


def write_bundles(documents: DataFrame, path: str) -> None:
    """Documents (path, value), each whole, many in a file: as files of their own they cost the driver a listing and a move each."""
    documents.select("path", "value").write.parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """path and value of the documents in bundles."""
    return spark.read.schema("path string, value string").parquet(path)


def write_report(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV with a header and these columns, in this order."""
    rows.select(*columns).write.option("header", True).csv(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
