"""Glossary terms in texts: exact, phonetic and fuzzy matches, TF-IDF retrieval, rule corrections and their audit."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.text import holds_phrase, phonetic_key, phonetic_key_of
from turnstone.scratch import written

#: Spoken forms and what they stand for, in the order in which they are applied. Fixed values.
CORRECTIONS = (
    ("piano note audio", "pyannote.audio"), ("pie anode audio", "pyannote.audio"), ("speaker diary station", "speaker diarization"), ("piano note", "pyannote"), ("pie anode", "pyannote"),
    ("diary station", "diarization"), ("diary zation", "diarization"), ("diaryzation", "diarization"), ("temporal anger", "temporal anchor"), ("overlap aware", "overlap-aware"),
    ("faster whisper", "faster-whisper"), ("whisper", "Whisper"), ("c translate two", "CTranslate2"), ("q when", "Qwen"), ("tag speech", "TagSpeech"), ("dm asr", "DM-ASR"),
    ("the ear", "DER"), ("dear", "DER"), ("where", "WER"), ("rack", "RAG"), ("rag", "RAG"),
)


#: Forms that are tried as one expression; more are joined by runs of words.
FEW_FORMS = 1000


def phrase_matches(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """Texts (id, tokens) with the forms (form, canonical) whose words stand in them one after the other.

    Few forms are looked for in each text where it is, without a join. With more, a form of n words meets only the n-word
    runs of the texts, so it is a join on equal strings.
    """
    few = forms.select("form", "canonical").distinct().limit(FEW_FORMS + 1).collect()
    if 0 < len(few) <= FEW_FORMS:
        known = F.array(*[F.struct(F.lit(r.canonical).alias("canonical"), F.lit(r.form).alias("form")) for r in few])
        joined = texts.select("id", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).alias("joined"))
        held = joined.select("id", F.explode(F.filter(known, lambda x: F.contains(F.col("joined"), F.concat(F.lit(" "), x["form"], F.lit(" "))))).alias("x"))
        return held.select("id", "x.*").distinct()
    lengths = forms.select(F.size(F.split("form", " ")).alias("n")).distinct()
    runs = texts.join(F.broadcast(lengths), F.size("tokens") >= F.col("n"))
    run = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("n") + 1), lambda i: F.array_join(F.slice("tokens", i, F.col("n")), " "))))
    return runs.select("id", run.alias("form")).join(forms, "form").select("id", "canonical", "form").distinct()


#: Scores that a task keeps, as the same pairs of strings come again and again.
KEPT_SCORES = 200_000
#: Words of a text that are a row of their own, so that rows are bounded, and words of a batch that are looked at together.
PIECE, SOME_WORDS = 1024, 1 << 18


def _runs_like(forms: list[tuple[str, str]], least: float, key):
    """Runs of words of texts (id, tokens) with the forms (canonical, form) whose keys have at least so great a ratio.

    Words are numbers here, and a run's length and letters are sums of those of its words' keys, so that runs that can't
    reach the ratio are dropped as numbers. A seam of two words adds letters to a key, or takes one, as b and c or b and b do.
    """
    fewest, most, added = len(key("b b")) - 2, len(key("b c")) - 2, key("b c").replace("b", "").replace("c", "")
    known = [(canonical, form, key(form), {max(1, n - 1), n, n + 1}) for canonical, form in forms for n in [len(form.split(" "))] if key(form)]
    letters = sorted({letter for _, _, form_key, _ in known for letter in form_key})
    matchers = {form_key: SequenceMatcher(None, "", form_key) for _, _, form_key, _ in known}

    def score(text: str, form_key: str, kept: dict) -> float:
        pair = key(text), form_key
        if pair not in kept:
            if len(kept) >= KEPT_SCORES:
                kept.clear()
            matchers[form_key].set_seq1(pair[0])
            kept[pair] = matchers[form_key].ratio()
        return kept[pair]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, str], float] = {}
        for batch in batches:
            coded = batch.column(1).flatten().dictionary_encode()
            names, word = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys = [key(name) for name in names]
            size = np.array([len(own) for own in keys], np.int32)
            held = {letter: np.array([own.count(letter) for own in keys], np.int32) for letter in letters}
            n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            room = np.repeat(np.cumsum(n), n) - np.arange(len(word))  # words from here to the text's end
            found: dict[str, list] = {name: [] for name in ("row", "window", "canonical", "form", "score")}
            for at in range(0, len(word), SOME_WORDS):
                for width in sorted({width for *_, widths in known for width in widths}):
                    starts = at + np.flatnonzero(room[at : at + SOME_WORDS] >= width)
                    length = sum(size[word[starts + d]] for d in range(width))
                    for canonical, form, form_key, widths in known:
                        if width not in widths:
                            continue
                        other = len(form_key)
                        low, high = length + fewest * (width - 1), length + most * (width - 1)
                        right = (2 * other >= least * (low + other) - 1e-9) & (2 * high >= least * (high + other) - 1e-9)
                        place, low = starts[right], low[right]
                        shared = sum(np.minimum(sum(held[letter][word[place + d]] for d in range(width)) + added.count(letter) * (width - 1), form_key.count(letter)) for letter in set(form_key))
                        place = place[2 * shared >= least * (low + other) - 1e-9]
                        run_of = word[place]
                        for d in range(1, width):  # the same number for the same words
                            run_of = np.unique(run_of * len(names) + word[place + d], return_inverse=True)[1]
                        _, first, run_of = np.unique(run_of, return_index=True, return_inverse=True)
                        texts = [" ".join(names[k] for k in word[i : i + width]) for i in place[first]]
                        scores = np.array([score(text, form_key, kept) for text in texts])
                        if not (scores >= least).any():
                            continue
                        of_text = np.unique(row[place] * len(texts) + run_of)  # a run once a text
                        of_text = of_text[scores[of_text % len(texts)] >= least]
                        found["row"].append(of_text // len(texts))
                        found["window"].append(pa.array(texts, pa.string()).take(pa.array(of_text % len(texts))))
                        found["canonical"].append(pa.repeat(pa.scalar(canonical, pa.string()), len(of_text)))
                        found["form"].append(pa.repeat(pa.scalar(form, pa.string()), len(of_text)))
                        found["score"].append(pa.array(scores[of_text % len(texts)]))
            if found["row"]:
                columns = [pa.concat_arrays(found[name]) for name in ("window", "canonical", "form", "score")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(found["row"]))), *columns], names=["id", "window", "canonical", "form", "score"])

    return run


def _near_windows(texts: DataFrame, forms: DataFrame, least: float, key) -> DataFrame:
    """id, window, canonical, form, score: runs of n - 1 to n + 1 words of texts (id, tokens) like a form of n words.

    key makes the strings that are compared. A similarity is at most twice the shared letters over all letters, so runs
    whose lengths or letters rule out the least one are dropped first, which loses none. Forms, a glossary, are sent to all
    tasks; texts are looked at where they are, in pieces that share the words of a run but one, and no run is shuffled.
    """
    known = [(r.canonical, r.form) for r in forms.where("form is not null").select("canonical", "form").distinct().collect()]
    more = max((len(form.split(" ")) for _, form in known), default=0)
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens")), F.lit(PIECE))
    pieces = texts.select("id", F.explode(F.transform(begins, lambda i: F.slice("tokens", i, PIECE + more))).alias("tokens"))
    kind = texts.schema["id"].dataType.simpleString()
    return pieces.mapInArrow(_runs_like(known, least, key), f"id {kind}, window string, canonical string, form string, score double")


def _best_windows(met: DataFrame) -> DataFrame:
    """The best score of each text and term, and the first of the windows that reach it."""
    best = met.groupBy("id", "canonical").agg(F.min(F.struct((-F.col("score")).alias("down"), "window")).alias("best"))
    return best.select("id", "canonical", F.round(-F.col("best.down"), 3).alias("score"), "best.window")


def fuzzy_matches(texts: DataFrame, forms: DataFrame, least: float = 0.82) -> DataFrame:
    """Terms of which some form is like a run of words of a text (id, tokens): id, canonical, score, window.

    A term of at most four letters must be there as it stands.
    """
    best = _best_windows(_near_windows(texts, forms, least, lambda c: c))
    return best.where((F.length(F.regexp_replace(F.lower("canonical"), "[^a-z0-9]", "")) > 4) | (F.col("score") >= 1.0))


def phonetic_matches(texts: DataFrame, forms: DataFrame, least: float = 0.94) -> DataFrame:
    """Terms whose form sounds like a run of words of a text: by keys of at least three letters."""
    return _best_windows(_near_windows(texts, forms.where(F.length(phonetic_key(F.col("form"))) >= 3), least, phonetic_key_of))


def rule_correction(text: Column, terms: Column) -> Column:
    """The corrections whose replacement is, holds or lies in one of the terms, applied in order."""
    low = F.transform(terms, F.lower)
    for source, replacement in CORRECTIONS:
        target = F.lit(replacement.lower())
        held = F.exists(low, lambda term: (term == target) | F.contains(term, target) | F.contains(target, term))  # noqa: B023
        # The pattern is chosen, not the result: a choice between two texts would double the expression with each rule.
        text = F.regexp_replace(text, F.when(held, F.lit(rf"(?i)\b\Q{source}\E\b")).otherwise(F.lit("(?!)")), F.lit(replacement))
    return text


def _shares(chunks: DataFrame) -> DataFrame:
    """id, token, share of a chunk's tokens (id, tokens), dealt by chunk."""
    words = chunks.repartition("id").select("id", F.size("tokens").alias("total"), F.explode("tokens").alias("token")).groupBy("id", "total", "token").agg(F.count("*").alias("n"))
    return words.select("id", "token", (F.col("n") / F.col("total")).alias("share"))


#: A token is frequent if one of so many chunks has it, so there are at most so many times the tokens of a mean chunk.
FREQUENT = 1000


def tfidf_top(queries: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """query_id, rank, id, score: the k chunks of largest cosine with each query (id, tokens); idf is ln((1 + N) / (1 + df)) + 1 over the chunks.

    The chunks' shares are worked out once and written. Norms need them all; products only those of the queries' tokens, and
    these are dealt by chunk before they meet the queries: a chunk's products are added up in one task, which passes on its
    k best of each query.
    """
    shares = written(_shares(chunks), "tfidf-shares")
    size = chunks.count()
    idf = written(shares.groupBy("token").agg((F.log(F.lit(1 + size) / (1 + F.count("*"))) + 1).alias("idf"), (F.count("*") * FREQUENT >= size).alias("frequent")), "tfidf-idf")
    frequent = idf.where("frequent").select("token", "idf")
    # Frequent tokens, most of a chunk, meet their idf where they are; only the others are dealt by token.
    weights = shares.join(F.broadcast(frequent), "token").unionByName(shares.join(F.broadcast(frequent.select("token")), "token", "left_anti").join(idf.where("not frequent").select("token", "idf"), "token"))
    norms = weights.groupBy("id").agg(F.sqrt(F.sum((F.col("share") * F.col("idf")) ** 2)).alias("norm"))
    asked = _shares(queries).join(idf, "token", "left").select(F.col("id").alias("query_id"), "token", "idf", (F.col("share") * F.coalesce("idf", F.log(F.lit(1.0 + size)) + 1)).alias("q"))
    asked = written(asked, "tfidf-queries")
    lengths = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") ** 2)).alias("q_norm"))
    known = asked.where("idf is not null")
    dots = shares.join(known.select("token").distinct(), "token", "left_semi").repartition("id").join(known, "token").groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("share") * F.col("idf")).alias("dot"))
    scored = dots.join(norms, "id").join(lengths, "query_id").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("q_norm")), 6)).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def term_scores(required: Column, text: Column) -> tuple[Column, Column, Column]:
    """How many of the required terms (normal) the text holds, which, and their share; 1 where none is required."""
    held = F.filter(required, lambda term: holds_phrase(text, term))
    return F.size(held), F.array_join(F.array_sort(held), ","), F.when(F.size(required) == 0, 1.0).otherwise(F.round(F.size(held) / F.size(required), 6))


def set_scores(wanted: Column, got: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of the different terms got; 1 where there is nothing to get wrong."""
    hits = F.size(F.array_intersect(wanted, got))
    part = lambda n: F.when(n == 0, 1.0).otherwise(F.round(hits / n, 6))
    a, b = F.size(F.array_distinct(wanted)), F.size(F.array_distinct(got))
    return part(b), part(a), F.when(a + b == 0, 1.0).otherwise(F.round(2 * hits / (a + b), 6))
