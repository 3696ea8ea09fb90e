"""Text functions as columns: normal forms, tokens, phonetic keys, edit distances, phrase tests, tolerant casts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Disfluencies that cleaned error rates leave out. Fixed values.
FILLERS = ("um", "uh", "mm-hmm", "mm", "hmm", "mhm", "mmhmm")


#: Texts that a task holds as Python objects at once, whatever the size of its batches.
SOME_TEXTS = 128


@F.arrow_udf(StringType())  # a type by name needs a session when the module is imported
def _nfkc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        done = [pa.array([], pa.string())]
        for at in range(0, len(texts), SOME_TEXTS):
            done.append(pa.array([None if text is None else unicodedata.normalize("NFKC", text) for text in texts.slice(at, SOME_TEXTS).to_pylist()], pa.string()))
        yield pa.concat_arrays(done)


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark lacks; ASCII needs none and stays in the JVM: Python, which is given all rows, sees null instead."""
    plain = text.rlike("^[\\x00-\\x7F]*$")
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def wer_normal(text: Column, compose: bool = True) -> Column:
    """Composed for compatibility (unless it is already), lower case, straight quotes, punctuation to blanks but for ' - . _ between letters or digits."""
    quotes = F.regexp_replace(F.lower(nfkc(text) if compose else text), "[\u2019`]", "'")
    inner = F.regexp_replace(quotes, "(?<![\\p{L}\\p{N}])['\\-._]|['\\-._](?![\\p{L}\\p{N}])|[\\p{P}&&[^'\\-._]]", " ")
    return F.trim(F.regexp_replace(inner, "\\s+", " "))


def wer_words(text: Column, compose: bool = True) -> Column:
    """The words of a normal text."""
    return F.filter(F.split(wer_normal(text, compose), " "), lambda w: w != "")


def cer_normal(text: Column) -> Column:
    """Composed for compatibility, lower case, without punctuation and white space."""
    return F.regexp_replace(F.lower(nfkc(text)), "[\\p{P}\\s]", "")


#: Codes and names of Mandarin, whose errors are counted by character. Fixed values.
MANDARIN = ("cmn", "cmn-cn", "mandarin", "zh", "zh-cn", "zh-hans", "zh_cn")


def canonical_language(code: Column) -> Column:
    """The code in lower case with hyphens; empty for null."""
    return F.replace(F.lower(F.trim(F.coalesce(code, F.lit("")))), F.lit("_"), F.lit("-"))


def is_mandarin(code: Column) -> Column:
    name = canonical_language(code)
    return name.isin(*MANDARIN) | F.startswith(name, F.lit("zh-"))


def metric_of(language: Column) -> Column:
    """CER for Mandarin, which doesn't put blanks between words, else WER."""
    return F.when(is_mandarin(language), "CER").otherwise("WER")


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)


def drop_fillers(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*FILLERS))


def collapse_repeats(words: Column) -> Column:
    """Without words that equal the one before."""
    return F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, a column of the table at a time as the bits of whole numbers (after Myers and Hyyrö)."""
    if not a:
        return len(b)
    whole, last, places = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    up, down, score = whole, 0, len(a)  # where a column's values rise and fall
    for token in b:
        equal = places.get(token, 0)
        level = (((equal & up) + up) ^ up) | equal
        rises, falls = down | (whole & ~(level | up)), up & level
        score += bool(rises & last) - bool(falls & last)
        rises, falls, either = (rises << 1 | 1) & whole, (falls << 1) & whole, equal | down
        up, down = falls | (whole & ~(either | rises)), rises & either
    return score


@F.pandas_udf(IntegerType())
def _token_distance(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([edit_distance([] if x is None else x.tolist(), [] if y is None else y.tolist()) for x, y in zip(a, b, strict=True)], dtype="int32")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of token arrays; null is empty."""
    return _token_distance(a, b)


def error_rate(distance: Column, length: Column) -> Column:
    """Distance over length; without a reference 0 if nothing was said, else 1."""
    return F.when(length > 0, F.round(distance / length, 6)).when(distance > 0, 1.0).otherwise(0.0)


def phonetic_key(text: Column) -> Column:
    """Letters and digits without vowels and y, repeats once."""
    bare = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(bare, "[aeiouy]", ""), "(.)\\1+", "$1")


def phonetic_key_of(text: str) -> str:
    """The same of a string, for tasks."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[^a-z0-9]|[aeiouy]", "", text.lower()))


def clipped_rate(distance: Column, length: Column) -> Column:
    """Distance over length, 1 at most; 0 without a reference."""
    return F.when(length > 0, F.round(F.least(distance / length, F.lit(1.0)), 6)).otherwise(0.0)


def without_stopwords(words: Column, stop: tuple[str, ...]) -> Column:
    """The words but for stop words; repeats stay."""
    return F.filter(words, lambda w: ~w.isin(*stop))


def holds_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def bounded_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase stands in the text in any case, not within a longer word."""
    return text.rlike(f"(?i)(?<![A-Za-z0-9])\\Q{phrase}\\E(?![A-Za-z0-9])")


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def as_float(value: Column, default: float = 0.0) -> Column:
    number = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(default))


def parse_list(value: Column) -> Column:
    """A JSON list, else parts between commas; trimmed, without empty ones."""
    listed = F.coalesce(F.from_json(value, "array<string>"), F.split(value, ","))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def two_places(number: Column) -> Column:
    """A double from 0 to 7 to two places, by its exact binary value and halves to even; Java's format rounds its shortest decimal up."""
    one = F.lit(1 << 60).cast("decimal(19,0)")  # in these units all bits of doubles from 1/256 on are whole
    hundred = (number * float(1 << 60)).cast("long").cast("decimal(19,0)") * F.lit(100).cast("decimal(3,0)")
    rest = hundred % one
    up = (rest * 2 > one) | ((rest * 2 == one) & (((hundred - rest) / one).cast("long") % 2 == 1))
    places = ((hundred - rest) / one).cast("long") + up.cast("long")
    return F.format_string("%d.%02d", F.floor(places / 100), places % 100)


def audio_stamp(seconds: Column) -> Column:
    """MM:SS.ss"""
    return F.format_string("%02d:%05.2f", F.floor(seconds / 60).cast("int"), seconds - F.floor(seconds / 60) * 60)


def masked(key: Column) -> Column:
    """A secret's first three and last two characters; up to eight are all hidden, and none at all is said."""
    bare = F.trim(F.coalesce(key, F.lit("")))
    shown = F.concat(F.substring(bare, 1, 3), F.lit("..."), F.substring(bare, -2, 2))
    return F.when(bare == "", "(not configured)").when(F.length(bare) <= 8, F.regexp_replace(bare, "(?s).", "*")).otherwise(shown)


def safe_stem(name: Column) -> Column:
    """A file name's stem of letters, digits, dots, hyphens and underscores, without dots and underscores at its ends."""
    bare = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(bare == "", "transcript").otherwise(bare)
