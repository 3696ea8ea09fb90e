from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from turnstone.llm import langid
from turnstone.llm.queries import op2_language_id

from .conftest import SF


def bundle(text: str, dimensions: int = langid.DIMENSIONS) -> np.ndarray:
    """A text's bundle, gram by gram."""
    total = np.zeros(dimensions)
    for letters, run in groupby(text.lower(), str.isalpha):
        word = [32, *map(ord, run), 32] if letters else []
        for three in zip(word, word[1:], word[2:], strict=False):
            vectors = [langid._letter_vector(point, dimensions, shift).astype(float) for point, shift in zip(three, (2, 1, 0), strict=True)]
            total += vectors[0] * vectors[1] * vectors[2]
    return total


def test_prediction_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat, and the dog.", "en"), (2, "Der Hund und die Katze schlafen nicht.", "de"), (3, "and that the dog", None), (4, "die Hunde schliefen", None)], "doc_id long, text string, lang string")
    rows = docs.collect()
    prototypes = {r.lang: bundle(r.text) for r in rows if r.lang}
    trained = langid.train(docs.select("text", "lang"))
    assert sorted(trained) == ["de", "en"] and all(np.array_equal(trained[x], prototypes[x]) for x in trained)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, trained).collect()}
    for r in rows:
        own = bundle(r.text)
        cosine = {x: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for x, p in prototypes.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[r.doc_id][0] == best and abs(got[r.doc_id][1] - cosine[best]) < 2e-4
    assert got[3][0] == "en" and got[4][0] == "de"


def test_held_out_accuracy(spark):
    out = op2_language_id(spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    tested = out.join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    hits, n = tested.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and hits >= 0.95


def test_odd_rows(spark, docs, no_docs):
    clashing = docs.withColumns({"score": F.lit("x"), "lang_pred": F.lit("x")})
    trained = langid.train(docs.where("doc_id <> 6").select("text", "lang"))  # 9000 times one word would be all of en
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(clashing, trained).collect()}
    assert langid.predict(clashing, trained).count() == docs.count()
    assert got[2] == got[3] == got[4] == got[7] == ("und", 0.0)
    assert got[1][0] == "en" and got[5][0] == "de" and 0 <= got[8][1] <= 1
    assert langid.predict(no_docs, trained).count() == 0
    nothing = langid.train(no_docs.select("text", "lang"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
