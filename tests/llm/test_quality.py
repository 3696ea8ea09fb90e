from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from turnstone.llm import quality
from turnstone.llm.queries import op1_quality

from .conftest import SF


def plain_model(texts, order=quality.ORDER):
    """Modified Kneser-Ney by dictionaries: probability of an n-gram's last character after the others."""
    padded = lambda text: quality.EDGE * (order - 1) + quality.plain(text)
    counts = {order: Counter(s[i : i + order] for s in map(padded, texts) for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, own in counts.items():
        n = Counter(own.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.9, 2.85), strict=True)]
        total, held = defaultdict(int), defaultdict(float)
        for g, c in own.items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        tables[k] = (own, d, total, held)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        own, d, total, held = tables[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        c = own.get(g, 0)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * p(g[1:])

    def log_perplexity(text):
        s = padded(text)
        return -sum(np.log(p(s[i : i + order])) for i in range(len(s) - order + 1)) / max(len(s) - order + 1, 1)

    return p, log_perplexity


TEXTS = ["The cat sat on the mat.", "The dog sat on the log!", "Ein Hund läuft 12 km.", "the the the", "日本語のテキスト", "Ξένα και νέα"]


def test_perplexity_against_plain_model(spark, monkeypatch):
    model = quality.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    p, log_perplexity = plain_model(TEXTS)
    seen = sorted({c for t in TEXTS for c in t})
    assert abs(sum(p("sat " + c) for c in seen) + p("sat \u2603") - 1) < 1e-9
    probe = [*TEXTS, "A new cat, unseen: ßß 99", "本語 cat\n\n sat", "x", ""]
    for size in (1 << 20, 40):
        n, total = np.zeros(len(probe), np.int64), np.zeros(len(probe))
        for shard in quality.shards(model, size):
            assert size > 40 or len(shard.marks) < 120
            n, added = quality.log_p(shard, probe)
            total += added
        for text, own, value in zip(probe, n, total, strict=True):
            assert own == len(quality.plain(text))
            assert not own or abs(-(model.base + value / own) - log_perplexity(text)) < 1e-4
    # Long texts are cut, and what is cut differs in nothing.
    whole = quality.log_p(shard, ["the cat sat " * 50])
    monkeypatch.setattr(quality, "AT_ONCE", 64)
    parts = quality.log_p(shard, ["the cat sat " * 50])
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_rows_of_several_shards(spark, docs, monkeypatch):
    ids = spark.createDataFrame([(1,), (5,), (6,)], "doc_id long")
    rows = lambda: sorted(map(str, quality.classify(docs, ids).collect()))
    one = rows()
    monkeypatch.setattr(quality, "SHARD", 30)
    monkeypatch.setattr(quality.shards, "__defaults__", (30,))
    assert rows() == one and len(one) == docs.count()


def test_query_against_plain_model(spark):
    """The query's perplexities, limits and verdicts, worked out anew."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    _, log_perplexity = plain_model([r.text for r in docs if r.doc_id in good and r.text])
    value = {r.doc_id: log_perplexity(r.text) for r in docs if quality.plain(r.text or "")}
    adjusted = {r.doc_id: value[r.doc_id] - quality.ALLOWANCE / np.sqrt(len(quality.plain(r.text))) for r in docs if r.doc_id in value}

    def limit(ids):
        steps = sorted(np.ceil(adjusted[i] / quality.STEP) for i in ids)
        return steps[int(np.ceil(len(steps) * quality.QUANTILE)) - 1] * quality.STEP + np.log(quality.MARGIN)

    by_lang = defaultdict(list)
    for r in docs:
        if r.doc_id in good and r.doc_id in value:
            by_lang[r.lang].append(r.doc_id)
    overall = limit([i for ids in by_lang.values() for i in ids])
    limits = {lang: limit(ids) for lang, ids in by_lang.items() if len(ids) >= quality.ENOUGH}
    out = op1_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs)
    for r in out:
        if r.doc_id not in value:
            assert r.perplexity is None and not r.keep
            continue
        assert abs(np.log(r.perplexity) - value[r.doc_id]) < 1e-4
        own = limits.get(r.lang, overall)
        assert abs(np.log(r.limit) - own) < 1.5 * quality.STEP
        if abs(adjusted[r.doc_id] - own) > 2 * quality.STEP:
            assert r.keep == (adjusted[r.doc_id] <= own)


def test_query_keeps_good_and_rejects_bad(spark):
    out = op1_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = {(r.quality, r.keep): r["count"] for r in out.join(labels, "doc_id").groupBy("quality", "keep").count().collect()}
    assert found.get((1, False), 0) <= 0.02 * found[(1, True)]
    assert found[(0, False)] > 0.7 * (found[(0, False)] + found.get((0, True), 0))
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows(spark, docs, no_docs):
    ids = spark.createDataFrame([(1,), (1,), (5,), (None,)], "doc_id long")
    out = {(r.doc_id, r.keep) for r in quality.classify(docs, ids).collect()}
    assert (2, False) in out and (3, False) in out and (4, False) in out and (1, True) in out and (5, True) in out
    kept = quality.keep_good(docs, ids)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 2
    assert quality.classify(no_docs, ids).count() == 0 and quality.keep_good(no_docs, ids).count() == 0
    nothing = quality.classify(docs, ids.limit(0))
    assert nothing.where("keep").count() == docs.where(F.length(F.trim(F.regexp_replace("text", "\\s+", " "))) > 0).count()
    clashing = docs.selectExpr("nullif(doc_id, 8) as doc_id", "text", "lang", "source", "1 as keep", "2 as limit", "3 as perplexity", "4 as mark")
    kept = quality.keep_good(clashing, ids)
    assert kept.columns == clashing.columns and kept.where("doc_id = 5").count() == 2
    assert quality.classify(clashing, ids).where("doc_id is null").count() == 1
