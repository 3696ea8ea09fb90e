import re

from pyspark.sql import functions as F

from turnstone.llm import mixing
from turnstone.llm.queries import op9_source_mix

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict) -> dict:
    """Targets by giving out the excess again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: i % 3 + 1 for i, name in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[x] for x in capped)
        open_ = [x for x in names if x not in capped]
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        over = {x for x in open_ if share[x] > 3 * sizes[x]}
        if not over:
            return {x: share.get(x, 3 * sizes[x]) for x in names}
        capped |= over


def check(rows, texts):
    """Sizes, targets and limits; each source's words come near its target."""
    sizes, largest, taken = {}, {}, {}
    for doc_id, source, text in texts:
        n = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    wanted = targets(sizes)
    by_id = {doc_id: (source, len(WORD.findall(text or ""))) for doc_id, source, text in texts}
    assert len(rows) == len(texts)
    for r in rows:
        source, n = by_id[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[source] and abs(r.target - wanted[source]) < 1e-6 * max(1, wanted[source])
        assert 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[source] = taken.get(source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - wanted[source]) <= max(1, largest[source] / 2), source
    return taken, wanted


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op9_source_mix(spark, SF).collect()
    taken, wanted = check(rows, [(r.doc_id, r.source, r.text) for r in docs])
    assert abs(sum(taken.values()) - sum(wanted.values())) < 0.02 * sum(wanted.values())


def test_targets_stop_at_three_times_the_source(spark):
    texts = [(i, "small" if i < 10 else "tiny" if i < 13 else None if i < 60 else "large", "word " * (5 + i % 7)) for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, source string, text string")
    _, wanted = check(mixing.mix(df).collect(), texts)
    sizes = {s: sum(5 + i % 7 for i, x, _ in texts if x == s) for s in ("small", "tiny")}
    assert wanted["small"] == 3 * sizes["small"] and wanted["tiny"] == 3 * sizes["tiny"]


def test_reruns_agree_in_any_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect())
    assert rows(docs) == rows(docs.orderBy(F.desc("text")).repartition(7))


def test_more_probable_documents_come_more_often(spark):
    texts = [(i, f"s{i % 3}", "word " * (20 if i % 2 else 2000)) for i in range(600)]
    out = mixing.mix(spark.createDataFrame(texts, "doc_id long, source string, text string"))
    mean = {r.long: r.copies for r in out.groupBy((F.col("size") > 100).alias("long")).agg(F.avg("copies").alias("copies")).collect()}
    assert mean[True] > mean[False]


def test_odd_rows(spark, docs, no_docs):
    clashing = docs.withColumns({"target": F.lit(1), "copies": F.lit("x")})
    out = mixing.mix(clashing)
    assert out.count() == docs.count() and {r.taken for r in out.where("doc_id in (2, 3, 4)").collect()} == {0}
    applied = mixing.apply_mix(clashing)
    assert applied.columns == clashing.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.apply_mix(no_docs).count() == 0
