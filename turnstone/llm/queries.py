"""The registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import langid, licenses, media, mixing, neardup, packing, pii, quality, resampling, spelling, substrings, tokencount, topk
from turnstone.llm.common import documents


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the documents that people found good, and whether it stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(documents(spark, sf_dir), quality.trusted(labels))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out quarter."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 4) == 2, F.lit(False))
    prototypes = langid.train(docs.where(~held_out).select("text", "lang"))
    predicted = langid.predict(docs.select("doc_id", "text"), prototypes)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")



def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures in every document."""
    return licenses.scan(documents(spark, sf_dir))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in its text."""
    return pii.replace_all(documents(spark, sf_dir).select("doc_id", "text")).select("doc.doc_id", "doc.text", "n_entities")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image, read back and described."""
    described = media.media_features(media.store_payload(documents(spark, sf_dir)), carry=("n_bytes",))
    return described.select(
        "doc_id", "n_bytes", F.col("samples_bytes").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256",
        F.col("dhash").alias("feature"), "height", "width", F.sha2("tile_npy", 256).alias("tile_sha256"),
    )



def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix of all documents, by source weights, takes each of them."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")



def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences that each hold the corpus's mix of sources."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that a document of smaller id has too."""
    return substrings.remove_repeats(documents(spark, sf_dir))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's texts, with every document's weight and score."""
    drawn = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with the more frequent word that it is a variant of."""
    return spelling.variants(documents(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokencount.count_tokens(documents(spark, sf_dir), tokenizer_path())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,

    "op3_near_duplicates": op3_near_duplicates,
    "op4_license_scan": op4_license_scan,
    "op5_surrogates": op5_surrogates,
    "op6_media": op6_media,
    "op7_top_products": op7_top_products,
    "op8_packing": op8_packing,
    "op9_source_mix": op9_source_mix,
    "op10_repeats": op10_repeats,
    "op11_resample": op11_resample,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_counts": op13_token_counts,
}

_TOP_PRODUCTS_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where len(embedding) > 0 and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  scored as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v q join v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id and len(q.e) = len(v.e))
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scored qualify rank <= 5"""

_REPEATS_SQL = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
  win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as k from (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as i from d where len(ws) >= 50)),
  firsts as (select k, min(doc_id) as first_doc from win group by 1), hit as (select doc_id, i from win join firsts using (k) where first_doc < doc_id),
  gone as (select distinct doc_id, unnest(generate_series(i, i + 49)) as pos from hit), w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from d),
  kept as (select w.doc_id, count(gone.pos) as n_removed, string_agg(word, ' ' order by w.pos) filter (gone.pos is null) as t from w left join gone on w.doc_id = gone.doc_id and w.pos = gone.pos group by 1)
  select doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""


def _mix_sql() -> str:
    """The mix by ranks over whole sources: what the operator takes bucket by bucket."""
    steps, picked = [], "select null::varchar as source, null::bigint as doc_id, null::bigint as size where false"
    for i in range(mixing.CLOSINGS):
        before = f"closed{i}"
        steps.append(f"{before} as ({picked})")
        gap = f"gap{i} as (select c.source, max(budget) - (sum(size * more) + coalesce((select sum(size) from {before} x where x.source is not distinct from c.source), 0)) as gap from chosen c where odds is not null group by c.source having max(budget) > sum(size * more) + coalesce((select sum(size) from {before} x where x.source is not distinct from c.source), 0))"
        steps.append(gap)
        picked = f"select * from {before} union all select source, doc_id, size from (select c.source, c.doc_id, c.size, row_number() over (partition by c.source order by abs(c.size - gap), c.doc_id, c.size) as place from chosen c join gap{i} g on c.source is not distinct from g.source where more = 0 and odds is not null and abs(c.size - gap) < gap and not exists (select 1 from {before} x where x.source is not distinct from c.source and x.doc_id = c.doc_id)) where place = 1"
    steps.append(f"closed as ({picked})")
    return f"""with sizes as (select doc_id, source, size, size * 1000 // (size + {mixing.HALF_LENGTH}) as x from (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents)),
  own as (select source, sum(size)::bigint as source_size, sum(size * x)::bigint as size_x, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sizes group by 1),
  levels as (select *, (sum(source_size) over () - coalesce(sum(source_size * {mixing.LIMIT}) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as level from own),
  filled as (select *, level * weight >= source_size * {mixing.LIMIT} as full_ from levels), open_ as (select level as open_level from filled where not full_ order by source_size / weight, source nulls last limit 1),
  targets as (select source, source_size, case when full_ then (source_size * {mixing.LIMIT})::double else weight * (select open_level from open_) end as target, coalesce(size_x / nullif(source_size, 0), 0.0) as mean_x from filled),
  rated as (select s.doc_id, s.source, s.size, t.source_size, t.target, least(greatest(coalesce(target / nullif(source_size, 0), 0.0) + {mixing.TILT} * least(coalesce(target / nullif(source_size, 0), 0.0), {mixing.LIMIT} - coalesce(target / nullif(source_size, 0), 0.0)) * ((x - mean_x) / 1000), 0.0), {mixing.LIMIT}::double) as expected, (('0x' || left(md5('{mixing.SEED}|' || s.doc_id), 13))::bigint + 0.5) / {float(1 << 52)!r} as u from sizes s join targets t on s.source is not distinct from t.source),
  odd as (select *, floor(expected)::bigint as certain, case when expected - floor(expected) > 0 and size > 0 then u / (1 - u) * ((1 - (expected - floor(expected))) / (expected - floor(expected))) end as odds from rated),
  budgets as (select source, max(target) - sum(size * certain) as budget, sum(case when odds is not null then size else 0 end) as wanted from odd group by 1),
  chosen as (select o.*, case when wanted > budget then budget end as budget, case when o.odds is null then 0 when sum(case when o.odds is not null then size else 0 end) over (partition by o.source order by o.odds nulls last, o.doc_id rows unbounded preceding) <= budget then 1 else 0 end as more from odd o join budgets b on o.source is not distinct from b.source),
  {", ".join(steps)}
  select c.doc_id, c.size, c.source_size, c.target, ((certain + more + (k.doc_id is not null)::int) * c.size)::bigint as taken, c.source, (certain + more + (k.doc_id is not null)::int)::bigint as copies from chosen c left join closed k on c.source is not distinct from k.source and c.doc_id = k.doc_id"""


def _crc_tables() -> str:
    """A list of the 16 steps of a CRC-32 by half bytes, worked out from its polynomial."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ 0xEDB88320 * (value & 1)
        steps.append(value)
    return f"({steps}::bigint[])"


def _half_bytes(text: str) -> str:
    """SQL of a text's UTF-8 half bytes, the low one of each byte first."""
    return f"list_transform(range(2 * strlen({text})), lambda k: instr('0123456789ABCDEF', hex({text})[k + 2 - 2 * (k % 2)]) - 1)"


def _crc_sql(half_bytes: str, state: str = "4294967295::bigint") -> str:
    """SQL of a CRC-32's state after these half bytes."""
    return f"list_reduce({half_bytes}, lambda c, b: xor(c >> 4, {_crc_tables()}[(xor(c, b) & 15) + 1]), {state})"


def _words_sql(table: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({table}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_RESAMPLE_SQL = f"""with d as (select doc_id, {_words_sql("documents")} as ws from documents), t as (select unnest({_words_sql("benchmark")}) as w from benchmark),
  s as (select doc_id, w, count(*) as k from (select doc_id, unnest(ws) as w from d) group by 1, 2), words as (select distinct w from (select w from s union all select w from t)),
  hashed as (select w, xor({_crc_sql(_half_bytes("w"))}, 4294967295) % {resampling.BUCKETS} as b from words),
  sb as (select b, sum(k)::bigint as s from s join hashed using (w) group by 1), tb as (select b, count(*) as t from t join hashed using (w) group by 1),
  totals as (select coalesce((select sum(s) from sb), 0)::double as s_all, coalesce((select sum(t) from tb), 0)::double as t_all),
  gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + {resampling.BUCKETS}) / ((coalesce(s, 0) + 1)::double * (t_all + {resampling.BUCKETS}))))::bigint as g from sb full join tb using (b), totals),
  weighed as (select doc_id, floor(sum(k * g) / sum(k))::bigint as weight from s join hashed using (w) join gain using (b) group by 1),
  scored as (select d.doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{resampling.SEED}:' || d.doc_id), 8))::bigint + 0.5) / 4294967296)))::bigint as score from d left join weighed using (doc_id)),
  placed as (select *, row_number() over (partition by n_features >= {resampling.LEAST_WORDS} order by score desc, doc_id) as place, {resampling.PERCENT} * (count(*) filter (n_features >= {resampling.LEAST_WORDS}) over ()) // 100 as drawn from scored)
  select doc_id, n_features, weight, score, case when n_features >= {resampling.LEAST_WORDS} and place <= drawn then place end as rank from placed"""

_SPELLING_SQL = f"""with recursive d as (select doc_id, {_crc_sql(_half_bytes("(doc_id || ':')"))} as state, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+') as ws from documents),
  s as (select doc_id, state, w, count(*) as k from (select doc_id, state, unnest(ws) as w from d) where length(w) >= {spelling.SHORTEST} group by all),
  coded as (select w, {_half_bytes("w")} as bits from (select distinct w from s)), hashed as (select w, k, xor({_crc_sql("bits", "state")}, 4294967295) as h from s join coded using (w)),
  written as (select case when h % {spelling.DROP_EVERY} = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end as word, k from hashed),
  v as materialized (select word, sum(k)::bigint as n from written where length(word) >= {spelling.SHORTEST} group by 1 having sum(k) >= {spelling.LEAST_COUNT}),
  less as (select word, n, i, word[:i] || word[i + 2:] as rest from (select word, n, unnest(range(length(word))) as i from v)),
  near as materialized (select a.word, b.word as other, b.n as other_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union all select distinct a.word, v.word, v.n from less a join v on a.rest = v.word union all select distinct v.word, a.word, a.n from less a join v on a.rest = v.word),
  best as (select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by 1),
  formed as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= {spelling.RATIO} * v.n then other end as form, case when other_n >= {spelling.RATIO} * v.n then other_n end as form_n from v left join best using (word)),
  follow as (select word, form as at from formed where form is not null union all select follow.word, formed.form from follow join formed on follow.at = formed.word where formed.form is not null),
  ends as (select follow.word, follow.at from follow join formed on follow.at = formed.word where formed.form is null)
  select formed.word, form, coalesce(ends.at, formed.word) as root, n, n_near, form_n from formed left join ends using (word)"""


#: SQL of the operators that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {"op7_top_products": _TOP_PRODUCTS_SQL, "op9_source_mix": _mix_sql(), "op10_repeats": _REPEATS_SQL, "op11_resample": _RESAMPLE_SQL, "op12_spelling_variants": _SPELLING_SQL}
