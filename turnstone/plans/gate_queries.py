"""Queries of the gates, their features, labels and baselines, with their SQL.

Proposals are whole turns that begin with planted words; what is proposed has other words there, lacks the last words or
says all of them twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import gates
from turnstone.plans.edit_queries import edits_sql
from turnstone.sources.tables import TURNS_SQL, conversation_turns, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


#: raw words, proposed words, retrieved terms, context.
PLANTED = (
    ("we use piano note", "we use pyannote", ("pyannote",), "Speaker diarization toolkit discussion."), ("put it on the rack", "put it on the RAG", ("RAG",), "A physical equipment rack is being discussed."),
    ("where changed after the test", "WER changed after the test", ("WER",), "A test is mentioned without specifying ASR."), ("Speaker A said so", "speaker B said so", (), "A meeting."),
    ("the dear value", "the DER value", ("DER", " "), "Diarization benchmark metric."), ("same words", "same words", ("Qwen",), ""), ("tag speech paper", "TagSpeech paper", ("TagSpeech", "paper"), "Temporal speech research; the year may be wrong."),
    ("temporal anger", "temporal anchor", ("temporal anchor",), "Cooking, unrelated."), ("the straße der", "the strasse DER", ("DER",), "Participant 2 gave no result."), ("wer is", "WER is", ("WER", "wer is"), "An ASR metric."),
)
_planted_sql = "planted(p, raw_words, new_words, terms, context) as (values " + ", ".join(f"({i}, '{a}', '{b}', {list(terms)}::varchar[], '{context}')" for i, (a, b, terms, context) in enumerate(PLANTED)) + ")"
PROPOSALS_SQL = f"""{TURNS_SQL}, {_planted_sql},
  proposals as (select clip_id, idx, clip_id * 100000 + idx as id, case when (clip_id + idx) % 17 = 0 then ' ' else raw_words || ' ' || coalesce(text, '') end as raw_text,
    case when (clip_id + idx) % 19 = 0 then '' when idx % 5 = 1 then new_words || ' ' || left(coalesce(text, ''), (length(coalesce(text, '')) * 2 // 3)::bigint) when idx % 5 = 2 then new_words || ' ' || coalesce(text, '') || ' ' || coalesce(text, '') else new_words || ' ' || coalesce(text, '') end as corrected_text,
    context, terms, clip_id % 2 = 0 as overlap, clip_id % 5 = 0 as heavy_overlap, clip_id % 7 = 0 as speaker_ambiguity, idx % 4 = 3 as partial from turns join planted on p = (clip_id * 7 + idx) % {len(PLANTED)})"""
_fold = lambda x: f"replace(lower({x}), 'ß', 'ss')"
_tokens = lambda x: f"regexp_extract_all({_fold(x)}, '{gates.TOKEN}')"
_any = lambda x, cues: "(" + " or ".join(f"contains({x}, '{cue}')" for cue in cues) + ")"
_CONTEXTUAL = "case " + " ".join(f"when contains({_fold('t')}, '{key}') or contains('{key}', {_fold('t')}) then {_any('folded', cues)}" for key, cues in gates.TERM_CUES.items()) + " else true end"
_SAID = f"list_filter(terms, lambda t: trim(t) <> '' and contains(array_to_string(corrected, ' '), array_to_string({_tokens('t')}, ' ')))"
_speakers = lambda x: f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '(?i)\\b(?:speaker|participant)\\s*(?:[a-z]|[0-9]+)\\b'), lambda m: lower(regexp_replace(m, '(?i)^(speaker|participant)\\s*', '\\1 ')))))"
_steps = lambda x, *steps: "case " + " ".join(f"when {x} >= {least} then {points}" for least, points in steps) + " else 0 end"
_S, _R = gates.SUPPORT, gates.RISK
EVIDENCE_SQL = f"""{PROPOSALS_SQL}, cut as (select *, trim(raw_text) as rt, trim(corrected_text) as ct, {_tokens('raw_text')} as raw, {_tokens('corrected_text')} as corrected, {_fold('context')} as folded from proposals),
  pairs as (select id, raw as a, corrected as b from cut), {edits_sql(leave_out_common=True)},
  moved as (select id, flatten(list(a[a0 + 1:a1] order by place)) as removed, flatten(list(b[b0 + 1:b1] order by place)) as added from edits join pairs using (id) group by 1),
  ev as (select cut.*, coalesce(removed, []) as removed, coalesce(added, []) as added, {_SAID} as said from cut left join moved using (id)),
  ev2 as (select *, list_filter(said, lambda t: {_CONTEXTUAL}) as supported_terms, list_filter(said, lambda t: not ({_CONTEXTUAL})) as weak_terms, raw = corrected as no_change, (len(removed) + len(added)) / greatest(len(raw) + len(corrected), 1) as changed_ratio,
    greatest(0.0, (len(corrected) - len(raw)) / greatest(len(raw), 1)) as length_growth, case when len(added) > 0 then len(list_filter(added, lambda w: list_contains(flatten(list_transform(terms, lambda t: {_tokens('t')})), w) or list_contains(raw, w))) / len(added) else 1.0 end as support_ratio,
    {_any('folded', gates.AMBIGUITY_CUES)} as ambiguity, {_any('folded', gates.CONTRADICTION_CUES)} as contradiction, {_speakers('raw_text')} <> {_speakers('corrected_text')} as attribution, rt = '' or ct = '' as empty from ev),
  ev3 as (select *, len(added) > 0 and support_ratio < 0.5 as weakly from ev2),
  points as (select *, case when no_change then {_S['no_change']} else {_S['base']} + case when len(supported_terms) > 0 then least({_S['terms_most']}, {_S['term']} + {_S['each_term']} * len(supported_terms)) else 0 end + {_steps('support_ratio', _S['grounded'], _S['half_grounded'])}
      + case when len(added) = 0 and len(removed) > 0 then {_S['only_removed']} else 0 end - case when contradiction then {_S['contradiction']} when ambiguity then {_S['ambiguity']} else 0 end end as s,
    {_R['base']} + overlap::int * {_R['overlap']} + heavy_overlap::int * {_R['heavy_overlap']} + speaker_ambiguity::int * {_R['speaker_ambiguity']} + partial::int * {_R['partial']} + {_steps('changed_ratio', _R['large_edit'], _R['edit'])} + {_steps('length_growth', _R['much_longer'], _R['longer'])}
      + (len(weak_terms) > 0)::int * {_R['weak_terms']} + ambiguity::int * {_R['ambiguity']} + (contradiction and not no_change)::int * {_R['contradiction']} + weakly::int * {_R['weakly_grounded']} + attribution::int * {_R['attribution']} as r from ev3),
  scored as (select *, case when empty then 0.0 else round(least(greatest(s::double, 0), 1), 3) end as support_score, case when empty then 1.0 else round(least(greatest(r::double, 0), 1), 3) end as risk_score from points),
  decided as (select *, case when empty then 'reject' when no_change then 'accept' when attribution or risk_score >= 0.78 then 'reject' when support_score < 0.3 and risk_score >= 0.45 then 'reject' when ambiguity then 'needs_review' when risk_score >= 0.4 or support_score < 0.58 then 'needs_review' else 'accept' end as decision,
    array_to_string(list_filter([case when no_change then 'the proposal preserves the ASR evidence' end, case when not no_change and len(supported_terms) > 0 then 'retrieval and context support ' || array_to_string(list_transform(supported_terms, lambda t: trim(t)), ', ') end, case when not no_change and support_ratio >= 0.8 then 'most inserted tokens are grounded' end], lambda x: x is not null), '; ') as pro,
    array_to_string(list_filter([case when overlap then 'overlap' end, case when heavy_overlap then 'heavy overlap' end, case when speaker_ambiguity then 'speaker ambiguity' end, case when partial then 'partial utterance' end, case when changed_ratio >= 0.55 then 'large edit' end, case when length_growth >= 0.5 then 'substantial unsupported expansion' end,
      case when len(weak_terms) > 0 then 'retrieval term lacks matching context' end, case when ambiguity then 'context explicitly signals ambiguity' end, case when contradiction and not no_change then 'context contradicts the proposed domain edit' end, case when weakly then 'inserted tokens are weakly grounded' end, case when attribution then 'speaker attribution changed' end], lambda x: x is not null), ', ') as con from scored)"""


def planted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(PLANTED)], "p int, raw_words string, new_words string, terms array<string>, context string")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, clip = F.col("idx"), F.col("clip_id")
    turns = conversation_turns(spark, sf_dir).select("clip_id", "idx", F.coalesce("text", F.lit("")).alias("text"), ((clip * 7 + i) % len(PLANTED)).cast("int").alias("p"))
    rows = turns.join(F.broadcast(planted(spark)), "p")
    say = lambda words, *texts: F.concat_ws(" ", words, *texts)
    part = F.substring(F.col("text"), F.lit(1), F.expr("cast(length(text) * 2 div 3 as int)"))
    new = F.when((clip + i) % 19 == 0, "").when(i % 5 == 1, say("new_words", part)).when(i % 5 == 2, say("new_words", "text", "text")).otherwise(say("new_words", "text"))
    return rows.select(
        "clip_id", "idx", F.when((clip + i) % 17 == 0, " ").otherwise(say("raw_words", "text")).alias("raw_text"), new.alias("corrected_text"), "context", "terms",
        (clip % 2 == 0).alias("overlap"), (clip % 5 == 0).alias("heavy_overlap"), (clip % 7 == 0).alias("speaker_ambiguity"), (i % 4 == 3).alias("partial"),
    )


@query(f"with recursive {EVIDENCE_SQL} select clip_id, idx, support_score, risk_score, decision, case when empty then 'Reject: empty raw or proposed text is not auditable.' else decision || ': ' || coalesce(nullif(pro, ''), 'no strong support evidence') || '; observed risk: ' || coalesce(nullif(con, ''), 'low edit risk') || '.' end as explanation from decided")
def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate_scores(gates.evidence(proposals(spark, sf_dir))).select("clip_id", "idx", "support_score", "risk_score", "decision", "explanation")


@query(f"with recursive {EVIDENCE_SQL} select clip_id, idx, case when decision = 'accept' and not no_change and support_score >= 0.58 and risk_score < 0.4 and not (heavy_overlap or speaker_ambiguity) and not (partial and risk_score >= 0.35) then 'safe_to_apply' else 'do_not_apply' end as binary_decision from decided")
def binary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.binary_gate(gates.gate_scores(gates.evidence(proposals(spark, sf_dir)))).select("clip_id", "idx", "binary_decision")


@query("""with e as (select doc_id, (doc_id % 89) / 100 as before, (n_chars % 97) / 100 as after, doc_id % 7 = 0 as unsafe from documents)
  select doc_id, case when not unsafe and after + 0.05 < before then 'safe_to_apply' else 'do_not_apply' end as label, case when unsafe then 'Safety override: unsupported, invented, forbidden, or speaker-attribution-changing content was detected.' when after + 0.05 < before then 'error_after + 0.050 < error_before' else 'error_after + 0.050 >= error_before' end as reason from e""")
def binary_margin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, reason = gates.margin_label((F.col("doc_id") % 89) / 100, (F.col("n_chars") % 97) / 100, 0.05, F.col("doc_id") % 7 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), reason.alias("reason"))
