"""One query for each operator, over the whole documents table, and its oracle SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.classifier import quality_scores
from usagelens.llm.common import documents, id_remainder
from usagelens.llm.credentials import secrets
from usagelens.llm.exact_dedup import exact_duplicates
from usagelens.llm.langid import language_id
from usagelens.llm.lexical import TOP, ranked_search
from usagelens.llm.mixing import mix
from usagelens.llm.packing import pack_documents
from usagelens.llm.pii import personal_data
from usagelens.llm.quality import BUCKETS_PER_DOUBLING, FENCE, LEAST_SPREAD, MIN_DOCS, quality_rules
from usagelens.llm.registry import query
from usagelens.llm.simhash import near_groups
from usagelens.llm.substrings import substring_dedup
from usagelens.llm.token_files import round_trip
from usagelens.llm.whitening import whiten

_EXACT_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents),
g as (
  select *, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over (partition by text_sha256 order by n_chars desc, doc_id) as keep_id
  from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""


@query("op1_exact_dedup", _EXACT_SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _quality_sql() -> str:
    signals = {
        "symbols": "n_symbols / n_words", "upper": "n_upper / word_chars", "marks": "n_marks / n_words",
        "dup_lines": "n_dup_lines / n_lines", "repeated": "n_repeat_words / n_words", "word_length": "word_chars / n_words",
    }
    values = " union all ".join(f"select doc_id, lang, source, '{s}' as signal, {v} as value from j where not base_failed" for s, v in signals.items())
    least = " ".join(f"when '{s}' then {v}" for s, v in LEAST_SPREAD.items())

    def quartiles(name: str, keys: str) -> str:
        by = f"partition by {keys}signal"
        return f"""
{name}_r as (
  select {keys}signal, bucket, sum(sum(n)) over ({by}) as docs, sum(sum(n)) over ({by} order by bucket nulls first) as upto
  from sketch group by {keys}signal, bucket),
{name} as (
  select {keys}signal, max(docs) as docs,
    min(coalesce(pow(2.0, bucket / {BUCKETS_PER_DOUBLING}.0), 0.0)) filter (upto * 4 >= docs) as q25,
    min(coalesce(pow(2.0, bucket / {BUCKETS_PER_DOUBLING}.0), 0.0)) filter (upto * 4 >= docs * 3) as q75
  from {name}_r group by {keys}signal)"""

    return rf"""
with w as (
  select doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as solid,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
grams as (
  select doc_id, unnest(range(1, len(words) - 6)) as i, words from w where len(words) >= 8),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, array_to_string(words[i:i + 7], ' ')) as times from grams),
repeats as (
  select doc_id, sum(least(8, i - before)) as n_repeat_words
  from (select doc_id, i, lag(i, 1, -8) over (partition by doc_id order by i) as before from windows where times > 1) group by doc_id),
c as (
  select w.doc_id, lang, source, cast(len(words) as bigint) as n_words, length(solid) as word_chars,
    length(regexp_replace(solid, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    length(regexp_replace(solid, '[^\p{{Lu}}]', '', 'g')) as n_upper,
    length(regexp_replace(solid, '[\p{{L}}\p{{M}}\p{{N}}]', '', 'g')) as n_marks,
    cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from w left join repeats using (doc_id)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
v as ({values}),
sketch as (
  select lang, source, signal, case when value > 0 then ceil(round(log2(value) * {BUCKETS_PER_DOUBLING}, 6)) end as bucket, count(*) as n
  from v group by all),
{quartiles("f", "lang, source, ")},{quartiles("l", "lang, ")},{quartiles("a", "")},
q as (
  select f.lang, f.source, f.signal,
    case when f.docs >= {MIN_DOCS} then f.q25 when l.docs >= {MIN_DOCS} then l.q25 else a.q25 end as lo,
    case when f.docs >= {MIN_DOCS} then f.q75 when l.docs >= {MIN_DOCS} then l.q75 else a.q75 end as hi,
    case f.signal {least} end as least_spread
  from f join l on f.lang is not distinct from l.lang and f.signal = l.signal join a on f.signal = a.signal),
failed as (
  select distinct doc_id from v join q on v.lang is not distinct from q.lang and v.source is not distinct from q.source and v.signal = q.signal
  where value > hi + greatest(hi - lo, least_spread) * {FENCE}
    or (v.signal = 'word_length' and value < lo - greatest(hi - lo, least_spread) * {FENCE}))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from failed) as kept
from j
"""


@query("op2_quality_rules", _quality_sql())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 3) == 1
    found = language_id(documents(spark, sf_dir), ~held_out, held_out.alias("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


_SUBSTRING_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, i, array_to_string(words[i:i + 34], ' ') as span
  from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35)),
repeated as (select doc_id, i from (select doc_id, i, count(*) over (partition by span) as times from windows) where times > 1),
covered as (select distinct doc_id, unnest(range(i, i + 35)) as j from repeated),
places as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as j from w),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by j) as text
  from places anti join covered using (doc_id, j) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""


@query("op4_substring_dedup", _SUBSTRING_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    columns = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return packed.select("doc_id", *(F.col(c).cast("long").alias(c) for c in columns))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir), shingle_words=3, words=1, segment_bits=32, ball=1, max_distance=2, matches=None)
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.col("bits")[0]), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(documents(spark, sf_dir), labels, ~held_out, held_out.alias("held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op9_token_binary")
def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_secrets")
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_LEXICAL_SQL = rf"""
with t as (select doc_id, unnest({_TERMS_SQL}) as term from documents),
f as (select doc_id, term, count(*) as tf from t group by all),
d as (select doc_id, cast(sum(tf) as bigint) as n from f group by doc_id),
s as (select count(*) as docs, cast(sum(n) as bigint) as total from d),
w as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as weight from f, s group by term),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS_SQL}) as term from benchmark) group by all),
scores as (
  select item_id, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) as bigint) as score
  from q join w using (term) join f using (term) join d using (doc_id), s group by all),
ranked as (select item_id, doc_id, score, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {TOP}
"""


@query("op12_lexical_search", _LEXICAL_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
