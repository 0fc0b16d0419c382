"""One query per operator, with its production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.llm import common


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.decontam import find_leaks

    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm import chat

    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.lit("</s>[INST] ok [/INST]").alias("text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe)
    out = chat.read_back(chat.format_trees(chat.linear_messages(rows.unionByName(own))))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.importance import resample

    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.toxicity import fit_toxicity, score_toxicity

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = common.held_out(F.col("doc_id"), 5, 0)
    scored = score_toxicity(docs, fit_toxicity(docs, labels.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.bpe import encode_documents

    out = encode_documents(common.table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from recordspark.llm import token_files as files

    docs = common.table(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files.write_token_files(docs, path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    keyed = files.find(spark, path, docs.select("doc_id"))
    unkeyed = spark.read.parquet(f"{path}/keys").where("key is null").select("key", "shard", "record")
    out = files.read_records(keyed.unionByName(unkeyed), path)
    starts = F.broadcast(files.shard_starts(spark, path))  # one row per shard file
    out = out.select("key", "shard", "offset", "n_tokens", "crc32").join(starts, "shard")
    return out.select(F.col("key").alias("doc_id"), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", F.col("crc32").alias("ids_crc32"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.rules import host_rules

    out = host_rules(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failures", "host_verdict", "kept")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.katz import score_documents

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", common.held_out(F.col("doc_id"), 7, 2).alias("held"))
    return score_documents(docs, "held")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.jaccard import similar_groups

    return similar_groups(common.table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.urls import judge_urls

    return judge_urls(common.table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.infill import fill_in_middle, restored

    out = fill_in_middle(common.table(spark, sf_dir, "documents"))
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.syncmers import edited_prints

    out = edited_prints(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordspark.llm.whitening import whiten

    return whiten(common.table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filters": op10_url_filters,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_fingerprints": op12_fingerprints,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: Host rules and the host-word fallback, restated as LIKE and regular expressions.
_URL_SQL = """
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
), judged as (
  select page_id, host, path,
    case when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
         when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
         when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
         when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule,
    (select min(k) from (select unnest(range(12)) k) s where
       contains('.' || host, '.' || (['ads-track','adult-x','casino','cheap-pills','free-bets','spam-farm'])[k // 2 + 1] || (['.', '-'])[k % 2 + 1])) as w
  from parts
)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when w is not null and host <> '' then 'block' else 'allow' end as verdict,
  case when host <> '' and w is not null then 'word:' || (['ads-track','adult-x','casino','cheap-pills','free-bets','spam-farm'])[w // 2 + 1] end as word_rule
from judged
"""

_ESCAPED = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"

#: Marks of a turn: 12 + 1 + 11 characters besides role and text.
_CHAT_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length(replace({_ESCAPED.format(x="role")}, chr(10), '&#10;')) + length({_ESCAPED.format(x="text")})) as bigint) as formatted_chars
from rows group by conv_id
"""

_RULES_SQL = """
with docs as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents
), split as (
  select rid, doc_id, source, text,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from docs
), pos as (
  select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select rid, w, unnest(range(1, len(w) - 1)) as i from split)
), rep as (
  select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from pos) where n > 1
), cov as (
  select rid, count(distinct i + k) as n_repeat_words from rep, (select unnest([0, 1, 2]) as k) group by rid
), m as (
  select rid, doc_id, source, len(w) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(regexp_extract_all(text, '[A-Z]')) as bigint) as n_upper,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from split left join cov using (rid)
), f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    cast(10 * n_symbols > n_words as int) + cast(10 * n_dup_lines > 3 * n_lines as int) + cast(2 * n_upper > word_chars as int)
    + cast(word_chars < 2 * n_words as int) + cast(word_chars > 20 * n_words as int) as n_failures
  from m
), h as (
  select source, count(*) as n, sum(cast(base_failed or n_failures > 0 as int)) as x from f group by source
), t as (
  select sum(n) as tn, sum(x) / sum(n) as mean, count(*) as th from h
), s as (
  select max(mean) as mean, sum(n * pow(x / n - mean, 2)) / max(tn) - max(th) * max(mean) * (1 - max(mean)) / max(tn) as extra from h, t
), v as (
  select source, (x + mean * k) / (n + k) as rate
  from (select h.*, mean, case when extra > 0 then greatest(1.0, least(1e6, mean * (1 - mean) / extra - 1)) else 1e6 end as k from h, s)
), j as (
  select f.*, case when rate > 0.5 then 'block' when rate <= 0.02 then 'trust' else 'watch' end as host_verdict
  from f join v on f.source is not distinct from v.source
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cast(n_failures as bigint) as n_failures, host_verdict,
  not base_failed and host_verdict <> 'block' and n_failures <= case when host_verdict = 'trust' then 1 else 0 end as kept
from j
"""

_INFILL_SQL = """
with units as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u,
    sha256('7:' || coalesce(cast(doc_id as varchar), '')) as hex
  from documents
), drawn as (
  select doc_id, t, u, cast(len(u) as bigint) as n,
    cast('0x' || substr(hex, 1, 8) as bigint) % (len(u) + 1) as a, cast('0x' || substr(hex, 9, 8) as bigint) % (len(u) + 1) as b,
    t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') as plain,
    cast('0x' || substr(hex, 25, 8) as bigint) % 100 < 50 as spm
  from units
), parts as (
  select doc_id, t, n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
    coalesce(array_to_string(u[1:least(a, b)], ''), '') as prefix, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') as middle,
    coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') as suffix
  from drawn
)
select doc_id, n, form,
  case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""

#: Anchors of five words whose least run of two words is their first or last, as digit and hash.
_PRINTS = """
{name}_w as (
  select rid, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') as w from seen
), {name}_h as (
  select rid, w, list_transform(range(1, len(w)), lambda i: left(md5(w[i] || ' ' || w[i + 1]), 8)) as h from {name}_w
), {name}_p as (
  select rid, w, list_filter(range(1, len(h) - 2), lambda i: least(h[i], h[i + 3]) <= least(h[i + 1], h[i + 2])) as p from {name}_h
), {name} as (
  select rid, case
    when len(p) > 0 then list_transform(range(1, len(p) + 1), lambda j: (p[j] - case when j = 1 then 1 else p[j - 1] end) || left(md5(array_to_string(w[p[j]:p[j] + 4], ' ')), 8))
    when len(w) > 0 then ['9' || left(md5(array_to_string(w, ' ')), 8)] else cast([] as varchar[]) end as a
  from {name}_p
)"""

_SYNCMER_SQL = f"""
with docs as (
  select row_number() over (order by doc_id desc nulls last, coalesce(text, '') desc) as rid, doc_id, coalesce(text, '') as text from documents
), seen as (
  select rid, doc_id, text, length(text) as n, case when rid < max(rid) over () then rid + 1 else 1 end as next_rid,
    left(text, length(text) - length(text) // 3) || left(coalesce(lead(text) over (order by rid), first_value(text) over (order by rid)), length(text) // 3) as edited
  from docs
), {_PRINTS.format(name="own", text="text")}, {_PRINTS.format(name="other", text="edited")}, three as (
  select doc_id, n, edited, array_to_string(own.a, '') as fingerprint, array_to_string(other.a, '') as edited_fingerprint,
    list_distinct(own.a) as a, list_distinct(other.a) as b, list_distinct(x.a) as c
  from seen join own using (rid) join other using (rid) join own x on x.rid = next_rid
)
select doc_id, cast(n as bigint) as n_chars, sha256(edited) as edited_sha256, fingerprint, edited_fingerprint,
  case when len(a) + len(b) = 0 then 1.0 else 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) end as near_edited,
  case when len(a) + len(c) = 0 then 1.0 else 2.0 * len(list_intersect(a, c)) / (len(a) + len(c)) end as near_next
from three
"""

ORACLE_SQL = {
    "op2_chat_formatting": _CHAT_SQL,
    "op5_quality_rules": _RULES_SQL,
    "op10_url_filters": _URL_SQL,
    "op11_fill_in_middle": _INFILL_SQL,
    "op12_fingerprints": _SYNCMER_SQL,
}
