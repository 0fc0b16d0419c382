"""Fusion and workflow jobs over orders, line items, events, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.operators import fusion as U
from recordspark.operators import archive as V
from recordspark.operators import workflow as W
from recordspark.plans.registry import ORACLE_SQL, query, run, table


def duck(sql: str) -> str:
    """The same fixture for the other engine."""
    return sql.replace("{", "").replace("}", "")


EVIDENCE = """select l_partkey as rec_id, case when l_partkey % 3 = 0 then 'artigo' else 'livro' end as type, 'publisher' as field, case l_linenumber % 4 when 0 then 'cip' when 1 then 'api' when 2 then 'cover' else 'label' end as source, case when l_orderkey % 6 = 0 then ' ' else concat('house ', cast(l_suppkey % 30 as string)) end as value from {lineitem}
  union all select l_partkey, case when l_partkey % 3 = 0 then 'artigo' else 'livro' end, 'year', case l_linenumber % 3 when 0 then 'cip' when 1 then 'api' else 'cover' end, cast(year(l_shipdate) as string) from {lineitem}"""
PRIORITY = "select * from (values ('livro', 'publisher', 'cip', 1), ('livro', 'publisher', 'api', 2), ('livro', 'publisher', 'cover', 3), ('artigo', 'publisher', 'cover', 1), ('artigo', 'publisher', 'label', 2), ('livro', 'year', 'cip', 1), ('livro', 'year', 'api', 2), ('artigo', 'year', 'api', 1)) as t(type, field, source, rank)"


@query(
    "fu1_fuse_fields",
    f"select rec_id, field, value, source from (select *, row_number() over (partition by rec_id, field order by rank, value, source) as rn from ({duck(EVIDENCE)}) join ({PRIORITY}) using (type, field, source) where trim(value) <> '') where rn = 1",
)
def fu1(spark, sf):
    return U.fuse_fields(run(spark, sf, EVIDENCE, "lineitem"), spark.sql(PRIORITY))


PACKAGES = "select l_partkey as rec_id, l_linenumber <> 2 as approved, l_orderkey * 10 + l_linenumber as seen_at, cast(case when l_orderkey % 4 = 0 then null else year(l_shipdate) end as int) as year, cast(case when l_orderkey % 5 = 0 then null else cast(l_quantity as int) * 10 end as int) as pages from {lineitem} where l_suppkey % 2 = "
LOCAL = "select p_partkey as rec_id, cast(1992 + p_partkey % 7 as int) as year, cast(p_size * 10 as int) as pages from {part}"


@query(
    "fu3_reconcile_listings",
    f"""with p as (select rec_id, unnest(max(struct_pack(seen_at := seen_at, p_year := year, p_pages := pages))) from ({duck(PACKAGES + '0')}) where approved group by rec_id), s as (select rec_id, unnest(max(struct_pack(seen_at := seen_at, s_year := year, s_pages := pages))) from ({duck(PACKAGES + '1')}) where approved group by rec_id),
      j as (select l.rec_id, l.year as ly, l.pages as lp, coalesce(p_year, s_year) as y, coalesce(p_pages, s_pages) as g from ({duck(LOCAL)}) l left join p using (rec_id) left join s using (rec_id))
      select rec_id, coalesce(y, ly) as year, coalesce(g, lp) as pages, concat_ws('; ', case when y <> ly then 'ano_divergente' end, case when abs(g - lp) > greatest(5.0::double, 0.2::double * lp) then 'paginas_divergentes' end) as alerts from j""",
)
def fu3(spark, sf):
    return U.reconcile_listings(run(spark, sf, PACKAGES + "0", "lineitem"), run(spark, sf, PACKAGES + "1", "lineitem"), run(spark, sf, LOCAL, "part"))


PREPARED = "select c_custkey as hash, c_name as title, c_mktsegment as city from {customer} where c_custkey % 3 <> 0"
SENT = "select c_custkey as hash, concat('sent ', c_name) as title, c_custkey * 7 as remote_id from {customer} where c_custkey % 2 = 0"
REVISED = "select c_custkey as hash, c_custkey % 4 <> 1 as approved, case when c_custkey % 8 = 0 then '' else concat('rev ', c_name) end as title, 'Faro' as city from {customer} where c_custkey % 5 = 0"


@query(
    "fu4_consolidate_sources",
    f"""with p as ({duck(PREPARED)}), s as ({duck(SENT)}), r as (select hash, nullif(title, '') as rt, city as rc from ({duck(REVISED)}) where approved), h as (select hash from p union select hash from s union select hash from r)
      select hash, coalesce(rt, p.title, s.title) as title, coalesce(rc, p.city) as city, remote_id, concat_ws(', ', case when p.hash is not null then 'preparado' end, case when remote_id is not null then 'enviado' end, case when r.hash is not null then 'revisado' end) as sources
      from h left join p using (hash) left join s using (hash) left join r using (hash)""".replace("p.hash", "p.city").replace("r.hash", "rc"),
)
def fu4(spark, sf):
    return U.consolidate_sources(run(spark, sf, PREPARED, "customer"), run(spark, sf, SENT, "customer"), run(spark, sf, REVISED, "customer"))


RECORDS = "select c_custkey as rec_id, concat('f', cast(c_custkey as string)) as file, concat('h', cast(c_custkey % 400 as string)) as hash, c_name as title, case when c_custkey % 2 = 0 then 'isbn' else '' end as conflicts, 'year' as pending from {customer}"
REVISIONS = "select concat('f', cast(case when c_custkey % 6 = 0 then c_custkey + 100000 else c_custkey end as string)) as file, concat('h', cast((c_custkey + cast(c_custkey % 9 = 0 as int)) % 400 as string)) as hash, concat('new ', c_name) as title, c_custkey % 4 = 1 as approved, case when c_custkey % 5 = 0 then 'title' end as conflicts, cast(null as string) as pending from {customer} where c_custkey % 3 = 0"


@query(
    "fu5_apply_revisions",
    f"""with r as ({duck(REVISIONS)}), n as (select file, min(struct_pack(h := hash, t := title, a := approved, c := coalesce(conflicts, ' '))) as n from r group by file), b as (select hash, min(struct_pack(f := file, t := title, a := approved, c := coalesce(conflicts, ' '))) as b from r group by hash),
      j as (select x.*, n, b from ({duck(RECORDS)}) x left join n using (file) left join b using (hash)), k as (select *, case when n.h = hash then n.a when n is null then b.a end as ap, nullif(case when n.h = hash then n.c when n is null then b.c end, ' ') as cf from j)
      select rec_id, coalesce(case when n.h = hash then n.t when n is null then b.t end, title) as title, case when coalesce(ap, false) then '' else coalesce(cf, conflicts) end as conflicts, case when coalesce(ap, false) then '' else pending end as pending, case when n.h = hash then 'file and hash' when n is not null then 'hash differs' when b is not null then 'hash' else 'none' end as how from k""",
)
def fu5(spark, sf):
    return U.apply_revisions(run(spark, sf, RECORDS, "customer"), run(spark, sf, REVISIONS, "customer"))


@query("fu6_merge_dictionary", "select p_name as key, max(p_size) as value, false as added from part where p_partkey % 2 = 0 group by 1 union all select p_name, max(p_size), true from part where p_name not in (select p_name from part where p_partkey % 2 = 0) group by 1")
def fu6(spark, sf):
    p = table(spark, sf, "part")
    d = lambda x: x.groupBy(F.col("p_name").alias("key")).agg(F.max("p_size").alias("value"))
    return U.merge_dictionary(d(p.where("p_partkey % 2 = 0")), d(p))


CANDIDATES = "select l_partkey as rec_id, l_orderkey * 10 + l_linenumber as cand_id, concat('shop', cast(l_suppkey % 2 as string)) as source, l_linenumber <> 3 as approved, case when l_suppkey % 3 = 0 then 'other title' else '' end as motives, case when l_orderkey % 9 = 0 then 'auxiliar' else 'alta' end as confidence, l_orderkey % 7 <> 0 as has_metadata, l_suppkey % 5 = 0 as isbn_differs, cast(l_discount * 10 as double) as score from {lineitem}"
UNRESOLVED = "select p_partkey as rec_id, case when p_partkey % 2 = 0 then 'bnf' else 'archive' end as source, p_size % 4 as n_found from {part} where p_partkey % 3 = 0"


@query(
    "fu7_rejection_log",
    f"""with c as (select rec_id, source, cand_id, 0 as late, -score as o, concat_ws('; ', case when not approved then case when motives <> '' then motives else 'not approved' end end, case when confidence <> 'alta' then 'confidence ' || confidence end, case when isbn_differs then 'different isbn' end, case when score > 0 and score < 0.72::double then 'low score' end, case when not has_metadata then 'no metadata' end) as reason from ({duck(CANDIDATES)})),
      u as (select * from c where reason <> '' union all select rec_id, source, null, 1, 0.0, cast(n_found as varchar) || ' candidates without a safe choice' from ({duck(UNRESOLVED)}) where n_found > 0), n as (select *, row_number() over (partition by rec_id order by late, source, o, cand_id) as n from u)
      select rec_id, source, cand_id, reason, n from n where n <= 30""",
)
def fu7(spark, sf):
    return U.rejection_log(run(spark, sf, CANDIDATES, "lineitem"), run(spark, sf, UNRESOLVED, "part"))


SOURCES = "select l_partkey as isbn, case l_linenumber % 3 when 0 then 'api' when 1 then 'cbl' else 'bnf' end as source, case when l_orderkey % 2 = 0 then 't' end as title, case when l_orderkey % 3 = 0 then 'a' else '' end as authors, cast(year(l_shipdate) as int) as year, case when l_suppkey % 4 = 0 then cast(l_quantity as int) end as pages from {lineitem}"


@query(
    "fu8_rank_isbn_sources",
    f"""with w as (select isbn, source, case when title is not null and title <> '' then 5 else 0 end + case when authors <> '' then 4 else 0 end + 2 + case when pages is not null then 2 else 0 end + case source when 'cbl' then 3 when 'api' then 1 else 0 end as weight from ({duck(SOURCES)}))
      select isbn, source, weight from (select *, row_number() over (partition by isbn order by weight desc, source) as rn from w) where rn = 1""",
)
def fu8(spark, sf):
    return U.rank_isbn_sources(run(spark, sf, SOURCES, "lineitem"), {"cbl": 3, "api": 1})


STATES = "select o_orderkey as rec_id, o_orderkey % 97 = 0 as discarded, cast(floor(o_totalprice) as bigint) * 2000 as bytes, case o_custkey % 6 when 0 then 'apostila' when 1 then 'artigo' when 2 then 'revista' else 'livro' end as type, cast(o_orderkey % 5 = 0 as int) as n_conflicts, cast(o_orderkey % 3 = 0 as int) as n_pending, o_orderstatus <> 'P' as text_ok from {orders}"


@query(
    "wf1_derive_state",
    f"""with s as (select *, case when discarded then 'descartado' when bytes > 500000000 then 'excecao_tamanho' when type = 'apostila' then 'apostilas' when type = 'artigo' then 'artigos' when type = 'revista' then 'revistas' when n_conflicts > 0 then 'conflito' when n_pending > 0 then 'analisado' else 'pronto' end as state from ({duck(STATES)}))
      select rec_id, state, case when text_ok then state else 'precisa OCR' end as overall from s""",
)
def wf1(spark, sf):
    return W.derive_state(run(spark, sf, STATES, "orders"))


READY = "select o_orderkey as rec_id, concat('h', cast(o_custkey as string)) as hash, case o_custkey % 4 when 0 then 'livro' when 1 then 'documento' when 2 then 'artigo' else 'revista' end as queue, case o_custkey % 5 when 0 then 'livro' when 1 then 'documento' when 2 then 'artigo' when 3 then 'tese' else 'revista' end as type, case o_orderkey % 3 when 0 then 'pronto para cadastro' when 1 then 'pronto para cadastro específico' else 'analisado' end as state, case when o_orderkey % 9 = 0 then '' when o_orderkey % 10 = 0 then repeat('word ', 40) when o_orderkey % 12 = 1 then 'Todos os direitos reservados' when o_orderkey % 12 = 2 then 'Resumo: x' else o_orderpriority end as title, cast(o_orderkey % 5 = 0 as int) as n_conflicts, case o_orderkey % 4 when 0 then 'editora | data de publicacao' when 1 then 'capa' else '' end as pending, o_orderstatus <> 'P' as text_ok from {orders}"
READY_FILES = "select o_orderkey as rec_id, concat('h', cast(o_custkey + cast(o_orderkey % 13 = 0 as int) as string)) as file_hash, cast(floor(o_totalprice) as bigint) * 2000 as bytes, case when o_orderkey % 17 = 0 then 'PK' else '%PDF-' end as signature, case o_orderkey % 7 when 0 then null when 1 then '.bmp' else '.JPG' end as cover from {orders} where o_orderkey % 11 <> 0"
_in_queue = "case queue when 'livro' then type = 'livro' when 'artigo' then type = 'artigo' when 'revista' then type in ('revista', 'periódico', 'boletim', 'jornal') else type in ('documento', 'apostila', 'sermão', 'trecho', 'tese', 'dissertação', 'trabalho acadêmico', 'apresentação', 'opúsculo') end"


@query(
    "qg10_readiness_errors",
    f"""with j as (select *, queue = 'documento' and type in ('documento', 'apostila', 'sermão', 'trecho', 'apresentação', 'opúsculo') as only_title, list_filter(list_transform(string_split(pending, '|'), lambda x: trim(x)), lambda x: x <> '' and not (queue <> 'livro' and x in ('editora', 'data de publicacao'))) as notes from ({duck(READY)}) left join ({duck(READY_FILES)}) using (rec_id)),
      e as (select rec_id, concat_ws('; ', case when not ({_in_queue}) then 'type of another queue' end, case when state <> 'pronto para cadastro' and (queue = 'livro' or state not in ('aguardando cadastro específico', 'pronto para cadastro específico')) then 'not ready for this queue' end, case when not text_ok then 'text not approved' end, case when n_conflicts > 0 and not only_title then 'conflicts' end, case when len(notes) > 0 and not only_title then 'pending' end,
      case when title = '' then 'no title' when title = 'Todos os direitos reservados' then 'title is a rights notice' when length(title) > 240 or len(string_split(trim(title), ' ')) > 32 then 'title too long' when only_title and starts_with(lower(title), 'resumo:') then 'title is a summary' end,
      case when file_hash is null then 'no file' end, case when signature <> '%PDF-' then 'no pdf' end, case when bytes > 500000000 then 'file too large' end, case when file_hash <> hash then 'file changed' end, case when cover is null then 'no cover' when lower(cover) = '.bmp' then 'cover format' end) as errors from j)
      select rec_id, errors, errors = '' as ready from e""",
)
def qg10(spark, sf):
    return W.readiness_errors(run(spark, sf, READY, "orders"), run(spark, sf, READY_FILES, "orders"))


@query("qg10_error_histogram", "with e as (select unnest(string_split(errors, '; ')) as error from qg10) select error, count(*) as n from e where error <> '' group by error".replace("from qg10)", "from (__qg10__))"))
def qg10_histogram(spark, sf):
    return W.error_histogram(qg10(spark, sf))


ORACLE_SQL["qg10_error_histogram"] = ORACLE_SQL["qg10_error_histogram"].replace("__qg10__", ORACLE_SQL["qg10_readiness_errors"])


QUEUE = "select o_orderkey as rec_id, case o_orderkey % 5 when 0 then 'liberado' when 1 then 'erro' else 'aguardando' end as state, concat('i', cast(o_custkey as string)) as isbn from {orders} where o_orderkey % 3 <> 0"
ELIGIBLE = "select o_orderkey as rec_id, concat('i', cast(o_custkey + cast(o_orderkey % 8 = 0 as int) as string)) as isbn, o_orderkey % 1000 as changed_at, o_orderdate as created_at, o_orderpriority as name from {orders} where o_orderkey % 4 <> 0"
JOURNAL = "select event_id % 20000 as rec_id, cast(case cast(floor(value) as int) % 4 when 0 then 500 when 1 then 400 when 2 then 0 else 201 end as int) as http_status, event_id % 1013 as finished_at from {events} where event_type in ('error', 'purchase')"


@query(
    "wf3_reconcile_queue",
    f"""with l as (select rec_id, unnest(max(struct_pack(finished_at := finished_at, http_status := http_status))) from ({duck(JOURNAL)}) group by rec_id), q as (select rec_id, state as old, isbn as old_isbn from ({duck(QUEUE)})),
      j as (select *, case when old is null then 'new' when old = 'liberado' then 'kept' when created_at is null then 'retired' when isbn is distinct from old_isbn then 'reset' when old = 'erro' and (http_status >= 500 or http_status = 0) and changed_at > finished_at then 'reopened' else 'kept' end as change from q full join ({duck(ELIGIBLE)}) e using (rec_id) left join l using (rec_id))
      select rec_id, case when change in ('new', 'reset', 'reopened') then 'aguardando' when change = 'retired' then 'retirado' else old end as state, change, case when change = 'new' then row_number() over (partition by change order by created_at, name, rec_id) end as place from j""",
)
def wf3(spark, sf):
    # the newest attempt of each record, ties by status
    journal = run(spark, sf, JOURNAL, "events").groupBy("rec_id").agg(F.max(F.struct("finished_at", "http_status")).alias("m")).select("rec_id", "m.*")
    return W.reconcile_queue(run(spark, sf, QUEUE, "orders"), run(spark, sf, ELIGIBLE, "orders"), journal)


ATTEMPTS = "select user_id as rec_id, case event_type when 'error' then 400 when 'click' then cast(null as int) else 201 end as http_status, case when event_id % 3 = 0 then 'ISBN obrigatorio' when event_id % 3 = 1 then 'Duplicado' else 'other' end as answer, case when event_id % 4 = 0 then 'bad certificate' else 'timeout' end as local_error from {events}"
ERRORS = "select o_orderkey as rec_id, case when o_orderkey % 2 = 0 then 'erro' else 'pronto' end as state from {orders}"


@query(
    "wf4_reopen_attempts",
    f"""with j as (select rec_id, min(case when http_status = 400 and contains(lower(answer), 'isbn obrigat') then 'withdrawn rule' when http_status is null and contains(lower(local_error), 'certificate') then 'before http' end) as reason from ({duck(ATTEMPTS)}) group by rec_id)
      select rec_id, reason from j join ({duck(ERRORS)}) using (rec_id) where reason is not null and state = 'erro'""",
)
def wf4(spark, sf):
    return W.reopen_attempts(run(spark, sf, ERRORS, "orders"), run(spark, sf, ATTEMPTS, "events"))


#: Outputs of the two reconciliations besides their queues.
@query(
    "wf3_retired",
    f"""select rec_id from ({duck(QUEUE)}) q left join ({duck(ELIGIBLE)}) e using (rec_id) where state <> 'liberado' and created_at is null""",
)
def wf3_retired(spark, sf):
    return V.retired(wf3(spark, sf))


@query(
    "wf3_archived_attempts",
    f"""with l as (select rec_id, unnest(max(struct_pack(finished_at := finished_at, http_status := http_status))) from ({duck(JOURNAL)}) group by rec_id), q as (select rec_id, state as old, isbn as old_isbn from ({duck(QUEUE)})),
      j as (select rec_id, case when isbn is distinct from old_isbn then 'reset' when old = 'erro' and (http_status >= 500 or http_status = 0) and changed_at > finished_at then 'reopened' end as archived_for from q join ({duck(ELIGIBLE)}) e using (rec_id) left join l using (rec_id) where old <> 'liberado' and created_at is not null)
      select rec_id, http_status, finished_at, archived_for from ({duck(JOURNAL)}) join j using (rec_id) where archived_for is not null""",
)
def wf3_archived(spark, sf):
    return V.archived_attempts(wf3(spark, sf), run(spark, sf, JOURNAL, "events")).select("rec_id", "http_status", "finished_at", "archived_for")


@query(
    "wf4_archived_attempts",
    f"""with j as (select rec_id, min(case when http_status = 400 and contains(lower(answer), 'isbn obrigat') then 'withdrawn rule' when http_status is null and contains(lower(local_error), 'certificate') then 'before http' end) as reason from ({duck(ATTEMPTS)}) group by rec_id)
      select rec_id, http_status, answer, local_error, reason as archived_for from ({duck(ATTEMPTS)}) join j using (rec_id) join ({duck(ERRORS)}) using (rec_id) where reason is not null and state = 'erro'""",
)
def wf4_archived(spark, sf):
    attempts = run(spark, sf, ATTEMPTS, "events")
    return V.archived_attempts(W.reopen_attempts(run(spark, sf, ERRORS, "orders"), attempts), attempts, "reason", ())


SYNC_Q = "select o_orderkey as rec_id, case when o_orderkey % 3 = 0 then 'enviado' else 'erro' end as state, case when o_orderkey % 3 = 0 then o_custkey end as remote_id from {orders} where o_orderkey % 2 = 0"
SYNC_C = "select o_orderkey as rec_id, case when o_orderkey % 6 = 0 then 'cadastrado' else 'pronto' end as state, case when o_orderkey % 12 = 0 then o_custkey end as remote_id from {orders}"


@query(
    "wf5_sync_catalogue",
    f"""with q as (select rec_id, case when state = 'enviado' then 'cadastrado' else state end as qs, remote_id as qi from ({duck(SYNC_Q)})), j as (select c.rec_id, coalesce(qs, state) as ns, coalesce(qi, remote_id) as ni, state, remote_id from ({duck(SYNC_C)}) c left join q using (rec_id))
      select rec_id, ns as state, ni as remote_id, ns is distinct from state or ni is distinct from remote_id as changed from j""",
)
def wf5(spark, sf):
    return W.sync_catalogue(run(spark, sf, SYNC_Q, "orders"), run(spark, sf, SYNC_C, "orders"))


SENT_NAMES = {"title": "titulo", "house": "editor", "size": "paginas", "note": "abstract"}
CHANGES = "select p_partkey as rec_id, p_name as title, case when p_partkey % 6 = 0 then '' else p_brand end as house, cast(p_size as string) as size, cast(null as string) as note, p_partkey % 50 as generated_at from {part}"
_json = lambda size: "'{' || concat_ws(',', case when house <> '' then '\"editor\":\"' || house || '\"' end, '\"paginas\":\"' || " + size + " || '\"', '\"titulo\":\"' || title || '\"') || '}'"


@query(
    "wf6_record_changes",
    f"""with r as (select *, sha256({_json("size")}) as signature, sha256({_json("cast(cast(size as int) + cast(rec_id % 4 = 0 as int) as varchar)")}) as sent from ({duck(CHANGES)}))
      select rec_id, signature, case when rec_id % 3 = 0 then true when rec_id % 5 = 0 then generated_at > 25 else signature <> sent end as changed from r""",
)
def wf6(spark, sf):
    """A third was never sent, a fifth of the others has an old attempt without signature."""
    p = run(spark, sf, CHANGES, "part")
    old = p.where("rec_id % 3 <> 0").withColumn("size", F.expr("cast(cast(size as int) + cast(rec_id % 4 = 0 as int) as string)"))
    none = spark.createDataFrame([], "rec_id long, signature string, finished_at long")
    journal = W.record_changes(old, none, SENT_NAMES).select("rec_id", F.expr("if(rec_id % 5 = 0, null, signature)").alias("signature"), F.lit(25).cast("long").alias("finished_at"))
    return W.record_changes(p, journal, SENT_NAMES)


PLAN = "select o_orderpriority as queue, cast(substr(o_orderpriority, 1, 1) as int) as ord, o_orderkey % 7 = 0 as uncertain from {orders}"


@query(
    "wf7_plan_dispatch",
    f"""with q as (select queue, ord, count(*) filter (not uncertain) as available, count(*) filter (uncertain) as uncertain from ({duck(PLAN)}) group by all)
      select *, cast(greatest(0, least(available, 6000 - coalesce(sum(available) over (order by ord rows between unbounded preceding and 1 preceding), 0))) as bigint) as selected from q""",
)
def wf7(spark, sf):
    return W.plan_dispatch(run(spark, sf, PLAN, "orders"), 6000)


UNSURE = "select o_orderkey as rec_id, o_custkey as isbn, o_orderstatus = 'O' as unknown_result from {orders}"
LOOKUP = "select o_orderkey as rec_id, o_custkey + o_orderkey % 2 as isbn, cast(o_orderkey % 4 as int) as n_exact from {orders} where o_orderkey % 5 <> 0"


@query(
    "wf8_uncertain_attempts",
    f"select rec_id, case when j.isbn = l.isbn or n_exact = 1 then 'confirmed' when n_exact = 0 then 'cleared' else 'left' end as outcome from ({duck(UNSURE)}) j left join ({duck(LOOKUP)}) l using (rec_id) where unknown_result",
)
def wf8(spark, sf):
    return W.uncertain_attempts(run(spark, sf, UNSURE, "orders"), run(spark, sf, LOOKUP, "orders"))


REJECTED = "select user_id as rec_id, event_id, case event_type when 'error' then 400 when 'click' then 503 else 201 end as http_status, case event_id % 5 when 0 then 'ISBN obrigatório' when 1 then 'Registo duplicado' when 2 then 'Título já existe' end as answer from {events}"
_code = "case when contains(lower(coalesce(answer, '')), 'isbn') and contains(lower(coalesce(answer, '')), 'obrigat') then 'isbn required' when contains(lower(coalesce(answer, '')), 'existe') or contains(lower(coalesce(answer, '')), 'duplic') then 'duplicate' when http_status >= 500 then 'server error' else 'validation' end"
_action = "case code when 'isbn required' then 'allow records without isbn' when 'duplicate' then 'link to record' when 'server error' then 'retry later' else 'correct record' end"
REASONS = "select c_custkey as rec_id, c_name as title, case when c_custkey % 2 = 0 then 'sem ISBN próprio' else 'não localizado' end as isbn_reason, c_custkey % 9 = 0 as registered from {customer}"


@query("wf9_rejection_report", f"with c as (select rec_id, {_code} as code from ({duck(REJECTED)}) where http_status >= 400) select code, {_action} as action, count(*) as n, count(distinct rec_id) as n_records from c group by code")
def wf9(spark, sf):
    return W.rejection_report(run(spark, sf, REJECTED, "events"))


@query(
    "wf9_rejection_cases",
    f"""with c as (select *, {_code} as code, row_number() over (partition by rec_id order by event_id desc) as rn from ({duck(REJECTED)})), k as (select c.*, title, isbn_reason from c join ({duck(REASONS)}) using (rec_id) where rn = 1 and http_status >= 400 and not registered)
      select rec_id, title, code, {_action} as action, case code when 'isbn required' then case when isbn_reason = 'sem ISBN próprio' then 'edition without isbn' else 'isbn not found yet' end when 'duplicate' then 'already registered' when 'server error' then 'server failed' else coalesce(nullif(answer, ''), 'no message') end as diagnosis,
        case code when 'isbn required' then 'after a change of the rule' when 'duplicate' then 'never' when 'server error' then 'after a check' else 'after correction' end as resend from k""",
)
def wf9_cases(spark, sf):
    return W.rejection_cases(run(spark, sf, REJECTED, "events"), run(spark, sf, REASONS, "customer"))


AUDIT = "select concat('f', cast(case when c_custkey % 10 = 0 then c_custkey + 100000 else c_custkey end as string)) as file, case when c_custkey % 7 = 0 then '' when c_custkey % 5 = 0 then 'old' else concat('h', cast(c_custkey as string)) end as hash, case when c_custkey % 3 = 0 then c_name else 'x' end as title, case when c_custkey % 8 = 0 then c_mktsegment end as city from {customer} where c_custkey % 4 <> 0"
AUDIT_REC = "select concat('f', cast(c_custkey as string)) as file, concat('h', cast(c_custkey as string)) as hash, case when c_custkey % 9 = 0 then 'new' else concat('h', cast(c_custkey as string)) end as file_hash, case when c_custkey % 11 = 0 then 'cadastrado' else 'analisado' end as state, c_name as title, c_mktsegment as city from {customer}"
LANDING = "select concat('f', cast(c_custkey + 100000 as string)) as file, case when c_custkey % 20 = 0 then 'other' else concat('h', cast(c_custkey as string)) end as hash from {customer} where c_custkey % 30 <> 0 and c_custkey % 10 = 0"
AUDITED = f"""v as ({duck(AUDIT)}), r as ({duck(AUDIT_REC)}), n as (select v.*, coalesce(rh.file, rf.file) as r_file, coalesce(rh.file_hash, rf.file_hash) as r_hash, coalesce(rh.state, rf.state) as r_state, coalesce(rh.title, rf.title) as r_title, coalesce(rh.city, rf.city) as r_city, l.hash as l_hash from v left join r rh on v.hash <> '' and rh.hash = v.hash left join r rf on rf.file = v.file left join ({duck(LANDING)}) l on l.file = v.file),
  df as (select *, r_file is not null and r_state <> 'cadastrado' as live, title is not null and title <> r_title as dt, city is not null and city <> r_city as dc from n)"""


@query(
    "wf10_audit_revisions",
    f"""with {AUDITED} select file, unnest(list_filter([case when r_file is null then case when l_hash is null then 'orphan' when hash = '' then 'no hash' when l_hash = hash then 'awaiting' else 'hash changed' end when r_state = 'cadastrado' then case when hash <> '' and hash <> r_hash then 'closed notice' else 'closed' end when hash = '' then 'no hash' when hash <> r_hash then 'hash changed' end,
      case when live and (dt or dc) then 'diverging' end, case when live and hash <> '' and hash = r_hash and not (dt or dc) then 'ok' end], lambda x: x is not null)) as bucket from df""",
)
def wf10(spark, sf):
    return W.audit_revisions(run(spark, sf, AUDIT, "customer"), run(spark, sf, AUDIT_REC, "customer"), run(spark, sf, LANDING, "customer"), ["title", "city"])[0]


@query("wf10_audit_differences", f"with {AUDITED} select file, 'title' as field, title as revised, r_title as recorded from df where live and dt union all select file, 'city', city, r_city from df where live and dc")
def wf10_differences(spark, sf):
    return W.audit_revisions(run(spark, sf, AUDIT, "customer"), run(spark, sf, AUDIT_REC, "customer"), run(spark, sf, LANDING, "customer"), ["title", "city"])[1]


@query("wf11_orphan_files", "select concat('p', cast(p_partkey as string)) as path, p_size as bytes from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_orderkey % 9 = 0)")
def wf11(spark, sf):
    files = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("bytes"))
    return W.orphan_files(files, table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_orderkey % 9 = 0").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path")))


RELEASE = "select o_orderkey as rec_id, case o_custkey % 5 when 0 then 'cadastrado' when 1 then 'duplicado' when 2 then 'descartado' else 'pronto' end as state, cast(floor(o_totalprice) as bigint) as bytes from {orders}"
RELEASE_C = "select o_orderkey as rec_id, case when o_orderkey % 2 = 0 then o_custkey end as remote_id, o_orderkey % 9 = 0 as linked from {orders} where o_orderkey % 4 <> 3"


@query(
    "wf12_release_candidates",
    f"""with j as (select rec_id, bytes, case when state = 'cadastrado' and remote_id is not null then 'registered' when state = 'duplicado' then 'duplicate' when coalesce(linked, false) then 'linked' when state = 'descartado' then 'discarded' when state = 'cadastrado' then 'blocked' end as reason from ({duck(RELEASE)}) left join ({duck(RELEASE_C)}) using (rec_id))
      select reason, count(distinct rec_id) as n, cast(sum(bytes) as bigint) as bytes from j where reason is not null group by reason""",
)
def wf12(spark, sf):
    return W.release_candidates(run(spark, sf, RELEASE, "orders"), run(spark, sf, RELEASE_C, "orders"))


DONE = "select o_orderkey as hash, 1 as version, case when o_orderkey % 7 = 0 then '' else 't' end as title from {orders} where o_orderkey % 3 <> 0"


@query(
    "wf13_needs_processing",
    f"""with i as (select o_orderkey as rec_id, o_orderkey as hash, 1 + o_orderkey % 2 as version, o_custkey as processed_at from orders), d as (select hash, version from ({duck(DONE)}) where title <> '')
      select rec_id from i where (hash, version) not in (select (hash, version) from d) union select rec_id from i where hash % 10 = 0 and 500 > processed_at""",
)
def wf13(spark, sf):
    i = table(spark, sf, "orders").selectExpr("o_orderkey rec_id", "o_orderkey hash", "1 + o_orderkey % 2 version", "o_custkey processed_at")
    return W.needs_processing(i, run(spark, sf, DONE, "orders"), i.where("hash % 10 = 0").selectExpr("hash", "500L revised_at"))


SEARCH = "select p_partkey as rec_id, concat('f', cast(p_partkey as string)) as file, case p_partkey % 4 when 0 then 'analisado' when 1 then 'conflito' else 'pronto' end as state, case when p_partkey % 5 = 0 then 'artigo' else 'livro' end as type, case when p_partkey % 6 = 0 then 'eng' else 'por' end as language, case when p_partkey % 3 = 0 then '' else p_name end as card_title, case when p_partkey % 7 = 0 then 'de a' else p_type end as cover_title, case when p_partkey % 2 = 0 then '12' else p_brand end as card_author, p_brand as author from {part}"
SEARCHED = "select concat('f', cast(p_partkey as string)) as file, 'shop' as engine, 2 + p_partkey % 2 as version from {part} where p_partkey % 9 = 0"


@query(
    "wf13_search_targets",
    f"""with t as (select *, coalesce(nullif(card_title, ''), case when cover_title <> 'de a' then cover_title end) as title1, case when card_author <> '12' then card_author else author end as author1 from ({duck(SEARCH)}) where state in ('analisado', 'conflito') and type = 'livro' and language <> 'eng')
      select rec_id, file, title1 as title, author1 as author from t where title1 is not null and file not in (select file from ({duck(SEARCHED)}) where version = 2) order by lower(file) limit 200""",
)
def wf13_targets(spark, sf):
    return W.search_targets(run(spark, sf, SEARCH, "part"), run(spark, sf, SEARCHED, "part"), engine="shop", version=2, titles=["card_title", "cover_title"], authors=["card_author", "author"], skip_languages=("eng",), most=200)


FOUND = "select c_custkey % 900 as hash, case when c_custkey % 3 = 0 then cast(null as string) else 'pronto' end as state from {customer}"
HELD = "select c_custkey as hash, case when c_custkey % 2 = 0 then 'cadastrado' else 'analisado' end as state from {customer} where c_custkey % 4 <> 0"


@query(
    "wf16_register_existing",
    f"""with f as (select hash, min(state) as fs from ({duck(FOUND)}) group by hash) select coalesce(f.hash, c.hash) as hash, case when c.hash is null then coalesce(fs, 'legado registrado') when state = 'cadastrado' then state else coalesce(fs, state) end as state, c.hash is null as is_new from f full join ({duck(HELD)}) c on f.hash = c.hash""",
)
def wf16(spark, sf):
    return W.register_existing(run(spark, sf, FOUND, "customer"), run(spark, sf, HELD, "customer"))


@query(
    "wf17_revision_history",
    """with b as (select p_partkey as hash, p_name as title, p_brand as author from part), a as (select hash, case when hash % 3 = 0 then upper(title) else title end as title, case when hash % 4 = 0 then null else author end as author from b),
      x as (select hash, 'title' as field, b.title as old, a.title as new from b join a using (hash) union all select hash, 'author', b.author, a.author from b join a using (hash)) select * from x where old is distinct from new""",
)
def wf17(spark, sf):
    b = table(spark, sf, "part").selectExpr("p_partkey hash", "p_name title", "p_brand author")
    a = b.selectExpr("hash", "if(hash % 3 = 0, upper(title), title) title", "if(hash % 4 = 0, null, author) author")
    return W.revision_history(b, a, ["title", "author"])


MANIFEST = "select concat('u', cast(user_id as string)) as record_url, case event_type when 'error' then 'error' when 'view' then 'existing' else 'downloaded' end as status, event_id as updated_at, cast(floor(value) as bigint) as bytes from {events} where event_id % 2 = "


@query(
    "src9_merge_manifest",
    f"""with b as (select *, 0 as side from ({duck(MANIFEST + '0')}) union all select *, 1 from ({duck(MANIFEST + '1')})), m as (select *, row_number() over (partition by record_url order by side desc, updated_at desc, status) as rn from b) select record_url, status, updated_at, bytes from m where rn = 1""",
)
def src9(spark, sf):
    from recordspark.sources.pages import merge_manifest

    return merge_manifest(run(spark, sf, MANIFEST + "0", "events"), run(spark, sf, MANIFEST + "1", "events"))


@query(
    "src9_manifest_totals",
    f"""with b as (select *, 0 as side from ({duck(MANIFEST + '0')}) union all select *, 1 from ({duck(MANIFEST + '1')})), m as (select *, row_number() over (partition by record_url order by side desc, updated_at desc, status) as rn from b) select status, count(*) as n, cast(sum(bytes) as bigint) as bytes from m where rn = 1 group by status""",
)
def src9_totals(spark, sf):
    from recordspark.sources.pages import manifest_totals

    return manifest_totals(src9(spark, sf))


@query("st2_journal_state", "select user_id as rec_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) as state, count(*) as n_attempts from events group by user_id")
def st2(spark, sf):
    from recordspark.streaming.journal import journal_state

    return journal_state(table(spark, sf, "events").selectExpr("user_id rec_id", "event_type state", "ts", "event_id"))
