"""Review jobs over parts, suppliers, line items, orders, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.functions.tables import new_path, written
from recordspark.operators import alerts as A
from recordspark.operators import extract as X
from recordspark.operators import review as R
from recordspark.plans.extract_queries import reviewed_pages
from recordspark.plans.linkage_queries import NORM
from recordspark.plans.mining_queries import signals_of
from recordspark.plans.registry import ORACLE_SQL, query, run, table
from recordspark.plans.workflow_queries import duck
from recordspark.sources.pages import catalogue_report, explode_lines, labelled_fields

LISTING = "select page_id, concat('ISBN: ', cast(9780000000000 + page_id as string), chr(10), case when page_id % 2 = 0 then concat('Publisher: House ', cast(page_id % 9 as string), chr(10)) else '' end, 'Year: ', cast(1990 + page_id % 30 as string), case when page_id % 3 = 0 then concat(chr(10), 'Pages: ', cast(page_id as string)) else '' end) as text from {pages}"
SPEC = {"isbn": r"(?im)^ISBN:\s*([0-9Xx-]+)", "publisher": r"(?im)^Publisher:\s*(.+)$", "year": r"(?im)^Year:\s*([0-9]{4})", "pages": r"(?im)^Pages:\s*([0-9]+)"}


@query("src6_labelled_fields", "select * from (" + " union all ".join(f"select page_id, '{k}' as field, trim(regexp_extract(text, '{p}', 1)) as value from ({duck(LISTING)})" for k, p in SPEC.items()) + ") where value <> ''")
def src6(spark, sf):
    return labelled_fields(run(spark, sf, LISTING, "pages"), SPEC)


@query("src8_catalogue_report", "select case o_orderstatus when 'F' then 'cadastrado' when 'O' then 'pronto' else 'analisado' end as state, concat('f', cast(o_orderkey as string)) as file, o_custkey as bytes from orders")
def src8(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "cadastrado").when(F.col("o_orderstatus") == "O", "pronto").otherwise("analisado")
    return catalogue_report(table(spark, sf, "orders").select(state.alias("state"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), F.col("o_custkey").alias("bytes")))


#: First lines of documents as titles, some replaced by what scanners and catalogues leave there.
_BAD_TITLES = ["concat(title, ' Dados de Catalogação')", "'Image Evaluation Test Target'", "'Assunto: Teologia'", "'miolo_final.indd'", "'Apresentação do PowerPoint'", "'1998'", "'Aula nº 12'", "'Ana Lima CRB-8 123'", "'Todos os direitos reservados'", "'Clique aqui agora'", "'a b c d e'", "'B CASA DE ANA LUZ'", "'x # # #'", "'Quando a casa foi feita por todos os que nela moravam'", "'uma casa de campo que foi feita por eles'", "concat('Livro de ', author, ' II')", "concat(title, ' the of')"]
ALERT_RECORDS = "select doc_id as rec_id, case doc_id % 40 " + " ".join(f"when {k} then {t}" for k, t in enumerate(_BAD_TITLES)) + " else title end as title, case doc_id % 23 when 0 then 'Ana 2' when 1 then 'por: Rui' when 2 then 'Ana Luz (org.)' when 3 then 'Rui explores the city' when 4 then 'Livro Digital' when 5 then 'What? Ana' else author end as author, case doc_id % 9 when 0 then author when 1 then 'Casa $ Nova' when 2 then 'traduzido por Ana' when 3 then 'Instituto Ana Luz' else source end as publisher from (select doc_id, source, split_part(text, chr(10), 1) as title, concat('Ana Luz ', upper(lang)) as author from {documents})"
_n = {c: NORM.format(x=c) for c in ("title", "author", "publisher")}
_lst = lambda ws: ", ".join(f"'{w}'" for w in ws)
_has = lambda n, k: f"regexp_matches(' ' || {n} || ' ', ' ({A.PHRASES[k]}) ')"
_low = "strip_accents(lower({}))".format
_tok = lambda c, least, out=(): f"list_distinct(list_filter(regexp_extract_all(strip_accents(lower({c})), '[a-z0-9]+'), lambda w: length(w) > {least}" + (f" and w not in ({_lst(out)})" if out else "") + "))"
_RULES = [
    ("card text", _has("nt", "card text")), ("digitisation page", _has("nt", "digitisation page")), ("label", f"regexp_matches({_low('title')}, '^\\s*(categoria|assunto|classificacao)\\s*:')"), ("layout file", f"regexp_matches({_low('title')}, '\\.(indd|p65|docx?|pdf)\\b')"),
    ("application default", f"regexp_full_match(nt, '{A.APPLICATION}')"), ("odd signs", "contains(title, '$') or contains(title, '*')"), ("only a year", "regexp_full_match(title, '\\s*(19|20)[0-9]{2}\\s*')"), ("lesson number", "regexp_full_match(nt, '(aula|estudo|licao|classe) ?(n |no )?[0-9]{1,3}')"), ("cataloguer", f"regexp_matches({_low('title')}, '\\bcrb\\s*[-–]?\\s*[0-9]')"),
    ("rights notice", _has("nt", "rights notice")), ("promotion", _has("nt", "promotion") + f" or regexp_matches(nt, '^({A.PROMOTION_STARTS})( |$)')"), ("paragraph", "sz > 35 or length(title) > 240"), ("cut off", f"sz >= 8 and split_part(nt, ' ', -1) in ({_lst(A.CONNECTIVES)})"),
    ("ocr pieces", f"len(list_filter(string_split(nt, ' '), lambda w: regexp_full_match(w, '[a-z]') and w not in ({_lst(A.LONE_LETTERS)}))) >= 2"), ("lone letter first", "regexp_matches(title, '^\\s*[B-DF-HJ-NP-Z]\\s+\\p{Lu}') and sz >= 5"), ("series list", "length(title) - length(replace(title, '#', '')) >= 3 or " + _has("nt", "series list")),
    ("sentence", f"sz >= 10 and regexp_matches(nt, '^({A.SENTENCE_STARTS})( |$)')"), ("continued", "regexp_matches(title, '^\\p{Ll}') and sz >= 7"), ("cover text", "sz >= 12 and " + _has("nt", "cover text")), ("author in title", "len(an) > 0 and len(list_intersect(an, tn)) = len(an)"),
    ("author is a fragment", f"regexp_matches({_low('author')}, '(^|,\\s*)(por|de|do|da|organizacao|coordenacao)\\s*:?\\s+') or len(list_intersect(string_split(na, ' '), [{_lst(A.NO_AUTHOR)}])) > 0"), ("author implausible", "author <> '' and (length(na) < 5 or regexp_matches(author, '[0-9]'))"), ("author sentence", "len(list_filter(string_split_regex(trim(author), '\\s+'), lambda w: w <> '')) > 8 or " + _has("na", "author sentence")),
    ("author lead-in", _has("na", "author lead-in")), ("author punctuation", "regexp_matches(author, '[?:]')"), ("author is a title or house", "regexp_matches(author, '[()]') or " + _has("na", "author is a title or house")),
    ("publisher odd signs", "contains(publisher, '$') or contains(publisher, '*')"), ("publisher sentence", _has("np_", "publisher sentence")), ("publisher is author", "len(al) >= 2 and publisher <> '' and not " + _has("np_", "institution") + " and (len(list_intersect(al, pl)) = len(al) or len(list_intersect(al, pl)) = len(pl))"),
]
ALERTS = f"""ar as (select *, {_n['title']} as nt, {_n['author']} as na, {_n['publisher']} as np_, len(list_filter(string_split_regex(trim(title), '\\s+'), lambda w: w <> '')) as sz, {_tok('author', 1, A.NAME_FILLERS)} as an, {_tok('title', 1, A.NAME_FILLERS)} as tn, {_tok('author', 2)} as al, {_tok('publisher', 2)} as pl from ({duck(ALERT_RECORDS)})),
  al as (select rec_id, concat_ws('; ', {', '.join(f"case when {c} then '{n}' end" for n, c in _RULES)}) as alerts from ar)"""


@query("qg9_plausibility_alerts", f"with {ALERTS} select rec_id, alerts from al")
def qg9(spark, sf):
    return A.plausibility_alerts(run(spark, sf, ALERT_RECORDS, "documents"))


@query("qg9_alert_profile", f"with {ALERTS} select alert, count(*) as n from (select unnest(string_split(alerts, '; ')) as alert from al) where alert <> '' group by alert")
def qg9_profile(spark, sf):
    return A.alert_profile(A.plausibility_alerts(run(spark, sf, ALERT_RECORDS, "documents")))


TYPED = "select p_partkey as rec_id, case when p_partkey % 3 = 0 then 'artigo' else 'livro' end as type, case p_partkey % 5 when 0 then 'ISBN a confirmar | falta a editora' when 1 then 'ano ilegível' else '' end as pending from {part}"
REQUIRED = "select * from (values ('livro', 'isbn'), ('livro', 'year'), ('livro', 'publisher'), ('artigo', 'doi'), ('artigo', 'year')) as t(type, field)"
ALIASES = "select * from (values ('isbn', 'isbn'), ('year', 'ano'), ('year', 'data'), ('publisher', 'editora'), ('publisher', 'publisher'), ('doi', 'doi')) as t(field, alias)"
HAVE = "select p_partkey as rec_id, case p_size % 3 when 0 then 'isbn' when 1 then 'year' else 'doi' end as field from {part}"
REJECT = "select l_partkey as rec_id, concat('s', cast(l_suppkey % 4 as string)) as source, case when l_linenumber = 1 then '' else l_linestatus end as reason from {lineitem} where l_partkey % 4 <> 1"


@query(
    "qg11_missing_field_causes",
    f"""with n as (select rec_id, field from ({duck(TYPED)}) join ({REQUIRED}) using (type)), m as (select * from n where (rec_id, field) not in (select (rec_id, field) from ({duck(HAVE)}))),
      p as (select rec_id, trim(unnest(string_split(pending, '|'))) as note from ({duck(TYPED)})), d as (select rec_id, field, string_agg(distinct note, '; ' order by note) as named from m join p using (rec_id) join ({ALIASES}) using (field) where note <> '' and contains(lower(note), alias) group by all),
      r as (select *, row_number() over (partition by rec_id order by source, reason) as rn from (select distinct * from ({duck(REJECT)}) where reason <> '')), w as (select rec_id, string_agg(source || ': ' || reason, '; ' order by rn) as why from r where rn <= 5 group by all)
      select rec_id, field, coalesce(named, why, 'no cause recorded') as causes from m left join d using (rec_id, field) left join w using (rec_id)""",
)
def qg11(spark, sf):
    return causes_of(spark, sf)


def causes_of(spark, sf, own=lambda rows: rows):
    """Rows of qg11, of the items that own() leaves."""
    return R.missing_field_causes(own(run(spark, sf, TYPED, "part")), spark.sql(REQUIRED), spark.sql(ALIASES), own(run(spark, sf, HAVE, "part")), own(run(spark, sf, REJECT, "lineitem")))


CONSULTED = "select l_partkey as rec_id, concat('s', cast(l_suppkey % 4 as string)) as source, l_quantity > 40 as found from {lineitem}"


@query("qg11_source_outcomes", f"select rec_id, source, case when bool_or(found) then 'ok' else 'no result' end as outcome, count(*) filter (found) as n from ({duck(CONSULTED)}) group by all")
def qg11_outcomes(spark, sf):
    return R.source_outcomes(run(spark, sf, CONSULTED, "lineitem"))


CONVERGE = "select p_partkey as rec_id, case when p_partkey % 5 = 0 then 'artigo' else 'livro' end as type, cast(p_partkey % 7 = 0 as int) as n_conflicts, p_partkey % 11 = 0 as derived, case p_size % 4 when 0 then 'file' when 1 then 'cip' when 2 then 'isbn' else 'cover' end as title_origin, case p_size % 3 when 0 then 'label' when 1 then 'cip' else 'authority' end as author_origin, p_partkey % 4 = 0 as isbn_confirmed, case when p_partkey % 2 = 0 then '' else p_brand end as publisher, case when p_partkey % 3 = 0 then '' else cast(1990 + p_size as string) end as year from {part}"


@query(
    "qg12_convergence",
    f"""with r as (select *, case when type <> 'livro' then 'not a book' when n_conflicts > 0 then 'conflict' when derived then 'derived copy' when title_origin not in ('cip', 'isbn', 'cover') then 'weak title' when author_origin not in ('cip', 'isbn', 'authority') then 'weak author' when not (isbn_confirmed or publisher <> '' or regexp_matches(year, '^(1[5-9]|20)[0-9]{{2}}$')) then 'no support' else 'ok' end as reason from ({duck(CONVERGE)}))
      select rec_id, reason = 'ok' as converged, reason, case when reason = 'ok' and year = '' then '[s.d.]' else year end as year, case when reason = 'ok' and publisher = '' then '[s.n.]' else publisher end as publisher from r""",
)
def qg12(spark, sf):
    return R.convergence(run(spark, sf, CONVERGE, "part"))


PERIODICALS = "select * from (values ('Thematic Echo', 'of the and', '1234-5678'), ('Nation Review', 'review', '2222-3333'), ('La Revista', 'de la', '9999-000X'), ('Herald', 'herald', cast(null as string))) as t(periodical, alias, issn)"
ISSN_DOCS = "select doc_id, concat(case doc_id % 7 when 1 then concat('Herald', chr(10)) when 2 then concat('Review vol. 3', chr(10)) when 3 then concat('Herald of dawn', chr(10)) when 4 then concat('x', chr(10), 'HERALD março 1990', chr(10)) else '' end, text, case when doc_id % 13 = 0 then concat(chr(10), 'ISSN 2222 3333') when doc_id % 13 = 1 then concat(chr(10), '9999-000x') else '' end) as text from {documents}"


@query(
    "lk14_identify_periodical",
    f"""with d as (select doc_id, coalesce(text, '') as t from ({duck(ISSN_DOCS)})), k as (select periodical, {NORM.format(x="alias")} as a, upper(replace(coalesce(issn, ''), '-', '')) as issn from ({PERIODICALS})),
      i as (select doc_id, replace(replace(unnest(regexp_extract_all(upper(t), '[0-9]{{4}}[ -]?[0-9]{{3}}[0-9X]')), '-', ''), ' ', '') as issn from d),
      l as (select doc_id, j - 1 as pos, {NORM.format(x="ls[j]")} as n from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as j from (select doc_id, string_split(t, chr(10)) as ls from d))), w as (select doc_id, {NORM.format(x="t")} as n from d),
      e as (select doc_id, -1 as spot, periodical from i join k using (issn) where issn <> '' union all select doc_id, pos * 1000, periodical from l join k on not contains(a, ' ') and a <> '' and (n = a or regexp_matches(n, '^' || a || ' {R.AFTER_NAME}( |$)'))
        union all select doc_id, instr(' ' || n || ' ', ' ' || a || ' ') - 1, periodical from w join k on contains(a, ' ') and contains(' ' || n || ' ', ' ' || a || ' '))
      select doc_id, arg_min(periodical, struct_pack(a := spot, b := periodical)) as periodical from e group by doc_id""",
)
def lk14(spark, sf):
    return R.identify_periodical(run(spark, sf, ISSN_DOCS, "documents"), spark.sql(PERIODICALS))


CREDITS = "select p_partkey as rec_id, concat(case p_partkey % 6 when 0 then 'Ana Brand' when 1 then 'rui de souza' when 2 then 'J R TOLMAN Junior' when 3 then 'Igreja Nova' when 4 then 'mcdonald, bob' else 'Rui' end, case when p_partkey % 6 = 0 then cast(p_partkey % 30 as string) else '' end, case when p_partkey % 4 = 0 then '; ' else ' and ' end, concat('Lia Costa', cast(p_size % 9 as string))) as author, case p_partkey % 7 when 0 then concat('x', chr(10), 'Edited by Lia Costa', cast(p_size % 9 as string)) when 1 then 'Tradução: Rui Souza' when 2 then 'Tolman (organizador)' when 3 then 'Foreword by Ana Nobody' end as credits from {part}"
AUTHORITY = "select concat('Brand', cast(s_suppkey % 60 as string), ', Ana') as authority from {supplier}"
_key = "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(strip_accents(lower({x})), '[a-z0-9]+'), lambda w: w not in ('da', 'das', 'de', 'del', 'do', 'dos', 'e', 'van', 'von')))), ' ')"


@query(
    "lk15_link_author_authority",
    f"""with c as ({duck(CREDITS)}), p as (select rec_id, credits, cast(i - 1 as int) as position, trim(ps[i], ' ,;') as raw from (select *, unnest(range(1, len(ps) + 1)) as i from (select *, string_split_regex(author, '(?i)\\s*;\\s*| (?:&|e|y|and) ') as ps from c)) where trim(ps[i], ' ,;') <> ''),
      k as (select {_key.format(x="authority")} as key, min(authority) as authority from ({duck(AUTHORITY)}) group by 1),
      j as (select p.*, authority, case when regexp_matches(credits, '^x\\nEdited by') and raw like 'Lia Costa%' then 'Editor' when credits = 'Tradução: Rui Souza' and raw in ('rui de souza', 'Rui') then 'Tradutor' when credits like 'Tolman%' and raw like '%TOLMAN%' then 'Organizador' end as role from p left join k on {_key.format(x="raw")} = key and contains(raw, ' ')),
      l as (select *, bool_or(role in ('Editor', 'Organizador')) over (partition by rec_id) as led from j)
      select rec_id, position, case when authority is not null then authority when raw like 'Lia Costa%' then replace(raw, 'Lia ', '') || ', Lia' when raw like 'Ana Brand%' then replace(raw, 'Ana ', '') || ', Ana' when raw = 'rui de souza' then 'De Souza, Rui' when raw = 'J R TOLMAN Junior' then 'Tolman Junior, J. R.' when raw = 'mcdonald, bob' then 'McDonald, Bob' else raw end as name,
        case when authority is not null then 'authority' when raw = 'Igreja Nova' then 'institution' when contains(raw, ' ') then 'rule' else 'unmatched' end as how, coalesce(role, case when coalesce(led, false) then 'Colaborador' else 'Autor' end) as role from l""",
)
def lk15(spark, sf):
    return R.link_author_authority(run(spark, sf, CREDITS, "part"), run(spark, sf, AUTHORITY, "supplier"))


ROUTE = "select o_orderkey as rec_id, case o_custkey % 5 when 0 then 'apostila' when 1 then 'artigo' when 2 then 'revista' else 'livro' end as type, concat('Title ', cast(o_custkey as string)) as title, cast(o_orderkey % 3 = 0 as int) as n_errors from {orders}"
ROUTED = "select o_orderkey as rec_id, case when o_orderkey % 2 = 0 then 'liberado' else 'pronto' end as state from {orders} where o_orderkey % 5 = 0"
HELD = "select concat('title ', cast(c_custkey as string)) as title from {customer} where c_custkey % 6 = 0"


@query(
    "wf2_route_queues",
    f"""with r as (select *, case type when 'apostila' then 'apostilas' when 'artigo' then 'artigos' else 'revistas' end as queue, case type when 'apostila' then 'handout' when 'artigo' then 'article' else 'issue' end as kind, lower(title) as key from ({duck(ROUTE)}) where type <> 'livro')
      select rec_id, queue, kind, case when p.state in ('cadastrado', 'liberado', 'duplicado') then p.state when h.title is not null then 'cadastrado' when n_errors > 0 then 'aguardando correcao' else 'pronto' end as state from r left join ({duck(ROUTED)}) p using (rec_id) left join (select distinct title from ({duck(HELD)})) h on h.title = key""",
)
def wf2(spark, sf):
    return R.route_queues(run(spark, sf, ROUTE, "orders"), run(spark, sf, ROUTED, "orders"), run(spark, sf, HELD, "customer"))


GAPS = "select l_partkey as rec_id, case l_linenumber % 4 when 0 then 'isbn' when 1 then 'year' when 2 then 'place' else 'pages' end as field from {lineitem} where l_linenumber % 2 = "
OPEN = "select p_partkey as rec_id, p_size % 3 <> 0 as open from {part}"


@query(
    "wf14_review_packets",
    f"""with g as (select rec_id, count(*) as n_gaps, string_agg(field, ', ' order by field) as gaps from ({duck(GAPS + '0')}) group by 1), c as (select rec_id, string_agg(distinct field, ', ' order by field) as conflicts from ({duck(GAPS + '1')}) where rec_id % 2 = 0 group by 1)
      select rec_id, coalesce(n_gaps, 0) as n_gaps, coalesce(gaps, '') as gaps, coalesce(conflicts, '') as conflicts, case when conflicts is not null then 'decide' when n_gaps > 0 then 'complete' else 'approve' end as action from ({duck(OPEN)}) left join g using (rec_id) left join c using (rec_id) where open order by coalesce(n_gaps, 0) desc, rec_id limit 100""",
)
def wf14(spark, sf):
    return R.review_packets(run(spark, sf, OPEN, "part"), run(spark, sf, GAPS + "0", "lineitem"), run(spark, sf, GAPS + "1", "lineitem").where("rec_id % 2 = 0"))


@query(
    "wf14_full_packets",
    f"""with qg as ({ORACLE_SQL["qg11_missing_field_causes"]}), ex as ({ORACLE_SQL["ex13_review_pages"]}), mi as ({ORACLE_SQL["mi9_type_signals"]}),
      g as (select rec_id, count(*) as n_gaps, string_agg(field || ': ' || causes, ' | ' order by field || ': ' || causes) as gaps from qg group by 1), c as (select rec_id, string_agg(distinct field, ', ' order by field) as conflicts from ({duck(GAPS + '1')}) where rec_id % 2 = 0 group by 1),
      p as (select doc_id as rec_id, string_agg(cast(page_no as varchar), ', ' order by page_no) as pages from (select distinct doc_id, page_no from ex) group by 1), m as (select doc_id as rec_id, string_agg(distinct contradictions, '; ' order by contradictions) as contradictions from mi where contradictions <> '' group by 1),
      t as (select rec_id, coalesce(n_gaps, 0) as n_gaps, coalesce(gaps, '') as gaps, coalesce(conflicts, '') as conflicts from ({duck(OPEN)}) left join g using (rec_id) left join c using (rec_id) where open order by coalesce(n_gaps, 0) desc, rec_id limit 100)
      select rec_id, n_gaps, gaps, conflicts, coalesce(pages, '') as pages, coalesce(contradictions, '') as contradictions, case when conflicts <> '' then 'decide' when n_gaps > 0 then 'complete' when contradictions is not null then 'check type' else 'approve' end as action from t left join p using (rec_id) left join m using (rec_id)""",
)
def wf14_full(spark, sf):
    records, conflicts = run(spark, sf, OPEN, "part"), run(spark, sf, GAPS + "1", "lineitem").where("rec_id % 2 = 0")
    # the items are chosen once, and only their texts are parted into pages and searched
    chosen = written(R.review_packets(records, qg11(spark, sf), conflicts), new_path(spark, "packets"))
    own = lambda rows, key="rec_id": rows.join(F.broadcast(chosen.select(F.col("rec_id").alias(key))), key, "left_semi")
    # a table of their texts: filters on what is found in them would else be tested below the join, on every text
    docs = written(own(table(spark, sf, "documents", deal=False), "doc_id"), new_path(spark, "packet-texts"))
    pages = X.marked_pages(reviewed_pages(spark, sf, docs)).select(F.col("doc_id").alias("rec_id"), "page_no")
    against = signals_of(spark, docs).select(F.col("doc_id").alias("rec_id"), "contradictions")
    return R.full_packets(records, causes_of(spark, sf, own), conflicts, pages, against, chosen=chosen)


CATALOGUE = "select c_custkey as rec_id, concat('f', cast(c_custkey as string)) as file, case c_custkey % 5 when 0 then 'cadastrado' when 1 then 'analisado' when 2 then 'duplicado' else 'pronto' end as state, c_name as title, c_mktsegment as city from {customer}"
REVISED = "select concat('f', cast(c_custkey as string)) as file, c_custkey % 4 <> 0 as approved, case when c_custkey % 3 = 0 then 'new' else c_name end as title, case when c_custkey % 7 = 0 then cast(null as string) else c_mktsegment end as city from {customer} where c_custkey % 2 = 0"


@query(
    "wf15_reprocess_targets",
    f"""with j as (select c.rec_id, case when c.state in ('analisado', 'conflito', 'precisa OCR') then 'open' when c.state <> 'cadastrado' and r.approved and (c.title is distinct from r.title or c.city is distinct from r.city) then 'revised' end as why from ({duck(CATALOGUE)}) c left join (select * from ({duck(REVISED)}) where approved) r using (file) where c.state <> 'duplicado')
      select distinct rec_id, why from j where why is not null""",
)
def wf15(spark, sf):
    return R.reprocess_targets(run(spark, sf, CATALOGUE, "customer"), run(spark, sf, REVISED, "customer"), ["title", "city"])
