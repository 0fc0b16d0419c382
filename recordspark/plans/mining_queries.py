"""Language, topics, articles and issues over documents, suppliers and orders."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from recordspark.operators import classify as C
from recordspark.operators import generic as D
from recordspark.operators import mining as M
from recordspark.plans.registry import query, run, table
from recordspark.plans.text_queries import PAGES, doc_pages

#: The library's profiles and German, which the given texts have.
PROFILES = M.LANGUAGE_WORDS | {"ger": "und der die das nicht mit von ein eine".split()}
_values = ", ".join(f"({k}, '{lang}', '{w}')" for k, (lang, ws) in enumerate(PROFILES.items()) for w in ws)
LANG_DOCS = "select doc_id, lang, concat(text, case doc_id % 9 when 0 then ' All rights reserved. Published by X, published by Y' when 1 then ' Tous droits réservés' else '' end) as text from {documents}"
LANGUAGE = f"""ld as ({LANG_DOCS.replace("{documents}", "documents")}), lw as (select * from (values {_values}) as t(rank, detected, word)),
  dw as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) as word from ld),
  ph as (select doc_id, rank, detected, len(list_filter(range(1, len(ws) - len(pw) + 2), lambda i: ws[i : i + len(pw) - 1] = pw)) as hits from (select doc_id, ' ' || lower(coalesce(text, '')) || ' ' as low, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_ ]+') as parts from ld) x,
    (select rank, detected, word, string_split(word, ' ') as pw from lw where contains(word, ' ')) y, (select 1) z, lateral (select string_split(array_to_string(parts, ' | '), ' ') as ws)),
  dn as (select doc_id, rank, detected, sum(hits) as hits from (select doc_id, rank, detected, count(*) as hits from dw join lw using (word) group by all union all select doc_id, rank, detected, hits from ph where hits > 0) group by all),
  dl as (select ld.doc_id, lang, coalesce(detected, '') as detected, cast(coalesce(hits, 0) as bigint) as hits from ld left join (select *, row_number() over (partition by doc_id order by hits desc, rank) as rn from dn) x on x.doc_id = ld.doc_id and rn = 1)"""


@query("mi1_detect_language", f"with {LANGUAGE} select doc_id, detected, hits from dl")
def mi1(spark, sf):
    return M.detect_language(run(spark, sf, LANG_DOCS, "documents"), PROFILES)


@query("mi1_language_confusion", f"with {LANGUAGE} select lang, detected, count(*) as n from dl group by all")
def mi1_confusion(spark, sf):
    d = run(spark, sf, LANG_DOCS, "documents")
    return M.language_confusion(M.detect_language(d, PROFILES), d.select("doc_id", "lang"))


#: Frequent fragments of the texts as keywords.
TAXONOMY = "select * from (values ('rivers', 'tion'), ('rivers', 'ation'), ('hills', 'heit'), ('hills', 'keit'), ('coasts', 'ment'), ('coasts', 'eaux'), ('plains', 'ción'), ('plains', 'mente'), ('woods', 'ble'), ('woods', 'ing')) as t(topic, keyword)"
DECISIONS = "select * from (values ('rivers', 'build bridges'), ('hills', 'plant vines'), ('coasts', 'keep lights'), ('woods', 'cut paths')) as t(topic, decision)"


CAUTIONS = "select * from (values ('rivers', 1, 'check numbers', false), ('coasts', 2, 'no advice', true), ('coasts', 3, 'ask outside', false), ('woods', 1, 'check numbers', false)) as t(topic, ord, caution, careful)"


def topics_sql(rows: str, keys: str, k: int) -> str:
    return f"""tx as ({TAXONOMY}), tn as (select {keys}, topic, sum((length(low) - length(replace(low, keyword, ''))) // length(keyword)) as score from (select {keys}, lower(coalesce(text, '')) as low from {rows}) join tx on contains(low, keyword) group by all),
      tr as (select *, row_number() over (partition by {keys} order by score desc, topic desc) as rank from tn),
      tp as (select {keys}, topic, cast(score as bigint) as score, rank from tr where rank <= {k} union all select {keys}, '{M.DEFAULT_TOPIC}', 0, 1 from {rows} where ({keys}) not in (select ({keys}) from tn))"""


@query("mi2_topic_scores", f"with {topics_sql('documents', 'doc_id', 3)} select doc_id, topic, score, rank from tp")
def mi2(spark, sf):
    return M.topic_scores(table(spark, sf, "documents"), spark.sql(TAXONOMY), 3)


#: Issues: each document's pages, with a title line and a byline on every third page.
BYLINES = """select doc_id as issue_id, page_no, case when (page_no + doc_id) % 3 = 0 then concat('The Story Of ', cast((doc_id * 7 + page_no) % 12 as string), ' Rivers', chr(10), 'short', chr(10), 'By Ann Supplier', cast((doc_id + page_no) % 20 as string), chr(10), text) else text end as text from {pg}"""
_raw = BYLINES.replace("{pg}", "pg")
ARTICLES = f"""{PAGES}, bp as ({_raw}), nx as (select *, lead(text) over (partition by issue_id order by page_no) as next from bp),
  ls as (select issue_id, page_no, concat_ws(chr(10), text, next) as body, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:45] as ls from nx),
  bl as (select *, i - 1 as p from (select *, unnest(range(1, len(ls) + 1)) as i from ls) where lower(ls[i]) like 'by %'),
  au as (select issue_id, page_no, p as i, body, trim(substr(ls[p + 1], 4)) as author,
    list_reverse(list_filter(ls[greatest(p - 4, 1) : p], lambda x: length(x) between 4 and 90 and not lower(x) like 'by %' and regexp_matches(x, '\\p{{L}}{{3}}')))[1] as title from bl),
  ok as (select *, row_number() over (partition by issue_id, lower(title), lower(author) order by page_no, i) as rn from au where title is not null and regexp_matches(author, '{M.AUTHOR_RULE.replace("'", "''")}')),
  nb as (select *, count(*) over (partition by issue_id) as n, row_number() over (partition by issue_id order by page_no, i) - 1 as position from ok where rn = 1),
  ar as (select issue_id, page_no, position, title, author, body from nb where n <= 9 or position <= 2 or position = n // 2 or position >= n - 4)"""
TOPICS = topics_sql("(select distinct issue_id, page_no, body as text from ar)", "issue_id, page_no", 3)


def articles(spark, sf):
    return M.segment_articles(spark.sql(BYLINES, pg=doc_pages(spark, sf)))


def article_topics(spark, found):
    return M.topic_scores(found.select("issue_id", "page_no", "body").distinct(), spark.sql(TAXONOMY), 3, keys=("issue_id", "page_no"), text="body")


@query("mi3_segment_articles", f"with {ARTICLES} select issue_id, page_no, position, title, author, md5(body) as body from ar")
def mi3(spark, sf):
    return articles(spark, sf).withColumn("body", F.md5("body"))


def _ordered(rows: str, value: str, most: int, name: str) -> str:
    return f"(select issue_id, string_agg({value}, '; ' order by rn) as {name} from (select *, row_number() over (partition by issue_id order by p, r, {value}) as rn from (select issue_id, {value}, min(struct_pack(p := page_no, r := rank)).p as p, min(struct_pack(p := page_no, r := rank)).r as r from {rows} group by issue_id, {value})) where rn <= {most} group by issue_id)"


@query(
    "mi4_issue_summary",
    f"""with {ARTICLES}, {TOPICS}, dc as ({DECISIONS}), dt as (select issue_id, decision, page_no, rank from tp join dc using (topic)), wh as (select issue_id, author, page_no, position as rank from ar),
      ca as (select issue_id, string_agg(caution, '; ' order by ord, caution) as cautions, bool_or(careful) as careful from (select issue_id, ord, caution, bool_or(careful) as careful from (select distinct issue_id, topic from tp) join ({CAUTIONS}) using (topic) group by all) group by 1)
      select issue_id, n_articles, topics, decisions, authors, coalesce(cautions, '') as cautions, case when careful then 'high, with caution' else 'high' end as potential from (select issue_id, count(*) as n_articles from ar group by 1)
      left join {_ordered("tp", "topic", 8, "topics")} using (issue_id) left join {_ordered("dt", "decision", 7, "decisions")} using (issue_id) left join {_ordered("wh", "author", 8, "authors")} using (issue_id) left join ca using (issue_id)""",
)
def mi4(spark, sf):
    found = articles(spark, sf)
    return M.issue_summary(found, article_topics(spark, found), spark.sql(DECISIONS), spark.sql(CAUTIONS))


@query(
    "mi5_author_topics",
    f"""with {ARTICLES}, {TOPICS}, f as (select author, topic, min(struct_pack(a := issue_id, b := page_no, c := rank)) as spot from ar join tp using (issue_id, page_no) group by all),
      r as (select *, row_number() over (partition by author order by spot, topic) as rn from f), g as (select author, string_agg(topic, '; ' order by rn) as topics, arg_min(topic, rn) as topic from r where rn <= 4 group by author)
      select author, topics, coalesce(decision, '{M.DEFAULT_DECISION}') as decision from g left join ({DECISIONS}) using (topic)""",
)
def mi5(spark, sf):
    found = articles(spark, sf)
    return M.author_topics(found, article_topics(spark, found), spark.sql(DECISIONS))


@query(
    "mi6_topic_index",
    f"""with {ARTICLES}, {TOPICS}, t as (select issue_id, position, author, topic from ar join tp using (issue_id, page_no)), r as (select distinct * from (select 'topic' as kind, topic as term, issue_id, position, author from t union all select 'decision', decision, issue_id, position, author from t join ({DECISIONS}) using (topic))),
      w as (select kind, term, issue_id, author, min(position) as p from r group by all)
      select kind, term, issue_id, people, n_articles from (select kind, term, issue_id, string_agg(author, '; ' order by p) as people from w group by all) join (select kind, term, issue_id, count(*) as n_articles from r group by all) using (kind, term, issue_id)""",
)
def mi6(spark, sf):
    found = articles(spark, sf)
    return M.topic_index(found, article_topics(spark, found), spark.sql(DECISIONS))


@query("mi6_topic_index_totals", f"with {ARTICLES}, {TOPICS} select topic, count(distinct issue_id) as n_issues, count(distinct author) as n_people, count(*) as n_articles from ar join tp using (issue_id, page_no) group by topic")
def mi6_totals(spark, sf):
    found = articles(spark, sf)
    return M.topic_index_totals(found, article_topics(spark, found))


PROGRESS = "select o_orderkey as issue_id, year(o_orderdate) as year, month(o_orderdate) as month, o_orderpriority as name from {orders}"


_STATES = f"select *, case when issue_id % 5 = 0 then 'done' when issue_id % 3 = 0 then 'waiting' else 'no text' end as state from ({PROGRESS.replace('{orders}', 'orders')})"


@query("mi7_mining_progress", f"select issue_id, year, month, name, state from ({_STATES})")
def mi7(spark, sf):
    i = run(spark, sf, PROGRESS, "orders")
    return M.mining_progress(i, i.where("issue_id % 3 = 0"), i.where("issue_id % 5 = 0"))


@query(
    "mi7_progress_totals",
    f"""with p as ({_STATES}) select count(*) filter (state = 'done') as n_done, count(*) filter (state = 'waiting') as n_waiting, count(*) filter (state = 'no text') as n_no_text,
        (max(struct_pack(a := year, b := month, c := name, d := issue_id)) filter (state = 'done')).d as last_done, (min(struct_pack(a := year, b := month, c := name, d := issue_id)) filter (state = 'waiting')).d as next_waiting from p""",
)
def mi7_totals(spark, sf):
    return M.progress_totals(mi7(spark, sf))


#: Texts planted on the first page of documents, one for most rows of the rule table; the others keep their own pages.
_MARKS = ["Manual de Metodologia", "Tese apresentada à faculdade", "Dissertação apresentada", "E-book disponibilizado, totalmente gratuito, faça uma doação", "Professor: Ana, apostila do Professor: Rui", "Voluntários da igreja", "Revista do Aluno, publicação e distribuição, lição 1", "Manual Institucional", "LAB | sessão\nConferência Norte 2019", "Plano de aula apostilado", "Tema: fé\nsermão", "Discente: Ana", "Universidade X\nDocente: Rui", "Faculdade Y, ementa", "imprimir | fechar", "Por Ana Luz | 3 meses atrás", "Revista Z, resumo, volume 3", "Revista Z, ISSN 1234-5678", "Este livro é de uso pessoal; proibida a revenda; consentimento do autor", "12\nA CASA DE ANA LUZ", "com permissão do autor Ana", "Resumo de tudo", "Manual de vida, igreja", "Série de estudos da igreja", "Regimento interno da paróquia", "ISBN 1, Editora: X, manual de fé, igreja", "Aula 1 - a\nAula 2 - b\nAula 3 - c\nAula 4 - d", "Sumário\nUm texto longo ..... 3\nOutro texto longo ..... 7\nMais um texto ..... 9", "este artigo trata de tudo\nResumo: x", "Revista Sol, v. 3, n. 4, 2001\nO presente estudo\nResumo: y", "Acta Nova 12/3 (1999)\nSilva, Ana. A Casa Velha. Porto: Mar\n— Rui Reis", "3\nA casa e o rio\nAna Luz\n1. Introdução\nprofessor da Faculdade Sul", "Caderno Igreja\nmódulo 1", "Article\nhttp://a.org", "Abstract\nISSN 1234-5678\n2001 12(3): 45"]
TYPE_PAGES = "select doc_id, page_no, case when page_no = 1 then concat(case doc_id % 40 " + " ".join(f"when {k} then concat('{m.replace(chr(10), "', chr(10), '")}', chr(10))" for k, m in enumerate(_MARKS)) + " else '' end, text) else text end as text from {pg}"
TYPE_FILES = "select doc_id, case when doc_id % 6 = 0 then 'x_apostila.pdf' when doc_id % 7 = 0 then 'aula 03.pdf' else concat('f', cast(doc_id as string), '.pdf') end as name, case doc_id % 10 when 0 then 'Microsoft PowerPoint' when 1 then 'Microsoft Word' else '' end as producer, case when doc_id % 3 = 0 then 'Acta' end as periodical, doc_id % 20 = 0 as approved, doc_id % 4 = 1 as isbn_confirmed, doc_id % 2 = 1 as external, cast(doc_id % 100 as int) as n_pages from {documents}"


def _rule_sql(r) -> str:
    q = lambda p: p.replace("'", "''")
    tests = [f"regexp_matches({s}, '{q(p)}')" for s, p in r.all_of] + [f"not regexp_matches({s}, '{q(p)}')" for s, p in r.none_of] + [f"len(regexp_extract_all({s}, '{q(p)}')) >= {n}" for s, p, n in r.counts]
    tests += [f"n_text between {r.pages[0]} and {r.pages[1]}"] if r.pages else []
    tests += [f"short_share >= {r.short_share}::double"] if r.short_share else []
    return " and ".join(tests)


_SCOPE = lambda c: f"coalesce(string_agg(text, chr(10) order by page_no) filter ({c}), '')"
TYPE_SCOPES = f"""{PAGES}, tp as ({TYPE_PAGES.replace("{pg}", "pg")}), tn as (select *, max(page_no) over (partition by doc_id) as n from tp),
  ts as (select doc_id, count(*) filter (trim(text) <> '') as n_text, coalesce(count(*) filter (trim(text) <> '' and length(regexp_replace(trim(text), '\\s+', ' ', 'g')) < 700) / nullif(count(*) filter (trim(text) <> ''), 0), 0.0) as short_share, {_SCOPE("page_no <= 1")} as page1, {_SCOPE("page_no <= 3")} as first3, {_SCOPE("page_no <= 10")} as first10, {_SCOPE("page_no <= 12")} as first12, {_SCOPE("page_no > n - 3")} as last3 from tn group by doc_id)"""


#: The classes of words again, written out.
_LETTERS = "este esta presente this present:d artigo ensaio estudo article essay study paper:a objetivo aim:o resumo abstract:r texto:T tema proposito:t sermao predicacao mensaje:s dissertacao dissertation:D tese thesis:E monografia:M apresentada apresentado submitted presented:p conclusao:F curso:g obtencao:G titulo grau:l discente:q disciplina docente:u faculdade universidade:c seminario instituto:C doutor professor:k vol volume ano:v n no numero issue:i revista journal:j issn:I introducao:n by por:b imprimir:A fechar:B minuto minutos hora horas dia dias semana semanas mes meses anos:U atras:K lab:L conferencia:f plano:e aula:m apostilado:H ensino:y caderno:w igreja:z modulo discipulado aulas:Q unidade:W tematica:J ementa:S"
_CASES = " ".join(f"when t in ({', '.join(repr(w) for w in ws.split())}) then '{c}'" for ws, c in re.findall(r"([a-z ]+):(.)", _LETTERS))


def _classes(scope: str) -> str:
    """Lines of a scope as letters of classes."""
    one = f"case {_CASES} when regexp_full_match(t, '[ivxlcdm]{{2,}}') then 'R' when regexp_matches(t, '^[a-z]') then 'x' when regexp_full_match(t, '(19|20)[0-9]{{2}}') then 'Y' when regexp_matches(t, '^[0-9]') then case when length(t) <= 3 then 'N' else 'P' end when t in ('-', '–', '—') then 'h' when t in (':', '.', ',', '(', ')', '|', '/') then t else '~' end"
    return f"array_to_string(list_transform(string_split({scope}, chr(10)), lambda x: array_to_string(list_transform(regexp_extract_all(x, '[a-z]+|[0-9]+|[^a-z0-9\\s]'), lambda t: {one}), '')), chr(10))"


@query(
    "mi8_classify_document",
    f"""with {TYPE_SCOPES}, tf as ({TYPE_FILES.replace("{documents}", "documents")}), sc as (select doc_id, n_text, short_share, {", ".join(f"strip_accents(lower({c})) as {c}" for c in ("page1", "first3", "first10", "first12", "last3"))}, strip_accents(lower(substr(first10, 1, 2500))) as head, strip_accents(lower(first3 || chr(10) || last3)) as edges, lower(name) as name, lower(producer) as producer, lower(coalesce(periodical, '')) as periodical, approved, isbn_confirmed, external, n_pages from ts join tf using (doc_id)),
      cs as (select *, {", ".join(f"{_classes(x)} as {x}_c" for x in ("page1", "first3", "first10"))} from sc),
      rl as (select *, case {" ".join(f"when {_rule_sql(r)} then {k}" for k, r in enumerate(C.TYPE_RULES))} else -1 end as k from cs),
      ty as (select *, case when k < 0 then 'livro' else [{", ".join(f"'{r.type}'" for r in C.TYPE_RULES)}][k + 1] end as found, case when k >= 0 then [{", ".join(str(r.number) for r in C.TYPE_RULES)}][k + 1] end as rule from rl),
      fo as (select *, case when not approved and contains(producer, 'powerpoint') then 'apresentação' when not approved and found = 'documento' and rule in (23, 24) and isbn_confirmed and external and n_pages >= 40 then 'livro' end as forced_type from ty)
      select doc_id, coalesce(forced_type, found) as type, rule, forced_type is not null as forced from fo""",
)
def mi8(spark, sf):
    return C.classify_document(spark.sql(TYPE_PAGES, pg=doc_pages(spark, sf)), run(spark, sf, TYPE_FILES, "documents"))


#: Addresses, dates, labels and marks planted on the first page of documents, and file names.
_NOTES = ["Título: Estudo da casa\nAutor: Ana Luz\nhttp://a.org/2011/casa.", "Fonte: www.b.org/um,www.b.org/dois", "Publicado em 3/4/2015\nPor: Rui Reis", "12 de março de 2009\nwww.c.org", "Editora: Mar\nhttp://d.org", "Questionário da turma", "curso de grego", "Autor: Eva Sol", "veja http://e.org/lon-\ngo/1999/x)", "© Ana\nFonte: livro"]
GENERIC_PAGES = "select doc_id, page_no, case when page_no = 1 then concat(case doc_id % 14 " + " ".join(f"when {k} then concat('{m.replace(chr(10), "', chr(10), '")}', chr(10))" for k, m in enumerate(_NOTES)) + " else '' end, text) else text end as text from {pg}"
GENERIC_FILES = "select doc_id, case doc_id % 9 when 0 then concat('Apostila ', cast(doc_id as string), '.doc') when 1 then 'resumo-geral.v2.pdf' when 2 then cast(null as string) else concat('f_', cast(doc_id as string), '.pdf') end as name, doc_id % 5 = 0 as word from {documents}"


@query(
    "mi8_generic_documents",
    f"""with {PAGES}, gp as ({GENERIC_PAGES.replace("{pg}", "pg")}), gn as (select *, max(page_no) over (partition by doc_id) as n from gp),
      gs as (select doc_id, {_SCOPE("page_no <= 1")} as page1, {_SCOPE("page_no <= 3")} as first3, {_SCOPE("page_no <= 10")} as first10, {_SCOPE("page_no > n - 3")} as last3 from gn group by doc_id),
      gf as ({GENERIC_FILES.replace("{documents}", "documents").replace("cast(doc_id as string)", "cast(doc_id as varchar)")}),
      g0 as (select doc_id, page1, first3, first10, last3, first3 || chr(10) || last3 as edges, strip_accents(lower(regexp_replace(coalesce(name, ''), '\\.[^.]*$', ''))) as stem, word from gs join gf using (doc_id)),
      g1 as (select *, strip_accents(lower(edges)) as low, trim(regexp_extract(edges, '(?im)^[ \\t]*(?:autora?|author|por)[ \\t]*:[ \\t]*([^\\n]{{3,120}})$', 1)) as author, trim(regexp_extract(page1, '(?im)^[ \\t]*(?:t[ií]tulo|title)[ \\t]*:[ \\t]*([^\\n]{{3,120}})$', 1)) as labelled,
          list_filter(list_transform(string_split(page1, chr(10)), lambda x: trim(x)), lambda x: length(x) between 4 and 120 and regexp_matches(x, '\\p{{L}}') and not regexp_matches(lower(x), '^(http://|https://|www[.])') and not regexp_matches(x, '^[^\\s:]+[ \\t]*:')) as lines,
          list_transform(regexp_extract_all(regexp_replace(regexp_replace(edges, '([\\p{{L}}0-9_])-[ \\t]*\\n\\s*([\\p{{L}}0-9_])', '\\1-\\2', 'g'), ',(http://|https://|www[.])', ' \\1', 'gi'), '(?i)(?:http://|https://|www[.])[^\\s<>()]+'), lambda u: rtrim(u, '.,;:)]}}')) as found from g0),
      g2 as (select *, list_filter(found, lambda u, i: list_position(found, u) = i) as urls, case when labelled <> '' then labelled else coalesce(lines[1], '') end as title from g1),
      g3 as (select *, coalesce(nullif(regexp_extract(low, 'publicado\\s+em\\s+[0-9][0-9]?/[0-9][0-9]?/((19|20)[0-9][0-9])', 1), ''), nullif(regexp_extract(strip_accents(lower(first3)), '(?m)^[ \\t]*[0-9][0-9]? de (?:janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro) de ((19|20)[0-9][0-9])[ \\t]*$', 1), ''), nullif(regexp_extract(coalesce(urls[1], ''), '/((19|20)[0-9][0-9])/', 1), ''), '') as year,
          list_has_any(regexp_extract_all(stem || ' ' || strip_accents(lower(title)), '[a-z0-9]+'), ['resumo', 'questionario']) as bad, strip_accents(lower(first10 || chr(10) || last3)) as body from g2),
      g4 as (select *, regexp_matches(body, '\\b(isbn|copyright|tradutor)\\b') or contains(body, '©') or contains(body, '℗') or regexp_matches(body, 'dados (internacionais )?de catalogacao|ficha catalografica') or regexp_matches(body, '(editora|publisher|publicado por)\\s*:') as published,
          regexp_matches(low, '\\b(fonte|autor)\\s*:') or regexp_matches(low, 'publicado em [0-9]') or regexp_matches(low, 'blogspot[.]|geocities[.]|artigos?_print[.]php') or regexp_matches(low, '\\bcurso de\\b') as marked from g3)
      select doc_id, case when bad then 'arquivo inválido' when list_contains(regexp_extract_all(stem, '[a-z0-9]+'), 'apostila') then 'apostila' else 'documento' end as kind, title, case when bad then '' else author end as author, year, array_to_string(urls, ' ') as sources,
        case when bad then 'descarte' when author <> '' and (len(urls) > 0 or year <> '') then 'alta' when len(urls) > 0 or author <> '' then 'media' else 'baixa' end as confidence
      from g4 where bad or (not published and title <> '' and (word or len(urls) > 0 or marked))""",
)
def mi8_generic(spark, sf):
    return D.generic_documents(spark.sql(GENERIC_PAGES, pg=doc_pages(spark, sf)), run(spark, sf, GENERIC_FILES, "documents"))


#: Documents with planted words of several kinds of material.
SIGNAL_DOCS = "select doc_id, concat(text, case doc_id % 8 when 0 then ' ISBN 12, copyright' when 1 then ' Revista X, resumo e palavras-chave, 10.1234/abc, ISSN 1234-5678' when 2 then ' Tese, orientador' when 3 then ' plano de aula, Lição 4' when 4 then ' sermão' when 5 then ' doi 10.5555/x.y references' else '' end) as text, case doc_id % 5 when 0 then 'livro' when 1 then 'documento' when 2 then 'revista' when 3 then 'artigo' end as type, case when doc_id % 3 = 0 then '978' end as isbn, cast(doc_id % 150 as int) as n_pages from {documents}"


@query(
    "mi9_type_signals",
    f"""with d as (select doc_id, coalesce(type, 'livro') as type, isbn, n_pages, strip_accents(lower(coalesce(text, ''))) as t from ({SIGNAL_DOCS.replace("{documents}", "documents")})),
      s0 as (select *, list_filter([{", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in M.TYPE_SIGNALS)}], lambda x: x is not null) as s1, list_filter([{", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in M.ACADEMIC_SIGNALS)}], lambda x: x is not null) as a from d),
      s as (select *, case when len(s1) = 0 and isbn <> '' then ['livro'] else s1 end as s from s0), j as (select *, array_to_string(s, '; ') as joined, list_contains(a, 'doi') and len(a) >= 2 and n_pages <= 100 as package from s)
      select doc_id, joined as signals, concat_ws('; ', case when type = 'livro' and regexp_matches(joined, 'documento|artigo|tese') then 'book with signs of other material' end, case when type in ('documento', 'apostila') and list_contains(s, 'livro') then 'document with signs of a published book' end, case when type = 'revista' and contains(joined, 'artigo') then 'whole issue or single article' end) as contradictions,
        array_to_string(a, '; ') as academic, type = 'artigo' or package or (type in ('documento', 'apostila') and len(a) >= 3) as consult, package as becomes_article from j""",
)
def mi9(spark, sf):
    return signals_of(spark, table(spark, sf, "documents"))


def signals_of(spark, docs):
    """Rows of mi9, of the documents given."""
    return M.type_signals(spark.sql(SIGNAL_DOCS, documents=docs))


FILES = "select o_orderkey as file_id, case when o_orderkey % 11 = 0 then concat('Herald_', cast(o_orderkey as string)) else concat('Herald-', cast(year(o_orderdate) as string), '-', lpad(cast(o_custkey % 14 as string), 2, '0'), case when o_orderkey % 7 = 0 then '-06' else '' end, case when o_orderkey % 3 = 0 then concat('-v', cast(o_orderkey % 50 as string)) else '' end, case when o_orderkey % 5 = 0 then '-n4' else '' end, '.pdf') end as name, cast(o_orderkey % 90 as int) as n_pages, cast(o_orderkey % 1000 as int) as n_words from {orders}"
EDITORS = "select * from (values (1, 1992, 1993, 'Ana Luz'), (2, 1993, 1995, 'Rui Reis')) as t(ord, first_year, last_year, holder)"
_ISSUES = f"""f as (select file_id, n_pages, n_words, nullif(regexp_extract(name, '^([A-Za-z]+)-', 1), '') as series, cast(nullif(regexp_extract(name, '-((?:1[5-9]|20)[0-9]{{2}})-', 1), '') as int) as year, cast(nullif(regexp_extract(name, '-[0-9]{{4}}-([0-9]{{2}})', 1), '') as int) as month, nullif(regexp_extract(name, '-[0-9]{{4}}-[0-9]{{2}}-([0-9]{{2}})(?:-|\\.|$)', 1), '') as m2, cast(nullif(regexp_extract(name, '-v([0-9]+)', 1), '') as int) as given, nullif(regexp_extract(name, '-n([0-9]+)', 1), '') as number from ({FILES.replace("{orders}", "orders")})),
  s as (select *, case when series is null or year is null or month is null then 'no pattern' when month not between 1 and 12 then 'invalid' when n_words < 50 then 'too little text' else '' end as skip, coalesce(given, year - 1952) as volume, case when year between 1992 and 1993 then 'Ana Luz' when year between 1994 and 1995 then 'Rui Reis' end as editor, printf('%02d', month) || coalesce('/' || m2, '') as months from f),
  ir as (select file_id, case when skip = '' then series || '-' || year || '-' || printf('%02d', month) || coalesce('-' || m2, '') end as code, case when skip = '' then series || ', ' || months || '/' || year end as title, case when skip = '' then printf('%02d', month) || '/' || year end as date, month, year, volume, given is null as estimated, case when skip = '' then coalesce(editor, 'Society') end as author,
    case when skip = '' then concat_ws(' ', 'v.' || volume || case when given is null then ' (estimated)' else '' end, months || '/' || year, 'n.' || number, case when n_pages > 0 then n_pages || ' p.' end, 'Editor: ' || editor || '.') end as notes, skip from s)"""


@query("mi10_issue_records", f"with {_ISSUES} select * from ir")
def mi10(spark, sf):
    return M.issue_records(run(spark, sf, FILES, "orders"), spark.sql(EDITORS), "Society")


@query("mi10_skip_counts", f"with {_ISSUES} select skip, count(*) as n from ir where skip <> '' group by skip")
def mi10_skips(spark, sf):
    return M.skip_counts(mi10(spark, sf))
