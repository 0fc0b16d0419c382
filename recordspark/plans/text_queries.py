"""Page, line and quality jobs over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.operators import quality as Q
from recordspark.plans.registry import query, run, table
from recordspark.sources import pages as P

#: Every five lines are a page.
PAGES = "pg as (select doc_id, p + 1 as page_no, array_to_string(ls[p * 5 + 1 : p * 5 + 5], chr(10)) as text from (select doc_id, ls, unnest(range(0, (len(ls) - 1) // 5 + 1)) as p from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)))"

TOKENS = f"""{PAGES}, tk as (
  select doc_id, page_no, text, regexp_extract_all(text, '\\S+') as tok from pg
), cd as (
  select doc_id, page_no, tok, list_filter(tok, lambda p: length(p) > 2 and regexp_matches(p, '\\p{{L}}')) as cand from tk
), qn as (
  select doc_id, page_no, len(tok) as n_tokens, len(cand) as n_candidates,
    len(list_filter(list_transform(cand, lambda p: lower(regexp_replace(p, '^[.,;:()\\[\\]«»"'']+|[.,;:()\\[\\]«»"'']+$', '', 'g'))),
      lambda s: length(s) >= 3 and length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) / length(s) > 0.7
        and regexp_matches(s, '[aeiouáàâãéêíóôõúü]') and not regexp_matches(s, '[bcdfghjklmnpqrstvwxyz]{{5}}'))) as n_good,
    len(list_filter(tok, lambda p: regexp_matches(p, '^\\p{{L}}{{1,2}}$'))) as n_short
  from cd
), qs as (
  select *, case when n_tokens >= 40 and n_candidates >= 20
    then greatest(0.0::double, n_good::double / n_candidates - greatest(0.0::double, n_short::double / n_tokens - 0.22::double)) else 0.0::double end as score
  from qn
)"""

#: Lines are told apart by pieces: the number at the end and what stands before it, link marks, the two sides of a reference.
CLASSES = f"""{TOKENS}, ln as (
  select doc_id, page_no, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from pg
), dash as (
  select *, list_transform(lines, lambda x: regexp_extract(x, '[0-9]+[A-Za-z]?$')) as nums from ln
), lead as (
  select *, list_transform(range(1, len(lines) + 1), lambda i: lines[i][1 : length(lines[i]) - length(nums[i])]) as heads,
    list_transform(lines, lambda x: regexp_split_to_array(x, '\\[\\s*<<\\s*\\]')) as marks,
    list_transform(lines, lambda x: string_split(regexp_replace(regexp_replace(translate(x, '‐‑‒–—―', '------'), '\\s*([-,])\\s*', '\\1', 'g'), '\\s+', ' ', 'g'), ' ')) as sides
  from dash
), lc as (
  select doc_id, page_no, text, len(lines) as n_lines, length(regexp_replace(text, '\\s+', '', 'g')) as n_chars,
    len(regexp_extract_all(text, '\\p{{L}}{{3,}}')) as n_words, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as letters,
    length(text) - length(replace(text, chr(65533), '')) as broken,
    len(list_filter(range(1, len(lines) + 1), lambda i: nums[i] <> '' and ends_with(rtrim(heads[i]), '...'))) as dotted,
    len(list_filter(range(1, len(lines) + 1), lambda i: nums[i] <> '' and (ends_with(rtrim(heads[i]), '...') or length(heads[i]) - length(rtrim(heads[i])) >= 3))) as indexed,
    len(list_filter(marks, lambda m: len(m) > 1 and m[1] <> '' and translate(m[1], '0123456789 .,;:()-‐‑‒–—―' || chr(9), '') = '' and len(list_filter(m[2:], lambda y: trim(y) not in ('', ','))) = 0)) as linked,
    len(list_filter(sides, lambda z: case len(z)
      when 1 then regexp_matches(z[1], '^[0-9]{{1,3}}([:.][0-9]{{1,3}})?[-,]') and len(list_filter(regexp_split_to_array(z[1], '[-,]')[2:], lambda y: not regexp_full_match(y, '[0-9]{{1,4}}(n[0-9]+)?'))) = 0
        and (regexp_matches(z[1], '^[^-,]+-') or regexp_matches(z[1], '^[0-9]+[:.][0-9]+,[0-9]{{1,3}}-'))
      when 2 then regexp_full_match(z[1], '[0-9]{{1,3}}|[0-9]{{1,3}}-[0-9]{{1,3}}|[0-9]{{1,3}}[:.][0-9]{{1,3}}|[0-9]{{1,3}}[:.][0-9]{{1,3}}[-,][0-9]{{1,3}}') and len(list_filter(regexp_split_to_array(z[2], '[-,]'), lambda y: not regexp_full_match(y, '[0-9]{{1,4}}(n[0-9]+)?'))) = 0
      else false end)) as referred,
    len(list_filter(lines, lambda x: lower(x) in ('sumario', 'sumário', 'indice', 'índice'))) > 0 as headed
  from lead
), lf as (
  select *, broken / greatest(1, length(text)) < 0.002 as sound from lc
), lg as (
  select *, n_chars > 0 and letters / greatest(1, n_chars) >= 0.30 and sound as clean,
    n_lines >= 6 and sound and ((linked >= 8 and linked / n_lines >= 0.55) or (dotted >= 4 and dotted / n_lines >= 0.35) or (referred >= 8 and referred / n_lines >= 0.55)) as ix
  from lf
), cl as (
  select doc_id, page_no, n_chars, score, (headed and indexed >= 5 and sound) or ix or (n_words >= 25 and clean) or (n_chars >= 150 and n_words >= 8 and n_lines >= 3 and clean) as legible, ix
  from lg join qs using (doc_id, page_no)
), pc as (
  select doc_id, page_no, n_chars, score, legible,
    case when (n_chars >= 150 or ix) and (score >= 0.78 or legible) then 'texto_bom' when n_chars >= 150 or ix then 'texto_fraco' when n_chars > 0 then 'texto_curto' else 'sem_texto' end as class
  from cl
)"""


def doc_pages(spark, sf):
    return P.lines_as_pages(table(spark, sf, "documents"))


@query("src3_explode_lines", "select doc_id, i as line_no, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as ls from documents))")
def src3(spark, sf):
    return P.explode_lines(table(spark, sf, "documents"))


#: Lines as pages between form feeds, with blank ones.
FED = "select doc_id, replace(replace(text, chr(10), chr(12)), '. ', concat('.', chr(12), ' ', chr(12))) as text from {documents}"


@query("src3_explode_pages", f"select doc_id, false as dropped, i as page_no, ps[i] as text from (select doc_id, ps, unnest(range(1, len(ps) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(12)) as ps from ({FED.replace('{documents}', 'documents')}))) union all select doc_id, true, i, ps[i] from (select doc_id, ps, unnest(range(1, len(ps) + 1)) as i from (select doc_id, list_filter(string_split(coalesce(text, ''), chr(12)), lambda x: trim(x) <> '') as ps from ({FED.replace('{documents}', 'documents')})))")
def src3_pages(spark, sf):
    d = run(spark, sf, FED, "documents")
    every = [P.explode_pages(d, drop_blank=b).select("doc_id", F.lit(b).alias("dropped"), "page_no", "text") for b in (False, True)]
    return every[0].unionAll(every[1])


@query("src4_select_edge_pages", f"with {PAGES} select doc_id, page_no, text from (select *, max(page_no) over (partition by doc_id) as n from pg) where page_no <= 3 or page_no > n - 2")
def src4(spark, sf):
    return P.select_edge_pages(doc_pages(spark, sf), 3, 2)


#: Every seventh page gets a citation title, every fifth a date, every eleventh a PDF address, in several orders and quotes; every third links to records.
META = """select page_id, url, concat(replace(html, '<head>', concat('<head>', case when page_id % 7 = 0 then case when page_id % 2 = 0 then concat('<meta name="citation_title" content="Record ', cast(page_id as string), '">') else concat('<meta content=', chr(39), 'Record ', cast(page_id as string), chr(39), ' name=', chr(39), 'citation_title', chr(39), '>') end else '' end, case when page_id % 5 = 0 then concat('<meta name="citation_date" content="', cast(1950 + page_id % 70 as string), '/03">') else '' end, case when page_id % 11 = 0 then concat('<meta content="/pdf/', cast(page_id as string), '.pdf" name="citation_pdf_url">') else '' end)),
  case when page_id % 3 = 0 then concat('<a href="/rec/', cast(page_id % 40 as string), '">x</a><a href="/rec/7/">y</a><a href=', chr(39), '/rec/', cast(page_id % 9 as string), chr(39), '>z</a><a href="/rec/7/">y</a>') else '' end) as html from {pages}"""
_META = META.replace("{pages}", "pages")
_dq = lambda n: f"coalesce(nullif(regexp_extract(html, '(?is)<meta\\s+name=\"{n}\"\\s+content=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(html, '(?is)<meta\\s+content=\"([^\"]*)\"\\s+name=\"{n}\"', 1), ''), nullif(regexp_extract(html, '(?is)<meta\\s+content=~([^~]*)~\\s+name=~{n}~', 1), ''))".replace("~", "''")


@query(
    "src5_html_record_metadata",
    f"""with m as ({_META}), t as (
      select page_id, coalesce(trim({_dq("citation_title")}), nullif(trim(regexp_extract(html, '(?is)<meta\\s+property="og:title"\\s+content="([^"]*)"', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '')) as title, {_dq("citation_pdf_url")} as pdf_url, nullif(regexp_extract({_dq("citation_date")}, '((?:1[5-9]|20)[0-9]{{2}})', 1), '') as my,
        len(list_distinct(regexp_extract_all(html, 'href=["'']([^"''#]+)["'']', 1))) as n_links from m)
      select page_id, title, pdf_url, cast(coalesce(my, nullif(regexp_extract(title, '\\b((?:1[5-9]|20)[0-9]{{2}})\\b', 1), '')) as int) as year, substr(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9]+', '_', 'g'), 1, 80) as safe_name, n_links from t""",
)
def src5(spark, sf):
    return P.html_record_metadata(run(spark, sf, META, "pages"))


@query(
    "src5_record_links",
    f"""with m as ({_META}), l as (select distinct page_id, unnest(regexp_extract_all(html, 'href=["'']([^"''#?]*[0-9])/?["'']', 1)) as link from m), k as (select *, cast(regexp_extract(link, '([0-9]{{1,18}})$', 1) as bigint) as number from l)
      select page_id, cast(row_number() over (partition by page_id order by number, link) as int) as place, link, number from k""",
)
def src5_links(spark, sf):
    return P.record_links(run(spark, sf, META, "pages"))


@query("qg1_page_quality", f"with {TOKENS} select doc_id, page_no, n_tokens, n_candidates, n_good, n_short, score from qs")
def qg1(spark, sf):
    return Q.page_quality(doc_pages(spark, sf))


@query("qg2_page_class", f"with {CLASSES} select doc_id, page_no, n_chars, score, legible, class from pc")
def qg2(spark, sf):
    return Q.page_class(doc_pages(spark, sf))


@query(
    "qg3_document_quality",
    f"""with {CLASSES}, a as (
      select doc_id, count(*) as n_pages, 0 as n_blank, count(*) filter (class <> 'sem_texto') as n_searchable,
        count(*) filter (class in ('texto_bom', 'texto_fraco')) as n_rated, count(*) filter (class = 'texto_bom') as n_good,
        coalesce(median(case when class in ('texto_bom', 'texto_fraco') then case when legible then greatest(score, 0.78::double) else score end end), 0.0) as median_score,
        coalesce(list(page_no order by page_no) filter (class = 'texto_fraco'), []) as weak_pages, coalesce(list(page_no order by page_no) filter (class = 'texto_curto'), []) as short_pages
      from pc group by doc_id
    ), b as (
      select *, n_searchable / greatest(1, n_pages - n_blank) as coverage, case when n_rated > 0 then (n_rated - n_good) / n_rated else 1.0 end as weak_share from a
    ), c as (
      select *, concat_ws('; ', case when coverage < 0.8 then 'cobertura' end, case when weak_share > 0.05 and not (n_rated >= 10 and n_rated - n_good = 1 and coverage >= 0.95 and median_score >= 0.85) then 'texto fraco' end, case when median_score < 0.78 then 'mediana' end) as reasons from b
    ) select *, case when reasons = '' then 'OCR aprovado' else 'precisa OCR' end as status from c""",
)
def qg3(spark, sf):
    return Q.document_quality(Q.page_class(doc_pages(spark, sf)))


@query("qg4_min_text_gate", "select doc_id, n_words, n_words >= 50 as usable from (select doc_id, len(regexp_extract_all(coalesce(text, ''), '\\p{L}{3,}')) as n_words from documents)")
def qg4(spark, sf):
    return Q.min_text_gate(table(spark, sf, "documents"))


@query(
    "qg5_accept_new_version",
    """with o as (select doc_id, len(string_split(text, chr(10))) as np, len(regexp_extract_all(text, '\\p{L}{3,}')) as nw, 0 as nb from documents),
      n as (select doc_id, np + cast(doc_id % 9 = 0 as int) as np2, cast(floor(nw * (0.7 + doc_id % 5 * 0.1)) as bigint) as nw2, cast(doc_id % 7 = 0 as int) as nb2 from o),
      r as (select doc_id, case when np2 <> np then 'pages differ' when nw2 < greatest(100.0, 0.75 * nw) then 'too few words' when nb2 > nb then 'more broken signs' else '' end as reason from o join n using (doc_id))
      select doc_id, reason = '' as accepted, reason from r""",
)
def qg5(spark, sf):
    d = table(spark, sf, "documents")
    old = d.select("doc_id", F.size(F.split("text", "\n")).alias("n_pages"), F.size(F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), F.lit(0))).alias("n_words"), F.lit(0).alias("n_broken"))
    new = old.selectExpr("doc_id", "n_pages + cast(doc_id % 9 = 0 as int) n_pages", "floor(n_words * (0.7 + doc_id % 5 * 0.1)) n_words", "cast(doc_id % 7 = 0 as int) n_broken")
    return Q.accept_new_version(old, new)


#: Every second document has its page numbers printed as last lines, every fifth a layout tool's stamps with a missing page, every seventh a year.
NUMBERED = """select doc_id, page_no, concat(text, case when doc_id % 2 = 0 then concat(chr(10), cast(page_no + doc_id % 6 as string)) when doc_id % 5 = 0 then concat(chr(10), 'body.indd   ', cast(page_no + case when page_no > 4 then 1 else 0 end as string)) when doc_id % 7 = 0 then concat(chr(10), '1998') else '' end) as text from {pg}"""


@query(
    "qg6_page_sequence_gaps",
    f"""with {PAGES}, np as ({NUMBERED.replace("{pg}", "pg")}), ls as (select doc_id, page_no as sheet, count(*) over (partition by doc_id) as n, regexp_extract_all(text, '(?i)\\.indd\\s+([0-9]{{1,4}})\\b', 1) as stamp, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) as ls from np),
      al as (select *, list_filter(list_transform(list_filter(ls[1:4] || ls[greatest(len(ls) - 3, 1):], lambda x: regexp_full_match(x, '[0-9]{{1,4}}')), lambda x: cast(x as int)), lambda v: not ((sheet <= 4 and (v between 1450 and 2099 or v > greatest(50, n))) or v > greatest(n * 2, 2000))) as alone from ls),
      nm as (select doc_id, sheet, len(stamp) > 0 as stamped, case when len(stamp) > 0 then cast(stamp[-1] as int) else alone[-1] end as printed from al),
      j as (select *, lag(printed) over o as before, stamped and lag(stamped) over o as both_ from nm where printed is not null window o as (partition by doc_id order by sheet)),
      f as (select doc_id, count(*) as n_seen, min(case when both_ and printed - before > 1 then struct_pack(s := sheet, b := before, p := printed) end) as gap, min(case when printed > 1 then struct_pack(s := sheet, p := printed) end) as first from j group by doc_id)
      select doc_id, n_seen, gap.b as gap_from, gap.p as gap_to, coalesce(first.s <= 4 and first.p >= 5 and first.p - first.s >= 4, false) as late_start, gap is not null or coalesce(first.s <= 4 and first.p >= 5 and first.p - first.s >= 4, false) as partial from f where n_seen >= 3""",
)
def qg6(spark, sf):
    return Q.page_sequence_gaps(Q.printed_numbers(spark.sql(NUMBERED, pg=doc_pages(spark, sf))))


@query(
    "qg7_pagination_check",
    """with r as (select p_partkey as rec_id, 80 + p_partkey % 200 as file_pages, p_partkey % 4 = 0 as reflowable from part),
      e as (select l_partkey as rec_id, cast(max(l_quantity) * 8 as int) as edition_pages from lineitem group by l_partkey)
      select rec_id, file_pages, edition_pages, case when file_pages >= 0.75 * edition_pages then 'ok' when reflowable then 'reflowed' when edition_pages / file_pages between 1.65 and 2.15 then 'double_page' else 'conflict' end as verdict from r join e using (rec_id)""",
)
def qg7(spark, sf):
    rec = table(spark, sf, "part").selectExpr("p_partkey rec_id", "80 + p_partkey % 200 file_pages", "p_partkey % 4 = 0 reflowable")
    editions = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("rec_id")).agg((F.max("l_quantity") * 8).cast("int").alias("edition_pages"))
    return Q.pagination_check(rec, editions)


#: Marks planted by rules on the id; the rest is the documents' own text.
MARKED = """select doc_id, concat(text, case when doc_id % 11 = 0 then concat(chr(10), 'Traduzido automaticamente pelo Google') when doc_id % 11 = 1 then concat(chr(10), 'Previous | First | Next') when doc_id % 11 = 2 then concat(chr(10), 'Baixado do Scribd') when doc_id % 11 = 3 then concat(chr(10), 'Cópia digital não comercial') when doc_id % 11 = 4 then concat(chr(10), 'http://site.org/a', chr(10), 'https://Site.org/b?x', chr(10), ' http://site.org/ ', case when doc_id % 2 = 0 then concat(chr(10), '© 1999') else '' end) else '' end) as text, concat('i', cast(doc_id as string)) as isbn from {documents}"""


@query(
    "qg8_provenance_flags",
    f"""with d as (select doc_id, isbn, lower(coalesce(text, '')) as t from ({MARKED.replace("{documents}", "documents")})),
      h as (select doc_id, max(n) as same_host from (select doc_id, regexp_extract(trim(line), '^https?://([^/\\s]+)\\S*$', 1) as host, count(*) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) group by all) where host <> '' group by doc_id),
      f as (select doc_id, isbn, contains(t, 'machine translated by google') or contains(t, 'traduzido automaticamente pelo google') as machine_translated, regexp_matches(t, 'previous ?\\| ?first ?\\| ?next|<- ?previous +first +next ?->') or (coalesce(same_host, 0) >= 3 and not regexp_matches(t, '\\bisbn\\b|\\bcopyright\\b|©|℗|catalogação|catalogacao|ficha catalogr')) as site_capture,
        regexp_matches(t, 'scribd\\.com|baixado (do|em) scribd') as shared_copy, regexp_matches(t, 'c[oó]pia (digital )?n[aã]o comercial|non[- ]commercial (digital )?copy') as non_commercial from d left join h using (doc_id))
      select doc_id, machine_translated, site_capture, shared_copy, non_commercial, machine_translated or site_capture or non_commercial as derived, case when not (machine_translated or site_capture or non_commercial) then isbn end as isbn from f""",
)
def qg8(spark, sf):
    return Q.provenance_flags(run(spark, sf, MARKED, "documents"), isbn="isbn")
