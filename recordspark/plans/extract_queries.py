"""Identifier extraction and learned tables over documents, parts, line items and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.operators import extract as X
from recordspark.operators import learn as A
from recordspark.operators.scopes import CARD_HEADER, CREDIT_WORDS
from recordspark.plans.linkage_queries import BOOKS, CANON, CONFIRMED, NORM, WORDS, _check, duck
from recordspark.plans.registry import query, run, table
from recordspark.plans.text_queries import PAGES, doc_pages
from recordspark.sources.pages import explode_lines, lines_as_pages

#: Pages of the documents; the first two get a line with the number of the part that has the document's id, in five forms.
ISBN_PAGES = f"""select doc_id, page_no, concat(text, case when isbn is null then '' else concat(chr(10), case doc_id % 5 when 0 then concat('ISBN ', substr(isbn, 1, 3), '-', substr(isbn, 4), ' (pdf)') when 1 then concat('ISBN: ', isbn, ' vol. ', cast(1 + doc_id % 3 as string), ' brochura') when 2 then concat('see ', isbn, ' and 12345')
  when 3 then concat('Copyright 2001 Casa Nova', chr(10), 'capa dura ', substr(isbn, 1, 3), ' ', substr(isbn, 4, 4), ' ', substr(isbn, 8)) else concat('numbers ', isbn, ' and ', coalesce(ten, '1234567890')) end) end) as text
  from {{pg}} left join ({BOOKS}) b on b.rec_id = doc_id and page_no <= 2 left join (select rec_id - 1000000 as ten_id, isbn as ten from ({CONFIRMED}) where rec_id < 2000000) t on ten_id = doc_id and page_no <= 2"""
_PAGES = f"{PAGES}, ip as ({duck(ISBN_PAGES).replace('{pg}', 'pg')}), il as (select doc_id, page_no, ls, i as line_no, ls[i] as line, regexp_matches(lower(text), '{X.CREDIT_PAGE}') as credit, concat_ws(' ', case when i > 1 then ls[i - 1] end, ls[i], ls[i + 1]) as around from (select doc_id, page_no, text, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from ip))"
_TEN_OK = f"({' + '.join(f'cast(substr(isbn, {k + 1}, 1) as int) * {10 - k}' for k in range(9))} + case when substr(isbn, 10, 1) = 'X' then 10 else cast(substr(isbn, 10, 1) as int) end) % 11 = 0"
#: Candidates as rows: 13 digits first, then 10 in the rest of the line; the first place on a page stays.
_CANDS = f"""{_PAGES}, fd as (select *, unnest(list_distinct(regexp_extract_all(line, '\\b97[89][- ]?(?:[0-9][- ]?){{9}}[0-9]\\b') || regexp_extract_all(regexp_replace(line, '\\b97[89][- ]?(?:[0-9][- ]?){{9}}[0-9]\\b', ' ', 'g'), '\\b(?:[0-9][- ]?){{9}}[0-9Xx]\\b'))) as raw from il),
  fi as (select *, upper(regexp_replace(raw, '[^0-9Xx]', '', 'g')) as isbn, instr(line, raw) as place from fd), fc as (select *, {CANON} as isbn13 from fi where length(isbn) = 13 or (length(isbn) = 10 and {_TEN_OK})),
  ff as (select *, case when regexp_matches(lower(line), 'pdf\\b') then 'pdf' when regexp_matches(lower(line), 'epub|mobi|kindle|ebook|eletr|electr') then 'digital' when regexp_matches(lower(line), 'brochura|paperback|r[uú]stica|bolsillo|\\btp\\b') then 'brochura' when regexp_matches(lower(line), 'capa dura|tapa dura|hardcover|\\btela\\b') then 'capa dura' else '' end as format,
    trim(concat_ws(' ', trim(substr(line, greatest(1, place - 50), least(50, place - 1))), trim(substr(line, place + length(raw), 40)))) as label, regexp_extract(line, '{X.VOLUME_RULE}', 1) as volume, row_number() over (partition by doc_id, page_no, isbn13 order by line_no, place, isbn) as rn from fc where isbn13 is not null),
  cd as (select doc_id, page_no, cast(line_no as int) as line_no, isbn13, isbn, label, format, volume, credit, credit or format <> '' or regexp_matches(lower(around), '{X.EDITORIAL_WORDS}') as anchored from ff where rn = 1)"""


def isbn_pages(spark, sf):
    return spark.sql(ISBN_PAGES.replace("{{pg}}", "{pg}"), pg=doc_pages(spark, sf), part=table(spark, sf, "part"))


@query("ex1_extract_isbns", f"with {_CANDS} select * from cd")
def ex1(spark, sf):
    return X.extract_isbns(isbn_pages(spark, sf))


@query(
    "ex2_suspect_isbns",
    f"""with {_PAGES}, an as (select distinct doc_id, page_no, upper(regexp_replace(unnest(regexp_extract_all(line, '(?i)ISBN[^0-9]{{0,12}}([0-9][0-9\\s\\-–—]{{7,20}}[0-9Xx])', 1)), '[^0-9Xx]', '', 'g')) as raw from il),
      bd as (select * from an where (length(raw) = 13 and (raw not like '97%' or substr(raw, 3, 1) not in ('8', '9') or {_check('raw')} <> substr(raw, 13, 1))) or (length(raw) = 10 and not ({_TEN_OK.replace('isbn', 'raw')}))),
      ch as (select doc_id, page_no, raw, place, substr(raw, 1, place - 1) || digit || substr(raw, place + 1) as isbn from bd, (select unnest(range(1, 14)) as place), (select unnest(string_split('0,1,2,3,4,5,6,7,8,9,X', ',')) as digit) where place <= length(raw) and (digit <> 'X' or place = 10)),
      ok as (select doc_id, page_no, raw, cast(place as int) as place, isbn as corrected from ch where isbn <> raw and case when length(isbn) = 13 then not contains(isbn, 'X') and isbn like '97%' and substr(isbn, 3, 1) in ('8', '9') and try_cast({_check('isbn').replace('cast(', 'try_cast(')} as int) = try_cast(substr(isbn, 13, 1) as int) else {_TEN_OK} end)
      select bd.*, place, corrected from bd left join ok using (doc_id, page_no, raw)""",
)
def ex2(spark, sf):
    return X.suspect_isbns(isbn_pages(spark, sf))


#: Files: a volume for every second document, a year for every third; barcodes and OPF packages for a few.
ISBN_FILES = "select doc_id, case when doc_id % 2 = 0 then cast(1 + doc_id % 3 as string) end as file_volume, case when doc_id % 3 = 0 then 1950 + doc_id % 90 end as year from {documents}"
MORE_ISBNS = f"select rec_id as doc_id, 0 as page_no, 0 as line_no, isbn as isbn13, isbn, case when rec_id % 2 = 0 then 'barcode' else 'opf' end as origin, '' as format, '' as volume, false as credit, true as anchored from ({BOOKS}) where rec_id % 13 = 1 and rec_id % 7 <> 0"


@query(
    "ex3_choose_isbn",
    f"""with {_CANDS}, k as (select doc_id, page_no, line_no, isbn13, isbn, 'page' as origin, format, volume, credit, anchored from cd union all select * from ({duck(MORE_ISBNS)})), fl as ({duck(ISBN_FILES).replace('{documents}', 'documents')}),
      pl as (select k.*, file_volume, case origin when 'barcode' then 1 when 'opf' then 2 else case when not anchored then 9 else 3 end end as stage, max(case when origin = 'page' and anchored and credit then 1 else 0 end) over (partition by doc_id) as has_credit from k join fl using (doc_id)),
      rk as (select *, case when stage <> 3 then 0 when has_credit = 1 and not credit then 99 when volume = file_volume then 1 when format = 'brochura' then 2 when format not in ('pdf', 'digital') then 3 else 5 end as tier from pl),
      bs as (select *, row_number() over (partition by doc_id order by stage, tier, case length(isbn) when 13 then 0 else 1 end, page_no, line_no, isbn13, isbn) as rn from rk)
      select fl.doc_id, case when stage < 9 then isbn end as isbn, case when stage < 9 then isbn13 end as isbn13,
        case when stage is null then case when year < 1970 then 'none: before 1970' else 'none: not found' end when stage = 9 then 'none: no bibliographic label' when stage = 1 then 'barcode' when stage = 2 then 'opf'
          else case tier when 1 then 'volume' when 2 then 'paperback' when 3 then 'print' else 'only' end || case when tier in (3, 5) and length(isbn) <> 13 and year < 2007 then ' (before 2007)' else '' end end as reason
      from fl left join (select * from bs where rn = 1) b using (doc_id)""",
)
def ex3(spark, sf):
    from pyspark.sql.functions import lit

    found = X.extract_isbns(isbn_pages(spark, sf)).withColumn("origin", lit("page"))
    more = run(spark, sf, MORE_ISBNS, "part")
    return X.choose_isbn(found.select(more.columns).unionByName(more), run(spark, sf, ISBN_FILES, "documents"))


#: Every fifth number begins with a Brazilian registration group.
IDS = f"select isbn from ({BOOKS}) union all select isbn from ({CONFIRMED}) union all select concat(b, {_check('b')}) from (select concat(case when p_partkey % 2 = 0 then '97885' else '97865' end, lpad(cast(p_partkey as string), 7, '0')) as b from {{part}} where p_partkey % 5 = 0)"
_EQUAL = f"eq as (select isbn13, count(distinct isbn) as n_forms, count(*) as n_records, isbn13 like '97885%' or isbn13 like '97865%' as brazil from (select isbn, {CANON} as isbn13 from ({duck(IDS)})) where isbn13 is not null group by 1)"


@query("ex4_isbn_equivalence", f"with {_EQUAL} select * from eq")
def ex4(spark, sf):
    return X.isbn_equivalence(run(spark, sf, IDS, "part"))


@query("ex4_isbn_groups", f"with {_EQUAL} select case when brazil then isbn13[4:5] else 'other' end as registration, count(*) as n_editions, cast(sum(n_records) as bigint) as n_records from eq group by 1")
def ex4_groups(spark, sf):
    return X.isbn_groups(X.isbn_equivalence(run(spark, sf, IDS, "part")))


DOI_DOCS = "select doc_id, concat(text, case when doc_id % 4 = 0 then concat(' (doi 10.', cast(1000 + doc_id % 90 as string), '/Abc—', cast(doc_id % 7 as string), ').') else '' end, case when doc_id % 8 = 0 then concat(' 10.', cast(1000 + doc_id % 90 as string), '/abc-', cast(doc_id % 7 as string), ';é 10.1234/a#b') else '' end) as text from {documents}"


@query("ex5_extract_dois", f"with d as ({DOI_DOCS.replace('{documents}', 'documents')}) select distinct doc_id, regexp_replace(x, '[.,;)]+$', '') as doi from (select doc_id, unnest(regexp_extract_all(replace(replace(lower(coalesce(text, '')), '–', '-'), '—', '-'), '10\\.[0-9]{{4,9}}/[-._;()/:a-z0-9]+')) as x from d)")
def ex5(spark, sf):
    return X.extract_dois(run(spark, sf, DOI_DOCS, "documents"))


#: Lines planted by rules on the id: anchored years, birth years, excluded words, edition phrases, © before an ISBN, Roman numerals.
YEAR_DOCS = "select doc_id, concat(case doc_id % 8 when 0 then concat('Seen in ', cast(1900 + doc_id % 120 as string), chr(10), 'Published here', chr(10)) when 1 then concat('Silva, Ana, 1962-', chr(10), 'Copyright ', cast(1960 + doc_id % 60 as string), chr(10)) when 2 then concat('Bible edition ', cast(1900 + doc_id % 120 as string), chr(10)) when 3 then concat('First edição: ', cast(1980 + doc_id % 40 as string), chr(10)) when 4 then concat('© 1990 A', chr(10), 'x', chr(10), '© ', cast(1991 + doc_id % 30 as string), ' B', chr(10), 'ISBN 1', chr(10), '© 2020', chr(10)) when 5 then concat('© MCM', case when doc_id % 2 = 0 then 'XCIV' else 'LXXX' end, chr(10)) when 6 then case doc_id % 5 when 0 then concat('Entered according to Act of Congress, in the year ', cast(1850 + doc_id % 60 as string), ', by A', chr(10)) when 1 then concat('London: House and Sons, ', cast(1860 + doc_id % 90 as string), chr(10)) when 2 then concat('Copyright da tradução © Casa Nova ', cast(1960 + doc_id % 60 as string), chr(10)) when 3 then concat('2ª edição em português ©', chr(10), cast(1990 + doc_id % 40 as string), ' A', chr(10)) else concat('Edição eletrônica publicada em ', cast(2000 + doc_id % 40 as string), chr(10)) end when 7 then concat('Primeira impressão ', cast(1970 + doc_id % 50 as string), chr(10)) else '' end, text) as text from {documents}"
#: The forms of editions again: what each class of words is, and what dates an edition.
EDITION_SQL = """el as (select doc_id, i, case when regexp_matches(line, '(^|[^0-9])(1[5-9]|20)[0-9][0-9]([^0-9]|$)') then line else concat_ws(' ', line, next) end as u from (select doc_id, i, ls[i] as line, ls[i + 1] as next from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d))),
  et as (select doc_id, i, regexp_extract_all(strip_accents(lower(u)), '[a-z]+|[0-9]+|©|:') as ts from el where regexp_matches(u, '(^|[^0-9])(1[5-9]|20)[0-9][0-9]([^0-9]|$)')),
  ec as (select doc_id, i, ts, array_to_string(list_transform(ts, lambda t: case when t in ('edicao', 'edicion', 'edition') then 'E' when t in ('impressao', 'impresion', 'printing') then 'P' when t in ('primeira', 'primera', 'first', 'premiere') then 'O'
    when t in ('ebook', 'digital', 'eletronica', 'electronica') then 'B' when t in ('publicacao', 'publicacion', 'publication', 'publicado', 'published') then 'U' when t in ('©', 'copyright') then 'C' when t in ('traducao', 'traduccion', 'translation', 'traduction') then 'T'
    when t = 'congress' then 'A' when t in ('london', 'edinburgh', 'boston', 'york', 'oxford', 'cambridge', 'philadelphia') then 'L' when regexp_full_match(t, '(1[5-9]|20)[0-9]{2}') then 'Y' when regexp_full_match(t, '[0-9]{1,2}') then 'N' when t = ':' then 'K' else 'x' end), '') as c from et),
  ey as (select doc_id, k, i, try_cast(ts[length(m)] as int) as y from (select doc_id, i, ts, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) as k, unnest([regexp_extract(c, '^.*?C[^Y]{0,3}T[^Y]{0,15}Y'), regexp_extract(c, '^.*?OE[^Y]{0,4}Y'), regexp_extract(c, '^.*?N[^Y]?E[^Y]{0,2}Y'), regexp_extract(c, '^.*?[ON][^Y]?P[^Y]{0,2}Y'), regexp_extract(c, '^.*?B[^Y]{0,3}[EU][^Y]{0,3}Y'),
    regexp_extract(c, '^.*?[EU][^Y]{0,3}B[^Y]{0,3}Y'), regexp_extract(c, '^.*?E[^Y]{0,6}C[^Y]?Y'), regexp_extract(c, '^.*?A[^Y]{0,8}Y'), regexp_extract(c, '^.*?LK[^Y]{1,8}Y')]) as m from ec) where m <> ''),
  e1 as (select doc_id, arg_min(y, struct_pack(k := k, i := i)) as edition from ey where y <= 2026 group by doc_id)"""


@query(
    "ex6_publication_year",
    f"""with d as (select doc_id, coalesce(text, '') as text from ({YEAR_DOCS.replace('{documents}', 'documents')})), {EDITION_SQL}, e as (select d.doc_id, edition, regexp_extract(text, '(?i)(?:copyright|©)\\s+([MDCLXVI]{{6,12}})\\b', 1) as numeral from d left join e1 using (doc_id)),
      l as (select doc_id, i, ls[i] as line, concat_ws(' ', case when i > 1 then ls[i - 1] end, ls[i], ls[i + 1]) as around from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d)),
      g as (select *, regexp_matches(lower(around), '{X.YEAR_EXCLUDED}') as out, min(case when regexp_matches(line, '(?i)\\bISBN\\b') then i end) over (partition by doc_id) as isbn_at from l),
      c as (select doc_id, max(struct_pack(i := i, y := regexp_extract_all(lower(line), '(?:©|copyright)\\s*((?:19|20)[0-9]{{2}})', 1)[-1])).y as credit from g where i < isbn_at and not out and regexp_matches(lower(line), '(?:©|copyright)\\s*(?:19|20)[0-9]{{2}}') group by doc_id),
      y as (select doc_id, i, list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(regexp_replace(around, ',\\s*[0-9]{{4}}\\s*[-–]', ' ', 'g'), '([^0-9])', '\\1 ', 'g') || ' ', '[^0-9]((?:1[6-9]|20)[0-9]{{2}})[^0-9]', 1), lambda v: cast(v as int)), lambda v: v <= 2026) as ys from g where not out and regexp_matches(lower(around), '{X.YEAR_ANCHORS}')),
      a as (select doc_id, min(struct_pack(i := i, y := ys[1])).y as anchored from y where len(ys) > 0 group by doc_id),
      r as (select doc_id, case when numeral <> '' then list_sum(list_transform(range(1, length(numeral) + 1), lambda k: case when v[k] < list_max(v[k + 1:]) then -v[k] else v[k] end)) end as roman from (select doc_id, numeral, list_transform(string_split(upper(numeral), ''), lambda x: case x when 'I' then 1 when 'V' then 5 when 'X' then 10 when 'L' then 50 when 'C' then 100 when 'D' then 500 when 'M' then 1000 else 0 end) as v from e)),
      j as (select doc_id, cast(edition as int) as edition, cast(credit as int) as credit, anchored, case when roman between 1500 and 2026 then cast(roman as int) end as roman from e left join c using (doc_id) left join a using (doc_id) left join r using (doc_id))
      select doc_id, coalesce(edition, credit, anchored, roman) as year, case when edition is not null then 'edition' when credit is not null then 'credit' when anchored is not null then 'anchored' else 'roman' end as how from j where coalesce(edition, credit, anchored, roman) is not null""",
)
def ex6(spark, sf):
    return X.publication_year(run(spark, sf, YEAR_DOCS, "documents"), latest=2026)


#: Pages of documents with planted cards, sheets and credit lines; the first page of each begins with one.
_PLANTS = ["Title: The Long Road\nAuthor(s): Luz, Ana\nPublisher: House Press\nYear: 1999", "Copyright © 2001 Editora Nova\nTradução: Rui de Souza\n2ª edição\nSão Paulo", "Título original: A Long Road\nCopyright © Ediciones Sol 1987\nTraducido\nTranslated by\nAna Maria Luz\nEdición en castellano – El Camino © 1999\nEditora Mar Azul.", "Todos os direitos reservados por Casa Norte, 2003\nThis is the 3rd edition of it", "Ficha catalográfica\nLuz, Ana, 1950-\nA casa verde / Ana Luz. – Lisboa : Editora Mar, 1988.\n210 p.\nISBN 978-85-1234-567-8\nCDD 230.1", "Tese apresentada à\nUniversidade de Faro\n2010", "Série Pequenos Guias\nPor Ana Luz\nISSN 1234-5678 http://site.org/a", "© 1998 Ana Luz\nPublished by House of Words", "Catalogação interna da publicação\nDisciplina: Grego\nProfessor: Rui Reis", "12 de março de 2004\nwww.site.org", "Luz, Ana\n120 p.\nISBN 85 123 4567 8\nCDU 27"]
CARD_PAGES = "select doc_id, page_no, case when page_no = 1 then concat(case doc_id % 12 " + " ".join(f"when {k} then concat('{m.replace(chr(10), "', chr(10), '")}', chr(10))" for k, m in enumerate(_PLANTS)) + " else '' end, text) else text end as text from {pg}"
_q = lambda x: x.replace("'", "''")
_scope = lambda c: f"coalesce(string_agg(text, chr(10) order by page_no) filter ({c}), '')"
_ranks: dict = {}


def _read(r) -> str:
    _ranks[r.field, r.source] = _ranks.get((r.field, r.source), 0) + 1
    value = f"rtrim(trim(regexp_extract({r.scope}, '{_q(r.pattern)}', 1)), ' .,;:')"
    tests = ["value <> ''"] + ([f"needed"] if r.needs else []) + ([f"regexp_matches(value, '{_q(r.shape)}')"] if r.shape else [])
    return f"select doc_id, '{r.field}' as field, '{r.source}' as source, value, {_ranks[r.field, r.source]} as rank from (select doc_id, {value} as value" + (f", regexp_matches({r.scope}, '{_q(r.needs)}') as needed" if r.needs else "") + f" from sc) where {' and '.join(tests)}"


def _labelled(field: str, labels: str, stops: str, low: int, high: int, shape: str, begins: bool) -> str:
    """First fitting value after a label of a credit line, which may stand on the next line."""
    rule = f"^({'' if begins else '(?:.*?[^a-z0-9])?'}(?:{labels}))(?:[^a-z0-9]|$)"
    return f"""select doc_id, '{field}' as field, 'copyright' as source, arg_min(value, i) as value, 1 as rank from (
      select doc_id, i, rtrim(trim(regexp_extract(ltrim(case when trim(rest, ' :–—-' || chr(9)) = '' then nraw else rest end, ' :–—-' || chr(9)), '^[^{stops}]*')), ' .,;:') as value
      from (select doc_id, i, nraw, substr(raw, length(regexp_extract(p, '{rule}', 1)) + 1) as rest from cl where regexp_matches(p, '{rule}')))
      where length(value) between {low} and {high} and regexp_matches(value, '{shape}') group by doc_id"""


_PERSON = r"^\p{Lu}[\p{L}''.-]*,?(?: (?:(?:de|da|do|das|dos|del|van|von|e)|\p{Lu}[\p{L}''.-]*,?)){1,5}$"
_HOUSES = "editora|editorial|edicoes|ediciones|publicacoes|casa publicadora"
_NTH = "[0-9]{1,2} ?(?:ª|º|a|o|st|nd|rd|th)?[.]? ?(?:edicao|edicion|edition)"
_lines_of = lambda scope: f"select doc_id, i, trim(ls[i], ' ' || chr(9) || chr(13)) as raw, strip_accents(lower(trim(ls[i], ' ' || chr(9) || chr(13)))) as p, coalesce(trim(ls[i + 1], ' ' || chr(9) || chr(13)), '') as nraw from (select doc_id, string_split({scope}, chr(10)) as ls, unnest(range(1, len(string_split({scope}, chr(10))) + 1)) as i from sc)"
_nth = lambda rows, rank: f"""select doc_id, 'edition', 'copyright', arg_min(value, i), {rank} from (select doc_id, i, substr(raw, length(h) + 1, length(regexp_extract(substr(p, length(h) + 1), '^{_NTH}'))) as value
      from (select *, regexp_extract(p, '^((?:.*?[^a-z0-9])?){_NTH}(?:[^a-z]|$)', 1) as h from {rows} where regexp_matches(p, '^((?:.*?[^a-z0-9])?){_NTH}(?:[^a-z]|$)'))) where length(value) between 6 and 40 group by doc_id"""  # noqa: E731
CREDIT_SQL = f"""cl as ({_lines_of("credit")}), cl3 as ({_lines_of("first3")}),
  cr as ({_labelled("original_title", "originally published in english as|originally published as|titulo del original|titulo original|titre original|original title", "©", 3, 80, ".", True)}
    union all {_labelled("edition_title", "edicion en castellano|edicao em portugues|edition francaise", "©", 3, 80, ".", True)}
    union all {_labelled("translator", "traduccion por|translated by|traduccion de|traducao por|traduit par|traducao de|traduccion|tradutora|tradutor|traducao", "©,;.", 3, 50, _PERSON, True)}
    union all {_labelled("publisher", "publicado no brasil por|reservados por|publicado por|published by|publie par", "©,.", 2, 75, "^[\\p{Lu}0-9]", False)}
    union all select doc_id, 'publisher', 'copyright', arg_min(v, i), 2 from (select doc_id, i, case when regexp_matches(strip_accents(lower(v1)), '^(?:{_HOUSES})(?:[^a-z]|$)') then v1 else v2 end as v from (
      select doc_id, i, rtrim(trim(regexp_extract(ltrim(rest, ' :;,.–—-©' || chr(9)), '^[^©,;.]*')), ' .,;:') as v1, rtrim(trim(regexp_extract(ltrim(regexp_extract(ahead, '^(.*?)[ ,]*(?:1[5-9]|20)[0-9]{{2}}', 1), ' :;,.–—-©' || chr(9)), '^[^©,;.]*')), ' .,;:') as v2 from (
        select doc_id, i, case when h1 <> '' then substr(raw, length(h1) + 1) end as rest, case when h2 <> '' then substr(raw, length(h2) + 1) end as ahead from (
          select *, regexp_extract(p, '^(.*?(?:©|copyright).*?(?:©|[^a-z])(?:1[5-9]|20)[0-9]{{2}})(?:[^0-9]|$)', 1) as h1, regexp_extract(p, '^(.*(?:©|copyright))', 1) as h2 from cl))))
      where regexp_matches(strip_accents(lower(v)), '^(?:{_HOUSES})(?:[^a-z]|$)') and length(v) between 4 and 75 and regexp_matches(v, '^[\\p{{Lu}}0-9]') group by doc_id
    union all select doc_id, 'publisher', 'copyright', arg_min(v, i), 3 from (select doc_id, i, rtrim(raw, ' .,;:') as v from cl where regexp_matches(p, '^(?:{_HOUSES}) ') and not regexp_matches(raw, '[©:]')) where length(v) between 5 and 60 and regexp_matches(v, '^[\\p{{Lu}}0-9]') group by doc_id
    union all {_nth("cl", 1)} union all {_nth("cl3", 2)})"""


@query(
    "ex7_catalog_card_fields",
    f"""with {PAGES}, cp as ({CARD_PAGES.replace("{pg}", "pg")}), cn as (select *, max(page_no) over (partition by doc_id) as n from cp),
      s0 as (select doc_id, {_scope("page_no <= 1")} as page1, {_scope("page_no <= 3")} as first3, {_scope("page_no <= 10")} as first10, {_scope("page_no <= 12")} as first12, {_scope("page_no > n - 3")} as last3, {_scope(f"(page_no <= 12 or page_no > n - 3) and regexp_matches(strip_accents(lower(text)), '{CREDIT_WORDS}')")} as credit from cn group by doc_id),
      s1 as (select *, strip_accents(lower(first12)) as low, regexp_extract(strip_accents(lower(first12)), '{CARD_HEADER}') as head from s0),
      sc as (select *, first3 || chr(10) || last3 as edges, case when head <> '' then substr(first12, instr(low, head) + length(head), 2600) else '' end as card from s1),
      {CREDIT_SQL}, rd as ({" union all ".join(_read(r) for r in X.CARD_RULES)} union all select * from cr)
      select doc_id, field, source, arg_min(value, rank) as value, min(rank) as rank from rd group by doc_id, field, source""",
)
def ex7(spark, sf):
    return X.catalog_card_fields(spark.sql(CARD_PAGES, pg=doc_pages(spark, sf)))


#: Documents with a planted classification line, in the spellings that scanned cards have.
CLASSIFIED = "select doc_id, concat(text, chr(10), case {{case}} else '' end) as text from {documents}".replace("{{case}}", "doc_id % 14 " + " ".join(f"when {k} then '{c}'" for k, c in enumerate(["CDU 27-1", "C D U: 22", "CDU 27(091)", "CDU–27-4", "CDD 230.1", "cdu 28", "CDU 27.36", "CDU 27-23", "CDU 37", "CDU 2", "CDU 279", "CDU: 29-3"])))


@query(
    "ex8_map_classification",
    f"""with d as (select doc_id, coalesce(text, '') as t from ({CLASSIFIED.replace("{documents}", "documents")})), x as (select doc_id as rec_id, upper(replace(regexp_extract(t, '(?i)\\b(C\\s*D\\s*[DU])\\s*[-:–—]?\\s*([0-9]{{1,3}}(?:[.\\s-][0-9]+)*(?:\\([0-9]+\\))?)', 1), ' ', '')) as label, trim(regexp_extract(t, '(?i)\\b(C\\s*D\\s*[DU])\\s*[-:–—]?\\s*([0-9]{{1,3}}(?:[.\\s-][0-9]+)*(?:\\([0-9]+\\))?)', 2)) as code from d),
      g as (select *, case when label = 'CDU' then case when regexp_matches(code, '^27([-:.]?1|\\(1\\)|/1)') then '230' when regexp_matches(code, '^27[-:.]?2') then '220' when regexp_matches(code, '^27[-:.]?31') then '241' when regexp_matches(code, '^27[-:.]?36') then '248' when regexp_matches(code, '^27[-:.]?4') then '240' when regexp_matches(code, '^27[-:.]?5') then '250' when regexp_matches(code, '^27[-:.]?7') then '260' when regexp_matches(code, '^27([-:.]?9|\\(091\\))') then '270' when code like '27%' then '230'
        when regexp_matches(code, '^22([^0-9]|$)') then '220' when regexp_matches(code, '^23([^0-9]|$)') then '230' when regexp_matches(code, '^28([^0-9]|$)') then '297' when regexp_matches(code, '^29([^0-9]|$)') then '290' when regexp_matches(code, '^2([^0-9]|$)') then '200' end end as guess from x where label <> '')
      select rec_id, case when label = 'CDD' then code else guess end as ddc, label <> 'CDD' and guess is not null as suggested, label || ' ' || code as original from g""",
)
def ex8(spark, sf):
    found = X.extract_classification(run(spark, sf, CLASSIFIED, "documents"))
    return X.map_classification(found.select(F.col("doc_id").alias("rec_id"), F.expr("if(label = 'CDD', code, '')").alias("ddc"), F.concat_ws(" ", "label", "code").alias("original")))


FILES = "select p_partkey as file_id, case p_partkey % 7 when 0 then concat(split_part(p_name, ' ', 1), '-', cast(1950 + p_size as string), '-0', cast(1 + p_partkey % 9 as string), case when p_partkey % 2 = 0 then concat('-v', cast(p_size as string)) else '' end, '.pdf') when 1 then concat(p_name, ' vol. ', cast(p_size as string), ' no. ', cast(p_partkey % 12 as string), ' ', cast(1950 + p_size as string), '.pdf') when 2 then concat('The ', p_name, ' ', case p_partkey % 3 when 0 then 'March' when 1 then 'setembro' else 'Dez' end, ' ', cast(1950 + p_size as string), '.pdf') else concat(lpad(cast(p_partkey as string), 4, '0'), '_', replace(p_name, ' ', '_'), case when p_partkey % 3 = 0 then concat(' vol. ', cast(p_size as string)) else '' end, case when p_partkey % 2 = 0 then concat(' - ', p_brand) else concat(' by ', p_type) end, case when p_partkey % 4 = 0 then concat(' (', cast(1950 + p_size as string), ')') else '' end, case when p_partkey % 5 = 0 then ' copy (2)' else '' end, '.pdf') end as name from {part}"
_issue = lambda k, i: f"nullif(regexp_extract({'low' if k == 'C' else 's'}, '{_q(X.ISSUE_RULES[k])}', {i}), '')"


@query(
    "ex9_filename_fields",
    f"""with a as (select file_id, regexp_replace(name, '(?i)\\.(pdf|epub|docx?|txt|jpe?g)$', '') as s from ({duck(FILES)})), b as (select file_id, trim(replace(regexp_replace(regexp_replace(s, '(?i)(\\s*\\(\\d{{1,2}}\\)|[ _-]+(copy|copia|scan|scanned|ocr|final|compressed))+$', ''), '^\\d{{3,}}[_ -]+', ''), '_', ' ')) as s from a),
      i as (select *, strip_accents(lower(s)) as low from b), k as (select *, case when {_issue("A", 1)} is not null then 'A' when {_issue("B", 1)} is not null then 'B' when {_issue("C", 1)} is not null then 'C' end as p from i),
      c as (select *, trim(regexp_replace(s, '(?i)\\s*\\((?:1[5-9]|20)[0-9]{{2}}\\)|\\s*\\b(?:vol\\.?|tomo|v\\.) ?[0-9]+', '', 'g')) as body from k), d as (select *, regexp_extract(body, '^(.*?)(?:\\s+-\\s+|\\s+by\\s+)(.*)$', 1) as t, regexp_extract(body, '^(.*?)(?:\\s+-\\s+|\\s+by\\s+)(.*)$', 2) as u, regexp_matches(body, '\\s+-\\s+|\\s+by\\s+') as two from c)
      select file_id, trim(case p when 'A' then {_issue("A", 1)} when 'B' then {_issue("B", 1)} when 'C' then substr(s, 1, length({_issue("C", 1)})) else case when two then t else body end end) as title, case when p is null and two then trim(u) end as author,
        cast(case when p is null then nullif(regexp_extract(s, '(?i)\\b(?:vol\\.?|tomo|v\\.) ?([0-9]+)', 1), '') when p = 'A' then {_issue("A", 4)} when p = 'B' then {_issue("B", 2)} end as int) as volume, cast(case when p is null then nullif(regexp_extract(s, '\\(((?:1[5-9]|20)[0-9]{{2}})\\)', 1), '') when p = 'A' then {_issue("A", 2)} when p = 'B' then {_issue("B", 4)} else {_issue("C", 3)} end as int) as year,
        p as issue_pattern, case p when 'A' then cast({_issue("A", 3)} as int) when 'C' then case when {_issue("C", 2)} = 'march' then 3 when {_issue("C", 2)} = 'setembro' then 9 else 12 end end as month, case when p = 'B' then cast({_issue("B", 3)} as int) end as number from d""",
)
def ex9(spark, sf):
    return X.filename_fields(run(spark, sf, FILES, "part"))


TITLES = "select p_partkey as rec_id, concat(case when p_partkey % 7 = 0 then 'Ana de Luz - ' else '' end, p_name, case when p_partkey % 2 = 0 then concat(': ', p_type) when p_partkey % 3 = 0 then concat(' ', p_name) else '' end, case when p_partkey % 5 = 0 then ', 2nd edition' when p_partkey % 11 = 0 then ' by Rui Reis' when p_partkey % 13 = 0 then ', Ana de Luz' when p_partkey % 17 = 0 then ' 12' else '' end) as title, case when p_partkey % 4 <> 1 then 'Ana de Luz' end as author from {part}"
_tidy = lambda x: f"trim(trim({x}), ' .,:;-_|')"


@query(
    "ex10_split_title",
    f"""with t as (select rec_id, coalesce(author, '') as author, cast(nullif(regexp_extract(title, '(?i)\\b([0-9]+)(?:st|nd|rd|th|ª)\\s*(?:ed\\.|edition|edição)', 1), '') as int) as edition, {_tidy("regexp_replace(title, '(?i)[,;]?\\s*\\b[0-9]+(?:st|nd|rd|th|ª)\\s*(?:ed\\.|edition|edição)', '', 'g')")} as b from ({duck(TITLES)})),
      u as (select rec_id, author, edition, {_tidy("regexp_replace(b, '(?i),?\\s+(?:by|por)\\s+\\p{Lu}[\\p{L}''. -]{2,89}$|\\s+(?:by|por)$', '')")} as b from t),
      v as (select rec_id, edition, {_tidy("case when author <> '' and ends_with(lower(b), lower(author)) and length(b) > length(author) then substr(b, 1, length(b) - length(author)) when author <> '' and starts_with(lower(b), lower(author)) and length(b) > length(author) then substr(b, length(author) + 1) else b end")} as b from u),
      h as (select rec_id, edition, case when length(b) % 2 = 1 and substr(b, 1, length(b) // 2) || ' ' || substr(b, 1, length(b) // 2) = b then substr(b, 1, length(b) // 2) else b end as b from v),
      g as (select rec_id, edition, {_tidy("regexp_replace(b, '(\\p{L})[ _-]+[0-9]{1,3}$', '\\1')")} as b from h),
      s as (select *, string_split_regex(b, ': | [-–—] ')[1] as first, regexp_extract_all(b, '[\\p{{L}}0-9]+') as ws from g),
      k as (select rec_id, string_agg(w, ' ' order by i) as key_words from (select *, row_number() over (partition by rec_id order by length(w) desc, i) as rn from (select rec_id, i, ws[i] as w from (select rec_id, ws, unnest(range(1, len(ws) + 1)) as i from s)) where length(w) >= 4 and strip_accents(lower(w)) not in ({", ".join(f"'{w}'" for w in X.COMMON_WORDS)})) where rn <= 6 group by rec_id)
      select rec_id, trim(first) as main, trim(case when length(b) > length(first) then substr(b, length(first) + case when substr(b, length(first) + 1, 2) = ': ' then 3 else 4 end) end) as subtitle, edition, coalesce(key_words, '') as key_words from s left join k using (rec_id)""",
)
def ex10(spark, sf):
    return X.split_title(run(spark, sf, TITLES, "part"))


#: Names of suppliers and customers planted as lines, some with honorifics, degrees, digits or addresses.
PERSON_DOCS = "select doc_id, concat(case doc_id % 7 when 0 then concat('Dr. Ana Silva', chr(10)) when 1 then concat('Maria de Souza', chr(10), 'Igreja Nova Vida', chr(10)) when 2 then concat('Rui Costa 1999', chr(10)) when 3 then concat('JOSE', chr(10), 'Lia Reis PhD', chr(10)) when 4 then concat('Edited by Ana Luz', chr(10)) else '' end, text) as text from {documents}"
_person = {n: getattr(X, n).replace("'", "''") for n in ("HONORIFIC", "DEGREE", "INSTITUTION", "ROLE", "NO_PERSON")}


@query(
    "ex11_best_person_line",
    f"""with d as ({PERSON_DOCS.replace("{documents}", "documents")}), l as (select doc_id, i as line_no, trim(ls[i]) as t from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as ls from d))),
      s as (select *, string_split_regex(t, '\\s+') as ws, regexp_replace(t, '[^\\p{{L}}]', '', 'g') as letters, regexp_matches(t, '{_person["HONORIFIC"]}') as titled from l),
      p as (select *, case when regexp_matches(t, '[0-9@]') or contains(lower(t), 'www.') or regexp_matches(t, '{_person["NO_PERSON"]}') then -100 else case when titled then 100 else 0 end + case when len(ws) between 2 and 4 then 20 when len(ws) = 1 then -15 when len(ws) > 6 then -30 else 0 end + case when regexp_matches(t, '{_person["DEGREE"]}') then 40 else 0 end
        - case when regexp_matches(t, '{_person["INSTITUTION"]}') then 60 else 0 end - case when regexp_matches(t, '{_person["ROLE"]}') then 50 else 0 end - case when length(letters) between 1 and 6 and t = upper(t) then 60 else 0 end
        + case when len(ws) >= 2 and len(list_filter(ws, lambda w: not regexp_matches(w, '^\\p{{Lu}}') and lower(w) not in ('de', 'del', 'da', 'dos', 'van', 'von', 'la', 'le', 'y', 'e'))) = 0 then 15 else 0 end end as score from s)
      select doc_id, t as line, score from (select *, row_number() over (partition by doc_id order by not titled, case when titled then 0 else -score end, line_no) as rn from p where score >= 15 or titled) where rn = 1""",
)
def ex11(spark, sf):
    return X.best_person_line(explode_lines(run(spark, sf, PERSON_DOCS, "documents")))


AUTHORED = "select p_partkey as rec_id, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then split_part(p_name, ' ', 1) else p_brand end as author, p_name as title, case when p_partkey % 2 = 0 then 'nome do arquivo' else 'cip' end as origin from {part}"


@query("ex11_author_in_title", f"with w as (select rec_id, origin, author, list_distinct(list_filter({WORDS.format(x='author')}, lambda x: length(x) > 2)) as a, list_distinct(list_filter({WORDS.format(x='title')}, lambda x: length(x) > 2)) as t from ({duck(AUTHORED)})) select rec_id, len(a) > 0 and len(list_intersect(a, t)) = len(a) and origin = 'nome do arquivo' as fragment from w")
def ex11_fragment(spark, sf):
    return X.author_in_title(run(spark, sf, AUTHORED, "part"))


REVIEWED_PAGES = ISBN_PAGES.replace("concat(text, case when isbn", "concat(text, case when (doc_id + page_no) % 9 = 0 then concat(chr(10), 'Sumário') when (doc_id + page_no) % 9 = 1 then concat(chr(10), 'Abstract: x') when (doc_id + page_no) % 9 = 2 then ' ficha catalográfica' else '' end, case when isbn")
_REVIEWED = _PAGES.replace(duck(ISBN_PAGES).replace("{pg}", "pg"), duck(REVIEWED_PAGES).replace("{pg}", "pg"))


@query(
    "ex13_review_pages",
    f"""with {_CANDS.replace(_PAGES, _REVIEWED)}, m as (select doc_id, page_no, text, case when page_no <= 3 then 'first pages' {" ".join(f"when regexp_matches(strip_accents(lower(text)), '{_q(p)}') then '{n}'" for n, p in X.REVIEW_MARKS)} end as mark from ip),
      r as (select * from (select *, row_number() over (partition by doc_id order by page_no > 3, page_no) as rn from m where mark is not null) where rn <= 10),
      an as (select distinct doc_id, page_no, upper(regexp_replace(unnest(regexp_extract_all(line, '(?i)ISBN[^0-9]{{0,12}}([0-9][0-9\\s\\-–—]{{7,20}}[0-9Xx])', 1)), '[^0-9Xx]', '', 'g')) as isbn from il),
      bd as (select doc_id, page_no, string_agg(isbn, ', ' order by isbn) as suspects from an where (length(isbn) = 13 and (isbn not like '97%' or substr(isbn, 3, 1) not in ('8', '9') or {_check('isbn')} <> substr(isbn, 13, 1))) or (length(isbn) = 10 and not ({_TEN_OK})) group by all),
      gd as (select doc_id, page_no, string_agg(distinct isbn13, ', ' order by isbn13) as isbns from cd group by all)
      select doc_id, page_no, mark, substr(text, 1, 900) as snippet, coalesce(isbns, '') as isbns, coalesce(suspects, '') as suspects from r left join gd using (doc_id, page_no) left join bd using (doc_id, page_no)""",
)
def ex13(spark, sf):
    return X.review_pages(reviewed_pages(spark, sf, table(spark, sf, "documents")))


def reviewed_pages(spark, sf, docs):
    """The pages that ex13 reviews, of the documents given."""
    return spark.sql(REVIEWED_PAGES, pg=lines_as_pages(docs), part=table(spark, sf, "part"))


SELLERS = "select s_name as publisher, n_name as city, l_orderkey from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on n_nationkey = (s_nationkey + cast(l_orderkey % 5 = 0 as int)) % 25"
KNOWN = "select lower(replace(s_name, '#', ' ')) as key, 'Porto' as city from {supplier} where s_suppkey % 9 = 0"
_sell = SELLERS.replace("{", "").replace("}", "")


@query(
    "ag1_learn_publisher_city",
    f"""with c as (select {NORM.format(x="publisher")} as key, city, count(*) as n from ({_sell}) group by all), t as (select key, sum(n) as total, arg_min(city, struct_pack(a := -n, b := city)) as city, max(n) as n from c group by key), k as (select {NORM.format(x="key")} as key, city as known from ({KNOWN.replace("{", "").replace("}", "")}))
      select coalesce(t.key, k.key) as key, coalesce(known, city) as city, cast(coalesce(case when known is not null then total else n end, 0) as bigint) as n, case when known is not null then 'conhecida' when n >= 3 then 'alta' else 'media' end as confidence from t full join k on t.key = k.key where known is not null or n >= 2""",
)
def ag1(spark, sf):
    from recordspark.functions.text import normal

    known = run(spark, sf, KNOWN, "supplier").withColumn("key", normal(F.col("key")))
    return A.learn_publisher_city(run(spark, sf, SELLERS, "lineitem", "supplier", "nation"), known)


PERIODICALS = "select case o_custkey % 4 when 0 then 'livro' when 1 then 'revista' else 'artigo' end as type, concat(case when o_custkey % 3 = 0 then 'Journal  of ' when o_custkey % 3 = 1 then case when o_orderkey % 2 = 0 then 'REVISTA ' else 'Revista ' end else 'Book ' end, cast(o_custkey % 400 as string)) as periodical from {orders}"


@query("ag2_learn_periodicals", f"with k as (select {NORM.format(x='periodical')} as key, trim(regexp_replace(periodical, '\\s+', ' ', 'g')) as name from ({PERIODICALS.replace('{orders}', 'orders')}) where type in ('artigo', 'revista')) select key, min(name) as name, count(*) as n from k where regexp_matches(key, '{A.PERIODICAL_WORDS}') and key not like '%7' group by key having count(*) >= 2")
def ag2(spark, sf):
    rows = run(spark, sf, PERIODICALS, "orders")
    known = rows.select(F.lower(F.regexp_replace("periodical", r"\s+", " ")).alias("key")).where("key like '%7'").distinct()
    return A.learn_periodicals(rows, known)


AUTO = "select c_custkey as hash, c_mktsegment as title, case when c_custkey % 4 = 0 then '' else concat('City ', cast(c_nationkey as string)) end as city from {customer}"
REVIEWED = "select c_custkey as hash, case when c_custkey % 3 = 0 then concat(lower(c_mktsegment), '!') when c_custkey % 3 = 1 then concat(c_mktsegment, ' two') else '' end as title, concat('City ', cast(c_nationkey % 20 as string)) as city, 1000 + c_custkey % 97 as seen_at from {customer} where c_custkey % 2 = 0"


@query(
    "ag3_learn_corrections",
    f"""with a as (select hash, 'title' as field, title as o from ({AUTO.replace("{customer}", "customer")}) union all select hash, 'city', city from ({AUTO.replace("{customer}", "customer")})), r as (select hash, 'title' as field, title as n, seen_at from ({REVIEWED.replace("{customer}", "customer")}) x(hash, title, city, seen_at) union all select hash, 'city', city, seen_at from ({REVIEWED.replace("{customer}", "customer")}) x(hash, title, city, seen_at)),
      j as (select field, {NORM.format(x="o")} as wrong, hash, n, seen_at from a join r using (hash, field) where trim(o) <> '' and trim(n) <> '' and {NORM.format(x="o")} <> {NORM.format(x="n")})
      select field, wrong, count(distinct hash) as n_items, count(distinct n) as n_forms, max(seen_at) as last_seen, count(distinct hash) >= 3 as recommended from j group by field, wrong""",
)
def ag3(spark, sf):
    return A.learn_corrections(run(spark, sf, AUTO, "customer"), run(spark, sf, REVIEWED, "customer"), ["title", "city"])


MARKED = "select case when p_partkey % 2 = 0 then upper(p_brand) else p_brand end as text, case when p_size % 2 = 0 then 'exato' else 'contem' end as mode from {part}"


@query("ag4_learn_noise", f"with m as (select distinct {NORM.format(x='text')} as key, mode from ({duck(MARKED)})) select key, mode from m where not (key like '%1' and mode = 'exato')")
def ag4(spark, sf):
    m = run(spark, sf, MARKED, "part")
    return A.learn_noise(m, m.where("text like '%1' and mode = 'exato'"))


@query("ag5_state_summary", "select case o_orderstatus when 'F' then 'cadastrado' when 'O' then 'pronto' else 'analisado' end as state, count(*) as n, cast(sum(cast(o_totalprice as bigint)) as bigint) as bytes from (select o_orderstatus, floor(o_totalprice) as o_totalprice from orders) group by 1")
def ag5(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "cadastrado").when(F.col("o_orderstatus") == "O", "pronto").otherwise("analisado")
    return A.state_summary(table(spark, sf, "orders").select(state.alias("state"), F.floor("o_totalprice").cast("long").alias("bytes")))


_EVAL = f"""g as (select p_partkey as rec_id, p_name as title, [p_brand, p_type] as authors, case when p_partkey % 4 = 1 then '10.1/' || p_partkey end as doi, 1990 + p_size as year from part), p as (select rec_id, case when rec_id % 5 = 0 then title || ' extra' when rec_id % 5 = 1 then replace(title, 'e', 'é') else title end as title, case when rec_id % 3 = 0 then authors[1:1] else authors end as authors, case when rec_id % 8 = 1 then doi end as doi, year + cast(rec_id % 7 = 0 as int) as year from g where rec_id % 4 <> 0),
  s as (select g.rec_id, p.rec_id is not null as has, {NORM.format(x="g.title")} as gt, {NORM.format(x="coalesce(p.title, '')")} as pt, list_transform(g.authors, lambda x: {WORDS.format(x="x")}[-1]) as sn, {NORM.format(x="array_to_string(coalesce(p.authors, []), ' ')")} as names, coalesce(g.doi, '') = coalesce(p.doi, '') as same_doi, g.year = p.year as same_year from g left join p using (rec_id)),
  e as (select rec_id, case when has then 1 - levenshtein(gt, pt) / greatest(length(gt), length(pt), 1) else 0.0 end as title_sim, case when has then len(list_filter(sn, lambda w: contains(names, w))) / len(sn) else 0.0 end as surname_recall, has and same_doi as doi_ok, coalesce(has and same_year, false) as year_ok from s),
  ev as (select *, title_sim >= 0.90::double as title_passed, surname_recall >= 0.80::double as authors_passed, title_sim >= 0.90::double and surname_recall >= 0.80::double as passed from e)"""


@query("ag6_evaluate_extraction", f"with {_EVAL} select * from ev")
def ag6(spark, sf):
    g = table(spark, sf, "part").select(F.col("p_partkey").alias("rec_id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), F.expr("if(p_partkey % 4 = 1, concat('10.1/', p_partkey), null)").alias("doi"), (1990 + F.col("p_size")).alias("year"))
    p = g.where("rec_id % 4 <> 0").withColumns({"title": F.expr("case when rec_id % 5 = 0 then concat(title, ' extra') when rec_id % 5 = 1 then replace(title, 'e', 'é') else title end"), "authors": F.expr("if(rec_id % 3 = 0, slice(authors, 1, 1), authors)"), "doi": F.expr("if(rec_id % 8 = 1, doi, null)"), "year": F.expr("year + cast(rec_id % 7 = 0 as int)")})
    return A.evaluate_extraction(p, g)


@query("ag6_evaluation_totals", f"with {_EVAL} select count(*) as n, round(avg(title_sim), 6) as title_sim, round(avg(surname_recall), 6) as surname_recall, " + ", ".join(f"count(*) filter ({c}) as n_{c}" for c in ("doi_ok", "year_ok", "title_passed", "authors_passed", "passed")) + " from ev")
def ag6_totals(spark, sf):
    return A.evaluation_totals(ag6(spark, sf))


_SPELL = "case {c} % 7 when 0 then 'Português' when 1 then 'portugues' when 2 then ' Castelhano ' when 3 then 'Inglês' when 4 then 'ingles' when 5 then 'Frances' else 'Latim' end"


@query(
    "ag7_language_name_profile",
    f"""with g as (select trim({_SPELL.format(c="c_custkey")}) as given from customer), s as (select given, case lower(given) {" ".join(f"when '{k}' then '{v}'" for k, v in A.LANGUAGE_NAMES.items())} else given end as language from g)
      select language, count(*) as n, count(*) filter (given <> language) as n_other from s group by language""",
)
def ag7(spark, sf):
    return A.language_name_profile(table(spark, sf, "customer").select(F.expr(_SPELL.format(c="c_custkey")).alias("language")))


#: Cards and parts of cards planted on the second page of documents.
_SIGN_CARDS = ["S586c Silva, Ana de\nA casa do rio / Ana de Silva. - São José\ndos Campos : Mar Alto, 2011.\n214 p.\nISBN 978-85-7742-123-4\nCDD 869.3", "Reis, Rui, 1950-\nO rio / Rui Reis.- Porto: Norte, 1998\n90p", "Editora: Mar\nISBN: 85 7742 123 X\n300 pp.\n2001", "ISBN 9788577421234\n12 p.\nCDU: 2-23\n1999", "texto - lugar: casa, 1999", "Luz, Eva;\nEditora: Sul\n1980, 1985"]
SIGN_PAGES = "select doc_id, page_no, case when page_no = 2 then concat(case doc_id % 9 " + " ".join(f"when {k} then concat('{m.replace(chr(10), "', chr(10), '")}', chr(10))" for k, m in enumerate(_SIGN_CARDS)) + " else '' end, text) else text end as text from {pg}"
_TIDY = lambda x: f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"
_STATED = "'^\\s*([^:;]{2,90}):[ \\t]*([^,;:\\n]{2,80}),[ \\t]*\\[?((19|20)[0-9][0-9])\\b'"
_CREDITED = "'([^\\n/]{2,300})[ \\t]/[ \\t]+([^\\n/.]{3,150})[. \\t\\n]*$'"


@query(
    "ex7_cards_by_signs",
    f"""with {PAGES}, sp as ({SIGN_PAGES.replace("{pg}", "pg")}), s0 as (select doc_id, page_no, text as t, regexp_split_to_array(text, '(^|[\\s.])[-–—]') as parts from sp where page_no <= 10),
      s1 as (select *, list_filter(range(1, len(parts)), lambda k: regexp_matches(parts[k + 1], {_STATED}))[1] as spot from s0),
      s2 as (select doc_id, page_no, {_TIDY("regexp_extract(t, '(?im)^[ \\t]*(?:editora|editorial|publisher)[ \\t]*:[ \\t]*([^\\n]{2,80})$', 1)")} as house, upper(regexp_replace(regexp_extract(t, '(?i)\\bisbn[: \\t-]*([0-9][0-9X -]{{8,16}}[0-9X])', 1), '[^0-9Xx]', '', 'g')) as digits,
        cast(nullif(regexp_extract(t, '(?i)\\b([0-9]{{1,5}}) ?pp?\\b', 1), '') as int) as n_pages, nullif(trim(regexp_extract(t, '\\b(CDD|CDU)[ :.-]*([0-9][0-9.]*)', 1) || ' ' || regexp_extract(t, '\\b(CDD|CDU)[ :.-]*([0-9][0-9.]*)', 2)), '') as class,
        {_TIDY("regexp_extract(t, '(?m)^[ \\t]*(?:[A-Z][0-9]{2,5}[a-z]?[ \\t]+)?(\\p{Lu}[\\p{L}''’-]+, \\p{Lu}[\\p{L}''’. -]{1,60}?)(?:, [0-9]{4}-[0-9]{0,4})?[.;]?[ \\t]*$', 1)")} as heading,
        coalesce({_TIDY(f"regexp_extract(parts[spot + 1], {_STATED}, 3)")}, list_max(regexp_extract_all(t, '\\b((?:19|20)[0-9][0-9])\\b', 1))) as year, {_TIDY(f"regexp_extract(parts[spot + 1], {_STATED}, 1)")} as city, {_TIDY(f"regexp_extract(parts[spot + 1], {_STATED}, 2)")} as stated,
        {_TIDY(f"regexp_extract(parts[spot], {_CREDITED}, 1)")} as title, {_TIDY(f"regexp_extract(parts[spot], {_CREDITED}, 2)")} as credit from s1),
      s3 as (select *, case when length(digits) in (10, 13) then digits end as isbn from s2),
      s4 as (select *, len(list_filter([house, isbn, cast(n_pages as varchar), class, heading, year, stated, title, credit], lambda x: x is not null)) as n_signs from s3)
      select doc_id, page_no, cast(n_signs as int) as n_signs, title, coalesce(heading, credit) as author, city, coalesce(stated, house) as publisher, year, n_pages, isbn, class from s4
      where n_signs >= 4 and coalesce(heading, house, stated) is not null qualify row_number() over (partition by doc_id order by page_no) = 1""",
)
def ex7_signs(spark, sf):
    from recordspark.operators.cards import cards_by_signs

    return cards_by_signs(spark.sql(SIGN_PAGES, pg=doc_pages(spark, sf)))
