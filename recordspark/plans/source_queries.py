"""Stored payloads, the sharded record store, covers and titles over parts, documents and pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from recordspark.operators.cover import BLURBS, LIFTS, cover_title
from recordspark.operators.fusion import COMPLETED, WEAK_WORDS, fuse_title
from recordspark.plans.linkage_queries import BOOKS, NORM, _check
from recordspark.plans.registry import query, run, table
from recordspark.plans.review_queries import _RULES, _n, _tok
from recordspark.plans.workflow_queries import duck
from recordspark.sources import payloads as S

_J = {  # payloads of a part, by source: what the catalogues would answer
    "cbl": """concat('{"Title":"', title, '","Authors":["', author, '","Rui"],"Imprint":"House","Ano":"', year, '","Paginas":"', pages, '","Subject":"Art","RowKey":"', isbn, '"}')""",
    "internet_archive": """concat('{"response":{"docs":[{"identifier":"a', id, '","isbn":["', isbn, '"],"title":"', title, '","creator":"', author, '","publisher":"House","date":"', year, '-01-01","subject":["Art","Arms"]},{"identifier":"b","isbn":"9780000000002","title":"wrong"}]}}')""",
    "openalex": """concat('{"results":[{"display_name":"', title, '","publication_year":', year, ',"doi":"https://doi.org/10.1/', id, '","id":"W', id, '","authorships":[{"author":{"display_name":"', author, '"},"institutions":[{"display_name":"House"}]}],"biblio":{"first_page":"1","last_page":"', pages, '"},"topics":[{"display_name":"Art"}]}]}')""",
    "crossref": """concat('{"message":{"items":[{"title":["', title, '"],"author":[{"given":"A.","family":"', author, '"}],"container-title":["House"],"published-print":{"date-parts":[[', year, ',3]]},"page":"1-', pages, '","DOI":"10.1/', id, '"}]}}')""",
    "open_library": """concat('{"ISBN:', isbn, '":{"title":"', title, '","authors":[{"name":"', author, '"}],"publishers":[{"name":"House"}],"publish_date":"May ', year, '","number_of_pages":', pages, ',"subjects":[{"name":"Art"}]}}')""",
    "hathitrust": """concat('{"records":{"1":{"isbns":["', isbn, '"],"titles":["', title, '"],"authors":["', author, '"],"publishers":["House"],"publishDates":["', year, '"],"publishPlaces":["Faro"],"recordURL":"u', id, '"},"2":{"isbns":["1"],"titles":["wrong"]}}}')""",
    "marcxml": """concat('<r xmlns="http://m"><record><controlfield tag="001">', id, '</controlfield><datafield tag="020"><subfield code="a">', isbn, ' (pbk)</subfield></datafield><datafield tag="100"><subfield code="a">', author, '</subfield></datafield><datafield tag="245"><subfield code="a">', title, '</subfield></datafield><datafield tag="260"><subfield code="a">Faro</subfield><subfield code="b">House</subfield><subfield code="c">c', year, '</subfield></datafield><datafield tag="300"><subfield code="a">', pages, ' p.</subfield></datafield><datafield tag="650"><subfield code="a">Art</subfield></datafield></record></r>')""",
    "dublin_core": """concat('<s:r xmlns:s="u"><x:dc xmlns:x="v" xmlns:dc="w"><dc:identifier>ark:/', id, '</dc:identifier><dc:identifier>ISBN ', isbn, '</dc:identifier><dc:title>', title, ' / by all</dc:title><dc:creator>', author, ' (1950-)</dc:creator><dc:publisher>House (Faro)</dc:publisher><dc:date>', year, '</dc:date><dc:format>', pages, ' p. ; 18 cm</dc:format><dc:subject>Art</dc:subject></x:dc></s:r>')""",
    "tei": """concat('<TEI xmlns="t"><sourceDesc><analytic><title level="a">', title, '</title><author><persName><forename>', author, '</forename></persName></author></analytic><monogr><title level="j">House</title><imprint><date when="', year, '-05"/></imprint></monogr><idno type="DOI">10.1/', id, '</idno></sourceDesc></TEI>')""",
    "opf": """concat('<package xmlns:dc="d" xmlns:opf="o"><dc:title>', title, '</dc:title><dc:creator>', author, '</dc:creator><dc:publisher>House</dc:publisher><dc:identifier opf:scheme="ISBN">', isbn, '</dc:identifier><dc:date>', year, '</dc:date></package>')""",
    "broken": """'<open'""",
}
_SOURCES = list(_J)
_PART = f"select rec_id, cast(rec_id as string) as id, isbn, title, author, cast(1950 + rec_id % 70 as string) as year, cast(100 + rec_id % 300 as string) as pages, rec_id % {len(_J)} as k from ({BOOKS}) where rec_id % 7 <> 0"
PAYLOADS = f"select rec_id as query_id, isbn, case k {' '.join(f"when {k} then '{n}'" for k, n in enumerate(_SOURCES))} end as source, case k {' '.join(f'when {k} then {v}' for k, v in enumerate(_J.values()))} end as payload from ({_PART})"
_in = lambda *names: "source in (" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    "src7_normalise_payloads",
    f"""with p as (select *, [{', '.join(f"'{n}'" for n in _SOURCES)}][k + 1] as source from ({duck(_PART)}))
      select rec_id as query_id, source, title, case when source = 'cbl' then author || '; Rui' when source = 'crossref' then author || ', A.' else author end as authors, 'House' as publisher, year,
        case when {_in('cbl', 'open_library', 'marcxml', 'dublin_core')} then pages when {_in('openalex', 'crossref')} then '1-' || pages end as pages, case when source = 'internet_archive' then 'Art; Arms' when {_in('cbl', 'openalex', 'open_library', 'marcxml', 'dublin_core')} then 'Art' else '' end as subjects,
        case when not ({_in('openalex', 'crossref', 'tei')}) then isbn end as isbn, case when {_in('openalex', 'crossref', 'tei')} then '10.1/' || id end as doi, case when {_in('hathitrust', 'marcxml', 'dublin_core')} then 'Faro' end as place,
        case source when 'internet_archive' then 'a' || id when 'openalex' then 'W' || id when 'hathitrust' then 'u' || id when 'marcxml' then id when 'dublin_core' then 'ark:/' || id end as identifier from p where source <> 'broken'""",
)
def src7(spark, sf):
    text = lambda c: F.array_join(c, "; ").alias(c)
    out = S.normalise_payloads(payload_rows(spark, sf))
    return out.select("query_id", "source", "title", text("authors"), "publisher", "year", "pages", text("subjects"), "isbn", "doi", "place", "identifier")


def payload_rows(spark, sf):
    """Braces of the payloads are text, so the table is named by a view of this query alone."""
    name = "parts_" + uuid.uuid4().hex
    table(spark, sf, "part").createOrReplaceTempView(name)
    try:
        # an exchange: the payloads are built once, not once for each source
        return spark.sql(PAYLOADS.replace("{part}", name)).repartition(spark.sparkContext.defaultParallelism, "query_id")
    finally:
        spark.catalog.dropTempView(name)


def _folder(spark) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{where}/records-{uuid.uuid4().hex}"


@query(
    "src1_read_sharded_records",
    "select sha256(text) as hash_sha256, 'd' || cast(min(doc_id) as varchar) as arquivo_origem, split_part(text, chr(10), 1) as titulo, case when min(doc_id) % 3 = 0 then min(doc_id) end as id_remoto, substr(sha256(text), 1, 2) as prefix from documents where text is not null group by text",
)
def src1(spark, sf):
    """Written by prefix of the hash and read back."""
    d = table(spark, sf, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("i"))
    fields = spark.createDataFrame([], S.RECORD_SCHEMA).schema["campos"].dataType
    record = F.struct(*[(F.substring_index("text", "\n", 1) if f.name == "titulo" else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
    rows = d.select(F.sha2("text", 256).alias("hash_sha256"), F.concat(F.lit("d"), F.col("i").cast("string")).alias("arquivo_origem"), record.alias("campos"), F.lit(None).cast("string").alias("justificativa"), F.array(F.lit("x")).alias("fontes"), F.when(F.col("i") % 3 == 0, F.col("i")).alias("id_remoto"))
    path = _folder(spark)
    S.write_sharded_records(rows, path)
    good, _ = S.read_sharded_records(spark, path, one_per_file=False)
    return good.select("hash_sha256", "arquivo_origem", F.col("campos.titulo").alias("titulo"), "id_remoto", F.regexp_extract("file", "prefix=([0-9a-f]{2})", 1).alias("prefix"))


#: Every document is a cover: its first six lines are blocks, with boxes by line number and length.
BLOCKS = "select doc_id as cover_id, line_no, line as text, case when doc_id % 3 = 0 then 'Ana the House' end as author, cast(40 + (doc_id * line_no) % 60 as double) as left_, cast(100 * line_no + (doc_id % 5) * 30 as double) as top_, cast(300 + (length(line) * 7) % 250 as double) as width_, cast(40 + (doc_id + line_no * line_no) % 50 as double) as height_, cast(20 + (doc_id * 3 + line_no * 11) % 70 as double) as mean_ from {lines} where line_no <= 6"
_BLOCKS = f"select cover_id, text, author, left_ as \"left\", top_ as \"top\", width_ as width, height_ as height, width_ * height_ as area, mean_ as mean_height from ({BLOCKS})"
_words = "regexp_extract_all(strip_accents(lower({})), '[a-z0-9]+')".format


@query(
    "ex12_cover_title",
    f"""with lines as (select doc_id, i as line_no, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as ls from documents))), b0 as ({duck(_BLOCKS)}),
      b1 as (select cover_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, {_words("text")} as w, list_distinct(list_filter({_words("coalesce(author, '')")}, lambda x: length(x) > 2)) as aw, "left" as l, "top" as t, width as wd, height as h, area, mean_height as mh from b0),
      b2 as (select *, ' ' || array_to_string(w, ' ') || ' ' as n from b1 where len(w) between 1 and 12),
      b3 as (select *, area * (1 + case when regexp_matches(n, ' ({LIFTS}) ') then 0.20::double else 0.0::double end + case when len(w) = 1 and length(w[1]) >= 4 then 0.15::double else 0.0::double end) + mh * 800 as score from b2 where not regexp_matches(n, ' ({BLURBS}) ') and not regexp_full_match(trim(n), '(19|20)[0-9]{{2}}|[0-9]{{1,3}}') and not (len(aw) > 0 and len(list_intersect(aw, w)) = len(aw))),
      m as (select * from (select cover_id, text as mt, l as ml, t as mtop, wd as mw, h as mhh, mh as mm, score as ms, list_sort(list(mh) over (partition by cover_id))[count(*) over (partition by cover_id) // 2 + 1] as med, row_number() over (partition by cover_id order by score desc, t, l, text) as rn from b3) where rn = 1),
      g as (select cover_id, mt, ms, list(text order by t, l, text) as lst from b3 join m using (cover_id) where (text = mt and t = mtop and l = ml) or (least(abs(t + h - mtop), abs(t - (mtop + mhh))) <= greatest(mhh, h, med) * 2.4::double and abs(l + wd / 2 - (ml + mw / 2)) <= greatest(mw, wd, 1.0) * 0.45::double and mh >= greatest(8.0, mm * 0.35::double)) group by all)
      select cover_id, case when len({_words("array_to_string(lst, ' ')")}) <= 12 then trim(array_to_string(lst, ' '), ' .,:;·•-') else trim(mt, ' .,:;·•-') end as title, mt as main, cast(len(lst) as int) as n_lines, round(ms, 2) as score from g""",
)
def ex12(spark, sf):
    from recordspark.sources.pages import explode_lines

    lines = explode_lines(table(spark, sf, "documents"))
    return cover_title(spark.sql(_BLOCKS.replace('"left"', "`left`").replace('"top"', "`top`"), lines=lines))


#: Titles of documents from many readers, present, missing or spoilt by rules on the id.
TITLES = """select doc_id as rec_id, case doc_id % 6 when 0 then '' when 1 then 'miolo.indd' when 2 then concat(a, ' b c d') else a end as title, case when doc_id % 5 = 0 then 'file name' else 'card' end as title_origin, case doc_id % 4 when 0 then '' when 1 then concat(a, ' revised') when 2 then z else a end as api_title, 'a subtitle' as api_subtitle, 'Ana Luz' as api_author,
  doc_id % 9 = 0 as exact_isbn, doc_id % 8 = 0 as by_title_author, doc_id % 7 = 0 as national, doc_id % 11 = 0 as trade_high, doc_id % 13 = 0 as trade_isbn, case when doc_id % 10 = 1 then 'Visual Words Here' else '' end as cover_visual, case when doc_id % 10 = 2 then 'Cover Words Here' else '' end as cover_title, case when doc_id % 10 in (3, 6) then a else '' end as pdf_title, case when doc_id % 10 = 4 then 'Copyright Line Words' else '' end as copyright_title, case when doc_id % 10 = 8 then a else '' end as first_page_title,
  case when doc_id % 3 = 0 then concat(a, ' complete works') when doc_id % 3 = 1 then 'File Words Here' else '' end as file_title from (select doc_id, array_join(slice(split(split_part(text, chr(10), 1), ' '), 1, 6), ' ') as a, array_join(slice(split(source, ' '), 1, 3), ' ') as z from {documents})"""
_DUCK_TITLES = TITLES.replace("{documents}", "documents").replace("array_join(slice(split(split_part(text, chr(10), 1), ' '), 1, 6), ' ')", "array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:6], ' ')").replace("array_join(slice(split(source, ' '), 1, 3), ' ')", "array_to_string(string_split(source, ' ')[1:3], ' ')")
_R = dict(_RULES)
_TITLE_RULES = [n for n, _ in _RULES[:20] if n != "author in title"]


def _bad(names: list[str], column: str, alias: str) -> str:
    """One of the title rules holds for a column."""
    nt = NORM.format(x="title")
    tests = " or ".join(f"coalesce({_R[n]}, false)" for n in names)
    return f"(select rec_id, {tests} as {alias} from (select rec_id, title, {nt} as nt, len(list_filter(string_split_regex(trim(title), '\\s+'), lambda w: w <> '')) as sz from (select rec_id, {column} as title from {{rows}})))"


_ok = lambda c, rows: _bad(_TITLE_RULES, c, f"bad_{c}").replace("{rows}", rows)
_weak = ", ".join(f"'{w}'" for w in WEAK_WORDS)
_strong = lambda c: f"list_filter({_words(c)}, lambda w: length(w) > 2 and w not in ({_weak}) and not regexp_full_match(w, '[0-9]+'))"
_long = lambda n: f"list_distinct(list_filter(string_split({n}, ' '), lambda w: length(w) > 2))"


@query(
    "fu9_fuse_title",
    f"""with r0 as (select rec_id, trim(title) as title, title_origin, trim(api_title) as api_title, api_subtitle, api_author, exact_isbn, by_title_author, national, trade_high, trade_isbn, cover_visual, cover_title, trim(pdf_title) as pdf_title, copyright_title, trim(first_page_title) as first_page_title, trim(file_title) as file_title from ({_DUCK_TITLES})),
      r1 as (select r0.*, length(title) >= 3 and not bad_title as ok_title, length(api_title) >= 3 and not bad_api_title as ok_api, length(cover_visual) >= 3 and not bad_cover_visual as ok_vis, length(cover_title) >= 3 and not bad_cover_title as ok_cov, length(file_title) >= 3 and not bad_file_title as ok_file, {NORM.format(x="title")} as nt_, {NORM.format(x="api_title")} as na_
        from r0 join {_ok("title", "r0")} using (rec_id) join {_ok("api_title", "r0")} using (rec_id) join {_ok("cover_visual", "r0")} using (rec_id) join {_ok("cover_title", "r0")} using (rec_id) join {_ok("file_title", "r0")} using (rec_id)),
      r2 as (select *, case when nt_ = '' or na_ = '' then 0.0 else greatest(len(list_intersect({_long("nt_")}, {_long("na_")})) / greatest(1, len(list_distinct({_long("nt_")} || {_long("na_")}))), 1 - levenshtein(nt_, na_) / greatest(length(nt_), length(na_))) end >= 0.68::double as alike, len(list_intersect({_tok("api_author", 1)}, {_tok("title", 1)})) = 2 as repeats, title_origin = 'file name' or not ok_title as faulty, api_title <> '' and (title <> '' or exact_isbn) as asked from r1),
      r3 as (select *, case when asked then case when exact_isbn and ok_api then 'exact isbn' when by_title_author and (alike or faulty) and ok_api then 'title and author' when national and not ok_title and ok_api then 'national agency' when trade_high and faulty and ok_api then 'trade listing' when alike or (trade_isbn and repeats) then 'api' end end as take from r2),
      r4 as (select *, case when take is not null then api_title else title end as t1, coalesce(take, title_origin) as o1, case when take is not null then ok_api else ok_title end as good1 from r3),
      r5 as (select *, case when cover_visual <> '' and ok_vis and not good1 then 1 when t1 <> '' and ok_cov and not good1 then 2 when t1 = '' and pdf_title <> '' then 3 when t1 = '' and cover_title <> '' then 4 else 0 end as c2 from r4),
      r6 as (select *, [t1, cover_visual, cover_title, pdf_title, cover_title][c2 + 1] as t2, [o1, 'visual title', 'cover over ocr', 'pdf metadata', 'cover'][c2 + 1] as o2 from r5),
      r7 as (select *, case when (t2 = '' or len(string_split_regex(t2, '\\s+')) < 2) and copyright_title <> '' then 1 when t2 = '' and first_page_title <> '' then 2 when t2 = '' and api_title <> '' then 3 else 0 end as c3 from r6),
      r8 as (select *, [t2, copyright_title, first_page_title, api_title][c3 + 1] as t3, [o2, 'copyright line', 'first page', 'api, other language?'][c3 + 1] as o3 from r7),
      r9 as (select r8.*, prose, {_strong("t3")} as sw, {_strong("file_title")} as fw from r8 join {_bad(["paragraph", "continued", "cut off", "sentence", "rights notice"], "t3", "prose").replace("{rows}", "r8")} using (rec_id)),
      ra as (select *, o3 in ({", ".join(f"'{c}'" for c in COMPLETED)}) and ok_file and len(sw) >= 2 and len(fw) > len(sw) and len(list_filter(sw, lambda w: list_contains(fw, w))) >= 2 and len(list_filter(sw, lambda w: list_contains(fw, w))) / len(sw) >= 0.75 as complete from r9)
      select rec_id, case when complete or (prose and ok_file) then file_title else t3 end as title, case when (case when complete or (prose and ok_file) then file_title else t3 end) = '' then '' when complete then o3 || ', completed by file name' when prose and ok_file then 'file name over prose' else o3 end as origin,
        case when take is not null then api_subtitle else '' end as subtitle, case when o3 = 'api, other language?' then '' when asked and take is null then api_title else '' end as original_title, o3 = 'api, other language?' and not exact_isbn as from_other_language from ra""",
)
def fu9(spark, sf):
    return fuse_title(run(spark, sf, TITLES, "documents"))


_FIRST = "array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:6], ' ')"
CARD = "select doc_id as rec_id, case when doc_id % {m} = 0 then '' else concat(case when doc_id % 4 = 0 then 'Luz, Ana ' else '' end, a, case when doc_id % 3 = 0 then ' / by all' when doc_id % 13 = 0 then ' miolo.indd' else '' end) end as title, case when doc_id % {n} = 0 then cast(null as string) when doc_id % 2 = 0 then 'Luz, Ana' else 'Rui Reis' end as author from (select doc_id, array_join(slice(split(split_part(text, chr(10), 1), ' '), 1, 6), ' ') as a from {{documents}}) where doc_id % {k} <> 0"
_card = lambda m, n, k: CARD.format(m=m, n=n, k=k).replace("{documents}", "documents").replace("array_join(slice(split(split_part(text, chr(10), 1), ' '), 1, 6), ' ')", _FIRST)


@query(
    "fu2_merge_catalog_cards",
    f"""with a as ({_card(3, 5, 7)}), b as ({_card(5, 2, 3)}), c as ({_card(11, 13, 1000000)}),
      j as (select c.rec_id, coalesce(nullif(trim(a.title), ''), nullif(trim(b.title), ''), nullif(trim(c.title), '')) as title, coalesce(a.author, b.author, c.author) as author, coalesce(b.author, a.author, c.author) as strong from c left join a using (rec_id) left join b on b.rec_id = c.rec_id),
      t as (select *, trim(string_split(title, '/')[1], ' .,:;-') as t1, {NORM.format(x="strong")} as who from j), u as (select *, case when who <> '' and starts_with({NORM.format(x="t1")} || ' ', who || ' ') then trim(array_to_string(string_split_regex(t1, '\\s+')[len(string_split(who, ' ')) + 1:], ' '), ' .,:;-') else t1 end as t2 from t),
      v as (select rec_id, coalesce(t2, '') as title, author from u)
      select v.rec_id, case when length(title) >= 3 and not bad_title then title end as title, author from v join {_ok("title", "v")} using (rec_id)""",
)
def fu2(spark, sf):
    from recordspark.operators.fusion import merge_catalog_cards

    cards = [run(spark, sf, CARD.format(m=m, n=n, k=k), "documents") for m, n, k in ((3, 5, 7), (5, 2, 3), (11, 13, 1000000))]
    return merge_catalog_cards(*cards, ["title", "author"])
