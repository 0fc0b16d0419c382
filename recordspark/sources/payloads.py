"""Stored answers of catalogues to one candidate schema, and the sharded record store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.functions import text as T

#: Fields of a candidate, in order. Authors and subjects are lists.
CANDIDATE = ("title", "subtitle", "authors", "publisher", "year", "pages", "subjects", "isbn", "doi", "place", "identifier", "source")

_PARTY = "array<struct<name:string>>"
_AUTHORSHIP = "array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>"
#: What is read of each source's JSON. The names that the sources use.
JSON_SCHEMAS = {
    "cbl": "Title string, Subtitle string, Authors array<string>, Imprint string, Ano string, Paginas string, Subject string, FormattedKey string, RowKey string, PartitionKey string",
    "internet_archive": "response struct<docs:array<struct<title:string,creator:string,publisher:string,year:string,date:string,subject:string,isbn:string,identifier:string>>>",
    "openalex": f"results array<struct<display_name:string,title:string,publication_year:string,doi:string,id:string,authorships:{_AUTHORSHIP},primary_location:struct<source:struct<display_name:string>>,biblio:struct<first_page:string,last_page:string>,topics:array<struct<display_name:string>>>>",
    "crossref": "message struct<items:array<struct<title:array<string>,subtitle:array<string>,author:array<struct<given:string,family:string,name:string>>,`container-title`:array<string>,publisher:string,`published-print`:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>,page:string,DOI:string,subject:array<string>>>>",
    "open_library": f"struct<title:string,subtitle:string,authors:{_PARTY},publishers:{_PARTY},publish_date:string,number_of_pages:string,subjects:{_PARTY},key:string>",
    "hathitrust": "records map<string,struct<isbns:array<string>,titles:array<string>,authors:array<string>,publishers:array<string>,publishDates:array<string>,publishPlaces:array<string>,recordURL:string>>",
}
XML_SOURCES = ("marcxml", "dublin_core", "tei", "opf")


def _year(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?<![0-9])((?:1[5-9]|20)[0-9]{2})(?![0-9])", 1), F.lit(""))


def _list(x: Column) -> Column:
    """A JSON value that is a string or a list of strings, as a list (from_json hands lists over as their text)."""
    return F.when(F.startswith(F.trim(x), F.lit("[")), F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))


def _names(x: Column, field: str = "name") -> Column:
    return F.filter(F.transform(F.coalesce(x, F.array()), lambda a: a[field]), lambda n: n.isNotNull() & (n != ""))


def _candidate(source: str, **fields: Column) -> list[Column]:
    lists = {"authors", "subjects"}
    empty = lambda f: F.array().cast("array<string>") if f in lists else F.lit(None).cast("string")
    cast = lambda f, c: F.slice(F.coalesce(c, empty(f)), F.lit(1), F.lit(5)) if f == "subjects" else F.array_distinct(F.coalesce(c, empty(f))) if f == "authors" else F.nullif(F.trim(c.cast("string")), F.lit(""))
    return [(F.lit(source) if f == "source" else cast(f, fields[f]) if f in fields else empty(f)).alias(f) for f in CANDIDATE]


def _same_isbn(numbers: Column) -> Column:
    """One of the numbers is the one asked for, in either form."""
    return F.exists(F.coalesce(numbers, F.array().cast("array<string>")), lambda n: T.canonical_isbn(F.split(F.trim(n), " ")[0]) == F.col("asked_isbn"))


def _json(rows: DataFrame, source: str) -> DataFrame:
    schema = JSON_SCHEMAS[source]
    j = rows.withColumn("p", F.from_json("payload", schema))
    own = ["query_id", "asked_isbn"]
    one = lambda path: j.select(*own, F.explode(path).alias("d"))
    d = lambda f: F.col(f"d.{f}")
    if source == "cbl":
        p = j.select(*own, "p.*").where("Title is not null")
        return p.where(_same_isbn(F.array("RowKey", "FormattedKey"))).select("query_id", *_candidate(source, title=F.col("Title"), subtitle=F.col("Subtitle"), authors=F.col("Authors"), publisher=F.col("Imprint"), year=_year(F.col("Ano")), pages=F.col("Paginas"), subjects=F.array_compact(F.array("Subject")), isbn=F.col("asked_isbn"), identifier=F.col("PartitionKey")))
    if source == "internet_archive":
        x = one("p.response.docs").where(_same_isbn(_list(d("isbn"))))
        return x.select("query_id", *_candidate(source, title=d("title"), authors=_list(d("creator")), publisher=F.get(_list(d("publisher")), F.lit(0)), year=F.coalesce(_year(d("year")), _year(d("date"))), subjects=_list(d("subject")), isbn=F.col("asked_isbn"), identifier=d("identifier")))
    if source == "openalex":
        x = one("p.results")
        people = F.filter(F.transform("d.authorships", lambda a: a.author.display_name), lambda n: n.isNotNull())
        houses = F.concat(F.flatten(F.transform("d.authorships", lambda a: _names(a.institutions, "display_name"))), F.array_compact(F.array(d("primary_location.source.display_name"))))
        first, last = d("biblio.first_page"), d("biblio.last_page")
        pages = F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat(first, F.lit("-"), last)).otherwise(F.coalesce(first, last))
        return x.select("query_id", *_candidate(source, title=F.coalesce(d("display_name"), d("title")), authors=people, publisher=F.array_join(F.slice(F.array_distinct(houses), 1, 3), "; "), year=_year(d("publication_year")), pages=pages, subjects=_names(d("topics"), "display_name"), doi=F.replace(d("doi"), F.lit("https://doi.org/"), F.lit("")), identifier=d("id")))
    if source == "crossref":
        x = one("p.message.items")
        people = F.transform(d("author"), lambda a: F.coalesce(F.when(a.family.isNotNull(), F.concat_ws(", ", a.family, a.given)), a["name"]))
        when = F.coalesce(F.get(F.get(F.col("d.published-print.date-parts"), F.lit(0)), F.lit(0)), F.get(F.get(F.col("d.issued.date-parts"), F.lit(0)), F.lit(0)))
        return x.select("query_id", *_candidate(source, title=F.get(d("title"), F.lit(0)), subtitle=F.get(d("subtitle"), F.lit(0)), authors=people, publisher=F.coalesce(F.get(F.col("d.container-title"), F.lit(0)), d("publisher")), year=_year(when.cast("string")), pages=d("page"), subjects=d("subject"), doi=d("DOI")))
    if source == "open_library":
        x = rows.withColumn("p", F.from_json(F.expr("from_json(payload, 'map<string,string>')[concat('ISBN:', raw_isbn)]"), schema)).where("p.title is not null")
        p = lambda f: F.col(f"p.{f}")
        return x.select("query_id", *_candidate(source, title=p("title"), subtitle=p("subtitle"), authors=_names(p("authors")), publisher=F.array_join(_names(p("publishers")), "; "), year=_year(p("publish_date")), pages=p("number_of_pages"), subjects=_names(p("subjects")), isbn=F.col("asked_isbn"), identifier=p("key")))
    x = j.select(*own, F.explode(F.map_values("p.records")).alias("d")).where(_same_isbn(d("isbns")))
    text = lambda f: F.array_join(F.coalesce(d(f), F.array().cast("array<string>")), "; ")
    return x.select("query_id", *_candidate(source, title=F.get(d("titles"), F.lit(0)), authors=d("authors"), publisher=text("publishers"), year=_year(text("publishDates")), isbn=F.col("asked_isbn"), place=text("publishPlaces"), identifier=d("recordURL")))


def _plain_xml(x: Column) -> Column:
    """Markup without name spaces and declarations, so that paths need none."""
    no_head = F.regexp_replace(x, r"(?s)<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    no_ns = F.regexp_replace(no_head, r"\s+xmlns(?::\w+)?=(?:\"[^\"]*\"|'[^']*')", "")
    return F.regexp_replace(F.regexp_replace(no_ns, r"(</?)\w+:", "$1"), r"(\s)\w+:(\w+=)", "$1$2")


def _xml(rows: DataFrame, source: str) -> DataFrame:
    x = rows.withColumn("x", _plain_xml(F.col("payload")))
    at = lambda path: F.nullif(F.trim(F.expr(f"xpath_string(x, '{path}')")), F.lit(""))
    every = lambda path: F.transform(F.expr(f"xpath(x, '{path}/text()')"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    own = ["query_id", "asked_isbn"]
    if source == "marcxml":
        cut = F.transform(F.split("x", "<record(?=[ >])"), lambda r: F.concat(F.lit("<record"), F.substring_index(r, "</record>", 1), F.lit("</record>")))
        x = x.select(*own, F.explode(F.filter(cut, lambda r: F.contains(r, F.lit("<datafield")))).alias("x"))
        sub = lambda tag, code: f'//datafield[@tag="{tag}"]/subfield[@code="{code}"]'
        x = x.where(_same_isbn(every(sub("020", "a"))))
        field = lambda code: F.coalesce(at(sub("264", code)), at(sub("260", code)))
        subjects = F.concat(*[F.array_compact(F.array(F.nullif(F.array_join(every(f'//datafield[@tag="{t}"]/subfield[@code="a" or @code="x" or @code="v"]'), " -- "), F.lit("")))) for t in ("600", "610", "650", "651")])
        pages = F.nullif(F.regexp_extract(F.array_join(every(sub("300", "a")), " "), r"(?i)\b([0-9]{1,5})\s+(?:pages?|p\.?)(?:\b|\s|$)", 1), F.lit(""))
        return x.select("query_id", *_candidate(source, title=at(sub("245", "a")), subtitle=at(sub("245", "b")), authors=F.concat(every(sub("100", "a")), every(sub("700", "a"))), publisher=field("b"), year=_year(field("c")), pages=pages, subjects=subjects, isbn=F.col("asked_isbn"), place=field("a"), identifier=at('//controlfield[@tag="001"]')))
    if source == "dublin_core":
        x = x.select(*own, F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<dc[ >].*?</dc>"), F.lit(0))).alias("x"))
        numbers = F.transform(F.filter(every("//identifier"), lambda i: F.contains(F.lower(i), F.lit("isbn"))), lambda i: F.regexp_replace(i, r"(?i)isbn[: ]*", ""))
        x = x.where(_same_isbn(numbers))
        who = F.transform(every("//creator"), lambda a: F.rtrim(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(a, r"\s*\([0-9]{4}(?:-[0-9]{0,4})?\)\s*", " "), r"(?i)\.\s*(?:auteur du texte|traducteur|editeur scientifique).*$", ""), r"\s+", " ")), F.lit(" .")))
        house = at("//publisher")
        place = F.nullif(F.regexp_extract(F.coalesce(house, F.lit("")), r"\(([^()]{2,50})\)\s*$", 1), F.lit(""))
        title = F.trim(F.substring_index(at("//title"), " / ", 1))
        pages = F.nullif(F.regexp_extract(F.coalesce(at("//format"), F.lit("")), r"(?i)\b([0-9]{1,5})\s*p(?:\.|\b)", 1), F.lit(""))
        ark = F.get(F.filter(every("//identifier"), lambda i: F.contains(i, F.lit("ark:/"))), F.lit(0))
        return x.select("query_id", *_candidate(source, title=title, authors=who, publisher=F.trim(F.regexp_replace(house, r"\s*\([^()]{2,50}\)\s*$", "")), year=_year(at("//date")), pages=pages, subjects=every("//subject"), isbn=F.col("asked_isbn"), place=place, identifier=ark))
    if source == "tei":
        who = F.filter(F.transform(F.regexp_extract_all(F.regexp_extract("x", r"(?s)<analytic[ >].*?</analytic>", 0), F.lit(r"(?s)<author[ >].*?</author>"), F.lit(0)), lambda a: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(a, r"(?s)<persName.*?</persName>", 0), F.lit("")), a), r"<[^>]+>", " "), r"\s+", " "))), lambda n: n != "")
        date = F.coalesce(at("//sourceDesc//monogr//imprint/date/@when"), at("//sourceDesc//monogr//imprint/date"))
        return x.select("query_id", *_candidate(source, title=F.coalesce(at('//sourceDesc//analytic/title[@level="a"]'), at("//titleStmt/title")), authors=who, publisher=at('//sourceDesc//monogr/title[@level="j"]'), year=_year(date), subjects=every("//profileDesc//keywords//term"), doi=F.lower(at('//idno[@type="DOI" or @type="doi"]'))))
    number = F.get(F.filter(every('//identifier[contains(@scheme, "ISBN") or contains(@scheme, "isbn")]'), lambda i: T.canonical_isbn(i).isNotNull()), F.lit(0))
    who = F.filter(every("//creator"), lambda n: n != "")
    alone = F.split(F.get(who, F.lit(0)), r"(?i)\s+(?:e|and|&|;)\s+")
    two = (F.size(who) == 1) & (F.size(alone) == 2) & F.forall(alone, lambda n: F.contains(n, F.lit(" ")))
    return x.select("query_id", *_candidate(source, title=at("//title"), authors=F.when(two, alone).otherwise(who), publisher=at("//publisher"), year=_year(at("//date")), isbn=number, identifier=at('//identifier[contains(@scheme, "ASIN")]')))


def normalise_payloads(raw: DataFrame) -> DataFrame:
    """query_id and the candidate fields of every record in stored payloads (query_id, source, isbn, payload).

    Sources: cbl, internet_archive, openalex, crossref, open_library, hathitrust (JSON), marcxml,
    dublin_core, tei, opf (XML). Sources asked by ISBN keep only records that carry that ISBN in either form. Years are four
    digits, at most five subjects stay, equal authors count once. Broken payloads and unknown sources give no rows.
    """
    rows = raw.withColumn("asked_isbn", T.canonical_isbn(F.col("isbn"))).withColumn("raw_isbn", F.regexp_replace(F.coalesce("isbn", F.lit("")), "[^0-9Xx]", ""))
    rows = rows.where("payload is not null")
    out = None
    for source in (*JSON_SCHEMAS, *XML_SOURCES):
        own = rows.where(F.col("source") == source).drop("source")
        if source in XML_SOURCES:
            own = own.where(F.from_xml("payload", "a string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNull())
        part = _json(own, source) if source in JSON_SCHEMAS else _xml(own, source)
        out = part if out is None else out.unionByName(part)
    return out


#: A shared record: hash and file, the fields, and where they come from.
RECORD_SCHEMA = (
    "hash_sha256 string, arquivo_origem string, campos struct<titulo:string,subTitulo:string,nmAutor0:string,autores:array<struct<nome:string,desc:string>>,editora:string,isbn:string,data:string,edicao:string,lugar:string,nPaginas:string,cdd:string,nmLingua:string,tipo_documento:string,volume:string,series:string,tipoAssunto1:string>, "
    "justificativa string, fontes array<string>, id_remoto long"
)


def read_sharded_records(spark: SparkSession, path: str, one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of a store of JSON files, nested as deep as they may be, and what holds none (file, reason: no json or no hash).

    one_per_file: a record fills a file; else, as write_sharded_records writes them, a line. Bad
    files are reported, not fatal.
    """
    schema = RECORD_SCHEMA + ", _corrupt_record string"
    base = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", one_per_file)
    rows = base.json(path).withColumn("file", F.col("_metadata.file_path"))
    good = rows.where("hash_sha256 is not null and _corrupt_record is null").drop("_corrupt_record")
    reason = F.when(F.col("_corrupt_record").isNotNull(), "no json").otherwise("no hash")
    return good, rows.where("hash_sha256 is null or _corrupt_record is not null").select("file", reason.alias("reason"))


def write_sharded_records(records: DataFrame, path: str) -> None:
    """Writes records as JSON under prefix=<first two digits of the hash>; records without hash are refused.

    Rows meet by prefix first, so each prefix is few files, and an optional salt keeps a crowded prefix from one task.
    """
    if records.where("hash_sha256 is null").limit(1).count():
        raise ValueError("records without hash_sha256")
    cut = records.withColumn("prefix", F.substring("hash_sha256", 1, 2))
    cut.repartition("prefix", F.substring("hash_sha256", 3, 1)).write.mode("overwrite").partitionBy("prefix").json(path)
