"""What a reviewer sees: alerts, missing fields, convergence, authorities, packets and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions import text as T
from recordspark.functions.tables import dealt
from recordspark.operators.credits import after_prefix, raw_line


def missing_field_causes(records: DataFrame, required: DataFrame, aliases: DataFrame, evidence: DataFrame, rejections: DataFrame, most: int = 5) -> DataFrame:
    """(rec_id, field, causes): fields that the type requires and no evidence fills, with what is known about it.

    records: rec_id, type, pending (notes parted by ` | `); required: type, field; aliases: field, alias; evidence: rec_id, field; rejections: rec_id,
    source, reason. Causes are the pending notes that name the field; else the first source rejections of the record (five at
    most, a report); else a default.
    """
    need = records.join(required, "type").select("rec_id", "field").join(evidence.select("rec_id", "field").distinct(), ["rec_id", "field"], "left_anti")
    notes = records.select("rec_id", F.explode(F.split(F.coalesce("pending", F.lit("")), r"\s*\|\s*")).alias("note")).where("note <> ''")
    named = need.join(notes, "rec_id").join(aliases, "field").where(F.contains(F.lower("note"), F.lower("alias")))
    named = named.groupBy("rec_id", "field").agg(F.array_join(F.sort_array(F.collect_set("note")), "; ").alias("named"))
    rank = F.row_number().over(Window.partitionBy("rec_id").orderBy("source", "reason"))
    why = rejections.where("source <> '' and reason <> ''").select("rec_id", "source", "reason").distinct().withColumn("rn", rank).where(F.col("rn") <= most)
    why = why.groupBy("rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "source", "reason"))), lambda x: F.concat(x.source, F.lit(": "), x.reason)), "; ").alias("why"))
    out = need.join(named, ["rec_id", "field"], "left").join(why, "rec_id", "left")
    return out.select("rec_id", "field", F.coalesce("named", "why", F.lit("no cause recorded")).alias("causes"))


def source_outcomes(consulted: DataFrame) -> DataFrame:
    """rec_id, source, outcome (ok or no result), n: what each consulted source gave. consulted: rec_id, source, found."""
    g = consulted.groupBy("rec_id", "source").agg(F.max("found").alias("f"), F.count_if("found").alias("n"))
    return g.select("rec_id", "source", F.when(F.col("f"), "ok").otherwise("no result").alias("outcome"), "n")


STRONG_TITLE, STRONG_AUTHOR = ("cip", "isbn", "cover"), ("cip", "isbn", "authority")


def convergence(records: DataFrame) -> DataFrame:
    """rec_id, converged, reason, year, publisher: books whose title and author have strong origins and one more support.

    Support is a confirmed ISBN, a publisher or a four-digit year; the missing ones of a converged record become [s.d.] and [s.n.].
    """
    support = F.col("isbn_confirmed") | (F.coalesce("publisher", F.lit("")) != "") | F.coalesce("year", F.lit("")).rlike("^(1[5-9]|20)[0-9]{2}$")
    reason = (
        F.when(F.col("type") != "livro", "not a book").when(F.col("n_conflicts") > 0, "conflict").when(F.col("derived"), "derived copy")
        .when(~F.col("title_origin").isin(*STRONG_TITLE), "weak title").when(~F.col("author_origin").isin(*STRONG_AUTHOR), "weak author").when(~support, "no support").otherwise("ok")
    )
    fill = lambda c, v: F.when((F.col("reason") == "ok") & (F.coalesce(c, F.lit("")) == ""), v).otherwise(F.col(c))
    r = records.withColumn("reason", reason)
    return r.select("rec_id", (F.col("reason") == "ok").alias("converged"), "reason", fill("year", "[s.d.]").alias("year"), fill("publisher", "[s.n.]").alias("publisher"))


#: What may follow a one-word periodical on its line. Fixed values.
AFTER_NAME = "(?:vol(?:ume)?|v|n|issue|ano|[0-9]{1,3}|janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|january|february|march|april|may|june|july|august|september|october|november|december)"


def identify_periodical(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, periodical: an ISSN beats all; else the alias that stands first in the text.

    docs: doc_id, text; dictionary: periodical, alias, issn. An alias of several words counts anywhere, one of a
    single word alone on its line or before a volume, number or month. Texts and aliases meet by
    the ISSN, the first word of the line, or the alias's first word, never by comparing all with all.
    """
    text = F.coalesce("text", F.lit(""))
    d = dictionary.select("periodical", T.normal(F.col("alias")).alias("a"), F.upper(F.regexp_replace("issn", "[^0-9Xx]", "")).alias("issn")).where("periodical is not null")
    numbers = F.transform(F.regexp_extract_all(F.upper(text), F.lit("[0-9]{4}[ -]?[0-9]{3}[0-9X]"), F.lit(0)), lambda x: F.regexp_replace(x, "[ -]", ""))
    by_issn = docs.select("doc_id", F.explode(F.array_distinct(numbers)).alias("issn")).join(d.where("length(issn) = 8").select("issn", "periodical").distinct(), "issn").select("doc_id", F.lit(-1).cast("long").alias("at"), "periodical")
    ls = F.transform(F.split(text, "\n"), lambda x: T.normal(x))
    lines = docs.select("doc_id", F.posexplode(ls).alias("pos", "n")).where("n <> ''")
    one = lines.withColumn("a", F.substring_index("n", " ", 1)).join(d.where("a <> '' and not contains(a, ' ')").select("a", "periodical").distinct(), "a")
    rest = F.substring(F.col("n"), F.length("a") + 2, F.length("n"))
    one = one.where((F.col("n") == F.col("a")) | rest.rlike(f"^{AFTER_NAME}(?: |$)")).select("doc_id", (F.col("pos") * 1000).cast("long").alias("at"), "periodical")
    whole = docs.select("doc_id", T.normal(text).alias("n"))
    first = whole.select("doc_id", F.explode(F.array_distinct(F.split("n", " "))).alias("w")).join(d.where("contains(a, ' ')").select("a", "periodical", F.substring_index("a", " ", 1).alias("w")).distinct(), "w")
    many = first.join(whole, "doc_id").withColumn("at", F.expr("instr(concat(' ', n, ' '), concat(' ', a, ' '))")).where("at > 0").select("doc_id", (F.col("at") - 1).cast("long").alias("at"), "periodical")
    every = by_issn.unionAll(one).unionAll(many)
    return every.groupBy("doc_id").agg(F.min_by("periodical", F.struct("at", "periodical")).alias("periodical"))


#: Words of institutions, suffixes and particles of names, and credit lines by role, later ones first. Fixed values.
INSTITUTIONS = "igreja|convencao|associacao|sociedade|ministerio|seminario|universidade|departamento|instituto|conselho|comissao|university|institute|church|press|society"
SUFFIXES = ("junior", "júnior", "filho", "neto", "sobrinho", "segundo", "terceiro", "jr")
NAME_PARTICLES = ("van", "von", "de", "da", "do", "dos", "das", "del")
ROLE_LABELS = (
    ("Tradutor", "translated by", "", 2), ("Prefácio", "foreword by", "", 2), ("Editor", "edited by", "", 2),
    ("Tradutor", "traducao", ":", 1), ("Coordenador", "coordenacao", ":", 1), ("Organizador", "organizacao", ":", 1), ("Editor", "editor", ":", 1),
    ("Coordenador", "coordenador", "()", 1), ("Organizador", "organizador", "()", 1), ("Editor", "editor", "()", 1),
)


def credited(lines: str, label: str, sign: str) -> Column:
    """Column: the names that lines give with a label (plain words): after it, and a colon where the sign is one, or before it in brackets."""

    def one(x: Column) -> Column:
        raw = raw_line(x)
        if sign == "()":
            value = F.substring(raw, 1, F.length(F.regexp_extract(T.plain(raw), rf"^(.+)\({label}\)[ \t.-]*$", 1)))
        else:
            particle = f"(?: de| por)?[ \t]*{sign}" if sign else ""
            value = after_prefix(raw, f"^({label}{particle})(?:[^a-z0-9]|$)")
        return F.trim(F.coalesce(value, F.lit("")), F.lit(" \t"))

    return F.filter(F.transform(lines, one), lambda v: F.length(v).between(3, 90) & ~F.contains(v, F.lit("|")))



def _name_word(w: Column) -> Column:
    """A word of a name as it is written: initials with a point, particles small, Junior, Mc and Mac names, others with a capital."""
    bare, low = F.rtrim(w, F.lit(".")), F.lower(w)
    title = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))
    tail = lambda x, k: F.substring(x, F.lit(k), F.length(x))
    return (
        F.when(bare.rlike(r"^\p{L}$"), F.concat(F.upper(bare), F.lit("."))).when(low.isin(*NAME_PARTICLES), low).when(low.isin("jr", "jr."), "Junior")
        .when(F.startswith(low, F.lit("mc")) & (F.length(w) > 2), F.concat(F.lit("Mc"), title(tail(w, 3)))).when(F.startswith(low, F.lit("mac")) & w.rlike(r"^...\p{Lu}."), F.concat(F.lit("Mac"), title(tail(w, 4)))).otherwise(title(w))
    )


def inverted_name(name: Column) -> Column:
    """`Surname, Given`: the last word, with the particle or family suffix that belongs to it; one word stays."""
    ws = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    n = F.size(ws)
    last, before = F.element_at(ws, -1), F.lower(F.get(ws, n - 2))
    two = (n >= 3) & (F.lower(F.rtrim(last, F.lit("."))).isin(*SUFFIXES) | before.isin(*NAME_PARTICLES))
    cut = F.when(two, n - 2).otherwise(n - 1)
    form = lambda words: F.array_join(F.transform(words, _name_word), " ")
    surname, given = form(F.slice(ws, cut + 1, n)), form(F.slice(ws, F.lit(1), cut))
    surname = F.concat(F.upper(F.substring(surname, 1, 1)), F.substring(surname, F.lit(2), F.length(surname)))
    sides = F.split(name, r"\s*,\s*", 2)
    given_as = F.concat(form(F.split(F.trim(F.get(sides, F.lit(0))), r"\s+")), F.lit(", "), form(F.split(F.trim(F.get(sides, F.lit(1))), r"\s+")))
    return F.when(F.contains(name, F.lit(",")), given_as).when(n <= 1, name).otherwise(F.concat(surname, F.lit(", "), given))


def link_author_authority(records: DataFrame, authors: DataFrame) -> DataFrame:
    """rec_id, position, name, how (authority, institution, rule or unmatched), role of each co-author.

    records: rec_id, author, credits (text with credit lines, may be null); authors: authority. Co-authors are
    parted by `;`, `&`, `e`, `y` and `and`; a known author takes the authority's form, institutions stay, other names are written
    `Surname, Given`. A role comes from the last kind of credit line that names the person; without one it is Autor, or
    Colaborador where somebody else is editor, organiser or coordinator.
    """
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("author", F.lit("")), r"\s+", " "), r"(?i)\s*;\s*| (?:&|e|y|and) "), lambda x: F.trim(x, F.lit(" ,;"))), lambda x: x != "")
    in_words = lambda x: F.transform(x, lambda v: F.struct(T.words(v).alias("words"), T.normal(v).alias("line")))
    found = [F.struct(F.lit(role).alias("role"), in_words(credited("lines_", label, sign)).alias("names"), F.lit(least).alias("least")) for role, label, sign, least in ROLE_LABELS]

    def role_of(x: Column) -> Column:
        named = lambda f: F.exists(f.names, lambda v: F.contains(v.line, x.line) | F.contains(x.line, v.line) | (F.size(F.array_intersect(x.words, v.words)) >= f.least))
        return F.when((F.size("found") > 0) & (x.line != ""), F.get(F.filter("found", named), F.lit(0)).role)

    # what is credited is read once a record, in a projection of its own, and only where there is something
    p = dealt(records.select("rec_id", "author", "credits")).withColumn("lines_", F.split(F.coalesce("credits", F.lit("")), "\n"))
    p = p.select("rec_id", parts.alias("parts"), F.when(F.col("credits") != "", F.filter(F.array(*found), lambda f: F.size(f.names) > 0)).alias("found"))
    p = p.withColumn("parts", F.transform("parts", lambda x: F.struct(x.alias("raw"), T.words(x).alias("words"), T.normal(x).alias("line"))))
    p = p.select("rec_id", F.transform("parts", lambda x: F.struct(x.raw.alias("raw"), role_of(x).alias("role"))).alias("people"))
    led = F.exists("people", lambda x: F.coalesce(x.role.isin("Editor", "Organizador", "Coordenador"), F.lit(False)))
    # outer: else a test of the array's size is put before it, which works out all of it again
    p = p.select("rec_id", led.alias("led"), F.posexplode_outer("people").alias("position", "x")).where("position is not null").select("rec_id", "led", "position", "x.raw", "x.role")
    known = authors.groupBy(T.author_key(F.col("authority")).alias("key")).agg(F.min("authority").alias("authority")).where("key is not null")
    j = p.withColumn("key", T.author_key(F.col("raw"))).join(known, "key", "left")
    house = F.concat(F.lit(" "), T.normal(F.col("raw")), F.lit(" ")).rlike(f" (?:{INSTITUTIONS}) ")
    how = F.when(F.col("authority").isNotNull(), "authority").when(house, "institution").when(F.contains("raw", F.lit(" ")), "rule").otherwise("unmatched")
    name = F.when(F.col("authority").isNotNull(), F.col("authority")).when(house | ~F.contains("raw", F.lit(" ")), F.col("raw")).otherwise(inverted_name(F.col("raw")))
    return j.select("rec_id", "position", name.alias("name"), how.alias("how"), F.coalesce("role", F.when(F.col("led"), "Colaborador").otherwise("Autor")).alias("role"))


#: Types and the queue and remote kind they go to. Fixed values.
ROUTES = (("apostila", "apostilas", "handout"), ("artigo", "artigos", "article"), ("revista", "revistas", "issue"))
TERMINAL = ("cadastrado", "liberado", "duplicado")


def route_queues(records: DataFrame, previous: DataFrame, held_titles: DataFrame) -> DataFrame:
    """rec_id, queue, kind, state of non-books: terminal states stay, an exactly held title is confirmed, else waiting for a fix or ready.

    records: rec_id, type, title, n_errors; previous: rec_id, state; held_titles: title.
    """
    routes = F.broadcast(records.sparkSession.createDataFrame(ROUTES, "type string, queue string, kind string"))
    r = records.join(routes, "type").withColumn("key", T.normal(F.col("title")))
    held = held_titles.select(T.normal(F.col("title")).alias("key"), F.lit(True).alias("held")).where("key <> ''").distinct()
    j = r.join(previous.select("rec_id", F.col("state").alias("old")), "rec_id", "left").join(held, "key", "left")
    state = F.when(F.col("old").isin(*TERMINAL), F.col("old")).when(F.col("held"), "cadastrado").when(F.col("n_errors") > 0, "aguardando correcao").otherwise("pronto")
    return j.select("rec_id", "queue", "kind", state.alias("state"))


def review_packets(records: DataFrame, gaps: DataFrame, conflicts: DataFrame, most: int = 100) -> DataFrame:
    """rec_id, n_gaps, gaps, conflicts, action of the open items with most gaps first: a report of at most so many."""
    g = gaps.groupBy("rec_id").agg(F.count("*").alias("n_gaps"), F.array_join(F.sort_array(F.collect_list("field")), ", ").alias("gaps"))
    c = conflicts.groupBy("rec_id").agg(F.array_join(F.sort_array(F.collect_set("field")), ", ").alias("conflicts"))
    j = records.where("open").select("rec_id").join(g, "rec_id", "left").join(c, "rec_id", "left")
    action = F.when(F.col("conflicts").isNotNull(), "decide").when(F.col("n_gaps") > 0, "complete").otherwise("approve")
    return j.select("rec_id", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("gaps", F.lit("")).alias("gaps"), F.coalesce("conflicts", F.lit("")).alias("conflicts"), action.alias("action")).orderBy(F.desc("n_gaps"), "rec_id").limit(most)


def full_packets(records: DataFrame, causes: DataFrame, conflicts: DataFrame, pages: DataFrame, contradictions: DataFrame, most: int = 100, chosen: DataFrame | None = None) -> DataFrame:
    """rec_id, n_gaps, gaps (field: causes), conflicts, pages, contradictions, action: the packets with why, where to look, and what speaks against the type.

    causes: rec_id, field, causes, as missing_field_causes() gives them; pages: rec_id, page_no of review_pages(); contradictions: rec_id,
    contradictions of type_signals(). The items are chosen first, so only theirs, `most` at the most, are gathered from the other tables.
    chosen: the rows of review_packets(), where the caller has them; causes, pages and contradictions then need only their items.
    """
    chosen = F.broadcast((review_packets(records, causes, conflicts, most) if chosen is None else chosen).select("rec_id", "n_gaps", "conflicts", "action"))  # at most `most` rows
    own = lambda d: d.join(chosen.select("rec_id"), "rec_id", "left_semi")
    told = own(causes).groupBy("rec_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "field", "causes"))), " | ").alias("gaps"))
    where = own(pages).groupBy("rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("page_no")), lambda n: n.cast("string")), ", ").alias("pages"))
    against = own(contradictions).where("contradictions <> ''").groupBy("rec_id").agg(F.array_join(F.sort_array(F.collect_set("contradictions")), "; ").alias("contradictions"))
    j = chosen.join(told, "rec_id", "left").join(where, "rec_id", "left").join(against, "rec_id", "left")
    action = F.when((F.col("action") == "approve") & F.col("contradictions").isNotNull(), "check type").otherwise(F.col("action"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return j.select("rec_id", "n_gaps", blank("gaps"), "conflicts", blank("pages"), blank("contradictions"), action.alias("action"))


def reprocess_targets(catalogue: DataFrame, revisions: DataFrame, fields: list[str]) -> DataFrame:
    """rec_id, why: open items, and items not closed whose approved revision differs in a field; duplicates are left out.

    catalogue: rec_id, file, state and fields; revisions: file, approved and fields.
    """
    r = revisions.where("approved").select("file", *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("has"))
    j = catalogue.where("state <> 'duplicado'").join(r, "file", "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"r_{f}"))
    why = F.when(F.col("state").isin("analisado", "conflito", "precisa OCR"), "open").when((F.col("state") != "cadastrado") & F.col("has") & differs, "revised")
    return j.select("rec_id", why.alias("why")).where("why is not null").distinct()
