"""Named alerts on titles, authors and publishers, as rules over their plain forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.functions import text as T

#: Phrases and words of the rules, in plain form (lower case, no accents), as alternatives of a pattern. Fixed values.
PHRASES = {
    "card text": "camara brasileira do livro|dados de catalogacao|c ip",
    "digitisation page": "test target|image evaluation|microfiche|microreproductions?|cihm|icmh|lura document|digitized by the internet archive",
    "rights notice": "todos os direitos reservados|proibida a reproducao|reproducao total ou parcial|autorizacao previa|lei n? ?9? ?610",
    "promotion": "(?:este|esse) e ?book (?:foi )?disponibilizado|totalmente gratuito para voce|instagram com|youtube com|paypal com|(?:leia|aponte) (?:[a-z0-9]+ ){0,5}qr ?code",
    "series list": "livro adotado como manual de estudo",
    "cover text": "apresentacao|com prefacio|prefacio de",
    "author sentence": "qualquer pessoa|desde que|leitura incrivel|deseja prosperar|horas que|novo livro",
    "author lead-in": "follows|delves|looks|explores|unpacks|takes|considers|examines|asks|seeks|investigates|traces|discusses|reflects|outlines|explains|reviews|starting out",
    "author is a title or house": "oracao|eleitos|livres|editora|publicacao|publicacoes",
    "publisher sentence": "com a devida autorizacao|enigmas? e|contradicao|contradicoes|traduzido por|todos os direitos",
    "institution": "association|foundation|ministry|ministries|associacao|fundacao|instituto|institute",
}
#: Beginnings of titles, last words of cut titles, words of no author, and words that do not make a name. Fixed values.
PROMOTION_STARTS = "faca doacao|faca uma doacao|siga nos|clique aqui|acesse|visite"
SENTENCE_STARTS = "por causa|faca|este livro|o novo livro|qualquer pessoa|quando|porque|espero que|dedico|agradeco"
CONNECTIVES = "a ao aos as com da das de do dos e em na nas no nos para pela pelas pelo pelos por the of to with and".split()
NO_AUTHOR = "comentario biblico hermeneutica estudos conhecido testamento vangelho cristo capitulo sumario tcc revista pdf vocabulario bibliografia indice organizacao organizador coordenacao coordenador missionarios figuras livro digital ebook diario diarios sermon sermones tomo volume uso pessoal consentimento proprietario direitos isencao responsabilidade".split()
NAME_FILLERS = "de da do das dos e and por organizador organizada editor".split()
LONE_LETTERS = "a o e y".split()
APPLICATION = r"apresentacao do powerpoint|microsoft (?:word|powerpoint)|untitled|sem titulo|documento ?[0-9]*"


def _has(plain: Column, phrases: str) -> Column:
    return F.concat(F.lit(" "), plain, F.lit(" ")).rlike(f" (?:{phrases}) ")


def title_alerts(title: Column, author: Column) -> list[tuple[str, Column]]:
    """(name, condition) of every rule on titles."""
    t = F.coalesce(title, F.lit(""))
    n, low, ws = T.normal(t), T.plain(t), F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    size, words = F.size(ws), T.words(t)
    lone = F.filter(words, lambda w: (F.length(w) == 1) & ~w.isin(*LONE_LETTERS) & ~w.rlike("[0-9]"))
    names = lambda x: F.array_distinct(F.filter(T.words(F.coalesce(x, F.lit(""))), lambda w: (F.length(w) > 1) & ~w.isin(*NAME_FILLERS)))
    return [
        ("card text", _has(n, PHRASES["card text"])),
        ("digitisation page", _has(n, PHRASES["digitisation page"])),
        ("label", low.rlike(r"^\s*(?:categoria|assunto|classificacao)\s*:")),
        ("layout file", low.rlike(r"\.(?:indd|p65|docx?|pdf)\b")),
        ("application default", n.rlike(f"^(?:{APPLICATION})$")),
        ("odd signs", t.rlike("[$*]")),
        ("only a year", t.rlike(r"^\s*(?:19|20)[0-9]{2}\s*$")),
        ("lesson number", n.rlike("^(?:aula|estudo|licao|classe) ?(?:n |no )?[0-9]{1,3}$")),
        ("cataloguer", low.rlike(r"\bcrb\s*[-–]?\s*[0-9]")),
        ("rights notice", _has(n, PHRASES["rights notice"])),
        ("promotion", _has(n, PHRASES["promotion"]) | n.rlike(f"^(?:{PROMOTION_STARTS})(?: |$)")),
        ("paragraph", (size > 35) | (F.length(t) > 240)),
        ("cut off", (size >= 8) & F.element_at(words, -1).isin(*CONNECTIVES)),
        ("ocr pieces", F.size(lone) >= 2),
        ("lone letter first", t.rlike(r"^\s*[B-DF-HJ-NP-Z]\s+\p{Lu}") & (size >= 5)),
        ("series list", (F.length(t) - F.length(F.replace(t, F.lit("#"), F.lit(""))) >= 3) | _has(n, PHRASES["series list"])),
        ("sentence", (size >= 10) & n.rlike(f"^(?:{SENTENCE_STARTS})(?: |$)")),
        ("continued", t.rlike(r"^\p{Ll}") & (size >= 7)),
        ("cover text", (size >= 12) & _has(n, PHRASES["cover text"])),
        ("author in title", (F.size(names(author)) > 0) & (F.size(F.array_except(names(author), names(t))) == 0)),
    ]


def author_alerts(author: Column) -> list[tuple[str, Column]]:
    """(name, condition) of every rule on authors."""
    a = F.coalesce(author, F.lit(""))
    n, low = T.normal(a), T.plain(a)
    start = low.rlike(r"(?:^|,\s*)(?:por|de|do|da|organizacao|coordenacao)\s*:?\s+")
    return [
        ("author is a fragment", start | F.exists(T.words(a), lambda w: w.isin(*NO_AUTHOR))),
        ("author implausible", (a != "") & ((F.length(n) < 5) | a.rlike("[0-9]"))),
        ("author sentence", (F.size(F.filter(F.split(F.trim(a), r"\s+"), lambda w: w != "")) > 8) | _has(n, PHRASES["author sentence"])),
        ("author lead-in", _has(n, PHRASES["author lead-in"])),
        ("author punctuation", a.rlike("[?:]")),
        ("author is a title or house", a.rlike("[()]") | _has(n, PHRASES["author is a title or house"])),
    ]


def publisher_alerts(publisher: Column, author: Column) -> list[tuple[str, Column]]:
    """(name, condition) of every rule on publishers."""
    p = F.coalesce(publisher, F.lit(""))
    long = lambda x: F.array_distinct(F.filter(T.words(F.coalesce(x, F.lit(""))), lambda w: F.length(w) > 2))
    inside = lambda x, y: F.size(F.array_except(long(x), long(y))) == 0
    same = (F.size(long(author)) >= 2) & (p != "") & ~_has(T.normal(p), PHRASES["institution"]) & (inside(author, p) | inside(p, author))
    return [("publisher odd signs", p.rlike("[$*]")), ("publisher sentence", _has(T.normal(p), PHRASES["publisher sentence"])), ("publisher is author", same)]


def _said(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules]))


def plausible_title(title: Column) -> Column:
    """At least three characters and no title alert."""
    t = F.coalesce(title, F.lit(""))
    none = F.lit(True)
    for _, c in title_alerts(t, F.lit("")):
        none = none & ~F.coalesce(c, F.lit(False))
    return (F.length(F.trim(t)) >= 3) & none


def plausibility_alerts(records: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """rec_id, alerts: names of the rules that a record's title, author or publisher breaks, in rule order.

    noise (rec_id, field, reason), as noise_match finds it in the memory of known noise, adds `title
    noise: reason` and `author noise: reason` in front.
    """
    t, a, p = F.col("title"), F.col("author"), F.col("publisher")
    said = _said([*title_alerts(t, a), *author_alerts(a), *publisher_alerts(p, a)])
    if noise is None:
        return records.select("rec_id", F.array_join(said, "; ").alias("alerts"))
    known = noise.groupBy("rec_id").agg(F.sort_array(F.collect_set(F.concat("field", F.lit(" noise: "), "reason"))).alias("known"))
    r = records.select("rec_id", said.alias("said")).join(known, "rec_id", "left")
    return r.select("rec_id", F.array_join(F.concat(F.coalesce("known", F.array().cast("array<string>")), "said"), "; ").alias("alerts"))


def alert_profile(alerts: DataFrame) -> DataFrame:
    """alert, n over all records."""
    return alerts.select(F.explode(F.split("alerts", "; ")).alias("alert")).where("alert <> ''").groupBy("alert").agg(F.count("*").alias("n"))
