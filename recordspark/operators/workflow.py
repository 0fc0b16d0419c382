"""Workflow state: queues, attempts, revisions, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions import text as T

#: State names as the catalogue stores them. Fixed values.
DISCARDED, TOO_LARGE, CONFLICT, ANALYSED, READY, NEEDS_TEXT = "descartado", "excecao_tamanho", "conflito", "analisado", "pronto", "precisa OCR"
QUEUE_OF_TYPE = {"apostila": "apostilas", "artigo": "artigos", "revista": "revistas"}


def derive_state(records: DataFrame, max_bytes: int = 500_000_000) -> DataFrame:
    """rec_id, state, overall: discarded, too large, a type's queue, conflict, analysed (pending) or ready, in that order; overall needs text first.

    Rows: rec_id, discarded, bytes, type, n_conflicts, n_pending, text_ok.
    """
    queue = F.create_map(*[F.lit(x) for kv in QUEUE_OF_TYPE.items() for x in kv])[F.col("type")]
    state = F.when(F.col("discarded"), DISCARDED).when(F.col("bytes") > max_bytes, TOO_LARGE).when(queue.isNotNull(), queue).when(F.col("n_conflicts") > 0, CONFLICT).when(F.col("n_pending") > 0, ANALYSED).otherwise(READY)
    r = records.withColumn("state", state)
    return r.select("rec_id", "state", F.when(F.col("text_ok"), F.col("state")).otherwise(NEEDS_TEXT).alias("overall"))


#: Types that each queue takes, states that are ready for it, notes that do not hold back what is no book, and forms of covers. Fixed values.
QUEUE_TYPES = {
    "livro": ("livro",),
    "documento": ("documento", "apostila", "sermão", "trecho", "tese", "dissertação", "trabalho acadêmico", "apresentação", "opúsculo"),
    "artigo": ("artigo",),
    "revista": ("revista", "periódico", "boletim", "jornal"),
}
TITLE_IS_ENOUGH = ("documento", "apostila", "sermão", "trecho", "apresentação", "opúsculo")
READY_STATE, READY_ELSEWHERE = "pronto para cadastro", ("aguardando cadastro específico", "pronto para cadastro específico")
WAIVED = ("editora", "data de publicacao", "aguardar endpoint de artigos/documentos", "confirmar tela e ação da API para artigos/documentos", "aguardar endpoint de trabalhos acadêmicos/documentos", "aguardar endpoint de documentos", "aguardar endpoint de revistas/periódicos")
RIGHTS_NOTICE = "todos os direitos reservados|proibida a reproducao|reproducao total ou parcial|autorizacao previa|lei n? ?9? ?610"
COVERS = (".jpg", ".jpeg", ".png", ".gif", ".webp")


def readiness_errors(records: DataFrame, files: DataFrame, max_bytes: int = 500_000_000) -> DataFrame:
    """rec_id, errors, ready: what keeps a record from being sent to its queue.

    records: rec_id, hash, queue (livro, documento, artigo, revista), type, state, title, n_conflicts, pending (notes parted by ` | `), text_ok;
    files: rec_id, file_hash, bytes, signature (first five bytes as text), cover (ending, null without one). Documents for which a title is
    enough may have conflicts and notes.
    """
    j = records.join(files, "rec_id", "left")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    fits = F.coalesce(*[F.when(F.col("queue") == q, F.col("type").isin(*types)) for q, types in QUEUE_TYPES.items()], F.lit(False))
    ready = (F.col("state") == READY_STATE) | ((F.col("queue") != "livro") & F.col("state").isin(*READY_ELSEWHERE))
    enough = (F.col("queue") == "documento") & F.col("type").isin(*TITLE_IS_ENOUGH)
    notes = F.filter(F.split(F.coalesce("pending", F.lit("")), r"\s*\|\s*"), lambda x: (F.trim(x) != "") & ~((F.col("queue") != "livro") & F.trim(x).isin(*WAIVED)))
    rights = F.concat(F.lit(" "), T.normal(title), F.lit(" ")).rlike(f" (?:{RIGHTS_NOTICE}) ")
    long = (F.length(title) > 240) | (F.size(F.split(title, " ")) > 32)
    rules = [
        (~fits, "type of another queue"), (~ready, "not ready for this queue"), (~F.col("text_ok"), "text not approved"), ((F.col("n_conflicts") > 0) & ~enough, "conflicts"), ((F.size(notes) > 0) & ~enough, "pending"),
        (title == "", "no title"), ((title != "") & rights, "title is a rights notice"), (long & ~rights, "title too long"), (enough & ~long & ~rights & F.lower(title).rlike("^(?:resumo|abstract):"), "title is a summary"),
        (F.col("file_hash").isNull(), "no file"), (F.col("signature") != "%PDF-", "no pdf"), (F.col("bytes") > max_bytes, "file too large"), (F.col("file_hash") != F.col("hash"), "file changed"),
        (F.col("cover").isNull(), "no cover"), (~F.lower("cover").isin(*COVERS), "cover format"),
    ]
    errors = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in rules])), "; ")
    return j.select("rec_id", errors.alias("errors")).withColumn("ready", F.col("errors") == "")


def error_histogram(errors: DataFrame) -> DataFrame:
    """error, n over all records."""
    return errors.select(F.explode(F.split("errors", "; ")).alias("error")).where("error <> ''").groupBy("error").agg(F.count("*").alias("n"))


def reconcile_queue(queue: DataFrame, eligible: DataFrame, journal: DataFrame) -> DataFrame:
    """rec_id, state, change, place: the queue after new and changed records.

    queue: rec_id, state, isbn; eligible: rec_id, isbn, changed_at, created_at, name; journal: rec_id, http_status, finished_at.
    States: liberado stays for ever; a record no longer eligible is retired; a corrected ISBN, or a
    server error or local error followed by a change of the record, reopens; new ones join in (time, name) order.
    """
    last = journal.groupBy("rec_id").agg(F.max_by(F.struct("http_status", "finished_at"), F.col("finished_at")).alias("j"))
    q = queue.select("rec_id", F.col("state").alias("old"), F.col("isbn").alias("old_isbn"))
    j = q.join(eligible, "rec_id", "full").join(last, "rec_id", "left")
    later = F.col("changed_at") > F.col("j.finished_at")
    change = (
        F.when(F.col("old").isNull(), "new").when(F.col("old") == "liberado", "kept").when(F.col("created_at").isNull(), "retired")
        .when(~F.col("isbn").eqNullSafe(F.col("old_isbn")), "reset").when((F.col("old") == "erro") & ((F.col("j.http_status") >= 500) | (F.col("j.http_status") == 0)) & later, "reopened").otherwise("kept")
    )
    j = j.withColumn("change", change)
    state = F.when(F.col("change").isin("new", "reset", "reopened"), "aguardando").when(F.col("change") == "retired", "retirado").otherwise(F.col("old"))
    j = j.withColumn("state", state)
    # order within the new ones: by day first, so that no task gets all of them
    day = F.to_date("created_at")
    new = j.where("change = 'new'").withColumn("day", day)
    per_day = new.groupBy("day").agg(F.count("*").alias("c"))
    before = per_day.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = new.join(before, "day").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("created_at", "name", "rec_id")))
    out = j.where("change <> 'new'").select("rec_id", "state", "change", F.lit(None).cast("long").alias("place"))
    return out.unionByName(placed.select("rec_id", "state", "change", F.col("place").cast("long").alias("place")))


def reopen_attempts(queue: DataFrame, journal: DataFrame) -> DataFrame:
    """rec_id, reason: attempts rejected by the withdrawn ISBN rule (400) or failed before HTTP by a certificate."""
    reason = F.when((F.col("http_status") == 400) & F.lower("answer").contains("isbn obrigat"), "withdrawn rule").when(F.col("http_status").isNull() & F.lower("local_error").contains("certificate"), "before http")
    j = journal.withColumn("reason", reason).where("reason is not null").groupBy("rec_id").agg(F.min("reason").alias("reason"))
    return queue.where("state = 'erro'").join(j, "rec_id").select("rec_id", "reason")


def sync_catalogue(queue: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rec_id, state, remote_id, changed: the queue's state and id carried into the catalogue, null-safe."""
    q = queue.select("rec_id", F.when(F.col("state") == "enviado", "cadastrado").otherwise(F.col("state")).alias("q_state"), F.col("remote_id").alias("q_id"))
    j = catalogue.join(q, "rec_id", "left")
    state, rid = F.coalesce("q_state", "state"), F.coalesce("q_id", "remote_id")
    return j.select("rec_id", state.alias("state"), rid.alias("remote_id"), (~state.eqNullSafe(F.col("state")) | ~rid.eqNullSafe(F.col("remote_id"))).alias("changed"))


def record_changes(records: DataFrame, journal: DataFrame, names: dict[str, str]) -> DataFrame:
    """rec_id, signature, changed: SHA-256 of the outgoing fields as JSON (outgoing names in order, empty ones left out) against the last attempt's.

    records: rec_id, generated_at and the fields of names (own name: outgoing name); journal: rec_id, signature, finished_at.
    An attempt of before signatures were kept counts as outdated if the record was generated after it; a record never sent is changed.
    """
    body = F.to_json(F.struct(*[F.nullif(F.col(f).cast("string"), F.lit("")).alias(n) for f, n in sorted(names.items(), key=lambda x: x[1])]))
    r = records.select("rec_id", "generated_at", F.sha2(body, 256).alias("signature"))
    last = journal.groupBy("rec_id").agg(F.max_by(F.struct(F.col("signature").alias("sent"), "finished_at"), "finished_at").alias("j"))
    j = r.join(last, "rec_id", "left")
    changed = F.when(F.col("j").isNull(), True).when(F.col("j.sent").isNull(), F.col("generated_at") > F.col("j.finished_at")).otherwise(F.col("signature") != F.col("j.sent"))
    return j.select("rec_id", "signature", changed.alias("changed"))


def plan_dispatch(queues: DataFrame, limit: int) -> DataFrame:
    """queue, ord, available, uncertain, selected: one limit shared out in queue order; uncertain items wait. Rows: queue, ord, uncertain."""
    q = queues.groupBy("queue", "ord").agg(F.count_if(~F.col("uncertain")).alias("available"), F.count_if(F.col("uncertain")).alias("uncertain"))
    before = F.coalesce(F.sum("available").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per queue
    return q.withColumn("selected", F.greatest(F.lit(0), F.least(F.col("available"), F.lit(limit) - before)))


def uncertain_attempts(journal: DataFrame, lookup: DataFrame) -> DataFrame:
    """rec_id, outcome: confirmed (same ISBN or one exact match), cleared (absent) or left. lookup: rec_id, isbn, n_exact."""
    j = journal.where("unknown_result").select("rec_id", "isbn").join(lookup.select("rec_id", F.col("isbn").alias("l_isbn"), "n_exact"), "rec_id", "left")
    out = F.when((F.col("isbn") == F.col("l_isbn")) | (F.col("n_exact") == 1), "confirmed").when(F.col("n_exact") == 0, "cleared").otherwise("left")
    return j.select("rec_id", out.alias("outcome"))


def _rejection_code(answer: str = "answer", status: str = "http_status") -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(low.contains("isbn") & low.contains("obrigat"), "isbn required").when(low.contains("existe") | low.contains("duplic"), "duplicate").when(F.col(status) >= 500, "server error").otherwise("validation")


#: What to do about a rejection, and when to send again.
ACTIONS = {"isbn required": "allow records without isbn", "duplicate": "link to record", "server error": "retry later", "validation": "correct record"}
RESEND = {"isbn required": "after a change of the rule", "duplicate": "never", "server error": "after a check", "validation": "after correction"}


def _of_code(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("code")]


def rejection_report(journal: DataFrame) -> DataFrame:
    """code, action, n, n_records of rejected attempts. Rows: rec_id, http_status, answer."""
    j = journal.where("http_status >= 400").withColumn("code", _rejection_code())
    return j.withColumn("action", _of_code(ACTIONS)).groupBy("code", "action").agg(F.count("*").alias("n"), F.countDistinct("rec_id").alias("n_records"))


def rejection_cases(journal: DataFrame, records: DataFrame) -> DataFrame:
    """rec_id, title, code, action, diagnosis, resend of every record whose last attempt was rejected and that is not registered since.

    journal: rec_id, event_id, http_status, answer; records: rec_id, title, isbn_reason, registered.
    """
    last = journal.groupBy("rec_id").agg(F.max_by(F.struct("http_status", "answer"), "event_id").alias("j")).select("rec_id", "j.*").where("http_status >= 400")
    c = last.join(records.where("not registered"), "rec_id").withColumn("code", _rejection_code())
    low = F.lower(F.coalesce("isbn_reason", F.lit("")))
    natural = F.contains(low, F.lit("sem isbn")) & (F.contains(low, F.lit("original")) | F.contains(low, F.lit("sem isbn próprio")))
    diagnosis = F.when(F.col("code") == "isbn required", F.when(natural, "edition without isbn").otherwise("isbn not found yet")).when(F.col("code") == "duplicate", "already registered").when(F.col("code") == "server error", "server failed").otherwise(F.coalesce(F.nullif("answer", F.lit("")), F.lit("no message")))
    return c.select("rec_id", "title", "code", _of_code(ACTIONS).alias("action"), diagnosis.alias("diagnosis"), _of_code(RESEND).alias("resend"))


CLOSED = ("cadastrado", "liberado", "descartado", "duplicado")


def audit_revisions(revisions: DataFrame, records: DataFrame, landing: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(file, bucket), one row per bucket of a revision, and (file, field, revised, recorded), one per difference.

    revisions: file, hash and fields (null: not revised); records: file, hash, file_hash (of the file as it is now), state and fields; landing: file,
    hash of files not prepared yet. A revision belongs to the record of its hash, else of its file name. Buckets: without
    a record orphan, awaiting (its file waits in the landing folder), hash changed or no hash; with a closed one closed or closed notice (the file
    changed since); else no hash or hash changed, diverging, and ok if none of these.
    """
    kept = [F.struct("file", "file_hash", "state", *fields).alias("r")]
    by_hash = records.where("hash <> ''").groupBy("hash").agg(F.min(kept[0]).alias("r1"))
    by_name = records.groupBy("file").agg(F.min(kept[0]).alias("r2"))
    waiting = landing.groupBy("file").agg(F.min("hash").alias("l_hash"))
    j = revisions.withColumn("hash", F.coalesce("hash", F.lit(""))).join(by_hash, "hash", "left").join(by_name, "file", "left").join(waiting, "file", "left").withColumn("r", F.coalesce("r1", "r2"))
    changed = F.col("hash") != F.col("r.file_hash")
    none, closed, blank = F.col("r").isNull(), F.col("r.state").isin(*CLOSED), F.col("hash") == ""
    first = (
        F.when(none & F.col("l_hash").isNull(), "orphan").when(none & blank, "no hash").when(none, F.when(F.col("l_hash") == F.col("hash"), "awaiting").otherwise("hash changed"))
        .when(closed, F.when(~blank & changed, "closed notice").otherwise("closed")).when(blank, "no hash").when(changed, "hash changed")
    )
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    live = ~none & ~F.coalesce(closed, F.lit(False))
    differs = {f: F.coalesce(live & F.col(f).isNotNull() & (text(F.col(f)) != text(F.col(f"r.{f}"))), F.lit(False)) for f in fields}
    any_ = F.lit(False)
    for d in differs.values():
        any_ = any_ | d
    j = j.withColumn("first", first).withColumn("any", any_)
    buckets = F.array_compact(F.array(F.col("first"), F.when(F.col("any"), "diverging"), F.when(F.col("first").isNull() & ~F.col("any"), "ok")))
    rows = F.array_compact(F.array(*[F.when(d, F.struct(F.lit(f).alias("field"), text(F.col(f)).alias("revised"), text(F.col(f"r.{f}")).alias("recorded"))) for f, d in differs.items()]))
    return j.select("file", F.explode(buckets).alias("bucket")), j.select("file", F.explode(rows).alias("x")).select("file", "x.*")


def orphan_files(files: DataFrame, references: DataFrame) -> DataFrame:
    """Files that no live record refers to, with their bytes."""
    return files.join(references.select("path"), "path", "left_anti")


def release_candidates(queues: DataFrame, catalogue: DataFrame) -> DataFrame:
    """reason, n, bytes of items that may be released, and of those blocked for want of proof. queues: rec_id, state, bytes; catalogue: rec_id, remote_id, linked."""
    j = queues.join(catalogue, "rec_id", "left")
    reason = F.when((F.col("state") == "cadastrado") & F.col("remote_id").isNotNull(), "registered").when(F.col("state") == "duplicado", "duplicate").when(F.coalesce("linked", F.lit(False)), "linked").when(F.col("state") == DISCARDED, "discarded").when(F.col("state") == "cadastrado", "blocked")
    return j.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.countDistinct("rec_id").alias("n"), F.sum("bytes").alias("bytes"))


def needs_processing(items: DataFrame, done: DataFrame, revisions: DataFrame) -> DataFrame:
    """rec_id of items not done with the same hash, program version and a title, or with a newer revision.

    items: rec_id, hash, version, processed_at; done: hash, version, title; revisions: hash, revised_at.
    """
    fresh = items.join(done.where("title is not null and trim(title) <> ''").select("hash", "version"), ["hash", "version"], "left_anti").select("rec_id")
    newer = items.join(revisions.select("hash", "revised_at"), "hash").where("revised_at > processed_at").select("rec_id")
    return fresh.union(newer).distinct()


def search_targets(records: DataFrame, searched: DataFrame, engine: str, version: int, titles: list[str], authors: list[str], skip_languages: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """rec_id, file, title, author of open books to look up, by file name; most: a report's limit.

    records: rec_id, file, state, type, language and the columns of titles and authors, best first; searched: file, engine,
    version. Open: analisado or conflito. The first title and author with a word of three letters that is no filler are
    taken (an author may stay the last one); items without a title, in a language the engine does not serve, or already searched by it with
    this version are left out.
    """
    filler = "a as o os um uma de da do das dos e em the of and for in to".split()
    usable = lambda c: F.size(F.filter(T.words(F.coalesce(c, F.lit(""))), lambda w: (F.length(w) >= 3) & ~w.isin(*filler))) > 0
    first = lambda cs: F.coalesce(*[F.when(usable(c), F.trim(c)) for c in cs])
    r = records.where(F.col("state").isin(ANALYSED, CONFLICT) & (F.coalesce("type", F.lit("livro")) == "livro") & ~F.coalesce("language", F.lit("")).isin(*skip_languages, "\0"))
    r = r.select("rec_id", "file", first(titles).alias("title"), F.coalesce(first(authors), authors[-1]).alias("author")).where("title is not null")
    r = r.join(searched.where((F.col("engine") == engine) & (F.col("version") == version)).select("file").distinct(), "file", "left_anti").orderBy(F.lower("file")).select("rec_id", "file", "title", "author")
    return r.limit(most) if most else r


def register_existing(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """hash, state, is_new: unseen hashes join as `legado registrado`, known ones are refreshed unless `cadastrado`. Rows: hash, state."""
    j = files.groupBy("hash").agg(F.min("state").alias("f_state")).join(catalogue, "hash", "full")
    state = F.when(F.col("state").isNull(), F.coalesce("f_state", F.lit("legado registrado"))).when(F.col("state") == "cadastrado", F.col("state")).otherwise(F.coalesce("f_state", "state"))
    return j.select("hash", state.alias("state"), F.col("state").isNull().alias("is_new"))


def revision_history(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(hash, field, old, new) of every field that a saved decision changed."""
    melt = lambda d, v: d.select("hash", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(v)) for f in fields])).alias("x")).select("hash", "x.*")
    return melt(before, "old").join(melt(after, "new"), ["hash", "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
