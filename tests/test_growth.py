"""Work that must grow with the input: what a plan writes out again, or a step reads again."""

from recordspark.operators.extract import publication_year
from recordspark.operators.scopes import document_scopes


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cut_once_for_a_year(spark):
    """Not once for each line, which made a text of n lines cost n squared."""
    many = "\n".join(["no date", "x"] * 3000)
    rows = [(1, f"{many}\n© 1990 A\nISBN 1\n{many}"), (2, f"{many}\nPublished here\nin 1984"), (3, many), (4, None), (5, f"1st edition 2001\n{many}\n© MCMXCIV"), (6, "© 19901\nISBN 2"), (7, "Seen in 1984"), (7, "Seen in 1985, published")]
    years = publication_year(spark.createDataFrame(rows, "doc_id long, text string"), latest=2026)
    assert _plan(years).count("split(coalesce(text") == 1
    assert sorted(map(tuple, years.collect())) == [(1, 1990, "credit"), (2, 1984, "anchored"), (5, 2001, "edition"), (6, 1990, "credit"), (7, 1985, "anchored")]


PAGES = [(1, 1, "Copyright 2001 Ana Luz\nEditora Mar"), (1, 2, "x"), (1, 3, None), (2, 2, "Título: Casa\nresumo"), (None, 1, "x")]


def test_pages_are_counted_without_a_join(spark):
    """Counts joined from the side are so small that one task got every document's text."""
    d = document_scopes(spark.createDataFrame(PAGES, "doc_id long, page_no int, text string"))
    assert "Join" not in _plan(d)
    assert sorted((r.doc_id, r.n_text, r.short_share, r.page1, r.first3) for r in d.collect()) == [(1, 2, 1.0, PAGES[0][2], PAGES[0][2] + "\nx\n"), (2, 1, 1.0, "", PAGES[3][2])]
