"""Queries of the catalog on tables of a few rows."""

from textloom import catalog


def test_skip_source_keeps_every_document(spark, tmp_path):
    rows = [(1, "a\nb", "en", "x", 3), (2, "c\nd", "en", "x", 3), (3, "e\nf", "de", "y", 3), (4, "g", "de", "y", 1), (5, "h", "en", "y", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.skip_source(spark, str(tmp_path)).collect()))
    assert got == [(1, 1, "b"), (2, 1, "d"), (3, 0, "e"), (3, 1, "f"), (4, 0, "g")]


def test_soup_nodes_are_a_tree(spark):
    from textloom.operators.blocks import DOC, candidates, flatten, uncovered
    from textloom.sources.books import nodes
    from textloom.sources.tables import page_documents, soup_nodes

    html = '<title>no</title>lead<div><p class="a b">one <b>two<br>three<i x="1">four</b> five</p>gap<ul><li>six<li><a href="/x">seven</a></ul>end'
    n = soup_nodes(html)
    assert [(x["element_path"], x["tag"], x["txt"], x["tail"]) for x in n] == [
        ("", "body", "lead", None), ("1", "p", "one ", "gap"), ("1.1", "b", "two", " five"), ("1.1.1", "br", "", "three"), ("1.1.2", "i", "four", ""),
        ("2", "li", "six", ""), ("3", "li", "", "end"), ("3.1", "a", "seven", ""),
    ]
    assert [(x["pre"], x["post"], x["parent"]) for x in n] == [(0, 7, -1), (1, 4, 0), (2, 4, 1), (3, 3, 2), (4, 4, 2), (5, 5, 0), (6, 7, 0), (7, 7, 6)]
    assert n[1]["classes"] == ["a", "b"] and n[4]["attrs"] == [("x", "1")] and soup_nodes(None)[0]["post"] == 0
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id long, html string")
    c = candidates(nodes(page_documents(pages)))
    got = {(r["book_id"], r["raw"]) for r in flatten(c.where("root is not null"), [*DOC, "root"]).collect()}
    assert got == {("1", "one two\nthreefour five"), ("1", "six"), ("1", "seven"), ("3", "")}
    assert sorted(r["element_path"] for r in uncovered(c).collect()) == ["", "1", "3"]


def test_recipes_over_lines(spark, tmp_path):
    rows = [(12, "Head\nA one\nlow\n\nlow two\nB", "en", "x", 3), (3, "low", "en", "x", 3), (4, "", "de", "y", 1), (5, None, "de", "y", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.recipe_joins(spark, str(tmp_path)).collect()))
    assert got == [
        (3, "heading", "0001", "Document 3"), (3, "rest", "0002", "low"), (4, "heading", "0001", "Document 4"),
        (12, "heading", "0001", "Document 12"), (12, "sentence", "0002", "Head"), (12, "sentence", "0003", "A one low low two"), (12, "sentence", "0004", "B"),
    ]
    got = sorted(map(tuple, catalog.recipe_edits(spark, str(tmp_path)).where("doc_id = 12").collect()))
    assert got == [
        (12, "digit", "front.002", "1"), (12, "line", "front.003", "A one"), (12, "line", "front.004", "low"), (12, "line", "front.005", ""), (12, "line", "front.006", "low two"), (12, "line", "front.007", "B"),
        (12, "name", "front.001", "Paper"), (12, "note", "front:1", "Document 12/1"),
    ]


def test_a_recipe_asks_its_checks_at_once(spark, tmp_path, monkeypatch):
    from textloom.plans import compiler

    asked = []
    run = compiler.Checks.run
    monkeypatch.setattr(compiler.Checks, "run", lambda self: (asked.append(len(self.queries)), run(self)))
    rows = [(1, "A\nb", "en", "x", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.recipe_edits(spark, str(tmp_path)).count() == 4
    assert len(asked) == 2 and sum(asked) >= 15  # one action for the plan, one for the records


def test_pages_leave_a_worker_in_small_batches():
    import pyarrow as pa

    from textloom.sources.tables import page_documents

    class Pages:  # calls the function as a worker does
        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            every = [(k, "<p>a <b>b</b></p>" * (5000 if k == 50 else 40)) for k in range(300)]
            return list(f(iter([pa.RecordBatch.from_pylist([{"page_id": k, "html": h} for k, h in every])])))

    got = page_documents(Pages())
    assert [x for b in got for x in b["book_id"].to_pylist()] == [str(k) for k in range(300)]
    sizes = [(b.num_rows, sum(map(len, b["nodes"].to_pylist()))) for b in got]
    assert all(n <= 4096 or pages == 1 for pages, n in sizes) and sum(n for _, n in sizes) == 299 * 81 + 10001


def _dealt_out(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _written(monkeypatch, *modules):
    """Exchanges in the plan of each table that the modules write, in order."""
    from textloom import storage

    found = []
    for m in modules:
        monkeypatch.setattr(m, "written", lambda df, **options: (found.append(_dealt_out(df)), storage.written(df, **options))[1])
    return found


def test_blocks_are_dealt_out_once(spark, tmp_path, monkeypatch):
    from textloom.operators.blocks import blocks
    from textloom.plans import compiler
    from textloom.sources.tables import line_documents, page_documents

    rows = [(1, "a\n\nb", "en", "x", 4), (2, None, "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert _dealt_out(blocks(line_documents(docs), form="none")) == 1
    pages = spark.createDataFrame([(1, "<h1>a</h1><p>b <b>c</b>"), (2, None)], "page_id long, html string")
    assert _dealt_out(blocks(page_documents(pages), form="none")) == 1
    found = _written(monkeypatch, compiler)
    assert catalog.recipe_edits(spark, str(tmp_path)).count() == 5
    assert found[:2] == [0, 1]  # the documents, and their blocks


def test_blocks_with_milestones_are_dealt_out_for_texts_and_for_outputs(spark, tmp_path, monkeypatch):
    from textloom.operators import blocks
    from textloom.plans import compiler

    rows = [(1, "a\n\nb", "en", "x", 4), (2, "c\nd", "en", "x", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = _written(monkeypatch, blocks, compiler)
    got = sorted(map(tuple, catalog.recipe_milestones(spark, str(tmp_path)).collect()))
    assert got == [(1, "0001", "Document 1"), (1, "0002", "a"), (1, "0003", "~b"), (2, "0001", "Document 2"), (2, "0002", "c"), (2, "0003", "d")]
    assert found[:2] == [1, 1]


def test_link_texts_read_the_dealt_out_pages_again(spark, tmp_path, monkeypatch):
    from textloom.operators import blocks

    rows = [(1, "u", '<p>a <a href="/x">b <b>c</b></a> d'), (2, "v", "<li><b>e</b>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = _written(monkeypatch, blocks)
    got = sorted(map(tuple, catalog.recipe_markup(spark, str(tmp_path)).collect()))
    assert got == [(1, "001", "a [b c]b *c* d"), (2, "001", "*e*")]
    assert len(found) == 1
