import pytest
from pyspark.sql import functions as F

from weftline.functions import lexers, names
from weftline.operators import findings as ops

DAX = ["SUM('My ''T'''[A]) + [B] // c [X]", 'VAR x = DT"2020" RETURN Sales[E]-1.5e3', "a.b.c && 'open [", '"say ""hi"" [no]" & COUNTROWS ( T )', "NOT [M] IN {1}", "é[ü]", ""]


def test_dax_tokens_add_up(spark):
    t = lexers.dax_tokens(spark.createDataFrame(list(enumerate(DAX)), "id int, text string"), "id", "text").collect()
    for i, text in enumerate(DAX):
        mine = sorted((r.pos, r.start, r.token) for r in t if r.expr_id == i)
        assert "".join(x[2] for x in mine) == text and all(text[s : s + len(k)] == k for _, s, k in mine)


def test_dax_references(spark):
    got = {(r.expr_id, r.shape, r.table_name, r.name) for r in lexers.dax_refs(spark.createDataFrame(list(enumerate(DAX)), "expr_id int, text string")).collect()}
    assert {(0, "function", None, "SUM"), (0, "field", "My 'T'", "A"), (0, "field", None, "B"), (1, "field", "Sales", "E"), (3, "table", None, "T"), (4, "field", None, "M"), (5, "field", "é", "ü")} <= got
    assert (0, "field", None, "X") not in got and (0, "table", "My 'T'", None) not in got
    assert {(4, "table", None, "NOT"), (4, "table", None, "IN"), (1, "table", None, "RETURN")} <= got  # any bare name may be a table


def test_fingerprints_ignore_layout(spark):
    rows = [(0, "SUM(T[A])"), (1, "sum ( 't'[a] ) // x"), (2, 'SUM(T["A"])'), (3, "SUM(T[B])"), (4, "1E5"), (5, "1e5"), (6, 'DT"2020"'), (7, 'dt"2020"'), (8, '"A"'), (9, '"a"')]
    got = {r.expr_id: r for r in lexers.dax_fingerprints(spark.createDataFrame(rows, "expr_id int, text string")).collect()}
    prints = {i: r.fingerprint for i, r in got.items()}
    assert prints[0] == prints[1] != prints[2] and prints[0] != prints[3] and got[0].n_tokens == 5
    assert prints[4] != prints[5] and prints[6] == prints[7] and prints[8] != prints[9]


@pytest.mark.parametrize(("text", "want"), [("SUM(a)", None), ("SUM(a", "unbalanced"), ("(}", "unbalanced"), ('"x', "unterminated"), ("[a", "unterminated"), ("/* x", "unterminated"), (" -- c", "empty"), (None, "empty")])
def test_structural_errors(spark, text, want):
    assert lexers.structural_error(text) == want
    assert lexers.structural_errors(spark.createDataFrame([(text,)], "text string")).first().error == want


def test_activations_variables_and_names(spark):
    df = spark.createDataFrame([(1, "VAR x = CALCULATE([M], USERELATIONSHIP(A[K], 'B b'[L])) RETURN ADDCOLUMNS(x, \"New \"\"C\", 1)")], "id int, text string")
    assert [tuple(r) for r in lexers.activations(df).collect()] == [(1, "A", "K", "B b", "L")]
    assert [r.name for r in lexers.variables(df).collect()] == ["x"] and [r.name for r in lexers.quoted_names(df).collect()] == ['new "c']


def test_m_references(spark):
    text = 'let S = Table.SelectColumns(#"Raw Q", {"A", "B"}), r = [a = T[Col], b = 1], p = S[[X],[Y]], q = each [Z], n = Odbc.Query("d", "select [q]"), t = "plain" in S'
    got = set(lexers.m_refs(text))
    assert {("name", None, "Raw Q"), ("column_string", None, "A"), ("column_string", None, "B"), ("field", "T", "Col"), ("field", None, "X"), ("field", None, "Z"), ("native", None, "Odbc.Query")} <= got
    assert not {("column_string", None, "plain"), ("column_string", None, "select [q]"), ("name", None, "a")} & got
    rows = lexers.m_refs_of(spark.createDataFrame([(7, text), (8, None)], "id int, text string")).collect()
    assert {(r.shape, r.table_name, r.name) for r in rows} == got and {r.id for r in rows} == {7}


def test_mdx_targets():
    assert lexers.mdx_targets("SELECT [Measures].[Sales Amt] ON 0, [Date].[Cal].[Year].&[2020] ON 1") == [("measure", "Sales Amt", None, None), ("field", "Date", "Cal", "Year")]


def test_mdx_chains_and_m_names():
    assert lexers.mdx_chains("SELECT [D].[H].&[1] ON 0, \"[no]\" /* [c] */ FROM [Cu]]be]") == [[("D", False), ("H", False), ("1", True)], [("Cu]be", False)]]
    assert lexers.m_names('let Source = #"My Q"{0}, x = Table.Sort(Sales) in x') == ["Source", "My Q", "x", "Table.Sort", "Table", "Sort", "Sales"]


def test_osa(spark):
    assert [lexers.osa_distance(a, b) for a, b in (("abdc", "abcd"), ("ca", "abc"), ("", "xy"), ("same", "same"))] == [1, 3, 2, 0]
    df = spark.createDataFrame([("abdc", "abcd"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(lexers.osa(F.col("a"), F.col("b"))).collect()] == [1, None]


def test_globs_and_names(spark):
    df = spark.createDataFrame([("Sales.Tot",), ("salesXtot",), ("a\nb",)], "n string")
    assert [r[0] for r in df.select(names.matches_any(F.col("n"), ["SALES.?ot"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(names.matches_any(F.col("n"), ["a*"])).collect()] == [False, False, True]
    row = spark.range(1).select(names.kpi_base(F.lit("Total Goal")), names.initial_catalog(F.lit("x=1; Initial Catalog = My M ;y")), names.strip_wait_time(F.lit("EVALUATE T [WaitTime: 3 ms]")), names.query_language(F.lit("  select {}")), names.format_bytes(F.lit(1536)), names.escape_command(F.lit("a%\n")), names.display(F.lit("column"), F.lit("T's"), F.lit("C"))).first()
    assert list(row) == ["Total", "My M", "EVALUATE T", "mdx", "1.5 KB", "a%AZP25%0A", "'T''s'[C]"]


def test_search_and_compare(spark):
    hits = ops.search_lines(spark.createDataFrame([(1, "x\r\nyes FOO foo\n"), (2, None)], "id int, t string"), "id", "t", "foo").collect()
    assert [(h.id, h.line, h.column) for h in hits] == [(1, 2, 5)]
    f = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "key string, subject string")
    base = spark.createDataFrame([("a", "unused"), ("d", "unused"), ("e", "duplicate_measure")], "key string, kind string")
    assert {(r.key, r.status) for r in ops.classify(f, base).collect()} == {("a", "existing"), ("b", "new"), ("c", "new")}
    assert {(r.key, r.status) for r in ops.classify(f, base, subjects=spark.createDataFrame([("s",)], "subject string")).collect()} == {("a", "unverified"), ("b", "unverified"), ("c", "new")}
    assert [r.key for r in ops.fixed(base, f).collect()] == ["d"]
    base = spark.createDataFrame([("a", "unused"), ("d", "column"), ("e", "duplicate_measure"), ("g", "broken_visual")], "key string, kind string")
    assert [r.key for r in ops.fixed(base, f, skipped=True).collect()] == ["g"]


def test_rules_on_every_branch(spark):
    rows = [(b, f, t) for b in (None, "oneDirection", "bothDirections", "automatic") for f in (None, "one", "many") for t in (None, "one", "many")]
    got = spark.createDataFrame(rows, "b string, f string, t string").select(names.filters_both_ways(F.col("b"), F.col("f"), F.col("t"))).collect()
    assert [r[0] for r in got] == [(b not in (None, "oneDirection")) or (f == "one" and t in (None, "one")) for b, f, t in rows]
    sizes = [0, 1023, 1024, 1_048_575, 1 << 20, 5 << 30, 1 << 40, 2 << 50]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(names.format_bytes(F.col("s"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1024.0 KB", "1.0 MB", "5.0 GB", "1.0 TB", "2048.0 TB"]
    assert spark.range(1).select(names.strip_wait_time(F.lit("a [WaitTime: 1 ms] b [WaitTime: 2 ms]  ")), names.is_guid(F.lit("00000000-0000-0000-0000-00000000000A")), names.is_guid(F.lit("x"))).first()[:] == ("a [WaitTime: 1 ms] b", True, False)
    worst = ops.worst(spark.createDataFrame([(f"T{i}",) for i in range(13)] + [("t0",), (None,)], "o string"), "o", top=10).collect()
    assert worst[0].findings == 2 and {r.more for r in worst} == {3} and len(worst) == 10


def test_search_column_where_folding_grows(spark):
    hit = ops.search_lines(spark.createDataFrame([(1, "\u0130\u0130abc")], "id int, t string"), "id", "t", "ABC").first()
    assert hit.column == 3
