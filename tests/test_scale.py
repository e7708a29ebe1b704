"""What keeps the work in proportion to the input: files dealt out to tasks, read once, and large tables not broadcast."""

import pytest
from model_fixture import files_df, model_files
from pyspark.sql import functions as F

from weftline.functions import lexers
from weftline.operators import binding
from weftline.operators import model as md
from weftline.operators.tables import once, written
from weftline.plans import rendered, scan
from weftline.sources import apps, tmdl
from weftline.sources.facts import Facts, parse_files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("files", [rendered.model_files, rendered.model_json, rendered.app_files, rendered.report_files])
def test_rendered_files_are_dealt_out_to_tasks(spark, tmp_path, files):
    """One piece of Parquet is one task, however many files are rendered from its rows."""
    n = 9 * rendered.ROWS
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit(50).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    held = [r.n for r in files(spark, str(tmp_path)).where("path not like '%shared.tmdl'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(held) >= 8 and max(held) < 2 * rendered.ROWS
    assert sum(held) >= n


def test_few_files_take_few_tasks(spark, tmp_path):
    """A file for one part in many is dealt out as what is left of the parts, not as all of them."""
    n = 9 * rendered.ROWS
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.when(F.col("id") % 1000 == 0, 50).otherwise(1).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = rendered.report_files(spark, str(tmp_path)).where("path like '%bookmark.json' or path like '%visual.json' or path like '%reportExtensions.json'")
    assert files.count() == n // 1000 + n // 12 + rendered.MODELS
    assert rendered.report_files(spark, str(tmp_path)).rdd.getNumPartitions() < 40  # 24 of them are pages
    assert rendered.model_files(spark, str(tmp_path)).rdd.getNumPartitions() < 2 * 9


def test_kinds_leave_the_facts_as_they_are_among_all(spark):
    files = files_df(spark, [*model_files(), ("/w/M.SemanticModel", "bad.tmdl", b"table\n")])
    every = parse_files(files, tmdl.parse)
    for kinds in (["column"], ["measure", "skip"], ["table_ref"]):
        assert sorted(map(str, parse_files(files, tmdl.parse, kinds).collect())) == sorted(map(str, every.where(F.col("kind").isin(*kinds)).collect()))


def test_files_without_the_words_of_a_kind_are_not_taken_apart(monkeypatch):
    """Every text is searched; only one that may hold a fact that is asked for is parsed, whatever its encoding."""
    read, tree = [], tmdl.tree
    monkeypatch.setattr(tmdl, "tree", lambda text, facts: read.append(text) or tree(text, facts))
    texts = ["table T\n\n\tcolumn A\n", "function F = ```\n\t\t(a) => a\n\t\t```\n", "table U\n\todd: 1\n"]

    def names(kinds):
        found = []
        for content in (t.encode(code) for t in texts for code in ("utf-8", "utf-16")):
            facts = Facts("m", "p", kinds=frozenset(kinds))
            tmdl.parse(facts, content)
            found += [(r[3], r[5]) for r in facts.rows]
        return found

    assert names(["function"]) == [("function", "F")] * 2 and len(read) == 2
    assert names(["function", "skip"]) == [("function", "F")] * 2 + [("skip", None)] * 2 and len(read) == 8
    assert names(["table"]) == [("table", "T")] * 2 + [("table", "U")] * 2


def test_lines_that_stand_in_many_files_are_read_once():
    before = tmdl._tokens_again.cache_info().misses
    for i in range(100):
        tmdl.parse(Facts("m", str(i)), b"table T\n\n\tcolumn Often\n\t\tdataType: often\n")
    assert tmdl._tokens_again.cache_info().misses <= before + 3
    facts = Facts("m", "p")
    with pytest.raises(ValueError, match="line 3: no key in '= often'"):
        tmdl.parse(facts, b"table T\n\n\t= often\n")


def test_facts_of_many_files_go_in_one_batch(spark):
    def sizes(batches):
        for b in batches:
            yield b.slice(0, 1).select(["seq"]).set_column(0, "n", __import__("pyarrow").array([b.num_rows]))

    files = spark.range(3000, numPartitions=1).select(F.lit("m").alias("model"), F.col("id").cast("string").alias("path"), F.lit("table T\n\n\tcolumn A\n").alias("content"))
    got = [r.n for r in parse_files(files, tmdl.parse).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 6000 and len(got) <= 3


def test_order_reads_each_file_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def parse(facts, content):
        seen.add(1)
        tmdl.parse(facts, content)

    files = model_files()
    assert tmdl.in_order(parse_files(files_df(spark, files), parse)).where("kind = 'table'").count() == 4
    assert seen.value == len(files)


def test_only_small_written_tables_are_broadcast(spark):
    ids = spark.range(400_000).select(F.concat(F.lit("/w/m1.SemanticModel\u001fcolumn\u001ft "), F.col("id").cast("string")).alias("id"))
    large, small = written(ids), written(ids.limit(100))
    assert "BroadcastHashJoin" not in plan(large.join(large.select(F.upper("id").alias("id")).distinct(), "id"))
    assert "BroadcastHashJoin" in plan(large.join(small, "id"))
    assert large.join(small, "id").count() == 100 and large.columns == ["id"]


def test_references_are_read_once(spark):
    """Lookups meet the references of M and of apps in written tables; the texts are not read again for each."""
    m = md.Model(parse_files(files_df(spark, model_files()), tmdl.parse))
    ix = binding.Index(m)
    for rows in binding.bind_m(m, ix):
        assert "MapInArrow" not in plan(rows)
    files = files_df(spark, [("/w/M.SemanticModel", "a.ts", b"const a = 'Shop'; const b = `EVALUATE Shop [Total]`;")])
    lit = parse_files(files, apps.parse).select("model", F.lit("a").alias("app"), "path", "line", F.get_json_object("props", "$.text").alias("text"), F.lit(True).alias("whole"))
    roots = binding.app_roots(lit, ix)
    assert "MapInArrow" not in plan(roots)
    assert {r.id.split("\u001f")[1] for r in roots.collect()} == {"table", "measure"}


def test_findings_of_reports_do_not_wait_for_the_graph(spark):
    """Broken bindings come from what reports name; edges, seeds and liveness are built when something asks for them."""
    a = scan.analyse(parse_files(files_df(spark, model_files()), tmdl.parse), None, None)
    assert scan.broken(a).count() == 0
    assert not {"from_m", "edges", "seeds", "live", "objects"} & set(vars(a))
    assert a.live.count() and a.live is a.live and "seeds" in vars(a)


def test_rows_whose_keys_differ_are_not_moved(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("name"))
    assert "Exchange" not in plan(once(rows, "id"))
    again = rows.unionByName(rows.where("id % 10 = 0"))
    assert once(again, "id").columns == ["id", "name"]
    assert sorted(r.id for r in once(again, "id").collect()) == sorted(r.id for r in rows.collect())


def test_a_role_that_filters_two_tables_alike_uses_both(spark):
    text = b"table A\n\n\tcolumn Key\n\ntable B\n\n\tcolumn Key\n\nrole R\n\n\ttablePermission A = [Key] > 1\n\n\ttablePermission B = [Key] > 1\n"
    m = md.Model(parse_files(files_df(spark, [("/w/M.SemanticModel", "m.tmdl", text)]), tmdl.parse))
    edges = binding.dax_edges(binding.Dax(m, binding.Index(m)), m).where("prov = 'row_filter'")
    assert sorted(r.dst.split("\u001f")[2] for r in edges.collect()) == ["a", "b"]


def test_only_texts_that_activate_are_gathered(spark):
    exprs = spark.createDataFrame([(1, "userelationship(A[x], B[y])"), (2, "SUM(A[x])")], "k int, text string")
    assert [(r.k, r.table_a, r.column_b) for r in lexers.activations(exprs).collect()] == [(1, "A", "y")]
    assert "USERELATIONSHIP" in [x for x in plan(lexers.activations(exprs)).splitlines() if "Filter" in x][-1]


def test_models_of_some_kinds_say_what_whole_ones_say(spark):
    files = files_df(spark, model_files())
    of = lambda kinds: md.Model(parse_files(files, tmdl.parse, kinds))
    rows = lambda df: sorted(map(str, df.collect()))
    whole = of(None)
    for kinds, ask in ((md.KINDS, md.objects), (md.DAX_KINDS, md.dax_expressions), (md.M_KINDS, md.m_expressions), (["relationship", "column"], md.filter_flows), (["relationship", "variation"], md.date_sources)):
        assert rows(ask(of(kinds))) == rows(ask(whole))


def test_statistics_that_are_asked_for_once_are_not_written(spark, tmp_path):
    """What is read of the analyzer's documents goes on to the aggregate; it took two written tables on the way."""
    from weftline.plans import more_queries as q

    spark.range(50).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), (F.col("id") % 20).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    loaded = q.storage_loaded_rows(spark, str(tmp_path))
    assert "MapInArrow" in plan(loaded) and "table-" not in plan(loaded)
    assert "MapInArrow" in plan(q.storage_sizes(spark, str(tmp_path)))
    assert {r.model: r.loaded for r in loaded.collect()} == {f"/w/m{i}.SemanticModel": i > 0 for i in range(20)}
