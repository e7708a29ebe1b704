import json

import pytest
from model_fixture import TMDL, files_df, model_files, report_files
from pyspark.sql import functions as F

from weftline.operators import lookup
from weftline.plans import scan
from weftline.sources import pbir, tmdl
from weftline.sources.facts import parse_files

M, R = "/w/M.SemanticModel", "/w/R.Report"


@pytest.fixture(scope="module")
def analysis(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    models = tmdl.in_order(parse_files(files_df(spark, model_files()), tmdl.parse)).drop("place")
    reports = parse_files(files_df(spark, report_files()), pbir.parse)
    return scan.analyse(models, reports, spark.createDataFrame([(R, M)], "report string, model string"))


def test_facts_of_a_model(analysis):
    rows = {(r.kind, r.tbl, r.name): json.loads(r.props) for r in analysis.model.facts.collect()}
    assert rows["measure", "Shop", "Total 2"]["expr"] == "VAR x = [Total]\nRETURN x * 2" and rows["measure", "Shop", "Total 2"]["kpi_target"] == "[Goal]"
    assert rows["partition", "Shop", "Shop-1"]["text"].startswith("let\n    Source") and "\n\n    Cut" in rows["partition", "Shop", "Shop-1"]["text"]
    assert rows["relationship", None, "r3"]["cross"] == "bothDirections" and rows["relationship", None, "r2"]["is_active"] is False
    assert rows["column", "Shop", "Kept"]["keep"] == "read elsewhere"
    assert rows["table_permission", "Shop", "Sellers"]["filter"] == '[Region] = "N"'
    notices = {(r.skip_kind, r.location) for r in analysis.notices.collect()}
    assert ("unknown_property", "6") in notices and ("stale_state", "p9") in notices


def test_unused_objects(analysis):
    rows = {r.display: r for r in scan.unused(analysis).collect()}
    assert {"'Shop'[Dead]", "'Shop'[Dead Too]", "'Shop'[Old]", "'Shop'[Copy]", "'Shop'[Ships]", "expression 'Unused'", "report measure 'RM2'", "report measure 'RM'", "relationship 'Shop'[ShipKey] -> 'Date'[Key]", "'Shop'[ShipKey]", "bookmark 'B1'"} <= set(rows)
    live = {"'Shop'[Total]", "'Shop'[Total 2]", "'Shop'[Goal]", "'Shop'[Amount]", "'Shop'[Region]", "'Shop'[Rank]", "hierarchy 'Shop'[Geo]", "'Date'[Month]", "'Date'[Key]", "'Shop'[DateKey]", "expression 'Server'", "role 'Sellers'", "'Shop'[Kept]", "table 'Bridge'", "'Bridge'[TagId]", "'Tag'[Id]", "'Tag'[Name]", "table 'Tag'"}
    assert not live & set(rows)
    old = rows["'Shop'[Old]"]
    assert {(u.by, u.prov, u.also_unused) for u in old.used_by} == {("'Shop'[Dead Too]", "measure", True), ("bookmark 'B1'", "stale_bookmark", True)}
    assert old.named_in_m is not None and len(old.named_in_m) == 1


def test_broken_bindings(analysis):
    rows = {(r.target, r.reason) for r in scan.broken(analysis).collect()}
    assert rows == {("'Shop'[Missing]", "measure_not_found"), ("'Shop'[Gone]", "field_not_found"), ("'Shop'[Broken]", "bound_artifact_broken")}
    refs = {r.owner.split("\x1f")[-1]: r.refs for r in analysis.artifacts.collect()}
    assert refs == {"broken": ["'Shop'[Gone]", "[Nothing]"]}


def test_duplicates_summary_verdict(analysis):
    groups = scan.duplicates(analysis, analysis.objects.sparkSession.createDataFrame([(R, M)], "report string, model string")).collect()
    assert [g.members for g in groups] == [["'Shop'[Total]", "'Shop'[Copy]", "report measure 'RM'"]]
    s = scan.summary(analysis).where(F.col("model") == M).first()
    assert s.objects == s.reachable + s.unused and s.broken == 3
    assert scan.verdict(analysis) == "findings"
    assert scan.verdict(analysis, kinds=["table"]) in ("clean", "incomplete")
    with pytest.raises(ValueError, match="unknown kinds"):
        scan.verdict(analysis, kinds=["nonsense"])


def test_dependencies_lookup_and_search(analysis):
    nodes, edges = scan.deps(analysis, "[Total 2]")
    names = {r.display for r in nodes.join(analysis.objects, "id").collect()}
    assert {"'Shop'[Total 2]", "'Shop'[Total]", "'Shop'[Amount]", "'Shop'[Goal]", "table 'Shop'"} <= names and edges.count() > 3
    up, _ = scan.deps(analysis, "'Shop'[Amount]", impact=True, depth=1)
    assert {r.display for r in up.join(analysis.objects, "id").collect()} >= {"'Shop'[Total]", "'Shop'[Copy]"}
    with pytest.raises(lookup.NotFound) as e:
        lookup.find_object(analysis.objects, "Totla 2")
    assert e.value.suggestion == "'Shop'[Total 2]"
    with pytest.raises(lookup.Ambiguous):
        lookup.find_object(analysis.objects, "[Id]")
    hits = {(r.display, r.property, r.line, r.column) for r in scan.search(analysis, "TOTAL").collect()}
    assert ("'Shop'[Total 2]", "measure", 1, 10) in hits
    assert scan.search(analysis, "Total", case=True).count() < scan.search(analysis, "t", regex=True).count()
    why = {r.why for r in scan.roots_of(analysis, lookup.find_object(analysis.objects, "[Total 2]")).collect()}
    assert why == {"field well 'Values' — visual 'V1' on page 'P1'"}


def test_inventory(analysis):
    rows = scan.inventory(analysis, page=["front"], match=["*month*", "total 2"]).collect()
    assert {(r.site, r.display, r.visual_type) for r in rows} == {("well", "'Shop'[Total 2]", "card")}
    assert {r.reason for r in scan.inventory(analysis, only_broken=True).collect()} == {"measure_not_found", "field_not_found", "bound_artifact_broken"}


def test_pairing(spark):
    datasets = spark.createDataFrame([("/w/R.Report", "path", "../M.SemanticModel"), ("/w/M.Report", "path", "../gone"), ("/x/C.Report", "connection", "a=1;Initial Catalog=Shown Name;"), ("/x/D.Report", "unresolved", None)], "report string, how string, reference string")
    models = spark.createDataFrame([("/w/M.SemanticModel", None), ("/y/N.SemanticModel", "Shown name")], "model string, display_name string")
    got = {r.report: (r.model, r.tier) for r in scan.pair_reports(datasets, models).collect()}
    assert got == {"/w/R.Report": (M, "path"), "/w/M.Report": (M, "stem"), "/x/C.Report": ("/y/N.SemanticModel", "catalog"), "/x/D.Report": (None, "unresolved")}


def test_tmdl_shapes():
    from weftline.sources.facts import Facts

    def facts(text):
        f = Facts("m", "p")
        tmdl.parse(f, text.encode())
        return [(r[3], r[4], json.loads(r[7])) for r in f.rows]

    assert facts("table T\n\tmeasure M = VAR x = 1\n\t\t\tRETURN x\n\t\tisHidden\n")[1][2]["expr"] == "VAR x = 1\nRETURN x"
    assert facts("function F = ```\n\t\t(a) =>\n\t\t    a\n\t\t```\n")[0][2]["text"] == "(a) =>\n    a"
    assert facts("role R\n\tcolumnPermission 'T x'[C] = none\n")[1][:2] == ("column_permission", "T x")
    assert facts("nonsense X\n")[0][0] == "skip"
    assert facts("table T\n    column C\n")[-1][0] in ("column", "table") and any(k == "skip" for k, *_ in facts("table T\n    column C\n"))
    with pytest.raises(ValueError):
        facts("table\n")
    assert set(TMDL) >= {"model.tmdl"}


def test_writers(analysis, spark):
    from weftline.sinks import writers

    rows = writers.issues(analysis).cache()
    doc = json.loads(writers.sarif(rows).where(F.col("model") == M).first().document)
    run = doc["runs"][0]
    assert len(run["tool"]["driver"]["rules"]) == 15 and doc["version"] == "2.1.0"
    dead = next(r for r in run["results"] if r["locations"][0]["logicalLocations"][0]["fullyQualifiedName"] == "'Shop'[Dead]")
    assert dead["ruleId"] == "WEFT-UNUSED-MEASURE" and run["tool"]["driver"]["rules"][dead["ruleIndex"]]["id"] == dead["ruleId"]
    assert dead["locations"][0]["physicalLocation"]["artifactLocation"]["uri"].endswith("tables/Shop.tmdl") and dead["locations"][0]["physicalLocation"]["region"]["startLine"] > 10
    assert [r["level"] for r in run["results"] if r["ruleId"] == "WEFT-BROKEN-VISUAL"] == ["error"] * 3
    lines = [r.value for r in writers.commands(rows).collect()]
    assert any(x.startswith("##vso[task.logissue type=warning;sourcepath=") and "code=WEFT-UNUSED-MEASURE;]'Shop'[Dead] is unused" in x for x in lines)
    known = rows.where("id = \"'Shop'[Dead]\"").select("key")
    later = writers.issues(analysis, known)
    assert [r.id for r in later.where("existing").collect()] == ["'Shop'[Dead]"] and writers.commands(later).count() == len(lines) - 1
    text = writers.markdown(rows, cap=2).where(F.col("model") == M).first().document
    assert "| measure | " in text and " more" in text and text.count("` |") == 2
    doc = json.loads(writers.scan_json(analysis).where(F.col("model") == M).first().document)
    assert doc["summary"]["unused"] == len([u for u in doc["unused"]]) and {b["reason"] for b in doc["broken"]} == {"measure_not_found", "field_not_found", "bound_artifact_broken"}
    assert doc["broken_artifacts"][0]["unresolved_references"] == ["'Shop'[Gone]", "[Nothing]"]
    gone = [json.loads(r.value) for r in writers.removable(analysis).collect() if not r.value.startswith("#")]
    assert {"kind": "measure", "table": "Shop", "name": "Dead", "id": "'Shop'[Dead]"} in gone
    assert spark.createDataFrame([("é😀\"x",)], "t string").select(writers.ascii_json(F.col("t"))).first()[0] == '\\u00e9\\ud83d\\ude00"x'
    inv = json.loads(writers.inventory_json(scan.inventory(analysis)).first().document)
    assert inv["unresolved"] == 3 and {p.get("page") for p in inv["pages"]} == {"P1", "p1", "Gone", None}
    assert json.loads(writers.search_json(scan.search(analysis, "Dead Too")).first().value)["property"] == "measure"
    assert len(writers.stub_files("A", "../M.SemanticModel")) == 3
