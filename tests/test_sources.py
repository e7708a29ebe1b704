import gzip
import io
import json
import sqlite3
import struct
import zipfile

import pytest
from model_fixture import REPORT, TMDL, files_df
from pyspark.sql import functions as F

from weftline.sources import apps, archives, facts, pbir, query_logs, tmsl, workbooks
from weftline.sources.facts import Facts


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def rows_of(parse, content, path="p"):
    f = Facts("m", path)
    parse(f, content)
    return [(r[3], r[4], r[5], json.loads(r[7])) for r in f.rows]


def test_text_decoding(spark):
    text = '{"a": "é"}'
    raws = [text.encode(), b"\xef\xbb\xbf" + text.encode(), text.encode("utf-16"), text.encode("utf-16-le"), text.encode("utf-16-be")]
    assert [facts.decode_text(r) for r in raws] == [text] * 5
    got = spark.createDataFrame([(r,) for r in raws], "c binary").select(facts.decoded(F.col("c")).alias("t")).collect()
    assert [r.t for r in got] == [text] * 5


def test_paths_names_and_formats(spark):
    rows = [("/a/M.SemanticModel/definition/tables/T.tmdl", b"table T"), ("/a/R.Report/definition.mobile/pages/P/page.json", b"{}"), ("/a/x.pbix", b"PK\x03\x04.."), ("/a/x.vpax", b"PK\x03\x04.."), ("/a/b.abf", "﻿STREAM_STORAGE_SIGNATURE_)!@#$%^&*(".encode("utf-16-le")), ("/a/m.bim", b"{}"), ("/a/app/src/x.tsx", b""), ("/a/l.csv", b"")]
    got = spark.createDataFrame(rows, "path string, content binary").select(facts.item_of(F.col("path")).alias("item"), facts.inside_definition(F.col("path")).alias("inside"), facts.format_of(F.col("path"), F.col("content")).alias("f")).collect()
    assert [r.f for r in got] == ["tmdl", "pbir", "archive", "vpax", "backup", "tmsl", "app", "query_log"]
    assert (got[0].item, got[0].inside) == ("/a/M.SemanticModel", "tables/T.tmdl") and (got[1].item, got[2].inside) == ("/a/R.Report", None)
    names = facts.display_names(spark.createDataFrame([("m", "/a/.platform", b'{"metadata": {"displayName": "Shown"}}')], "model string, path string, content binary"))
    assert names.first().display_name == "Shown"


def test_malformed_files_become_notices(spark):
    out = facts.parse_files(files_df(spark, [("m", "a.bim", b"{"), ("m", "b.bim", b"[]"), ("m", "c.bim", None)]), tmsl.parse).collect()
    assert len(out) == 3 and {r.kind for r in out} == {"skip"}


BIM = {
    "model": {
        "tables": [
            {"name": "T", "columns": [{"name": "A"}, {"name": "B", "type": "calculated", "expression": ["[A]", "+ 1"], "variations": [{"name": "V", "relationship": "r", "defaultHierarchy": {"table": "D", "hierarchy": "H"}}]}, {"name": "C", "type": "calculatedTableColumn"}], "measures": [{"name": "M", "expression": "1", "kpi": {"statusExpression": ["2"]}, "annotations": [{"name": "x_keep", "value": ["a", "b"]}]}], "partitions": [{"name": "P", "source": {"type": "m", "expression": ""}}], "annotations": [{"name": "__PBI_LocalDateTable", "value": "true"}], "calculationGroup": {"calculationItems": [{"name": "I", "expression": "SELECTEDMEASURE()"}], "noSelectionExpression": {"expression": "0"}}, "odd": 1},
            {"columns": []},
        ],
        "relationships": [{"name": "r", "fromTable": "T", "fromColumn": "A", "toTable": "D", "toColumn": "K"}, {"name": "bad"}],
        "roles": [{"name": "R", "tablePermissions": [{"name": "T", "filterExpression": "TRUE()", "columnPermissions": [{"name": "A", "metadataPermission": "none"}]}]}],
        "expressions": [{"name": "E", "expression": "1", "parameterValuesColumn": "'T'[A]"}],
        "functions": [{"name": "F", "expression": "() => 1"}],
    }
}


def test_tmsl():
    rows = {(k, t, n): p for k, t, n, p in rows_of(tmsl.parse, json.dumps(BIM).encode("utf-16"))}
    assert rows["column", "T", "B"]["expr"] == "[A]\n+ 1" and rows["column", "T", "C"]["column_kind"] == "calculated_table"
    assert rows["measure", "T", "M"]["keep"] == "a\nb" and rows["measure", "T", "M"]["kpi_status"] == "2"
    assert rows["table", "T", "T"]["is_local_date"] and rows["calculation_group", "T", "T"]["no_selection"] == "0"
    assert rows["expression", None, "E"]["parameter_column"] == "A" and rows["variation", "T", "V"]["target_hierarchy"] == "H"
    kinds = [p["skip_kind"] for k, _, _, p in rows_of(tmsl.parse, json.dumps(BIM).encode()) if k == "skip"]
    assert sorted(kinds) == ["malformed_value", "malformed_value", "unknown_property"]


SECTION = 'section Section1;\nshared T = let a = [x = 1; 2] in a;\n// shared No = 1;\nshared #"Extra ""q""" = "a;b";\n'


def test_archives_fill_missing_m(spark):
    inner = zipped({"Formulas/Section1.m": SECTION.replace("[x = 1; 2]", "[x = 1]")})
    mashup = struct.pack("<II", 0, len(inner)) + inner + b"rest"
    layout = json.dumps({"sections": []}).encode("utf-16-le")
    content = zipped({"DataModelSchema": json.dumps(BIM).encode("utf-16-le"), "DataMashup": mashup, "Report/Layout": layout})
    out = archives.read_archives(files_df(spark, [("m", "x.pbit", content)])).collect()
    parts = {(r.kind, r.name): json.loads(r.props) for r in out}
    assert parts["partition", "P"]["text"] == "let a = [x = 1] in a" and parts["expression", 'Extra "q"']["text"] == '"a;b"' and ("report", None) in parts
    assert archives.has_member(content, "DataMashup") and not archives.has_member(b"x", "DataMashup")
    assert {r.member for r in archives.members(files_df(spark, [("m", "x", content)])).collect()} == {"DataModelSchema", "DataMashup", "Report/Layout"}


def catalog():
    db = sqlite3.connect(":memory:")
    db.executescript(
        """create table Model(ID, Name); insert into Model values (1, 'Mod');
        create table "Table"(ID, Name, IsHidden); insert into "Table" values (3, 'D', 0), (2, 'T', 1);
        create table "Column"(ID, TableID, ExplicitName, InferredName, Type, Expression, SortByColumnID); insert into "Column" values (10, 2, 'A', null, 1, null, 11), (11, 2, null, 'B', 2, '[A]', null), (12, 2, 'Row', null, 3, null, null), (13, 3, 'K', null, 1, null, null), (14, 99, 'lost', null, 1, null, null);
        create table Measure(ID, TableID, Name, Expression, KPIID); insert into Measure values (20, 2, 'M', 'SUM(T[A])', 30);
        create table KPI(ID, TargetExpression); insert into KPI values (30, '1');
        create table Partition(ID, TableID, Name, Type, QueryDefinition); insert into Partition values (40, 2, 'P', 4, 'let a = 1 in a');
        create table Relationship(ID, Name, FromTableID, FromColumnID, ToTableID, ToColumnID, IsActive, CrossFilteringBehavior, FromCardinality, ToCardinality); insert into Relationship values (50, 'r', 2, 10, 3, 13, 0, 2, 2, 1);
        create table Annotation(ID, ObjectType, ObjectID, Name, Value); insert into Annotation values (60, 8, 20, 'my_keep', 'why');"""
    )
    return bytes(db.serialize())


def test_backup_catalog():
    db = catalog()
    u = lambda t: t.encode("utf-16")
    log = u("<BackupLog><FileGroups><FileGroup><FileList><BackupFile><Path>x\\metadata.sqlitedb</Path><StoragePath>S1</StoragePath></BackupFile></FileList></FileGroup></FileGroups></BackupLog>")
    at = 4096
    spans = [("S1", at, len(db)), ("LOG", at + len(db), len(log))]
    directory = u("<VirtualDirectory>" + "".join(f"<BackupFile><Path>{n}</Path><Size>{s}</Size><m_cbOffsetHeader>{o}</m_cbOffsetHeader></BackupFile>" for n, o, s in spans) + "</VirtualDirectory>")
    end = at + len(db) + len(log)
    header = u(f"<BackupLog><m_cbOffsetHeader>{end}</m_cbOffsetHeader><DataSize>{len(directory)}</DataSize></BackupLog>")
    sign = u(archives.FRAMINGS["raw"])
    assert len(sign) == archives.SIGNATURE_BYTES
    content = sign + header + b"\0" * (4096 - 72 - len(header)) + db + log + directory
    rows = {(k, t, n): p for k, t, n, p in rows_of(archives.parse_backup, content)}
    assert rows["column", "T", "A"]["sort_by"] == "B" and ("column", "T", "Row") not in rows and rows["column", "T", "B"]["column_kind"] == "calculated"
    assert rows["measure", "T", "M"] | {"keep": "why", "kpi_target": "1"} == rows["measure", "T", "M"]
    assert rows["relationship", None, "r"]["cross"] == "bothDirections" and rows["relationship", None, "r"]["is_active"] is False
    assert rows["skip", None, None]["detail"].startswith("Column 14")
    packed = archives.FRAMINGS["single"].encode("utf-16") + b"\0" * 200
    assert archives.framing(packed) == "single" and rows_of(archives.parse_backup, packed)[0][3]["skip_kind"] == "not_analyzed"


def test_storage_sizes(spark):
    from weftline.operators import model as md

    doc = {"Tables": [{"TableName": "T", "RowsCount": 7, "Columns": [{"$id": "1", "ColumnName": "A", "TotalSize": 10, "ColumnCardinality": 3}, {"$id": "2", "ColumnName": "B", "DictionarySize": 4, "ColumnSegments": [{"UsedSize": 5}, {"UsedSize": 1.4}]}, {"ColumnName": "R", "IsRowNumber": True, "TotalSize": 2}], "UserHierarchies": [{"HierarchyName": "H", "UsedSize": 6}]}], "Relationships": [{"FromColumn": {"$ref": "1"}, "ToColumn": {"$ref": "2"}, "UsedSizeFrom": 3}, {"FromColumn": {"$ref": "9"}, "ToColumn": {"$ref": "2"}}]}
    f = archives.read_sizes(files_df(spark, [("m", "x.vpax", zipped({"DaxModel.json": json.dumps(doc)}))]))
    m = md.Model(f)
    sizes = {r.id.split("\x1f")[1:][0]: (r.bytes, r.rows) for r in md.storage(m).orderBy("id").collect()}
    assert sizes["table"] == (28, 7) and sizes["hierarchy"] == (6, None) and sizes["relationship"] == (3, None)
    assert md.has_loaded_rows(m).first().loaded and f.where("kind = 'skip'").count() == 1


LAYOUT = {
    "filters": json.dumps([{"expression": {"Column": {"Expression": {"SourceRef": {"Entity": "T"}}, "Property": "F"}}}]),
    "sections": [{"name": "S1", "displayName": "One", "filters": "[]", "visualContainers": [{"config": json.dumps({"name": "V", "singleVisual": {"visualType": "table", "projections": {"Values": [{"queryRef": "t.A"}, {"queryRef": "gone"}]}, "prototypeQuery": {"From": [{"Name": "t", "Entity": "T"}], "Select": [{"Name": "t.A", "Aggregation": {"Expression": {"Column": {"Expression": {"SourceRef": {"Source": "t"}}, "Property": "A"}}, "Function": 0}}], "OrderBy": [{"Expression": {"Measure": {"Expression": {"SourceRef": {"Source": "t"}}, "Property": "M"}}}]}}}), "filters": ""}]}],
}


def test_legacy_layout():
    rows = rows_of(pbir.parse_legacy, json.dumps(LAYOUT).encode("utf-16-le"))
    got = {(p["site"], t, n, p.get("agg"), p.get("expr")) for k, t, n, p in rows if k == "binding"}
    assert got == {("filter", "T", "F", None, None), ("well", "T", "A", "Sum", None), ("well", None, None, None, "gone"), ("sort", "T", "M", None, None)}


def test_fields_and_aliases():
    f = Facts("m", "p")
    col = lambda **s: {"Column": {"Expression": s, "Property": "C"}}
    assert pbir.parse_field(col(SourceRef={"Source": "X"}), {"x": "T"}, f, "") == {"tkind": "column", "tbl": "T", "name": "C"}
    assert pbir.parse_field(col(Subquery={}), {}, f, "") is False and pbir.parse_field({"Literal": 1}, {}, f, "") is None
    assert pbir.parse_field(col(SourceRef={"Source": "q"}), {}, f, "")["tkind"] == "written" and json.loads(f.rows[0][7])["skip_kind"] == "unresolved_alias"
    level = {"HierarchyLevel": {"Expression": {"Hierarchy": {"Expression": {"PropertyVariationSource": {"Expression": {"SourceRef": {"Entity": "T"}}, "Name": "V", "Property": "D"}}, "Hierarchy": "H"}}, "Level": "Y"}}
    assert pbir.parse_field(level, {}, f, "") == {"tkind": "hierarchy_level", "tbl": "T", "hierarchy": "H", "level": "Y", "via_column": "D", "via_variation": "V"}
    native = lambda e: pbir.parse_field({"NativeMeasure": {"Language": "dax", "Expression": e}}, {}, f, "")
    assert native("SUM(T[A])")["tkind"] == "native_measure" and native("SUM(T[A]") is False
    deep = {"x": [{"And": {"Left": col(SourceRef={"Entity": "T"}), "Right": {"ScopedEval": {"Expression": col(SourceRef={"Entity": "U"})}}}}]}
    for _ in range(5000):
        deep = {"y": deep}
    assert [t["tbl"] for t in pbir.collect(deep, {}, f, "")] == ["T", "U"]


CSV = 'OperationName,EventText,TimeGenerated,User\nQueryEnd,"EVALUATE ""x"",\n[M] [WaitTime: 0 ms]",2024-01-01,u\nProgress,[no],2024-01-02,u\nqueryend,,2024-01-03,u\n'


def test_query_logs(spark):
    files = [("a", CSV.encode()), ("b", gzip.compress(b"\xef\xbb\xbf" + CSV.encode())), ("c", zipped({"x.csv": CSV, "__MACOSX/y": "z"})), ("d", json.dumps([{"EventText": "SELECT [Measures].[M] ON 0 FROM c", "ApplicationContext": json.dumps({"Sources": [{"ReportId": "r1"}, {"VisualId": ""}]}), "ItemId": "I1"}]).encode())]
    q = query_logs.logged_queries(query_logs.raw_rows(spark.createDataFrame(files, "path string, content binary")))
    rows = {r.path: r for r in q.where("text is not null").collect()}
    assert all(rows[x].text == 'EVALUATE "x",\n[M]' and rows[x].language == "dax" and rows[x].ts == "2024-01-01" for x in "abc")
    assert rows["d"].language == "mdx" and [s.report for s in rows["d"].sources] == ["r1"]
    assert query_logs.log_notices(q).count() == 3 and query_logs.retain(q, item_id="i2").count() == 3
    with pytest.raises(ValueError, match="one query log"):
        archives.query_text(zipped({"a": "1", "b": "2"}))


def test_app_sources(spark):
    source = "import x from 'y'; // 'no'\n/* \"no\" */ const t = `A ${f('in', `n ${1} m`)} B`;\nconst r = a / 2 / 'div'.length; const re = /['\"]/g;\nreturn /'x/.test(\"z\\u0041\\n\")"
    got = [(line, text, whole) for line, text, whole in apps.literals(source)]
    assert got == [(1, "y", True), (2, "A ", False), (2, "in", True), (2, "n ", False), (2, " m", False), (2, " B", False), (3, "div", True), (4, "zA\n", True)]
    yaml = 'name: a\nprofiles:\n  Dev:\n    semanticModels:\n      sales:\n        itemId: "11111111-2222-3333-4444-555555555555"\n      none:\n        itemId: "00000000-0000-0000-0000-000000000000"  # later\n'
    assert apps.manifest_models(yaml) == [("Dev", "sales", "11111111-2222-3333-4444-555555555555")]
    paths = ["/a/src/x.ts", "/a/node_modules/x.ts", "/a/.git/x.js", "/a/x.d.ts", "/a/x.test.tsx", "/a/x.py"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(apps.is_source(F.col("p"))).collect()] == [True] + [False] * 5
    pairs = apps.pair_apps(spark.createDataFrame([("a", "sales", "X1"), ("a", "Other-Model", None), ("a", "k", None), ("a", "m", "zz")], "app string, key string, item_id string"), spark.createDataFrame([("m1", "Sales", "x1"), ("m2", "other model", None)], "model string, name string, item_id string"), spark.createDataFrame([("a", "m", "m9")], "app string, key string, model string"))
    assert {(r.key, r.model, r.tier) for r in pairs.collect()} == {("sales", "m1", "service_id"), ("Other-Model", "m2", "alias"), ("k", None, None), ("m", "m9", "mapping")}


def test_workbooks():
    rel = lambda *r: '<Relationships xmlns="x">' + "".join(f'<Relationship Id="{i}" Type="http://t/{t}" Target="{p}"/>' for i, t, p in r) + "</Relationships>"
    book = zipped({
        "_rels/.rels": rel(("r0", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="n"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rel(("r1", "worksheet", "worksheets/s1.xml"), ("r2", "slicerCache", "slicerCaches/c1.xml"), ("r3", "connections", "connections.xml")),
        "xl/worksheets/s1.xml": '<worksheet xmlns="m"><c r="B2"><f>CUBEVALUE("con",CUBEMEMBER("con","[Geo].[City].[X]"),"[Measures].[Amt]",A1)</f></c><c r="B3"><f>CUBEMEMBER("con",A1&amp;"x")</f></c></worksheet>',
        "xl/worksheets/_rels/s1.xml.rels": rel(("p1", "pivotTable", "../pivotTables/p1.xml")),
        "xl/pivotTables/p1.xml": '<pivotTableDefinition xmlns="m" name="PT"><rowFields><field x="0"/><field x="-2"/></rowFields><pageFields><pageField fld="1" hier="-1"/></pageFields><dataFields><dataField fld="2"/></dataFields></pivotTableDefinition>',
        "xl/pivotTables/_rels/p1.xml.rels": rel(("c", "pivotCacheDefinition", "../pivotCache/c1.xml")),
        "xl/pivotCache/c1.xml": '<pivotCacheDefinition xmlns="m"><cacheFields><cacheField name="[Geo].[City].[City]"/><cacheField name="[Date].[Cal].[Year]"/><cacheField name="[Measures].[Amt]"/></cacheFields></pivotCacheDefinition>',
        "xl/slicerCaches/c1.xml": '<slicerCacheDefinition xmlns="m" name="SC" sourceName="[Geo].[Land]"><levels><level uniqueName="[Geo].[Land].[(All)]"/><level uniqueName="[Geo].[Land].[Land]"/></levels></slicerCacheDefinition>',
        "xl/connections.xml": '<connections xmlns="m"><connection name="q"><dbPr connection="Provider=MSOLAP.8" command="EVALUATE T" commandType="4"/></connection><connection name="sql"><dbPr connection="x"/></connection></connections>',
    })
    rows = rows_of(workbooks.parse, book)
    got = {(p.get("visual"), p["site"], p.get("role"), t, n, p.get("hierarchy"), p.get("level"), p["exact"]) for k, t, n, p in rows if k == "binding"}
    assert got == {
        ("PT", "well", "Rows", "Geo", "Geo", "City", "City", True), ("PT", "well", "Filters", "Date", "Date", "Cal", "Year", True), ("PT", "well", "Values", "Measures", "Amt", None, None, True),
        ("B2", "well", "CUBEMEMBER", "Geo", "Geo", "City", "X", False), ("B2", "well", "CUBEVALUE", "Measures", "Amt", None, None, False), (None, "filter", None, "Geo", "Geo", "Land", "Land", True),
    }
    assert [n for k, _, n, _ in rows if k == "report_query"] == ["q"] and sorted(p["detail"] for k, _, _, p in rows if k == "skip") == ["a computed argument at One!B3", "connection sql is not to a model"]
    assert set(TMDL) and set(REPORT)


def test_streamed_logs(spark, tmp_path):
    from weftline.streaming import logs

    rows = [(1, "2024-01-01 10:00:00", "u", "a", "r"), (1, "2024-01-01 10:00:00", "u", "a", "r"), (2, "2024-01-01 11:00:00", "u", "a", "r"), (3, "2024-01-02 10:00:00", "u", "b", "r"), (4, "2024-01-09 10:00:00", "u", "z", "r")]
    df = spark.createDataFrame(rows, "query_id long, ts string, user string, object_id string, report string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = logs.keep(logs.use_by_window(logs.events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r.id, r.uses) for r in logs.queried(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}
