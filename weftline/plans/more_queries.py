"""Queries of expressions, sinks, storage and traversal on encodings of the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators import binding, findings, graph
from weftline.operators import model as md
from weftline.plans import model_queries as mq
from weftline.plans import rendered, scan
from weftline.plans.queries import query
from weftline.plans.tables import GRAPH_SQL, edges, nodes, roots, table
from weftline.sinks import writers
from weftline.sources import apps, archives, facts, query_logs
from weftline.sources.facts import parse_files

W = mq.W
G = f"with recursive {GRAPH_SQL}"


def _pick(values: list, by):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (by + 1).cast("int"))


# Expressions

@query(W + "select k, case k % 5 when 0 then '''it''''s ' || k || '''[a]' when 1 then 'hierarchy ''it''''s ' || k || '''[a]' when 2 then 'calculation item ''it''''s ' || k || '''[a]' when 3 then 'table ''a''' else 'report measure ''a''' end as display from p")
def display_ids(spark, d):
    p = rendered.parts(spark, d)
    kind = _pick(["measure", "hierarchy", "calculation_item", "table", "report_measure"], F.col("k") % 5)
    return p.select("k", names.display(kind, F.concat(F.lit("it's "), F.col("k").cast("string")), F.lit("a")).alias("display"))


@query(W + "select k, case k % 4 when 0 then 'M ' || k when 1 then 'M ' || k || ' and' end as base from p")
def kpi_bases(spark, d):
    p = rendered.parts(spark, d)
    text = F.concat(F.lit("M "), F.col("k").cast("string"), _pick([" Goal", " andTREND", " Goals", ""], F.col("k") % 4))
    return p.select("k", names.kpi_base(text).alias("base"))


@query(W + "select k, case k % 3 when 0 then 'm ' || k when 1 then 'M' || k end as catalog from p")
def initial_catalogs(spark, d):
    p = rendered.parts(spark, d)
    return p.select("k", names.initial_catalog(_t3(F.col("k"), "Data Source=x;Initial Catalog= m {} ;a=b", "initial catalog=M{}", "Catalog={}")).alias("catalog"))


def _t3(k, *templates):
    parts = [F.concat(F.lit(t.split("{}")[0]), k.cast("string"), F.lit(t.split("{}")[1])) for t in templates]
    return F.element_at(F.array(*parts), (k % len(parts) + 1).cast("int"))


@query(W + "select k, case k % 3 when 0 then 'EVALUATE T' || k when 1 then 'x [WaitTime: 1 ms] y' || k else 'no ' || k end as text from p")
def wait_times(spark, d):
    p = rendered.parts(spark, d)
    return p.select("k", names.strip_wait_time(_t3(F.col("k"), "EVALUATE T{} [WaitTime: 0 ms]  ", "x [WaitTime: 1 ms] y{}\n[WaitTime: 2 ms]", "no {}")).alias("text"))


@query(W + "select k, case when k % 4 in (0, 2) then 'mdx' else 'dax' end as language from p")
def query_languages(spark, d):
    p = rendered.parts(spark, d)
    return p.select("k", names.query_language(_pick(["  select {} on 0", "EVALUATE x", "\nWITH MEMBER", "selection"], F.col("k") % 4)).alias("language"))


@query(W + "select k, k % 2 = 0 as is_guid from p")
def guids(spark, d):
    p = rendered.parts(spark, d)
    guid = F.concat(F.lit("00000000-aaaa-BBBB-cccc-"), F.lpad(F.col("k").cast("string"), 12, "0"))
    return p.select("k", names.is_guid(F.when(F.col("k") % 2 == 0, guid).otherwise(F.concat(guid, F.lit("0")))).alias("is_guid"))


@query(W + "select k, 'a%AZP25' || k || '%0D%0Ab' as data, 'a%AZP25' || k || '%3B%5D%0A' as property from p")
def command_escapes(spark, d):
    p = rendered.parts(spark, d)
    return p.select("k", names.escape_command(F.concat(F.lit("a%"), F.col("k").cast("string"), F.lit("\r\nb"))).alias("data"), writers.escape_property(F.concat(F.lit("a%"), F.col("k").cast("string"), F.lit(";]\n"))).alias("property"))


@query(W + "select model, case when count(*) > 3 then array_to_string(list(k order by k)[1:3], ', ') || ' and ' || (count(*) - 3) || ' more' else array_to_string(list(k order by k), ', ') end as shown from p group by model")
def capped_names(spark, d):
    p = rendered.parts(spark, d)
    ordered = F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string"))
    return p.groupBy("model").agg(ordered.alias("names")).select("model", findings.capped(F.col("names")).alias("shown"))


@query(W + "select k, k % 4 < 3 as dax from p")
def literals_that_look_like_dax(spark, d):
    p = rendered.parts(spark, d)
    return p.select("k", apps.looks_like_dax(_pick(["evaluate T", "x [M]", "a CALCULATE b", "Sales evaluated"], F.col("k") % 4)).alias("dax"))


@query(W + "select k, k % 6 = 0 as read from p")
def app_source_filter(spark, d):
    p = rendered.parts(spark, d)
    return p.select("k", apps.is_source(_pick(["/a/src/x.tsx", "/a/node_modules/x.ts", "/a/.git/x.js", "/a/x.d.ts", "/a/x.test.ts", "/a/x.css"], F.col("k") % 6)).alias("read"))


@query(W + "select k, ['tmdl', 'tmsl', 'archive', 'backup', 'workbook', 'vpax', 'pbir', 'app'][k % 8 + 1] as format from p")
def file_formats(spark, d):
    p = rendered.parts(spark, d)
    path = _pick(["/m/definition/t.TMDL", "/m/model.bim", "/m/x.pbix", "/m/x.abf", "/m/x.xlsx", "/m/x.vpax", "/r/definition/report.json", "/a/x.ts"], F.col("k") % 8)
    sign = F.unhex(F.lit(archives.FRAMINGS["raw"].encode("utf-16").hex()))
    content = F.when(F.col("k") % 8 == 3, sign).when((F.col("k") % 8).isin(2, 4, 5), F.unhex(F.lit("504b030400"))).otherwise(F.unhex(F.lit("7b7d")))
    return p.select("k", facts.format_of(path, content).alias("format"))


@query(W + "select k, '/w/' || model_name || '/M' || k as item, 'tables/T.tmdl' as inside from (select *, 'a' as model_name from p)")
def definition_folders(spark, d):
    p = rendered.parts(spark, d)
    path = F.concat(F.lit("/w/a/M"), F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, "/definition/").otherwise("/definition.mobile/"), F.lit("tables/T.tmdl"))
    return p.select("k", facts.item_of(path).alias("item"), facts.inside_definition(path).alias("inside"))


@query(W + "select k, '{\"a\": \"é' || k || '\"}' as text from p")
def decoded_texts(spark, d):
    p = rendered.parts(spark, d)
    text = F.concat(F.lit('{"a": "é'), F.col("k").cast("string"), F.lit('"}'))
    raw = F.element_at(F.array(F.encode(text, "UTF-8"), F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")), F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")), F.encode(text, "UTF-16LE"), F.encode(text, "UTF-16BE")), (F.col("k") % 5 + 1).cast("int"))
    return p.select("k", facts.decoded(raw).alias("text"))


@query(W + "select k, case when k % 2 = 0 then '/w/x' || k || '/M.SemanticModel' else '/w/y' || k end as resolved from p")
def resolved_paths(spark, d):
    p = rendered.parts(spark, d)
    k = F.col("k").cast("string")
    return p.select("k", scan.resolve_path(F.concat(F.lit("/w/x"), k, F.lit("/R.Report")), F.when(F.col("k") % 2 == 0, "../M.SemanticModel").otherwise(F.concat(F.lit(".\\..\\..\\y"), k))).alias("resolved"))


@query(W + "select k, case k % 3 when 0 then 'm' || k when 1 then 'n' || k end as model, case k % 3 when 0 then 'service_id' when 1 then 'alias' end as tier from p")
def app_pairing(spark, d):
    p = rendered.parts(spark, d)
    s = F.col("k").cast("string")
    asked = p.select(F.lit("a").alias("app"), F.concat(F.lit("Key-"), s).alias("key"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("ID"), s)).alias("item_id"))
    known = p.where("k % 3 = 0").select(F.concat(F.lit("m"), s).alias("model"), F.lit("x").alias("name"), F.concat(F.lit("id"), s).alias("item_id")).unionByName(p.where("k % 3 = 1").select(F.concat(F.lit("n"), s).alias("model"), F.concat(F.lit("KEY "), s).alias("name"), F.lit(None).cast("string").alias("item_id")))
    return apps.pair_apps(asked, known).select(F.substring("key", 5, 20).cast("long").alias("k"), "model", "tier")


@query(W + "select k, list_distinct(list_filter([case when k % 3 = 0 then 'r' || k end, case when k % 2 = 0 then 'r' || k end], lambda x: x is not null)) = [] as none, cast(k % 3 = 0 as integer) + cast(k % 2 = 0 as integer) as sources from p")
def query_sources(spark, d):
    p = rendered.parts(spark, d)
    part = lambda when, key: F.when(when, F.concat(F.lit(f'{{"{key}": "r'), F.col("k").cast("string"), F.lit('"}'))).otherwise(F.lit(f'{{"{key}": ""}}'))
    text = F.concat(F.lit('{"Sources": ['), part(F.col("k") % 3 == 0, "ReportId"), F.lit(", "), part(F.col("k") % 2 == 0, "VisualId"), F.lit("]}"))
    s = query_logs.query_sources(text)
    return p.select("k", (F.size(s) == 0).alias("none"), F.size(s).alias("sources"))


# Storage

def _sizes(spark, d):
    """An analyzer's document for each part, in the archive it comes in."""
    import io
    import zipfile

    import pyarrow as pa

    p = rendered.parts(spark, d)
    doc = rendered._t('{chr(123)}"Tables": [{chr(123)}"TableName": "T {k}", "RowsCount": {size}, "Columns": [{chr(123)}"$id": "1", "ColumnName": "Key", "TotalSize": {k}{chr(125)}, {chr(123)}"$id": "2", "ColumnName": "{brand}", "DictionarySize": 10, "ColumnSegments": [{chr(123)}"UsedSize": {size}{chr(125)}, {chr(123)}"UsedSize": 1.6{chr(125)}]{chr(125)}], "UserHierarchies": [{chr(123)}"HierarchyName": "H", "UsedSize": 7{chr(125)}]{chr(125)}], "Relationships": [{chr(123)}"FromColumn": {chr(123)}"$ref": "1"{chr(125)}, "ToColumn": {chr(123)}"$ref": "{if(k % 2 = 0, 2, 9)}"{chr(125)}, "UsedSizeFrom": 3, "UsedSizeTo": 4{chr(125)}]{chr(125)}')

    def zipped(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr("DaxModel.json", text)
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["model", "path", "content"])

    return p.select("model", F.concat(F.lit("/s/"), F.col("k").cast("string"), F.lit(".vpax")).alias("path"), doc.alias("doc")).mapInArrow(zipped, "model string, path string, content binary")


def _statistics(spark, d):
    """Models of the statistics alone. A query asks them for one kind of facts once, so neither these nor their typed table are written."""
    return md.Model(archives.read_sizes(_sizes(spark, d)), materialise=False)


SIZES = f"""sizes as (select {mq.KEY} as id, k as bytes, null as rows from p union all select {mq.BRAND}, 12 + size, null from p union all select {mq.H}, 7, null from p
    union all select {mq.T}, 19 + k + size, size from p union all select {mq._sid('relationship', "'t ' || k", "'key'", "'t ' || k", 'brand')}, 7, null from p where k % 2 = 0)"""


@query(f"{W}, {SIZES} select id, bytes, rows from sizes")
def storage_sizes(spark, d):
    return md.storage(_statistics(spark, d)).select("id", "bytes", "rows")


@query(W + "select model, 'malformed_value' as skip_kind, count(*) as n from p where k % 2 = 1 group by model")
def storage_notices(spark, d):
    f = archives.read_sizes(_sizes(spark, d)).where("kind = 'skip'")
    return f.select("model", F.get_json_object("props", "$.skip_kind").alias("skip_kind")).groupBy("model", "skip_kind").agg(F.count("*").alias("n"))


@query(W + "select model, max(size) > 0 as loaded from p group by model")
def storage_loaded_rows(spark, d):
    return md.has_loaded_rows(_statistics(spark, d))


@query(f"{W}, {SIZES}, {mq.ALL} select kind, count(*) as objects, count(bytes) as sized, cast(sum(bytes) as bigint) as bytes from objects left join sizes using (id) group by kind")
def storage_coverage(spark, d):
    sizes = md.storage(md.Model(archives.read_sizes(_sizes(spark, d))))
    rows, _ = md.attach_storage(md.objects(mq._model(spark, d, *md.KINDS)), sizes)
    return rows.groupBy("kind").agg(F.count("*").alias("objects"), F.count("bytes").alias("sized"), F.sum("bytes").alias("bytes"))


@query(W + "select cast(sum(case when dead_table or k % 2 = 0 then case when dead_table then 100 + size else size end else 0 end) as bigint) as bytes, cast(count(case when dead_table or k % 2 = 0 then 1 end) as bigint) as sized, cast(0 as bigint) as unsized from (select *, k % 3 = 0 as dead_table from p)")
def unused_storage_by_owner(spark, d):
    """A dead table's file covers its dead column's; other dead columns count by themselves."""
    p = rendered.parts(spark, d)
    t = p.where("k % 3 = 0").select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("id"), F.lit("").alias("owner"))
    c = p.where("k % 2 = 0").select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("owner"))
    sizes = p.select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("id"), (F.col("size").cast("long") + 100).alias("bytes")).unionByName(p.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("id"), F.col("size").cast("long").alias("bytes")))
    return findings.unused_storage(t.unionByName(c), sizes)


# Sinks

def _issues(spark, d):
    """An issue for each part, as the scan makes them; every fifth is known from before."""
    p = rendered.parts(spark, d)
    kind = _pick(["measure", "column", "broken_visual", "table"], F.col("k") % 4)
    rows = p.select("model", (F.col("k") % 5 == 0).alias("existing"), F.lit(0).alias("bucket"), F.col("k").alias("seq"), kind.alias("kind"), F.concat(F.lit("o|"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("é is unused; "), F.col("k").cast("string")).alias("message"), F.when(F.col("k") % 3 > 0, F.concat("model", F.lit("/t.tmdl"))).alias("path"), F.when(F.col("k") % 3 == 1, F.col("k").cast("int")).alias("line"))
    rule = {k: (r, i, x) for i, (r, k, x) in enumerate(writers.RULES)}
    look = lambda at: writers._lookup([(k, v[at]) for k, v in rule.items()], F.col("kind"))
    return rows.withColumns({"rule": look(0), "rule_index": look(1), "level": look(2), "key": names.object_key(F.col("kind"), F.col("id"))}).withColumn("fingerprint", names.fingerprint(F.col("key")))


ISSUES = "issues as (select *, k % 5 = 0 as existing, ['measure', 'column', 'broken_visual', 'table'][k % 4 + 1] as kind, ['WEFT-UNUSED-MEASURE', 'WEFT-UNUSED-COLUMN', 'WEFT-BROKEN-VISUAL', 'WEFT-UNUSED-TABLE'][k % 4 + 1] as rule, [0, 1, 12, 3][k % 4 + 1] as rule_index, case when k % 4 = 2 then 'error' else 'warning' end as level from p)"


@query(f"{W}, {ISSUES} select model, '##vso[task.logissue type=' || level || ';' || case when k % 3 > 0 then 'sourcepath=' || model || '/t.tmdl;' else '' end || case when k % 3 = 1 then 'linenumber=' || k || ';' else '' end || 'code=' || rule || ';]é is unused; ' || k as value from issues where not existing")
def log_commands(spark, d):
    return writers.commands(_issues(spark, d))


@query(f"""{W}, {ISSUES}, r as (select *, row_number() over (partition by model order by existing, k) - 1 as place from issues)
    select model, cast(place as bigint) as place, rule, cast(rule_index as bigint) as rule_index, level, 'é is unused; ' || k as message, case when k % 3 > 0 then model || '/t.tmdl' end as uri, case when k % 3 = 1 then k end as line, sha256(kind || chr(31) || 'o|' || k) as fingerprint, existing as suppressed from r""")
def sarif_results(spark, d):
    schema = "struct<version:string,runs:array<struct<results:array<struct<ruleId:string,ruleIndex:long,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long>>>>,partialFingerprints:struct<`finding/v1`:string>,suppressions:array<struct<kind:string>>>>>>>"
    doc = writers.sarif(_issues(spark, d)).select("model", F.from_json("document", schema).alias("d"))
    each = doc.select("model", F.posexplode(F.col("d.runs")[0]["results"]).alias("place", "r"))
    where = F.col("r.locations")[0]["physicalLocation"]
    return each.select("model", F.col("place").cast("long").alias("place"), F.col("r.ruleId").alias("rule"), F.col("r.ruleIndex").alias("rule_index"), "r.level", F.col("r.message.text").alias("message"), where["artifactLocation"]["uri"].alias("uri"), where["region"]["startLine"].alias("line"), F.col("r.partialFingerprints")["finding/v1"].alias("fingerprint"), F.col("r.suppressions").isNotNull().alias("suppressed"))


@query(f"""{W}, {ISSUES}, n as (select model, kind, count(*) as n from issues where not existing group by all), c as (select model, sum(n) as total, string_agg('| ' || kind || ' | ' || n || ' |', chr(10) order by list_position(['measure', 'column', 'hierarchy', 'table'], kind) nulls last) as counts from n group by model),
    s as (select *, row_number() over (partition by model order by k) as place from issues where not existing), t as (select model, string_agg('| ' || kind || ' | `o\\|' || k || '` |', chr(10) order by place) as shown from s where place <= 50 group by model)
    select model, '### Scan of `' || model || '`' || chr(10) || chr(10) || '**' || cast(total as bigint) || ' findings**' || chr(10) || chr(10) || '| Finding | Count |' || chr(10) || '|---|--:|' || chr(10) || counts || chr(10) || chr(10) || '| Type | Object |' || chr(10) || '|---|---|' || chr(10) || shown
      || case when total > 50 then chr(10) || chr(10) || '… and ' || cast(total - 50 as bigint) || ' more' else '' end || chr(10) as document from c join t using (model)""")
def markdown_summary(spark, d):
    return writers.markdown(_issues(spark, d))


@query(W + "select k, '{\"name\":\"\\u00e9\\ud83d\\ude00 ' || k || '\"}' as value from p")
def ascii_json_lines(spark, d):
    p = rendered.parts(spark, d)
    return p.select("k", writers.ascii_json(F.to_json(F.struct(F.concat(F.lit("é😀 "), F.col("k").cast("string")).alias("name")))).alias("value"))


@query("select report, count(*) as bindings, count(distinct page) as pages, count(distinct visual) as visuals, cast(sum(cast(reason as integer)) as bigint) as unresolved from (select '/r' || (p_partkey % 20) as report, 'P' || (p_partkey % 3) as page, 'V' || (p_partkey % 100) as visual, p_partkey % 7 = 0 as reason from part) group by report")
def inventory_documents(spark, d):
    k = F.col("p_partkey")
    s = lambda mark, by: F.concat(F.lit(mark), (k % by).cast("string"))
    rows = table(spark, d, "part").select(s("/r", 20).alias("report"), s("P", 3).alias("page"), F.lit(None).cast("string").alias("page_label"), s("V", 100).alias("visual"), F.lit("card").alias("visual_type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("bookmark"), F.lit(False).alias("mobile"), F.lit("well").alias("site"), F.lit(None).cast("string").alias("role"), k.cast("string").alias("display"), F.when(k % 7 == 0, "field_not_found").alias("reason"))
    schema = "struct<report:string,unresolved:long,pages:array<struct<page:string,visuals:array<struct<visual:string,bindings:array<struct<display:string>>>>>>>"
    doc = writers.inventory_json(rows).select(F.from_json("document", schema).alias("d")).select("d.*")
    visuals = F.flatten(F.transform("pages", lambda p: F.transform(p["visuals"], lambda v: v["visual"])))
    n = F.aggregate(F.flatten(F.transform("pages", lambda p: F.transform(p["visuals"], lambda v: F.size(v["bindings"]).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    return doc.select("report", n.alias("bindings"), F.size("pages").cast("long").alias("pages"), F.size(F.array_distinct(visuals)).cast("long").alias("visuals"), "unresolved")


# Traversal

@query(f"{G} select prov, count(*) as edges from (select distinct src, dst, prov from edges) group by prov")
def edge_counts(spark, d):
    return edges(spark, d).groupBy("prov").agg(F.count("*").alias("edges"))


@query(f"{G}, r as (select id as root, id from roots union select r.root, e.dst from r join edges e on e.src = r.id) select id, count(distinct root) as roots from r group by id")
def roots_reaching(spark, d):
    reached = graph.reached_by(roots(spark, d), edges(spark, d))
    return reached.groupBy("id").agg(F.countDistinct("root").alias("roots"))


@query(f"{G}, up as (select id, 0 as depth from nodes where id = 'n3' union select e.src, u.depth + 1 from up u join edges e on e.dst = u.id), down as (select id, 0 as depth from nodes where id = 'n3' union select e.dst, x.depth + 1 from down x join edges e on e.src = x.id) select id, cast(-min(depth) as integer) as distance from up where depth > 0 group by id union all select id, cast(min(depth) as integer) from down group by id")
def signed_distances(spark, d):
    return graph.signed_distances(nodes(spark, d).where("id = 'n3'").select("id"), edges(spark, d))


@query(f"{G} select src as id, dst as neighbour, min(prov) as prov from edges group by src, dst")
def neighbours(spark, d):
    return graph.neighbours(edges(spark, d))


@query(f"{G}, s as (select 'o' || o_orderkey as id from orders where o_orderpriority = '1-URGENT'), keep as (select id from s where id like 'o1%') select count(*) as edges from edges e semi join keep a on a.id = e.src semi join keep b on b.id = e.dst")
def pruned_slice(spark, d):
    e = edges(spark, d)
    ids = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    keep = ids.where(F.col("id").startswith("o1"))
    _, inner = scan.prune(ids, graph.induced(e, ids), keep)
    return inner.agg(F.count("*").alias("edges"))


# Findings

@query(W + "select kind, count(*) as n from (select unnest(['unused', 'broken_visual', 'broken_artifact', 'duplicate_measure', 'column']) as kind, k from p) where kind in ('unused', 'column') group by kind")
def usage_findings(spark, d):
    p = rendered.parts(spark, d).select("k", F.explode(F.array(*map(F.lit, ["unused", "broken_visual", "broken_artifact", "duplicate_measure", "column"]))).alias("kind"))
    return p.where(findings.about_usage(F.col("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(W + "select model, min(k) as first, count(*) as members from p group by model, lower(brand) having count(*) > 1")
def duplicate_groups(spark, d):
    from weftline.functions import lexers

    p = rendered.parts(spark, d).select("model", "k", F.col("k").cast("string").alias("display"), rendered._t("SUM ( '{brand}'[x] )").alias("text"))
    g = findings.duplicate_groups(lexers.dax_fingerprints(p), F.col("k"), ["model"])
    return g.select("model", F.col("first").cast("long").alias("first"), F.size("members").cast("long").alias("members"))


@query(f"{W}, o as (select model, 'T ' || k as name, 'table ''T ' || k || '''' as display, k from p) select model, name from o where lower(name) like 't 1%' or lower(display) like '%7'''")
def ignored_objects(spark, d):
    o = md.objects(mq._model(spark, d, *md.KINDS)).where("kind = 'table'")
    return scan.ignored(o, ["T 1*", "*7'"]).select("model", "name")


@query(W + f"select {mq.M_} as id, 'why ' || k as reason from p where k % 97 = 0")
def kept_by_reasons(spark, d):
    m = mq._model(spark, d, *md.KINDS)
    return md.kept_by(m, md.objects(m).select("id"))


@query(f"{W} select why, count(*) as seeds from (select {mq.ROLE} as id, 'role' as why from p where k < 20 union all select {mq.M_}, 'kept' from p where k % 97 = 0 union all select {mq.KEY}, 'root' from p where size >= 45) group by why")
def scan_seeds(spark, d):
    m = mq._model(spark, d, *md.KINDS)
    p = rendered.parts(spark, d).where("size >= 45").withColumns({"t": rendered._t("T {k}"), "c": F.lit("Key")})
    return md.seeds(m, p.select(md.object_id("column", "t", "c").alias("id"))).groupBy("why").agg(F.count("*").alias("seeds"))


@query(W + f"select {mq.T} as id, case when size >= 45 then 'in_use' when k % 2 = 0 then 'dead' else 'unused_by_reports' end as verdict from p")
def date_table_verdicts(spark, d):
    p = rendered.parts(spark, d).withColumn("t", rendered._t("T {k}")).withColumn("id", md.object_id("table", "t"))
    return scan.date_verdicts(p.select("id"), p.where("size >= 45").select("id"), p.where("size >= 45 or k % 2 = 1").select("id")).select("id", "verdict")


@query(W + "select k, case when k % 2 = 0 then 'field well ''Values'' — visual ''V' || k || ''' on page ''P''' else 'mobile layout filter in bookmark ''B''' end as phrase from p")
def provenance_phrases(spark, d):
    p = rendered.parts(spark, d)
    even = F.col("k") % 2 == 0
    rows = p.select("k", F.when(even, "well").otherwise("filter").alias("site"), F.lit("Values").alias("role"), F.when(even, F.concat(F.lit("V"), F.col("k").cast("string"))).alias("visual"), F.when(even, "P").alias("page"), F.when(~even, "B").alias("bookmark"), (~even).alias("mobile"))
    return rows.select("k", scan.provenance().alias("phrase"))


@query(W + "select k, ['table not found in the model', 'field not found in the model', 'bound artifact ''a'' has unresolvable references'][k % 3 + 1] as phrase from p")
def reason_phrases(spark, d):
    p = rendered.parts(spark, d)
    rows = p.select("k", _pick(["table_not_found", "field_not_found", "bound_artifact_broken"], F.col("k") % 3).alias("reason"), F.lit("'a'").alias("artifact"), F.lit("t").alias("target"))
    return rows.select("k", writers.reason_phrase().alias("phrase"))


@query(f"{W} select app, count(*) as broken from (select '/app' || (k % 20) as app from p where n > last) group by app")
def app_breakage(spark, d):
    """Literals that name an existing measure and one beyond the last part."""
    m = mq._model(spark, d)
    ix = binding.Index(m)
    p = rendered.parts(spark, d)
    lit = p.select(F.concat(F.lit("/app"), (F.col("k") % 20).cast("string")).alias("app"), "model", F.lit("p.ts").alias("path"), F.col("k").cast("int").alias("line"), rendered._t("EVALUATE ROW(\"x\", [M {k}] + [M {n}])").alias("text"), F.lit(True).alias("whole"))
    return binding.anchored_breakage(lit, ix, binding.calculated_schemas(m, ix)).groupBy("app").agg(F.count("*").alias("broken"))


@query(f"{W} select {mq.M_} as owner, {mq._sid('relationship', chr(39) + 't ' + chr(39) + ' || k', chr(39) + 'key' + chr(39), chr(39) + 't ' + chr(39) + ' || n', chr(39) + 'key' + chr(39))} as target from p where n <= last and k % 2 = 0")
def activated_relationships(spark, d):
    m = mq._model(spark, d, "relationship")
    p = rendered.parts(spark, d).where("k % 2 = 0").withColumns({"t": rendered._t("T {k}"), "m": rendered._t("M {k}")})
    exprs = p.select("model", md.object_id("measure", "t", "m").alias("owner"), rendered._t("CALCULATE([M {k}], USERELATIONSHIP('T {n}'[Key], 'T {k}'[Key]))").alias("text"))
    return binding.activated(exprs, m)


@query(W + "select cast(count(*) filter (where k % 10 = 0) as bigint) as opaque from p")
def opaque_sources(spark, d):
    from weftline.functions import lexers

    p = rendered.parts(spark, d).select("k", F.when(F.col("k") % 10 == 0, 'Odbc.Query("dsn", "select 1")').otherwise('"Odbc.Query" & Odbc.DataSource("x")').alias("text"))
    return lexers.m_refs_of(p).where("shape = 'native'").agg(F.countDistinct("k").alias("opaque"))


@query(W + f"select {mq.T} as id, cast(1 as bigint) as n from p where size >= 45")
def bound_tables(spark, d):
    """Tables that a bound member belongs to."""
    objects = md.objects(mq._model(spark, d, *md.KINDS))
    p = rendered.parts(spark, d).where("size >= 45").withColumns({"t": rendered._t("T {k}"), "m": rendered._t("M {k}")})
    return scan.owners_of(objects, p.select(md.object_id("measure", "t", "m").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
