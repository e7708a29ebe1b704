"""Queries of the readers and of the model operators, on files rendered from the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lexers
from weftline.operators import binding, graph
from weftline.operators import model as md
from weftline.operators.tables import written
from weftline.plans import rendered, scan
from weftline.plans.queries import query
from weftline.plans.tables import table
from weftline.sources import apps, pbir, query_logs, tmdl, tmsl
from weftline.sources.facts import parse_files, typed

P = "p as (select cast(p_partkey as bigint) as k, cast(p_partkey + 20 * (p_partkey // 20 + 1) as bigint) as n, p_brand as brand, cast(p_size as bigint) as size, max(p_partkey) over () as last, '/w/m' || (p_partkey % 20) || '.SemanticModel' as model, '/w/r' || (p_partkey % 20) || '.Report' as report from part)"
W = f"with {P} "


def _facts(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Facts of all models, of these kinds if any are named."""
    return parse_files(rendered.model_files(spark, d), tmdl.parse, list(kinds) or None)


def _model(spark: SparkSession, d: str, *kinds: str) -> md.Model:
    """The models, of facts of these kinds if any are named."""
    return md.Model(_facts(spark, d, *kinds))  # written once for each query


def _kind(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return typed(_facts(spark, d, kind), kind, md.PROPS[kind])


def _sid(kind: str, *parts: str) -> str:
    """SQL of an object's id."""
    return "model || chr(31) || '" + kind + "'" + "".join(f" || chr(31) || lower({x})" for x in parts)


T, TN = _sid("table", "'t ' || k"), _sid("table", "'t ' || n")
M_, MN = _sid("measure", "'t ' || k", "'m ' || k"), _sid("measure", "'t ' || n", "'m ' || n")
KEY, KEYN, BRAND, CK, CALC = _sid("column", "'t ' || k", "'key'"), _sid("column", "'t ' || n", "'key'"), _sid("column", "'t ' || k", "brand"), _sid("column", "'t ' || k", "'c ' || k"), _sid("column", "'t ' || k", "'calc'")
H, PT, I, REL = _sid("hierarchy", "'t ' || k", "'h'"), _sid("partition", "'t ' || k", "'p'"), _sid("calculation_item", "'t ' || k", "'i ' || k"), _sid("relationship", "'t ' || k", "'key'", "'t ' || n", "'key'")
ROLE, EXPR, FUN = _sid("role", "'r ' || k"), _sid("expression", "'e ' || k"), _sid("function", "'f ' || k")
BODY = "'SUM(''T ' || k || '''[' || brand || ']) + [M ' || n || ']'"
DETAIL = "'SELECTCOLUMNS(''T ' || k || ''',' || chr(10) || chr(9) || '\"a\", [Key])'"


@query(W + "select model, 'T ' || k as name, k % 7 = 0 as hidden, k % 50 = 3 as is_calculation_group from p")
def tmdl_tables(spark, d):
    return _kind(spark, d, "table").select("model", "name", "hidden", "is_calculation_group")


@query(W + """select model, 'T ' || k as tbl, unnest(['Key', brand, 'C ' || k, 'Calc']) as name, unnest(['data', 'data', 'data', 'calculated']) as column_kind, unnest([null, 'Key', null, null]) as sort_by,
    unnest([null, case when k % 8 = 0 then 'Key' end, null, null]) as group_by, unnest([null, null, null, '[Key] * ' || size]) as expr from p""")
def tmdl_columns(spark, d):
    return _kind(spark, d, "column").select("model", "tbl", "name", "column_kind", "sort_by", F.nullif(F.array_join("group_by", ","), F.lit("")).alias("group_by"), "expr")


@query(W + f"select model, 'M ' || k as name, {BODY} as expr, case when k % 5 = 0 then '\"0\"' end as format, case when k % 6 = 0 then {DETAIL} end as detail, case when k % 97 = 0 then 'why ' || k end as keep from p")
def tmdl_measures(spark, d):
    return _kind(spark, d, "measure").select("model", "name", "expr", "format", "detail", "keep")


@query(W + "select model, 'M ' || k as name, '[M ' || n || ']' as kpi_target from p where k % 4 = 0")
def tmdl_kpis(spark, d):
    return _kind(spark, d, "measure").where("has_kpi").select("model", "name", "kpi_target")


@query(W + "select model, 'T ' || k as tbl, unnest(['L1', 'L2']) as level, unnest([brand, 'Key']) as \"column\", unnest([0, 1]) as ordinal from p")
def tmdl_levels(spark, d):
    return _kind(spark, d, "level").select("model", "tbl", F.col("name").alias("level"), "column", "ordinal")


@query(W + "select model, 'T ' || k as tbl, 'm' as partition_kind, 'import' as mode, 'let' || chr(10) || '    Source = #\"T ' || n || '\",' || chr(10) || chr(10) || '    Out = Table.RemoveColumns(Source, {\"C ' || k || '\"})' || chr(10) || 'in' || chr(10) || '    Out' as text from p")
def tmdl_partitions(spark, d):
    return _kind(spark, d, "partition").select("model", "tbl", "partition_kind", "mode", "text")


@query(W + "select model, 'T ' || k as tbl, 'basic' as policy_type, '#\"E ' || (k % 20) || '\"' as source from p where k % 10 = 0")
def tmdl_refresh_policies(spark, d):
    return _kind(spark, d, "refresh_policy").select("model", "tbl", "policy_type", "source")


@query(W + "select model, 'T ' || k as tbl, 'I ' || k as name, 'SELECTEDMEASURE()' as expr, '\"x\"' as format from p where k % 50 = 3")
def tmdl_calculation_items(spark, d):
    return _kind(spark, d, "calculation_item").select("model", "tbl", "name", "expr", "format")


@query(W + "select model, 'T ' || k as tbl, unnest(['Key', brand]) as name, unnest(['primary', 'associated']) as role from p where k % 60 = 4")
def tmdl_calendars(spark, d):
    return _kind(spark, d, "calendar_column").select("model", "tbl", "name", "role")


@query(W + "select model, 'T ' || k as tbl, 'Key' as \"column\", 'r' || k as relationship, 'T ' || n as target_table, 'H' as target_hierarchy from p where k % 12 = 0")
def tmdl_variations(spark, d):
    return _kind(spark, d, "variation").select("model", "tbl", "column", "relationship", "target_table", "target_hierarchy")


@query(W + "select model, 'r' || k as name, 'T ' || k as from_table, 'T ' || n as to_table, k % 4 <> 1 as is_active, k % 3 = 0 as both_ways from p where n <= last")
def tmdl_relationships(spark, d):
    m = md.Model(_facts(spark, d, "relationship"), materialise=False)
    return m.relationships().select("model", "name", "from_table", "to_table", "is_active", "both_ways")


@query(W + "select model, 'R ' || k as role, 'T ' || k as tbl, '[Key] > ' || k as filter, brand as \"column\", 'none' as permission from p where k < 20")
def tmdl_roles(spark, d):
    f = written(_facts(spark, d, "table_permission", "column_permission"))  # both sides of the join from one reading
    t = typed(f, "table_permission", md.PROPS["table_permission"]).select("model", F.col("name").alias("role"), "tbl", "filter")
    c = typed(f, "column_permission", md.PROPS["column_permission"]).select("model", F.col("name").alias("role"), "tbl", "column", "permission")
    return t.join(c, ["model", "role", "tbl"])


@query(W + "select model, 'E ' || k as name, '\"x\"' as text, case when k % 2 = 0 then 'T ' || k end as parameter_table, case when k % 2 = 0 then 'Key' end as parameter_column from p where k < 20")
def tmdl_expressions(spark, d):
    return _kind(spark, d, "expression").select("model", "name", "text", "parameter_table", "parameter_column")


@query(W + "select model, 'F ' || k as name, '(a) =>' || chr(10) || '    a + ' || k as text from p where k < 20")
def tmdl_functions(spark, d):
    return _kind(spark, d, "function").select("model", "name", "text")


@query(W + "select model, 'unknown_property' as skip_kind, 'odd on table T ' || k as detail, count(*) as n from p where k % 13 = 0 group by all")
def tmdl_notices(spark, d):
    return typed(_facts(spark, d, "skip"), "skip", "skip_kind string, detail string").groupBy("model", "skip_kind", "detail").agg(F.count("*").alias("n"))


@query(W + "select model, unnest(['table', 'measure']) as kind, unnest(['T ' || k, 'M ' || k]) as name, unnest([2, 5 + cast(k % 7 = 0 as integer)]) as line from p")
def tmdl_positions(spark, d):
    return _facts(spark, d, "table", "measure").select("model", "kind", "name", "line")


@query(W + "select model, 'T ' || k as name, case when k >= 20 and k < 40 then 1 else 1 + (k // 20 + cast(k < 20 as integer)) end as place from p")
def tmdl_table_order(spark, d):
    from pyspark.sql import Window

    t = tmdl.in_order(_facts(spark, d, "table", "table_ref")).where("kind = 'table'")
    return t.select("model", "name", F.row_number().over(Window.partitionBy("model").orderBy("place")).cast("long").alias("place"))


@query(W + """select 'm' || k as model, unnest(['table', 'column', 'column', 'column', 'measure', 'partition', 'relationship']) as kind, unnest(['T ' || k, 'Key', brand, 'Calc', 'M ' || k, 'P', 'r']) as name,
    unnest([null, null, null, '[Key] *' || chr(10) || size, 'SUM(''T ' || k || '''[' || brand || '])', 'let' || chr(10) || '  a = 1' || chr(10) || 'in a', null]) as text from p""")
def tmsl_objects(spark, d):
    f = parse_files(rendered.model_json(spark, d), tmsl.parse).where("kind <> 'model'")
    text = F.coalesce(F.get_json_object("props", "$.expr"), F.get_json_object("props", "$.text"))
    return f.select("model", "kind", "name", text.alias("text"))


@query(W + f"""select model, kind, id, display from (
    select model, unnest(['table', 'column', 'column', 'column', 'column', 'measure', 'hierarchy', 'partition']) as kind, unnest([{T}, {KEY}, {BRAND}, {CK}, {CALC}, {M_}, {H}, {PT}]) as id,
      unnest(['table ''T ' || k || '''', '''T ' || k || '''[Key]', '''T ' || k || '''[' || brand || ']', '''T ' || k || '''[C ' || k || ']', '''T ' || k || '''[Calc]', '''T ' || k || '''[M ' || k || ']', 'hierarchy ''T ' || k || '''[H]', 'partition ''T ' || k || '''[P]']) as display from p
    union all select model, 'calculation_item', {I}, 'calculation item ''T ' || k || '''[I ' || k || ']' from p where k % 50 = 3
    union all select model, 'relationship', {REL}, 'relationship ''T ' || k || '''[Key] -> ''T ' || n || '''[Key]' from p where n <= last
    union all select model, unnest(['role', 'expression', 'function']), unnest([{ROLE}, {EXPR}, {FUN}]), unnest(['role ''R ' || k || '''', 'expression ''E ' || k || '''', 'function ''F ' || k || '''']) from p where k < 20)""")
def model_objects(spark, d):
    return md.objects(_model(spark, d, *md.KINDS)).select("model", "kind", "id", "display")


STRUCTURAL = f"""structural as (
    select unnest([{KEY}, {BRAND}, {CK}, {CALC}, {M_}, {H}]) as src, {T} as dst, 'table_member' as prov from p
    union all select {I}, {T}, 'table_member' from p where k % 50 = 3
    union all select {T}, unnest([{KEY}, {BRAND}, {CK}, {CALC}]), 'engine_managed' from p where k % 50 = 3
    union all select {T}, unnest([{KEY}, {BRAND}]), 'engine_managed' from p where k % 60 = 4
    union all select {BRAND}, {KEY}, 'sort_by_column' from p
    union all select {BRAND}, {KEY}, 'group_by_column' from p where k % 8 = 0
    union all select {T}, {PT}, 'table_partition' from p
    union all select {H}, unnest([{BRAND}, {KEY}]), 'hierarchy_level' from p
    union all select unnest([{T}, {TN}]), {REL}, case when k % 4 = 1 then 'inactive_relationship' else 'relationship' end from p where n <= last
    union all select {REL}, unnest([{KEY}, {KEYN}]), case when k % 4 = 1 then 'inactive_relationship_endpoint' else 'relationship_endpoint' end from p where n <= last
    union all select {ROLE}, unnest([{T}, {BRAND}]), 'role_permission' from p where k < 20
    union all select {EXPR}, {KEY}, 'm_parameter_binding' from p where k < 20 and k % 2 = 0)"""
DAX = f"""dax as (
    select {M_} as src, {BRAND} as dst, 'measure' as prov from p
    union all select {M_}, {MN}, 'measure' from p where n <= last
    union all select {M_}, unnest([{T}, {KEY}]), 'measure_detail_rows' from p where k % 6 = 0
    union all select {M_}, {MN}, 'kpi_target' from p where k % 4 = 0 and n <= last
    union all select {CALC}, {KEY}, 'calculated_column' from p
    union all select {ROLE}, {KEY}, 'row_filter' from p where k < 20)"""
M_EDGES = f"""m_edges as (
    select {PT} as src, {TN} as dst, 'power_query' as prov from p where n <= last
    union all select {PT}, {_sid('expression', "'e ' || (k % 20)")}, 'power_query' from p where k % 10 = 0)"""


@query(f"{W}, {STRUCTURAL} select src, dst, prov from structural")
def model_structural_edges(spark, d):
    return md.structural_edges(_model(spark, d))


@query(f"""{W} select model, unnest([{M_}, {CALC}]) as owner, unnest(['measure', 'calculated_column']) as kind, 't ' || k as home_key, unnest([{BODY}, '[Key] * ' || size]) as text from p
    union all select model, {M_}, 'measure_format_string', 't ' || k, '"0"' from p where k % 5 = 0
    union all select model, {M_}, 'measure_detail_rows', 't ' || k, {DETAIL} from p where k % 6 = 0
    union all select model, {M_}, 'kpi_target', 't ' || k, '[M ' || n || ']' from p where k % 4 = 0
    union all select model, {I}, unnest(['calculation_item', 'calculation_item_format_string']), 't ' || k, unnest(['SELECTEDMEASURE()', '"x"']) from p where k % 50 = 3
    union all select model, {ROLE}, 'row_filter', 't ' || k, '[Key] > ' || k from p where k < 20
    union all select model, {FUN}, 'function', null, '(a) =>' || chr(10) || '    a + ' || k from p where k < 20""")
def model_dax_expressions(spark, d):
    return md.dax_expressions(_model(spark, d, *md.DAX_KINDS))


@query(f"""{W} select {PT} as owner, 'partition' as kind, k % 10 >= 0 as some from p union all select {PT}, 'policy_source', true from p where k % 10 = 0 union all select {EXPR}, 'expression', true from p where k < 20""")
def model_m_expressions(spark, d):
    return md.m_expressions(_model(spark, d, *md.M_KINDS)).select("owner", "kind", (F.char_length("text") > 0).alias("some"))


@query(f"{W}, {DAX} select distinct src, dst, prov from dax")
def model_dax_edges(spark, d):
    m = _model(spark, d)
    return graph.dedupe_edges(binding.dax_edges(binding.Dax(m, binding.Index(m)), m))


@query(f"{W}, {M_EDGES} select distinct src, dst, prov from m_edges")
def model_m_edges(spark, d):
    m = _model(spark, d)
    return graph.dedupe_edges(binding.bind_m(m, binding.Index(m))[0])


@query(f"{W} select {CK} as \"column\", {PT} as owners from p")
def model_m_named_columns(spark, d):
    m = _model(spark, d)
    return binding.bind_m(m, binding.Index(m))[1].select("column", F.array_join("owners", ",").alias("owners"))


@query(f"{W} select {REL} as rel, k % 4 <> 1 as is_active, {TN} as src, {T} as dst from p where n <= last union all select {REL}, k % 4 <> 1, {T}, {TN} from p where n <= last and k % 3 = 0")
def model_filter_flows(spark, d):
    return md.filter_flows(_model(spark, d, "relationship", "column"))


@query(f"{W} select {M_} as id, 'why ' || k as reason from p where k % 97 = 0")
def model_kept(spark, d):
    return md.kept(_model(spark, d, *md.KINDS))


@query(f"{W} select {M_} as owner, '[M ' || n || ']' as refs from p where n > last")
def model_broken_artifacts(spark, d):
    m = _model(spark, d)
    ix = binding.Index(m)
    return binding.broken_artifacts(binding.Dax(m, ix), ix, binding.calculated_schemas(m, ix)).select("owner", F.array_join("refs", ",").alias("refs"))


@query(f"{W}, dates as (select {_sid('table', chr(39) + 't ' + chr(39) + ' || n')} as id, '''T ' || k || '''[Key]' as source_column from p where k % 12 = 0) select id, source_column from dates")
def model_date_sources(spark, d):
    return md.date_sources(_model(spark, d, "relationship", "variation"))


# Reports

SHOWN = "shown as (select * from p where size >= 45)"


def _report(spark: SparkSession, d: str) -> DataFrame:
    return parse_files(rendered.report_files(spark, d), pbir.parse)


@query(f"{W}, {SHOWN} select report, 'V' || k as visual, 'P' || (k % 3) as page, 'card' as visual_type from shown")
def pbir_visuals(spark, d):
    return typed(_report(spark, d), "visual", "page string, visual_type string").select(F.col("model").alias("report"), F.col("name").alias("visual"), "page", "visual_type")


@query("select '/w/r' || m || '.Report' as report, 'P' || page as page, 'Page ' || page as display_name, page = 2 as hidden from range(20) a(m), range(3) b(page)")
def pbir_pages(spark, d):
    return typed(_report(spark, d), "page", "display_name string, hidden boolean").select(F.col("model").alias("report"), F.col("name").alias("page"), "display_name", "hidden")


BINDINGS = f"""{SHOWN}, bindings as (
    select report, 'V' || k as visual, 'well' as site, 'measure' as tkind, 'T ' || k as tbl, 'M ' || k as name, false as inactive, k, model, brand, n, last from shown
    union all select report, 'V' || k, 'well', 'column', 'T ' || k, 'Gone', false, k, model, brand, n, last from shown where k % 17 = 0
    union all select report, 'V' || k, 'well', 'measure', 'T ' || k, 'Nope', false, k, model, brand, n, last from shown where k % 19 = 0
    union all select report, 'V' || k, 'well', 'column', 'X ' || k, 'Key', false, k, model, brand, n, last from shown where k % 23 = 0
    union all select report, 'V' || k, 'well', 'hierarchy_level', 'T ' || k, null, true, k, model, brand, n, last from shown where k % 2 = 0
    union all select report, 'V' || k, 'sort', 'column', 'T ' || k, brand, false, k, model, brand, n, last from shown where k % 5 = 0
    union all select report, 'V' || k, 'filter', 'column', 'T ' || k, unnest(['Key', 'Calc']), false, k, model, brand, n, last from shown where k % 3 = 0)"""


@query(f"{W}, {BINDINGS} select report, visual, site, tkind, tbl, name, inactive from bindings")
def pbir_bindings(spark, d):
    return pbir.bindings(_report(spark, d)).where("bookmark is null").select("report", "visual", "site", "tkind", "tbl", "name", F.coalesce("inactive", F.lit(False)).alias("inactive"))


@query(f"{W}, {SHOWN} select report, 'unknown_property' as skip_kind, 'pages/P' || (k % 3) || '/visuals/V' || k as at from shown where k % 29 = 0")
def pbir_notices(spark, d):
    return typed(_report(spark, d), "skip", "skip_kind string, at string").select(F.col("model").alias("report"), "skip_kind", "at")


@query("select '/w/r' || m || '.Report' as model, unnest(['p0', 'p1', 'p2', 'p' || (7 + m % 2)]) as page_key, unnest([true, true, false, true]) as ordered, unnest([true, true, true, false]) as foldered from range(20) a(m)")
def pbir_live_pages(spark, d):
    return pbir.live_pages(_report(spark, d))


@query("select '/w/r' || m || '.Report' as model, unnest(['p2', 'p' || (7 + m % 2)]) as page_key, 'stale_state' as skip_kind from range(20) a(m)")
def pbir_page_notices(spark, d):
    return pbir.page_notices(_report(spark, d))


@query(f"{W} select report, 'B' || k as bookmark, cast(k % 6 < 3 as bigint) as live_sections, cast(k % 6 >= 3 as bigint) as stale_sections, k % 6 >= 3 as fully_stale from p where k % 12 = 5")
def pbir_bookmarks(spark, d):
    return pbir.bookmark_states(_report(spark, d)).select("report", "bookmark", "live_sections", "stale_sections", "fully_stale")


@query("select '/w/r' || m || '.Report' as report, '/w/m' || m || '.SemanticModel' as model, case when m % 2 = 0 then 'path' else 'catalog' end as tier from range(20) a(m)")
def report_pairing(spark, d):
    f = _report(spark, d)
    datasets = typed(f, "dataset", "how string").select(F.col("model").alias("report"), "how", F.col("name").alias("reference"))
    models = rendered.pairing(spark).select("model", F.lit(None).cast("string").alias("display_name"))
    return scan.pair_reports(datasets, models)


def _bound(spark: SparkSession, d: str) -> tuple[md.Model, binding.Index, DataFrame]:
    m = _model(spark, d)
    ix = binding.Index(m)
    schemas = binding.calculated_schemas(m, ix)
    f = written(_report(spark, d))
    rows = binding.bind_reports(pbir.bindings(f), rendered.pairing(spark), m, ix, schemas, binding.broken_artifacts(binding.Dax(m, ix), ix, schemas), binding.report_measures(f))
    return m, ix, rows


TARGETS = f"""targets as (
    select report, visual, site, {M_} as target, case when n > last then 'bound_artifact_broken' end as reason from bindings where name = 'M ' || k
    union all select report, visual, site, {T}, 'field_not_found' from bindings where name = 'Gone'
    union all select report, visual, site, null, 'measure_not_found' from bindings where name = 'Nope'
    union all select report, visual, site, null, 'table_not_found' from bindings where tbl = 'X ' || k
    union all select report, visual, site, unnest([{H}, {BRAND}]), null from bindings where tkind = 'hierarchy_level'
    union all select report, visual, site, case when name = brand then {BRAND} when name = 'Key' then {KEY} else {CALC} end, null from bindings where tbl = 'T ' || k and tkind = 'column' and name <> 'Gone')"""


@query(f"{W}, {BINDINGS}, {TARGETS} select report, visual, site, target, reason from targets")
def report_binding_ladder(spark, d):
    return _bound(spark, d)[2].where("bookmark is null").select("report", "visual", "site", "target", "reason")


LIVE = f"""{STRUCTURAL}, {DAX}, {M_EDGES}, {BINDINGS}, {TARGETS},
    picks as (select t.target as src, {I} as dst, 'binding' as prov from p join targets t on t.target in ({KEY}, {BRAND}, {CK}, {CALC}) where k % 50 = 3),
    edges as (select distinct src, dst, prov from (from structural union all from dax union all from m_edges union all from picks) where src <> dst),
    seeds as (select target as id from targets where target is not null union select {KEY} from p where k % 12 = 5 and k % 6 < 3 union select {ROLE} from p where k < 20 union select {M_} from p where k % 97 = 0),
    strong as (select id from seeds union select e.dst from strong s join edges e on e.src = s.id where e.prov not in ('relationship_endpoint', 'inactive_relationship', 'inactive_relationship_endpoint')),
    live as (select id from strong union select e.dst from live s join edges e on e.src = s.id where e.prov not in ('table_member', 'inactive_relationship', 'inactive_relationship_endpoint'))"""


def _scan(spark: SparkSession, d: str) -> scan.Analysis:
    return scan.analyse(_facts(spark, d), _report(spark, d), rendered.pairing(spark))


ALL = f"""objects as (select model, unnest(['table', 'column', 'column', 'column', 'column', 'measure', 'hierarchy', 'partition']) as kind, unnest([{T}, {KEY}, {BRAND}, {CK}, {CALC}, {M_}, {H}, {PT}]) as id from p
    union all select model, 'calculation_item', {I} from p where k % 50 = 3 union all select model, 'relationship', {REL} from p where n <= last
    union all select model, unnest(['role', 'expression', 'function']), unnest([{ROLE}, {EXPR}, {FUN}]) from p where k < 20)"""


@query(f"with recursive {P}, {LIVE}, {ALL}, u as (select dst as id, count(distinct src) as n_used from edges group by dst) select o.kind, o.id, coalesce(u.n_used, 0) as used_by from objects o anti join live using (id) left join u on u.id = o.id")
def scan_unused(spark, d):
    a = _scan(spark, d)
    rows = scan.unused(a).where("kind not in ('report_measure', 'bookmark')")
    uses = a.edges.where("prov <> 'stale_bookmark'").join(a.objects.where("kind = 'report_measure'").select(F.col("id").alias("src")), "src", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("used_by"))
    return rows.select("kind", "id").join(uses, "id", "left").select("kind", "id", F.coalesce("used_by", F.lit(0)).alias("used_by"))


@query(f"with recursive {P}, {LIVE}, {ALL} select model, count(*) as objects, count(live.id) as reachable, count(*) - count(live.id) as unused from objects left join live using (id) group by model")
def scan_summary(spark, d):
    a = _scan(spark, d)
    return scan.summary(a).where(F.col("model").endswith(".SemanticModel")).select("model", "objects", "reachable", "unused")


@query(f"""{W}, {BINDINGS}, {TARGETS} select report, 'P' || (cast(substr(visual, 2) as bigint) % 3) as page, visual, reason, count(*) as findings from targets where reason is not null group by all""")
def scan_broken(spark, d):
    a = _scan(spark, d)
    return scan.broken(a).groupBy("report", "page", "visual", "reason").agg(F.count("*").alias("findings"))


@query(f"{W}, {ALL} select model, case kind when 'table' then 'tables' when 'column' then 'columns' when 'measure' then 'measures' when 'relationship' then 'relationships' else 'others' end as bucket, count(*) as objects from objects group by all")
def scan_overview(spark, d):
    from weftline.operators import findings

    return findings.buckets(md.objects(_model(spark, d, *md.KINDS)))


# Query logs and apps

LOG = """e as (select cast(event_id as bigint) as id, cast(user_id as bigint) as u, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from events where event_type in ('purchase', 'view', 'click')),
    q as (select id, u, ts, case when id % 31 = 0 then null when id % 5 = 0 then 'SELECT [Measures].[M ' || (id % 97) || '] ON 0 FROM [c]' else 'EVALUATE "a, b" [M ' || (id % 97) || ']' end as text,
        case when id % 31 = 0 then 'dax' when id % 5 = 0 then 'mdx' else 'dax' end as language, 'm' || (id % 4) as item from e)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    return query_logs.logged_queries(query_logs.raw_rows(rendered.log_files(spark, d)))


@query(f"with {LOG} select '/log/' || u as path, text, language, ts, item, count(*) as n from q where text is not null group by all")
def log_queries(spark, d):
    return _log(spark, d).where("text is not null").groupBy("path", "text", "language", "ts", "item").agg(F.count("*").alias("n"))


@query(f"with {LOG} select '/log/' || u as path, count(*) as n from q where text is null group by all")
def log_notices(spark, d):
    return query_logs.log_notices(_log(spark, d)).groupBy("path").agg(F.count("*").alias("n"))


@query(f"with {LOG} select min(ts) as first_seen, max(ts) as last_seen, count(*) as queries, count(distinct item) as items from q where text is not null")
def log_time_window(spark, d):
    return query_logs.window(_log(spark, d))


@query(f"with {LOG} select count(*) as queries from q where text is not null and item = 'm2'")
def log_retained(spark, d):
    return query_logs.retain(_log(spark, d), item="M2").agg(F.count("*").alias("queries"))


@query(f"with {P}, {LOG} select distinct q.text as query, {M_} as id from q join p on p.k = q.id % 97 and p.model = '/w/' || q.item || '.SemanticModel' where q.text is not null")
def log_query_roots(spark, d):
    m = _model(spark, d)
    q = _log(spark, d).where("text is not null").select(F.col("text").alias("query"), F.concat(F.lit("/w/"), "item", F.lit(".SemanticModel")).alias("model"), "language", "text").distinct()
    return binding.query_roots(q, binding.Index(m)).select("query", "id")


@query(W + """select '/app' || (k % 20) as app, k, unnest([2, 3, 3, 3]) as line, unnest(['T ' || k, 'EVALUATE ''T ' || k || ''' ', ' [M ' || k || ']', 'it''s']) as text, unnest([true, false, false, true]) as whole from p""")
def app_literals(spark, d):
    f = parse_files(rendered.app_files(spark, d), apps.parse)
    return typed(f, "code_literal", "text string, whole boolean").select(F.col("model").alias("app"), F.regexp_extract("path", r"/p([0-9]+)\.ts", 1).cast("long").alias("k"), "line", "text", "whole")


@query(W + f"""select '/app' || (k % 20) as app, k, unnest([{T}, {T}, {M_}]) as id, unnest([2, 3, 3]) as line from p""")
def app_object_roots(spark, d):
    m = _model(spark, d)
    f = parse_files(rendered.app_files(spark, d), apps.parse)
    lit = typed(f, "code_literal", "text string, whole boolean").withColumns({"app": F.col("model"), "model": F.concat(F.lit("/w/m"), F.regexp_extract("model", "([0-9]+)$", 1), F.lit(".SemanticModel"))})
    return binding.app_roots(lit, binding.Index(m)).select("app", F.regexp_extract("path", r"/p([0-9]+)\.ts", 1).cast("long").alias("k"), "id", "line")


# Lexers

@query(W + """, t as (select k, regexp_extract_all('SUM ( ''' || brand || '''[Price] ) + [Total] // x', '''[^'']*''|\\[[^\\]]*\\]|//.*|[A-Za-z]+|[0-9]+|\\s+|.') as tokens from p)
    select k, cast(len(list_filter(tokens, lambda t: not regexp_matches(t, '^(\\s|//)'))) as bigint) as n_tokens from t""")
def dax_significant_tokens(spark, d):
    p = rendered.parts(spark, d).select("k", rendered._t("SUM ( '{brand}'[Price] ) + [Total] // x").alias("text"))
    return lexers.dax_fingerprints(p).select("k", "n_tokens")


@query(W + "select k, case k % 6 when 0 then 'unterminated' when 1 then 'unbalanced' when 2 then 'unbalanced' when 3 then 'empty' end as error from p")
def dax_structure(spark, d):
    texts = F.element_at(F.array(*map(F.lit, ['SUM("a', "SUM(a", "{(})", " -- only", "SUM({1, 2})", "'T'[a] + \"x\""])), (F.col("k") % 6 + 1).cast("int"))
    return lexers.structural_errors(rendered.parts(spark, d).select("k", texts.alias("text"))).select("k", "error")


@query(W + "select k, 'A ' || k as table_a, 'K' as column_a, 'B' as table_b, 'L' as column_b from p")
def dax_activations(spark, d):
    return lexers.activations(rendered.parts(spark, d).select("k", rendered._t("CALCULATE([M], USERELATIONSHIP('A {k}'[K], B[L]))").alias("text")))


@query(W + "select k, unnest(['v' || k, 'w']) as name from p")
def dax_variables(spark, d):
    return lexers.variables(rendered.parts(spark, d).select("k", rendered._t("VAR V{k} = 1 VAR w = 2 RETURN V{k}").alias("text")))


@query(W + """select k, unnest(['name', 'name', 'name', 'name', 'name', 'column_string', 'field', 'name', 'field', 'name', 'name']) as shape, unnest([null, null, null, null, null, null, 'T ' || k, null, null, null, null]) as table_name,
    unnest(['S', 'Table.Column', 'Table', 'Column', 'Raw ' || k, 'Name', 'Col', 'T ' || k, 'x y', 'q', 'S']) as name from p""")
def m_references(spark, d):
    return lexers.m_refs_of(rendered.parts(spark, d).select("k", rendered._t('let S = Table.Column(#"Raw {k}", "Name"), q = each #"T {k}"[Col] & [x y] in S').alias("text")))


@query(W + "select k, unnest(['measure', 'field']) as mdx_kind, unnest(['M ' || k, 'Date']) as name, unnest([null, 'Cal']) as hierarchy, unnest([null, 'Year']) as level from p")
def mdx_targets(spark, d):
    return lexers.mdx_targets_of(rendered.parts(spark, d).select("k", rendered._t("SELECT [Measures].[M {k}] ON 0, [Date].[Cal].[Year].&[{k}] ON 1").alias("text")))


@query("select c_custkey, (coalesce(b, 'onedirection') <> 'onedirection') or (f = 'one' and coalesce(t, 'one') = 'one') as both_ways from (select c_custkey, case c_custkey % 4 when 1 then 'onedirection' when 2 then 'bothdirections' when 3 then 'automatic' end as b, case c_custkey // 4 % 3 when 1 then 'one' when 2 then 'many' else 'none' end as f, case c_custkey // 12 % 3 when 1 then 'one' when 2 then 'many' end as t from customer)")
def both_ways_combinations(spark, d):
    from weftline.functions import names

    pick = lambda values, by: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (by + 1).cast("int"))
    k = F.col("c_custkey")
    quarter, dozen = F.floor(k / 4), F.floor(k / 12)
    return table(spark, d, "customer").select("c_custkey", names.filters_both_ways(pick([None, "oneDirection", "BothDirections", "automatic"], k % 4), pick([None, "One", "many"], quarter % 3), pick([None, "one", "Many"], dozen % 3)).alias("both_ways"))
