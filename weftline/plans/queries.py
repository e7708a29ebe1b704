"""One query per operator on the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lexers, names
from weftline.operators import findings as ops
from weftline.operators import graph
from weftline.plans import scan
from weftline.plans.tables import GRAPH_SQL, LIVE_SQL, LOG_SQL, edges, nodes, query_log, roots, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


G = f"with recursive {GRAPH_SQL}"
GL = f"{G},\n{LIVE_SQL}"


def _live(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    return graph.liveness(roots(spark, d), e)


@query(f"{G}, strong as (select id from roots union select e.dst from strong s join edges e on e.src = s.id where e.prov <> 'relationship_endpoint') select id from strong")
def reach_strong(spark, d):
    return graph.reach(roots(spark, d), graph.strong(edges(spark, d))).select("id")


@query(f"{G}, weak as (select id from roots union select e.dst from weak s join edges e on e.src = s.id where e.prov <> 'table_member') select id from weak")
def reach_weak(spark, d):
    return graph.reach(roots(spark, d), graph.weak(edges(spark, d))).select("id")


@query(f"{GL} select n.kind, n.id from nodes n semi join live using (id)")
def used_objects(spark, d):
    return nodes(spark, d).join(_live(spark, d, edges(spark, d)), "id", "left_semi").select("kind", "id")


@query(
    f"""{GL}, uses as (select distinct src, dst from edges),
    c as (select dst as id, count(*) as n, count(l.id) as n_live from uses left join live l on l.id = uses.src group by dst)
    select n.kind, n.id, coalesce(c.n, 0) as used_by_count, coalesce(c.n > 0 and c.n_live = 0, false) as also_unused_all
    from nodes n anti join live using (id) left join c on c.id = n.id"""
)
def unused_objects(spark, d):
    e = edges(spark, d)
    return graph.unused(nodes(spark, d), _live(spark, d, e), e)


@query(f"{GL} select e.dst as id, e.src as used_by, e.prov, l.id is null as also_unused from edges e anti join live x on x.id = e.dst left join live l on l.id = e.src")
def used_by_chain(spark, d):
    e = edges(spark, d)
    live = _live(spark, d, e)
    dead = e.join(live.select(F.col("id").alias("dst")), "dst", "left_anti")
    out = dead.join(live.select(F.col("id").alias("src"), F.lit(False).alias("also_unused")), "src", "left")
    return out.select(F.col("dst").alias("id"), F.col("src").alias("used_by"), "prov", F.coalesce("also_unused", F.lit(True)).alias("also_unused"))


_FLOWS = """flows as (select distinct 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer union select distinct 'n' || s_nationkey, 's' || s_suppkey from supplier
    union select distinct 'n' || n_nationkey, 'r' || n_regionkey from nation),
    ends as (select 'c' || c_custkey as id from customer where c_mktsegment = 'BUILDING' union select 's' || s_suppkey from supplier where s_acctbal >= 5000)"""


@query(
    f"""with recursive {_FLOWS},
    fw as (select f.src as start, f.dst as id from flows f join ends l on l.id = f.src anti join ends x on x.id = f.dst union select w.start, f.dst from fw w join flows f on f.src = w.id anti join ends x on x.id = f.dst),
    bw as (select f.dst as fin, f.src as id from flows f join ends l on l.id = f.dst anti join ends x on x.id = f.src union select w.fin, f.src from bw w join flows f on f.dst = w.id anti join ends x on x.id = f.src)
    select distinct fw.id from fw join bw on fw.id = bw.id and fw.start <> bw.fin"""
)
def bridge_tables(spark, d):
    key = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    flows = c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst")).unionByName(s.select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst"))).unionByName(n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"))).distinct()
    live = c.where("c_mktsegment = 'BUILDING'").select(key("c", "c_custkey").alias("id")).unionByName(s.where("s_acctbal >= 5000").select(key("s", "s_suppkey").alias("id")))
    return graph.bridge_tables(live, flows)


_SLICE = "slice as (select id, 0 as depth from {seed} union select e.{to}, s.depth + 1 from slice s join edges e on e.{at} = s.id where s.depth < {n}), best as (select id, min(depth) as depth from slice group by id)"


def _orders(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))


_SEED = "seed as (select 'o' || o_orderkey as id from orders where o_orderpriority = '1-URGENT'), "


@query(f"{G}, {_SEED}{_SLICE.format(seed='seed', to='dst', at='src', n=2)} select id, cast(depth as integer) as depth from best")
def deps_slice_depth2(spark, d):
    return graph.slice_of(_orders(spark, d), edges(spark, d), 2)


@query(f"{G}, seed as (select 's' || s_suppkey as id from supplier where s_acctbal < 0), {_SLICE.format(seed='seed', to='src', at='dst', n=9)} select id, cast(depth as integer) as depth from best")
def impact_slice(spark, d):
    return graph.slice_of(table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")), edges(spark, d), None, impact=True)


@query(f"{G}, {_SEED}{_SLICE.format(seed='seed', to='dst', at='src', n=2)} select e.src, e.dst, e.prov from edges e semi join best a on a.id = e.src semi join best b on b.id = e.dst")
def induced_edges(spark, d):
    e = edges(spark, d)
    return graph.induced(e, graph.slice_of(_orders(spark, d), e, 2))


@query(
    f"""{G}, {_SEED}{_SLICE.format(seed='seed', to='dst', at='src', n=9)}, inside as (select e.* from edges e semi join best a on a.id = e.src semi join best b on b.id = e.dst),
    keep as (select id from best where id in ('n3', 'n7') union select i.src from keep k join inside i on i.dst = k.id) select id from keep"""
)
def consumer_prune(spark, d):
    e = edges(spark, d)
    ids = graph.slice_of(_orders(spark, d), e, None).select("id")
    return graph.keep_paths_to(graph.induced(e, ids), ids.where("id in ('n3', 'n7')"))


@query(f"{G} select src as consumer, prov from edges where dst = 's1'")
def consumers_of(spark, d):
    return graph.consumers(edges(spark, d), spark.createDataFrame([("s1",)], "dst string")).select("consumer", "prov")


@query(f"{G} select e.src, e.dst as producer, e.prov from edges e semi join (select id from nodes where kind in ('orders', 'customer')) n on n.id = e.src")
def producers_of(spark, d):
    mine = nodes(spark, d).where("kind in ('orders', 'customer')").select(F.col("id").alias("src"))
    return graph.producers(edges(spark, d), mine)


@query(f"{G} select e.dst as id, count(distinct r.id) as root_count from roots r join edges e on e.src = r.id group by e.dst")
def roots_of(spark, d):
    return graph.root_counts(edges(spark, d), roots(spark, d))


@query(f"{G} select kind, count(*) as objects from nodes group by kind")
def overview_counts(spark, d):
    return nodes(spark, d).groupBy("kind").agg(F.count("*").alias("objects"))


@query("select prov, count(*) as n from (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst, l_returnflag as prov from lineitem where 'p' || l_partkey <> 's' || l_suppkey) group by prov")
def edge_dedupe(spark, d):
    key = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    e = table(spark, d, "lineitem").select(key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst"), F.col("l_returnflag").alias("prov"))
    return graph.dedupe_edges(e).groupBy("prov").agg(F.count("*").alias("n"))


@query(
    f"with {LOG_SQL} select object_id, count(distinct query_id) as queries, max(ts) as last_seen, count(distinct user_key) as users, string_agg(distinct report, ',' order by report) as reports from log where operation = 'purchase' group by object_id"
)
def queried_objects(spark, d):
    return ops.queried_objects(query_log(spark, d).where("operation = 'purchase'"))


@query(f"with {LOG_SQL} select min(ts) as first_ts, max(ts) as last_ts, count(*) as queries from log")
def log_window(spark, d):
    return query_log(spark, d).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("queries"))


@query(f"with {LOG_SQL} select query_id, ts from log where upper(operation) = 'PURCHASE'")
def querylog_filter(spark, d):
    return query_log(spark, d).where(F.upper("operation") == "PURCHASE").select("query_id", "ts")


@query(f"with {LOG_SQL} select query_id, report from log where report is null or lower(report) = '3'")
def retain_item(spark, d):
    return query_log(spark, d).where(F.col("report").isNull() | (F.lower("report") == "3")).select("query_id", "report")


def _dims(spark, d):
    p = table(spark, d, "part")
    cols = ops.first_wins(p.select(F.lower("p_brand").alias("table_key"), F.lower("p_type").alias("name_key"), F.col("p_partkey").alias("id")), ["table_key", "name_key"], "id")
    measures = ops.first_wins(p.where("p_size < 25").select(F.lower("p_type").alias("name_key"), (F.col("p_partkey") + 1_000_000).alias("id")), ["name_key"], "id")
    return p, cols, measures


_DIMS = """cols as (select lower(p_brand) as table_key, lower(p_type) as name_key, min(p_partkey) as id from part group by all),
measures as (select lower(p_type) as name_key, min(p_partkey) + 1000000 as id from part where p_size < 25 group by all)"""


@query(f"with {_DIMS} select * from cols")
def first_wins_index(spark, d):
    return _dims(spark, d)[1]


@query(
    f"""with {_DIMS}, refs as (select p_partkey as ref, lower('Brand#' || (p_partkey % 70)) as table_key, lower(p_type) as name_key from part)
    select ref, coalesce(c.id, m.id) as target from refs left join cols c using (table_key, name_key) left join measures m on m.name_key = refs.name_key"""
)
def resolve_qualified_ladder(spark, d):
    p, cols, measures = _dims(spark, d)
    refs = p.select(F.col("p_partkey").alias("ref"), F.lower(F.concat(F.lit("Brand#"), (F.col("p_partkey") % 70).cast("string"))).alias("table_key"), F.lower("p_type").alias("name_key"))
    return ops.resolve_qualified(refs, cols, measures).select("ref", "target")


@query(
    f"""with {_DIMS}, refs as (select p_partkey as ref, lower(p_brand) as home_key, lower(p_type) as name_key from part)
    select ref, m.id as target, 'measure' as via from refs join measures m using (name_key) union all select ref, c.id, 'column' from refs join cols c on c.table_key = refs.home_key and c.name_key = refs.name_key"""
)
def resolve_unqualified_all(spark, d):
    p, cols, measures = _dims(spark, d)
    refs = p.select(F.col("p_partkey").alias("ref"), F.lower("p_brand").alias("home_key"), F.lower("p_type").alias("name_key"))
    return ops.resolve_unqualified(refs, cols, measures)


@query(f"with {_DIMS} select name_key, count(*) as columns from (select distinct lower(p_type) as name_key from part where p_size > 40) join cols using (name_key) group by name_key")
def resolve_columns_fanout(spark, d):
    p, cols, _ = _dims(spark, d)
    return p.where("p_size > 40").select(F.lower("p_type").alias("name_key")).distinct().join(cols, "name_key").groupBy("name_key").agg(F.count("*").alias("columns"))


@query(
    """with a as (select distinct l_partkey as x, l_suppkey as y from lineitem), b as (select distinct l_suppkey as x, l_partkey as y, l_linenumber as n from lineitem)
    select a.x, a.y, count(*) as hits from a join b on least(a.x, a.y) = least(b.x, b.y) and greatest(a.x, a.y) = greatest(b.x, b.y) group by a.x, a.y"""
)
def unordered_pair_join(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).distinct().withColumn("pair", names.unordered_pair(F.col("x"), F.col("y")))
    b = li.select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), "l_linenumber").distinct().withColumn("pair", names.unordered_pair(F.col("u"), F.col("v")))
    return a.join(b, "pair").groupBy("x", "y").agg(F.count("*").alias("hits"))


@query(
    f"""{GL}, sizes as (select 'p' || p_partkey as id, cast(p_size as bigint) * 1024 as bytes from part where p_size > 5)
    select cast(coalesce(sum(bytes), 0) as bigint) as bytes, count(bytes) as sized, count_if(bytes is null) as unsized from (select n.id from nodes n anti join live using (id) where n.kind = 'part') left join sizes using (id)"""
)
def unused_storage(spark, d):
    e = edges(spark, d)
    dead = nodes(spark, d).where("kind = 'part'").join(_live(spark, d, e), "id", "left_anti").select("id", F.lit("").alias("owner"))
    sizes = table(spark, d, "part").where("p_size > 5").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size").cast("long") * 1024).alias("bytes"))
    return ops.unused_storage(dead, sizes)


@query(f"{GL} select p_brand, count(*) as findings, greatest(count(*) over () - 10, 0) as more from part anti join live on live.id = 'p' || p_partkey group by p_brand order by findings desc, lower(p_brand) limit 10")
def worst_tables(spark, d):
    live = _live(spark, d, edges(spark, d))
    dead = table(spark, d, "part").withColumn("id", F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).join(live, "id", "left_anti")
    return ops.worst(dead, "p_brand")


@query("select count(*) as objects, count(l_partkey) as sized from part left join (select distinct l_partkey from lineitem where l_quantity > 45) on l_partkey = p_partkey")
def attach_storage_coverage(spark, d):
    sized = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("s")).distinct()
    return table(spark, d, "part").join(sized, "p_partkey", "left").agg(F.count("*").alias("objects"), F.count("s").alias("sized"))


def _snapshot(spark, d, where):
    o = table(spark, d, "orders").where(where)
    key = names.object_key(F.col("o_orderpriority"), F.col("o_custkey")).alias("key")
    kind = F.when(F.col("o_orderstatus") == "P", "duplicate_measure").when(F.col("o_orderpriority") == "3-MEDIUM", "broken_visual").otherwise("unused")
    return o.groupBy(key).agg(F.min(kind).alias("kind"), F.min(names.fold_name(F.col("o_orderpriority"))).alias("subject"))


_BEFORE, _AFTER = "o_orderdate < timestamp_ntz '1998-01-01'", "o_orderdate >= timestamp_ntz '1997-06-01'"
_SNAP = "select lower(o_orderpriority || chr(31) || cast(o_custkey as varchar)) as key, min(case when o_orderstatus = 'P' then 'duplicate_measure' when o_orderpriority = '3-MEDIUM' then 'broken_visual' else 'unused' end) as kind, min(lower(o_orderpriority)) as subject from orders where {} group by 1"
_SNAPS = "b as (" + _SNAP.format("o_orderdate < timestamp '1998-01-01'") + "), a as (" + _SNAP.format("o_orderdate >= timestamp '1997-06-01'") + ")"


@query(f"with {_SNAPS} select a.key, case when b.key is not null then 'existing' else 'new' end as status from a left join b using (key)")
def compare_status(spark, d):
    return ops.classify(_snapshot(spark, d, _AFTER), _snapshot(spark, d, _BEFORE)).select("key", "status")


@query(f"with {_SNAPS} select b.key, b.kind from b anti join a using (key) where b.kind <> 'duplicate_measure'")
def compare_fixed(spark, d):
    return ops.fixed(_snapshot(spark, d, _BEFORE), _snapshot(spark, d, _AFTER)).select("key", "kind")


@query(f"with {_SNAPS} select b.key, b.kind from b anti join a using (key) where b.kind = 'broken_visual'")
def compare_fixed_skipped(spark, d):
    """A baseline without reports: only breakage can be fixed."""
    return ops.fixed(_snapshot(spark, d, _BEFORE), _snapshot(spark, d, _AFTER), skipped=True).select("key", "kind")


@query(f"with {_SNAPS} select a.key, case when s.subject is not null then 'unverified' else 'new' end as status from a left join (select distinct subject from b where subject <> '5-low') s using (subject)")
def baseline_skipped_unverified(spark, d):
    before = _snapshot(spark, d, _BEFORE)
    return ops.classify(_snapshot(spark, d, _AFTER), before, subjects=before.where("subject <> '5-low'")).select("key", "status")


@query(
    """with t as (select p_partkey, lower(p_brand) as b, lower(p_type) as t from part), f as (select p_partkey, sha256('isum' || chr(31) || 'o(' || chr(31) || 'i' || b || chr(31) || 'b[' || t || ']' || chr(31) || 'o)') as fingerprint from t)
    select fingerprint, count(*) as members, min(p_partkey) as first_id, max(p_partkey) as last_id from f group by fingerprint having count(*) > 1"""
)
def duplicates_by_fingerprint(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat('SUM( ', \"'\", p_brand, \"'\", '[', p_type, ']) /* ', p_name, ' */')").alias("text"))
    return ops.duplicates(lexers.dax_fingerprints(p).withColumnRenamed("p_partkey", "id"))


_LINES = "with t as (select doc_id as id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as l from documents where text is not null), e as (select id, unnest(l) as line_text, unnest(range(1, len(l) + 1)) as line from t) "


@query(_LINES + 'select id, line, cast(instr(lower(line_text), \'license\') as bigint) as "column" from e where instr(lower(line_text), \'license\') > 0')
def search_literal_lines(spark, d):
    return ops.search_lines(table(spark, d, "documents"), "doc_id", "text", "License").drop("text")


@query(_LINES + "select id, line, cast(instr(line_text, regexp_extract(line_text, 'token = .[0-9a-f]+')) as bigint) as \"column\" from e where regexp_matches(line_text, 'token = .[0-9a-f]+')")
def search_regex_lines(spark, d):
    return ops.search_lines(table(spark, d, "documents"), "doc_id", "text", "token = .[0-9a-f]+", regex=True, case=True).drop("text")


@query("select p_partkey, p_name from part where lower(p_name) not like '%ring%' and not (lower(p_name) glob 's?all *')")
def glob_ignore(spark, d):
    return table(spark, d, "part").where(~names.matches_any(F.col("p_name"), ["*ring*", "s?all *"])).select("p_partkey", "p_name")


@query("select kind, count(*) as objects from (select unnest(['table', 'column', 'measure', 'role'])  as kind, p_partkey from part) where kind in ('column', 'measure') group by kind")
def kind_selection(spark, d):
    kinds = table(spark, d, "part").select(F.explode(F.array(*map(F.lit, ["table", "column", "measure", "role"]))).alias("kind"))
    return kinds.where(F.col("kind").isin("column", "measure")).groupBy("kind").agg(F.count("*").alias("objects"))


@query("select p_partkey, sha256(lower('unused' || chr(31) || p_brand || chr(31) || p_name)) as fingerprint from part")
def sarif_fingerprint(spark, d):
    return table(spark, d, "part").select("p_partkey", names.fingerprint(names.object_key(F.lit("unused"), F.col("p_brand"), F.col("p_name"))).alias("fingerprint"))


@query(
    f"{GL}, bound as (select distinct 'o' || l_orderkey as id from lineitem where l_returnflag = 'R' and l_quantity >= 49) select o_orderkey, case when bound.id is not null then 'in_use' when live.id is null then 'dead' else 'unused_by_reports' end as verdict from orders left join live on live.id = 'o' || o_orderkey left join bound on bound.id = 'o' || o_orderkey"
)
def auto_date_verdict(spark, d):
    bound = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id")).distinct()
    tables = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return scan.date_verdicts(tables, bound, _live(spark, d, edges(spark, d))).select("o_orderkey", "verdict")


@query(
    f"""with {_DIMS}, refs as (select p_partkey as ref, lower('Brand#' || (p_partkey % 70)) as table_key, lower(p_type) as name_key from part)
    select ref, case when c.id is not null or m.id is not null then null when t.table_key is null then 'table_not_found' else 'field_not_found' end as reason
    from refs left join cols c using (table_key, name_key) left join measures m on m.name_key = refs.name_key left join (select distinct table_key from cols) t on t.table_key = refs.table_key"""
)
def broken_reason(spark, d):
    p, cols, measures = _dims(spark, d)
    refs = p.select(F.col("p_partkey").alias("ref"), F.lower(F.concat(F.lit("Brand#"), (F.col("p_partkey") % 70).cast("string"))).alias("table_key"), F.lower("p_type").alias("name_key"))
    found = ops.resolve_qualified(refs, cols, measures).join(cols.select("table_key", F.lit(True).alias("there")).distinct(), "table_key", "left")
    return found.select("ref", F.when(F.col("target").isNotNull(), None).when(F.col("there").isNull(), "table_not_found").otherwise("field_not_found").alias("reason"))


@query(
    """with s as (select p_partkey, cast(p_partkey as bigint) * case p_partkey % 5 when 0 then 1 when 1 then 1000 when 2 then 1000000 when 3 then 1000000000 else 1000000000000 end as size from part)
    select p_partkey, case when size < 1024 then cast(size as varchar) || ' B' when size < 1048576 then printf('%.1f KB', size / 1024) when size < 1073741824 then printf('%.1f MB', size / 1048576)
    when size < 1099511627776 then printf('%.1f GB', size / 1073741824) else printf('%.1f TB', size / 1099511627776) end as shown from s"""
)
def byte_format(spark, d):
    step = F.element_at(F.array(*(F.lit(x).cast("long") for x in (1, 1000, 1_000_000, 1_000_000_000, 1_000_000_000_000))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", names.format_bytes(F.col("p_partkey") * step).alias("shown"))


#: The token pattern in the dialect of the SQL oracle: no possessive parts, no lookahead.
_TOKENS = "|".join([r"\s+", r"(?:--|//)[^\r\n]*", r"/\*(?s:.*?)(?:\*/|\z)", '[dD][tT]"(?:""|[^"])*"?', '"(?:""|[^"])*"?', "'(?:''|[^'])*'?", r"\[[^\]]*\]?", r"@[\p{L}\p{N}_]*", r"(?:[0-9][0-9.]*|\.[0-9][0-9.]*)(?:[eE][+-]?[0-9]+)?", r"[\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}\p{N}_]+)*", r"&&|\|\||<=|>=|<>|==", "(?s:.)"]).replace("'", "''")


@query(
    f"""with t as (select conv_id * 1000 + turn as expr_id, unnest(regexp_extract_all(coalesce(text, ''), '{_TOKENS}')) as t from conversations),
    k as (select *, case when regexp_matches(t, '^\\s') then 'space' when t like '--%' or t like '//%' or t like '/*%' then 'comment' when t like '''%' then 'table' when t like '"%' then 'string' when t like '[%' then 'bracket' when t like '@%' then 'parameter'
      when regexp_matches(t, '^[dD][tT]"') then 'date' when regexp_matches(t, '^([0-9]|\\.[0-9])') then 'number' when regexp_matches(t, '^[\\p{{L}}_]') then 'name' when t in ('&&', '||', '<=', '>=', '<>', '==') then 'operator' else 'other' end as kind from t)
    select expr_id, kind, count(*) as tokens, cast(sum(length(t)) as bigint) as chars from k group by all"""
)
def dax_token_counts(spark, d):
    t = lexers.dax_tokens(table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", "text")
    return t.groupBy("expr_id", "kind").agg(F.count("*").alias("tokens"), F.sum(F.char_length("token")).alias("chars"))


@query("select p_partkey, unnest(['function', 'field', 'function', 'field', 'field', 'table']) as shape, unnest([null, p_brand, null, null, 'Sales', null]) as table_name, unnest(['SUM', p_name, 'CALCULATE', 'Total', 'Qty', 'IN']) as name from part")
def dax_refs(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat('SUM ( ', \"'\", p_brand, \"'\", '[', p_name, '] ) + CALCULATE([Total], Sales[Qty] IN {1}) -- x')").alias("text"))
    return lexers.dax_refs(p).select("p_partkey", "shape", "table_name", "name")


@query("select p_partkey, p_name, cast(damerau_levenshtein(lower(p_name), 'smlal rnig') as bigint) as distance from part where damerau_levenshtein(lower(p_name), 'smlal rnig') <= 2 order by distance, p_name, p_partkey limit 1")
def suggest_nearest(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return lexers.near_names(p, "p_name", "smlal rnig").orderBy("distance", "p_name", "p_partkey").limit(1).select("p_partkey", "p_name", F.col("distance").cast("long").alias("distance"))
