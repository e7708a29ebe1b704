"""From written names to objects: DAX, M and report bindings against the models, as joins.

References that resolve to nothing stay as rows without a target; breakage is read from them. Names meet by
folded keys, and of objects named alike in one place the first wins, as in the engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import lexers, names
from weftline.operators.graph import dedupe_edges
from weftline.operators.model import PROPS, Model, dax_expressions, fold, m_expressions, object_id, structural_edges, union
from weftline.operators.tables import once
from weftline.sources.apps import looks_like_dax
from weftline.sources.facts import typed

#: Why a binding is broken.
REASONS = "table_not_found field_not_found measure_not_found hierarchy_not_found level_not_found bound_artifact_broken".split()
#: Column names that table constructors give.
CONSTRUCTED = ["value", *(f"value{i}" for i in range(1, 11))]


def first_of(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """keys and id of the first row of each key."""
    return rows.groupBy(*keys).agg(F.min_by("id", order).alias("id"))


class Index:
    """What names stand for, by model: folded keys to ids, first wins; each written when it is first asked for."""

    def __init__(self, m: Model):
        self.model = m

    def _first(self, rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return self.model.keep(first_of(rows, keys), tag)

    @cached_property
    def tables(self) -> DataFrame:
        return self._first(self.model.tables(), ["model", "table_key"], "ix-tables")

    @cached_property
    def columns(self) -> DataFrame:
        return self._first(self.model.owned("column"), ["model", "table_key", "name_key"], "ix-columns")

    @cached_property
    def measures(self) -> DataFrame:
        return self._first(self.model.owned("measure"), ["model", "name_key"], "ix-measures")

    @cached_property
    def hierarchies(self) -> DataFrame:
        return self._first(self.model.owned("hierarchy"), ["model", "table_key", "name_key"], "ix-hierarchies")

    @cached_property
    def items(self) -> DataFrame:
        return self.model.owned("calculation_item").select("model", "table_key", "name_key", "id")

    @cached_property
    def expressions(self) -> DataFrame:
        return first_of(self.model.shared("expression"), ["model", "name_key"])

    @cached_property
    def functions(self) -> DataFrame:
        return first_of(self.model.shared("function"), ["model", "name_key"])


def _target(refs: DataFrame, found: DataFrame, on: dict[str, str], via: str, how: str = "inner") -> DataFrame:
    """refs joined with the objects of a lookup, as ``target``, ``via``."""
    side = found.select(*(F.col(c).alias(f"__{c}") for c in on.values()), F.col("id").alias("target"))
    cond = None
    for a, b in on.items():
        c = refs[a] == side[f"__{b}"]
        cond = c if cond is None else cond & c
    return refs.join(side, cond, how).drop(*(f"__{c}" for c in on.values())).withColumn("via", F.lit(via))


def resolve_table(refs: DataFrame, ix: Index) -> DataFrame:
    return _target(refs, ix.tables, {"model": "model", "name_key": "table_key"}, "table")


def resolve_column_in_table(refs: DataFrame, ix: Index) -> DataFrame:
    return _target(refs, ix.columns, {"model": "model", "table_key": "table_key", "name_key": "name_key"}, "column")


def resolve_columns(refs: DataFrame, ix: Index) -> DataFrame:
    """Every column of that name, in any table."""
    return _target(refs, ix.columns, {"model": "model", "name_key": "name_key"}, "column")


def resolve_hierarchy(refs: DataFrame, ix: Index) -> DataFrame:
    return _target(refs, ix.hierarchies, {"model": "model", "table_key": "table_key", "name_key": "name_key"}, "hierarchy")


def resolve_expression(refs: DataFrame, ix: Index) -> DataFrame:
    return _target(refs, ix.expressions, {"model": "model", "name_key": "name_key"}, "expression")


def resolve_function(refs: DataFrame, ix: Index) -> DataFrame:
    return _target(refs, ix.functions, {"model": "model", "name_key": "name_key"}, "function")


def dax_references(exprs: DataFrame) -> DataFrame:
    """ref (its number), model, owner, kind, home_key, shape, table_key, name_key, written of each reference of DAX expressions (expr, model, owner, kind, home_key, text)."""
    refs = lexers.dax_refs(exprs, "text")
    written = F.when(F.col("shape") == "field", F.concat(F.coalesce(names.quoted(F.col("table_name")), F.lit("")), F.lit("["), "name", F.lit("]"))).otherwise(F.col("name"))
    return refs.withColumns({"ref": F.concat_ws("\u001d", "expr", "pos"), "table_key": fold("table_name"), "name_key": fold("name"), "written": written})


def numbered(exprs: DataFrame) -> DataFrame:
    """Expressions with ``expr``, a text that tells each apart: owner, kind, home table (a role may filter two tables alike) and what it says."""
    return once(exprs.withColumn("expr", F.concat_ws("\u001d", "owner", "kind", F.coalesce("home_key", F.lit("")), F.md5("text"))), "expr")


def bind_dax(refs: DataFrame, ix: Index, report_measures: DataFrame | None = None) -> DataFrame:
    """refs with ``target`` and ``via`` of everything each may mean; a reference may have several, or none and then no row.

    Qualified: the table's column, else the model's measure; besides them hierarchies and calculation items of that
    name; if none of these, the table. Unqualified: the measure and the home table's column, and report measures.
    """
    field = refs.where("shape = 'field'")
    qualified, bare = field.where("table_key is not null"), field.where("table_key is null")
    cols = resolve_column_in_table(qualified, ix)
    rest = qualified.join(cols.select("ref"), "ref", "left_anti")
    measures = _target(rest, ix.measures, {"model": "model", "name_key": "name_key"}, "measure")
    trees = resolve_hierarchy(qualified, ix)
    items = _target(qualified, ix.items, {"model": "model", "table_key": "table_key", "name_key": "name_key"}, "calculation_item")
    met = union([cols, measures, trees, items])
    lost = qualified.join(met.select("ref").distinct(), "ref", "left_anti")
    tables = _target(lost, ix.tables, {"model": "model", "table_key": "table_key"}, "qualifying_table")
    out = [met, tables, _target(bare, ix.measures, {"model": "model", "name_key": "name_key"}, "measure"), _target(bare, ix.columns, {"model": "model", "home_key": "table_key", "name_key": "name_key"}, "column")]
    if report_measures is not None:
        out.append(_target(bare, report_measures, {"report": "report", "name_key": "name_key"}, "report_measure"))
    out += [resolve_table(refs.where("shape = 'table'"), ix), resolve_function(refs.where("shape = 'function'"), ix)]
    return union(out)


def activated(exprs: DataFrame, m: Model) -> DataFrame:
    """owner, target: relationships that USERELATIONSHIP names by their two columns, in either order."""
    calls = lexers.activations(exprs.select("model", "owner", "text"))
    key = lambda t, c: F.concat_ws("\u001f", fold(t), fold(c))
    calls = calls.withColumn("pair", names.unordered_pair(key("table_a", "column_a"), key("table_b", "column_b")))
    known = m.relationships().select("model", F.col("id").alias("target"), names.unordered_pair(key("from_table", "from_column"), key("to_table", "to_column")).alias("pair"))
    return calls.join(known, ["model", "pair"]).select("owner", "target").distinct()


class Dax:
    """All DAX of the models: its expressions, their references, and what these may mean; each written once."""

    def __init__(self, m: Model, ix: Index):
        self.exprs = m.keep(numbered(dax_expressions(m)), "dax-exprs")
        self.refs = m.keep(dax_references(self.exprs), "dax-refs")
        self.bound = m.keep(bind_dax(self.refs, ix), "dax-bound")


def dax_edges(dax: Dax, m: Model) -> DataFrame:
    """Edges of all DAX expressions: each owner to whatever its expression may mean."""
    act = activated(dax.exprs, m).select(F.col("owner").alias("src"), F.col("target").alias("dst"), F.lit("measure").alias("prov"))
    return dax.bound.select(F.col("owner").alias("src"), F.col("target").alias("dst"), F.col("kind").alias("prov")).unionByName(act)


def bind_m(m: Model, ix: Index) -> tuple[DataFrame, DataFrame]:
    """(edges of M expressions to other tables and shared expressions; columns that M names: column, owners).

    A qualified field names its table and that table's column; a bare field or column text names every such column.
    M that names a column keeps nothing alive: the engine refreshes without it.
    """
    refs = m.keep(lexers.m_refs_of(m_expressions(m), "text").withColumn("name_key", fold("name")), "m-refs")
    name = refs.where("shape = 'name'")
    tables = _target(name, ix.tables, {"model": "model", "name_key": "table_key"}, "table")
    own = F.coalesce(F.col("table_key") == F.col("name_key"), F.lit(False))
    shared = resolve_expression(name, ix)
    fields = refs.where("shape = 'field'").withColumnsRenamed({"table_key": "own_key"}).withColumn("table_key", fold("table_name"))
    qualified = fields.where("table_key is not null")
    q_tables = _target(qualified, ix.tables, {"model": "model", "table_key": "table_key"}, "table").where(F.col("own_key").isNull() | (F.col("own_key") != F.col("table_key")))
    edges = union([x.select(F.col("owner").alias("src"), F.col("target").alias("dst")) for x in (tables.where(~own), shared, q_tables)])
    named = union([
        resolve_column_in_table(qualified, ix).select("owner", "target"),
        resolve_columns(fields.where("table_key is null").drop("table_key"), ix).select("owner", "target"),
        resolve_columns(refs.where("shape = 'column_string'").drop("table_key"), ix).select("owner", "target"),
    ])
    data = m.owned("column").where("column_kind = 'data'").select(F.col("id").alias("target"))
    columns = named.join(data, "target", "left_semi").groupBy(F.col("target").alias("column")).agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    return edges.withColumn("prov", F.lit("power_query")), columns


def opaque_sources(m: Model) -> DataFrame:
    """owner of M expressions that pass a native query on, whose names cannot be read."""
    return lexers.m_refs_of(m_expressions(m), "text").where("shape = 'native'").select("model", "owner", F.lit("opaque_source").alias("skip_kind")).distinct()


def report_measures(reports: DataFrame) -> DataFrame:
    """report, name_key, id, expr, format of the reports' own measures."""
    rows = typed(reports, "report_measure", PROPS["report_measure"])
    return rows.select(F.col("model").alias("report"), fold("name").alias("name_key"), F.concat_ws("\u001f", F.col("model"), F.lit("report_measure"), fold("name")).alias("id"), "name", "seq", "expr", "format")


def report_dax(measures: DataFrame, paired: DataFrame) -> DataFrame:
    """DAX of report measures against the model each report is paired with (report, model)."""
    held = F.array(F.struct(F.lit("report_measure").alias("kind"), F.col("expr").alias("text")), F.struct(F.lit("report_measure_format_string").alias("kind"), F.col("format").alias("text")))
    return measures.join(paired, "report").select("model", "report", F.col("id").alias("owner"), F.lit(None).cast("string").alias("home_key"), F.inline(held)).where("text is not null")


def calculated_schemas(m: Model, ix: Index) -> DataFrame:
    """model, table_key, name_key: columns that a calculated table may have by what its expression writes.

    String literals, the names that constructors give, and the columns of every table it refers to.
    """
    parts = m.owned("partition").where("partition_kind = 'calculated' and text is not null").select("model", "table_key", "text")
    own = lexers.quoted_names(parts).select("model", "table_key", F.col("name").alias("name_key"))
    made = parts.select("model", "table_key", F.explode(F.array(*map(F.lit, CONSTRUCTED))).alias("name_key"))
    refs = lexers.dax_refs(parts).where("shape = 'table' or table_name is not null").select("model", "table_key", fold(F.coalesce("table_name", "name")).alias("used"))
    columns = ix.columns.select("model", F.col("table_key").alias("used"), "name_key")
    more = lexers.dax_refs(parts).where("shape = 'field'").select("model", "table_key", fold("name").alias("name_key"))
    return union([own, made, refs.join(columns, ["model", "used"]).select("model", "table_key", "name_key"), more]).distinct()


def unresolved_fields(refs: DataFrame, bound: DataFrame, ix: Index, exprs: DataFrame, schemas: DataFrame, report_measure_names: DataFrame | None = None) -> DataFrame:
    """Field references that nothing can stand for, after every allowance: what binding found but a mere qualifying table, columns the query makes itself, extension columns."""
    found = bound.where("via <> 'qualifying_table'").select("ref").distinct()
    lost = ix.model.keep(refs.where("shape = 'field'").join(found, "ref", "left_anti"), "lost")
    exprs = exprs.select("expr", "text").join(lost.select("expr").distinct(), "expr", "left_semi")  # only what these say is read again
    made = lexers.quoted_names(exprs).select("expr", F.col("name").alias("name_key"))
    bare = lost.where("table_key is null and not startswith(name_key, '@')").where(~F.col("name_key").isin(*CONSTRUCTED)).join(made, ["expr", "name_key"], "left_anti")
    if report_measure_names is not None:
        bare = bare.join(report_measure_names.select("report", "name_key"), ["report", "name_key"], "left_anti")
    qualified = lost.where("table_key is not null").join(schemas, ["model", "table_key", "name_key"], "left_anti")
    variables = lexers.variables(exprs).select("expr", F.col("name").alias("table_key"))
    qualified = qualified.join(variables, ["expr", "table_key"], "left_anti")
    return bare.unionByName(qualified.select(bare.columns))


def broken_artifacts(dax: Dax, ix: Index, schemas: DataFrame) -> DataFrame:
    """owner, refs: objects whose DAX names what is not there, with the names, sorted."""
    lost = unresolved_fields(dax.refs, dax.bound, ix, dax.exprs, schemas)
    return lost.groupBy("owner").agg(F.array_sort(F.collect_set("written")).alias("refs"))


def bind_reports(bindings: DataFrame, paired: DataFrame, m: Model, ix: Index, schemas: DataFrame, artifacts: DataFrame, measures: DataFrame) -> DataFrame:
    """Every binding against its report's model: model, report, binding (its number), site and place, target, reason.

    A binding has a row for each object it stands for; without one, a row whose target is null. ``reason`` says
    why it is broken, if it is; a table that lost a field is still kept alive by who asks for the field.
    """
    b = bindings.join(paired, "report").withColumns({"binding": F.concat_ws("\u001d", "report", "path", "seq"), "table_key": fold("tbl"), "name_key": fold("name"), "hierarchy_key": fold("hierarchy"), "level_key": fold("level")})
    b, measures = m.keep(b, "bindings"), m.keep(measures, "report-measures")
    out = []
    keep = ["model", "report", "binding", "site", "page", "visual", "bookmark", "role", "mobile", "stale", "tkind", "tbl", "name", "hierarchy", "level", "seq"]

    def put(rows: DataFrame, target: Column, reason: Column) -> None:
        out.append(rows.select(*keep, target.alias("target"), reason.cast("string").alias("reason")))

    no = F.lit(None).cast("string")
    tables = ix.tables.select("model", "table_key", F.col("id").alias("table_id"))
    # columns: the column, else a measure; hierarchies and items of the name; else the table
    col = b.where("tkind = 'column'")
    cols = ix.columns.select("model", "table_key", "name_key", F.col("id").alias("column_id"))
    meas = ix.measures.select("model", "name_key", F.col("id").alias("measure_id"))
    trees = ix.hierarchies.select("model", "table_key", "name_key", F.col("id").alias("tree_id"))
    items = ix.items.select("model", "table_key", "name_key", F.col("id").alias("item_id")).dropDuplicates(["model", "table_key", "name_key"])
    seen = schemas.select("model", "table_key", "name_key", F.lit(True).alias("visible"))
    met = col.join(cols, ["model", "table_key", "name_key"], "left").join(meas, ["model", "name_key"], "left").join(trees, ["model", "table_key", "name_key"], "left").join(items, ["model", "table_key", "name_key"], "left").join(tables, ["model", "table_key"], "left").join(seen, ["model", "table_key", "name_key"], "left")
    direct = F.coalesce("column_id", "measure_id")
    some = F.array_compact(F.array(direct, "tree_id", "item_id"))
    held = met.withColumn("targets", F.when(F.size(some) > 0, some).otherwise(F.array_compact(F.array("table_id"))))
    reason = F.when(F.size(some) > 0, None).when(F.col("table_id").isNull(), "table_not_found").when(F.col("visible"), None).otherwise("field_not_found")
    put(held.withColumn("reason", reason).select("*", F.explode_outer("targets").alias("t")), F.col("t"), F.col("reason"))
    # measures: the report's own, else the model's, else the base of a KPI's parts
    mb = b.where("tkind = 'measure'")
    own = measures.groupBy("report", "name_key").agg(F.min("id").alias("own_id"))
    base = ix.measures.select("model", F.col("name_key").alias("base_key"), F.lit(True).alias("has_base"))
    met = mb.withColumn("base_key", fold(names.kpi_base(F.col("name")))).join(own, ["report", "name_key"], "left").join(meas, ["model", "name_key"], "left").join(base, ["model", "base_key"], "left")
    put(met, F.coalesce("own_id", "measure_id"), F.when(F.col("own_id").isNull() & F.col("measure_id").isNull() & F.col("has_base").isNull(), "measure_not_found"))
    # hierarchy levels: hierarchy and the level's column; through a variation its target; else the table
    hb = b.where("tkind in ('hierarchy_level', 'hierarchy')").drop("name_key").withColumn("name_key", F.col("hierarchy_key"))
    levels = m.of("level").select("model", fold("tbl").alias("table_key"), fold("hierarchy").alias("name_key"), fold("name").alias("level_key"), fold("column").alias("level_column"))
    level_cols = ix.columns.select("model", "table_key", F.col("name_key").alias("level_column"), F.col("id").alias("level_id"))
    met = hb.join(tables, ["model", "table_key"], "left").join(trees, ["model", "table_key", "name_key"], "left").join(levels, ["model", "table_key", "name_key", "level_key"], "left").join(level_cols, ["model", "table_key", "level_column"], "left")
    there = met.where("tree_id is not null")
    put(there.select("*", F.explode(F.array_compact(F.array("tree_id", "level_id"))).alias("t")), F.col("t"), F.when((F.col("tkind") == "hierarchy_level") & F.col("level_id").isNull(), "level_not_found"))
    lost = met.where("tree_id is null").drop("tree_id", "level_column", "level_id")
    plain = lost.where("via_column is null or table_id is null")
    put(plain, F.col("table_id"), F.when(F.col("table_id").isNull(), "table_not_found").otherwise("hierarchy_not_found"))
    varied = lost.where("via_column is not null and table_id is not null")
    r = m.relationships().select("model", fold("name").alias("rel_key"), fold("to_table").alias("rel_to"))
    v = m.of("variation").withColumn("rel_key", fold("relationship")).join(r, ["model", "rel_key"], "left")
    candidates = v.select("model", fold("tbl").alias("table_key"), fold("column").alias("via_key"), fold("name").alias("variation_key"), F.posexplode(F.array_compact(F.array(fold("target_table"), "rel_to"))).alias("rank", "other_key"), F.col("seq").alias("v_seq"))
    other_trees = ix.hierarchies.select("model", F.col("table_key").alias("other_key"), "name_key", F.col("id").alias("other_tree"))
    tried = varied.withColumns({"via_key": fold("via_column"), "wanted": fold("via_variation")}).join(candidates, ["model", "table_key", "via_key"]).where("wanted is null or wanted = variation_key").join(other_trees, ["model", "other_key", "name_key"])
    best = tried.groupBy("binding").agg(F.min_by(F.struct("other_key", "other_tree"), F.struct("rank", "v_seq")).alias("best"))
    met = varied.join(best, "binding", "left").withColumns({"other_key": F.col("best.other_key")})
    far_levels = levels.withColumnRenamed("table_key", "other_key").join(level_cols.withColumnRenamed("table_key", "other_key"), ["model", "other_key", "level_column"], "left").select("model", "other_key", "name_key", "level_key", F.col("level_id").alias("far_level"))
    met = met.join(far_levels, ["model", "other_key", "name_key", "level_key"], "left")
    put(met.select("*", F.explode(F.when(F.col("best").isNull(), F.array("table_id")).otherwise(F.array_compact(F.array(F.col("best.other_tree"), F.col("far_level"))))).alias("t")), F.col("t"), no)
    # names of an MDX field: measures by name; a column before a hierarchy; only what is said exactly breaks on a field or level
    x = b.where("tkind = 'mdx'").withColumn("field_key", F.col("hierarchy_key"))
    xm = x.where("table_key = 'measures'").join(own, ["report", "name_key"], "left").join(meas, ["model", "name_key"], "left")
    put(xm, F.coalesce("own_id", "measure_id"), F.when(F.col("own_id").isNull() & F.col("measure_id").isNull(), "measure_not_found"))
    xf = x.where("table_key <> 'measures'").join(tables, ["model", "table_key"], "left").join(cols.withColumnRenamed("name_key", "field_key"), ["model", "table_key", "field_key"], "left").join(trees.withColumnRenamed("name_key", "field_key"), ["model", "table_key", "field_key"], "left")
    xl = levels.withColumnRenamed("name_key", "field_key").join(level_cols, ["model", "table_key", "level_column"], "left").select("model", "table_key", "field_key", "level_key", F.col("level_id").alias("x_level"))
    xf = xf.join(xl, ["model", "table_key", "field_key", "level_key"], "left")
    hit = F.coalesce("column_id", "tree_id")
    exact = F.coalesce("exact", F.lit(False))
    reason = F.when(F.col("table_id").isNull(), "table_not_found").when(exact & F.col("field_key").isNotNull() & hit.isNull(), "field_not_found").when(exact & F.col("column_id").isNull() & F.col("tree_id").isNotNull() & F.col("level_key").isNotNull() & F.col("x_level").isNull(), "level_not_found")
    put(xf.select("*", F.explode_outer(F.array_compact(F.array(F.coalesce(hit, F.col("table_id")), F.when(F.col("column_id").isNull(), F.col("x_level"))))).alias("t")), F.col("t"), reason)
    # inline DAX: all its references, report measures, and every column of an unqualified name
    n = b.where("tkind = 'native_measure'").select("model", "report", F.col("binding").alias("expr"), F.col("binding").alias("owner"), F.lit("native_measure").alias("kind"), no.alias("home_key"), F.col("expr").alias("text"))
    refs = dax_references(n)
    bound = bind_dax(refs, ix, measures.select("report", "name_key", "id"))
    wide = resolve_columns(refs.where("shape = 'field' and table_key is null"), ix)
    reached = bound.select("expr", "target").unionByName(wide.select("expr", "target")).distinct()
    place = b.where("tkind = 'native_measure'")
    put(place.join(reached.select(F.col("expr").alias("binding"), "target"), "binding"), F.col("target"), no)
    lost = unresolved_fields(refs, bound.select(*refs.columns, "target", "via").unionByName(wide.select(*refs.columns, "target", "via")), ix, n, schemas, measures)
    lost = lost.join(tables, ["model", "table_key"], "left").select(F.col("expr").alias("binding"), F.col("written"), F.when(F.col("table_key").isNull(), "measure_not_found").when(F.col("table_id").isNull(), "table_not_found").otherwise("field_not_found").alias("why")).distinct()
    out.append(place.join(lost, "binding").select(*[F.col("written").alias("name") if c == "name" else F.col(c) for c in keep], no.alias("target"), F.col("why").alias("reason")))
    # what could not be read keeps what it may mean, and never breaks
    w = b.where("tkind = 'written'").withColumns({"w_table": fold(F.regexp_extract("expr", r"\A'?(.*?)'?\.", 1)), "w_name": fold(F.regexp_extract("expr", r"\.'?(.*?)'?\z", 1))})
    w = w.join(ix.columns.select("model", F.col("table_key").alias("w_table"), F.col("name_key").alias("w_name"), F.col("id").alias("w_column")), ["model", "w_table", "w_name"], "left").join(ix.measures.select("model", F.col("name_key").alias("w_name"), F.col("id").alias("w_measure")), ["model", "w_name"], "left")
    put(w, F.coalesce("w_column", "w_measure"), no)
    rows = union(out)
    bad = artifacts.select(F.col("owner").alias("target"), F.lit(True).alias("bad"))
    return rows.join(bad, "target", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("bad"), "bound_artifact_broken"))).drop("bad")


def roots_of_reports(bound: DataFrame) -> DataFrame:
    """id, report, site and place of what live bindings stand for."""
    return bound.where("target is not null and not stale").select(F.col("target").alias("id"), "report", "binding", "site", "page", "visual", "bookmark", "mobile")


def selection_edges(roots: DataFrame, m: Model) -> DataFrame:
    """A bound column of a calculation group can pick any of its items."""
    groups = m.tables().where("is_calculation_group").select("model", "table_key")
    columns = m.owned("column").join(groups, ["model", "table_key"]).select("model", "table_key", F.col("id").alias("src"))
    bound = columns.join(roots.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return bound.join(m.owned("calculation_item").select("model", "table_key", F.col("id").alias("dst")), ["model", "table_key"]).select("src", "dst", F.lit("binding").alias("prov"))


def stale_edges(bound: DataFrame, states: DataFrame) -> DataFrame:
    """Edges from bookmarks that are stale as a whole to what they would bind, to explain and never to keep."""
    b = bound.where("stale and target is not null").join(states.where("fully_stale").select("report", "bookmark"), ["report", "bookmark"], "left_semi")
    return b.select(F.concat_ws("\u001f", "report", F.lit("bookmark"), F.lower("bookmark")).alias("src"), F.col("target").alias("dst"), F.lit("stale_bookmark").alias("prov")).distinct()


def query_roots(queries: DataFrame, ix: Index) -> DataFrame:
    """query, id: what logged queries (query, model, language, text) name. DAX has no home table; a table it names does not keep its members here."""
    dax = queries.where("language = 'dax'").select("model", F.col("query").cast("string").alias("expr"), F.col("query").alias("owner"), F.lit("query").alias("kind"), F.lit(None).cast("string").alias("home_key"), "text")
    refs = ix.model.keep(dax_references(dax), "query-refs")
    found = bind_dax(refs, ix).select(F.col("owner").alias("query"), F.col("target").alias("id"))
    mdx = ix.model.keep(lexers.mdx_targets_of(queries.where("language = 'mdx'").select("model", "query", "text"), "text").withColumn("name_key", fold("name")), "mdx-refs")
    measures = _target(mdx.where("mdx_kind = 'measure'"), ix.measures, {"model": "model", "name_key": "name_key"}, "measure").select("query", F.col("target").alias("id"))
    fields = mdx.where("mdx_kind = 'field'").withColumn("table_key", F.col("name_key")).drop("name_key")
    tables = _target(fields, ix.tables, {"model": "model", "table_key": "table_key"}, "table").select("query", F.col("target").alias("id"))
    parts = fields.select("model", "query", "table_key", F.explode(F.array_compact(F.array(fold("hierarchy"), fold("level")))).alias("name_key"))
    cols = resolve_column_in_table(parts, ix).select("query", F.col("target").alias("id"))
    trees = resolve_hierarchy(parts, ix).select("query", F.col("target").alias("id"))
    return union([found, measures, tables, cols, trees]).distinct()


def app_roots(literals: DataFrame, ix: Index) -> DataFrame:
    """id, app, line of what an app's literals (app, model, path, line, text, whole) name.

    A literal that reads like a query binds as one; a whole name on one line is a table, a measure, or a column of
    the tables the app names, of any table if it names none.
    """
    lit = literals.withColumns({"query": F.concat_ws("\u001d", "app", "path", "line", F.md5("text")), "is_dax": looks_like_dax(F.col("text"))}).dropDuplicates(["query"])
    lit = ix.model.keep(lit, "literals")
    asked = query_roots(lit.where("is_dax").select("query", "model", F.lit("dax").alias("language"), "text"), ix)
    place = lit.select("query", "app", "path", "line")
    named = lit.where("not is_dax and whole").where(~F.col("text").contains("\n")).withColumn("name_key", fold("text"))
    tables = _target(named, ix.tables, {"model": "model", "name_key": "table_key"}, "table")
    measures = _target(named, ix.measures, {"model": "model", "name_key": "name_key"}, "measure")
    cols = _target(named, ix.columns, {"model": "model", "name_key": "name_key"}, "column").withColumn("table_id", F.regexp_replace(F.col("target"), "\u001fcolumn\u001f(.*)\u001f[^\u001f]*$", "\u001ftable\u001f$1"))
    scope = tables.select("app", F.col("target").alias("table_id")).distinct()
    scoped = cols.join(scope.select("app").distinct().withColumn("some", F.lit(True)), "app", "left").join(scope.withColumn("mine", F.lit(True)), ["app", "table_id"], "left").where("some is null or mine")
    whole = union([x.select("query", F.col("target").alias("id")) for x in (tables, measures, scoped)])
    return asked.unionByName(whole).join(place, "query").select("id", "app", "path", "line").distinct()


def anchored_breakage(literals: DataFrame, ix: Index, schemas: DataFrame) -> DataFrame:
    """app, path, line, written, reason of references in DAX literals that name nothing, where another reference of the literal does resolve."""
    lit = literals.where(looks_like_dax(F.col("text"))).withColumn("expr", F.concat_ws("\u001d", "app", "path", "line", F.md5("text"))).dropDuplicates(["expr"])
    exprs = lit.select("model", "expr", F.col("expr").alias("owner"), F.lit("code").alias("kind"), F.lit(None).cast("string").alias("home_key"), "text")
    refs = ix.model.keep(dax_references(exprs), "code-refs")
    bound = ix.model.keep(bind_dax(refs, ix), "code-bound")
    anchors = bound.where("via <> 'qualifying_table'").select("expr").distinct()
    lost = unresolved_fields(refs, bound, ix, exprs, schemas).join(anchors, "expr", "left_semi")
    tables = ix.tables.select("model", "table_key", F.col("id").alias("table_id"))
    why = F.when(F.col("table_key").isNull(), "measure_not_found").when(F.col("table_id").isNull(), "table_not_found").otherwise("field_not_found")
    return lost.join(tables, ["model", "table_key"], "left").join(lit.select("expr", "app", "path", "line"), "expr").select("app", "path", "line", "written", why.alias("reason")).distinct()


def model_edges(m: Model, dax: Dax, m_edges: DataFrame, more: list[DataFrame] | None = None) -> DataFrame:
    """All edges of the models: structural, DAX, M, and ``more``, without loops and repeats."""
    return dedupe_edges(union([structural_edges(m), dax_edges(dax, m), m_edges, *(more or [])]))
