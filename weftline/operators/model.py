"""Semantic models as relations: objects, expressions, structural edges, filter flows and seeds, from facts.

Every relation holds any number of models at once; ids carry their model, so joins never mix two of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators.tables import once, written
from weftline.sources.facts import typed

SEP = names.SEPARATOR
#: Object kinds, in the order of identities, and in the order in which findings are grouped for people.
KINDS = "table column measure hierarchy partition relationship role calculation_item expression function report_measure bookmark".split()
GROUP_ORDER = "measure column hierarchy table partition relationship calculation_item expression function report_measure bookmark broken_visual".split()
#: Kinds of facts in which DAX, and M, stands.
DAX_KINDS = "measure column partition table calculation_item calculation_group table_permission function refresh_policy".split()
M_KINDS = "partition refresh_policy expression".split()

PROPS = {
    "table": "hidden boolean, keep string, detail_rows string, is_private boolean, is_local_date boolean, is_template_date boolean, is_calculation_group boolean",
    "column": "expr string, column_kind string, sort_by string, group_by array<string>, source_column string, hidden boolean, keep string",
    "measure": "expr string, format string, detail string, hidden boolean, keep string, kpi_target string, kpi_status string, kpi_trend string, has_kpi boolean",
    "hierarchy": "hidden boolean, keep string",
    "level": "hierarchy string, column string, ordinal int",
    "partition": "partition_kind string, text string, mode string, expression_source string",
    "refresh_policy": "source string, polling string, policy_type string",
    "calculation_group": "no_selection string, no_selection_format string, multiple string, multiple_format string",
    "calculation_item": "expr string, format string, keep string",
    "relationship": "from_table string, from_column string, to_table string, to_column string, is_active boolean, cross string, from_cardinality string, to_cardinality string, keep string",
    "role": "x string",
    "table_permission": "filter string",
    "column_permission": "column string, permission string",
    "expression": "text string, parameter_table string, parameter_column string, keep string",
    "function": "text string, keep string",
    "calendar_column": "calendar string, role string",
    "variation": "column string, relationship string, target_table string, target_hierarchy string, target_column string, is_default boolean",
    "report_measure": "expr string, format string",
    "storage": "object_kind string, bytes long, rows long, cardinality long, from_table string, from_column string, to_table string, to_column string",
}


def fold(c: str | Column) -> Column:
    return names.fold_name(F.col(c) if isinstance(c, str) else c)


def object_id(kind: str, *parts: str | Column, model: str = "model") -> Column:
    """Model, kind and folded names: the identity of an object."""
    return F.concat_ws(SEP, F.col(model), F.lit(kind), *(F.coalesce(fold(p), F.lit("")) for p in parts))


class Model:
    """Facts of models, and the typed table of each kind, each written once when it is first asked for.

    What is built of them joins many small tables many times; plans over written tables stay small, and
    joins know which side is small. Without ``materialise`` nothing is written.
    """

    def __init__(self, facts: DataFrame, materialise: bool = True):
        self.materialise, self.held = materialise, {}
        self.facts = written(facts, "facts") if materialise else facts

    def of(self, kind: str) -> DataFrame:
        if kind not in self.held:
            rows = typed(self.facts, kind, PROPS[kind])
            self.held[kind] = written(rows, kind) if self.materialise else rows
        return self.held[kind]

    def keep(self, rows: DataFrame, tag: str) -> DataFrame:
        return written(rows, tag) if self.materialise else rows

    def tables(self) -> DataFrame:
        return self.of("table").withColumns({"table_key": fold("name"), "id": object_id("table", "name")})

    def owned(self, kind: str) -> DataFrame:
        """Objects of tables: columns, measures, hierarchies, partitions, calculation items."""
        return self.of(kind).withColumns({"table_key": fold("tbl"), "name_key": fold("name"), "id": object_id(kind, "tbl", "name")})

    def shared(self, kind: str) -> DataFrame:
        """Objects of the model itself: roles, expressions, functions."""
        return self.of(kind).withColumns({"name_key": fold("name"), "id": object_id(kind, "name")})

    def relationships(self) -> DataFrame:
        ends = ["from_table", "from_column", "to_table", "to_column"]
        return self.of("relationship").withColumns({"id": object_id("relationship", *ends), "both_ways": names.filters_both_ways(F.col("cross"), F.col("from_cardinality"), F.col("to_cardinality"))})


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def objects(m: Model) -> DataFrame:
    """model, id, kind, kind_rank, owner_table, name, display, seq, keep: every object whether used or not, each once."""
    own = [m.owned(k).select("model", "id", F.lit(k).alias("kind"), F.col("tbl").alias("owner_table"), "name", names.display(F.lit(k), F.col("tbl"), F.col("name")).alias("display"), "seq", (F.col("keep") if k != "partition" else F.lit(None).cast("string")).alias("keep")) for k in ("column", "measure", "hierarchy", "partition", "calculation_item")]
    own.append(m.tables().select("model", "id", F.lit("table").alias("kind"), F.col("name").alias("owner_table"), "name", names.display(F.lit("table"), F.col("name"), F.col("name")).alias("display"), "seq", "keep"))
    r = m.relationships()
    own.append(r.select("model", "id", F.lit("relationship").alias("kind"), F.col("from_table").alias("owner_table"), "name", names.display(F.lit("relationship"), F.col("from_table"), F.col("name"), F.col("from_column"), F.col("to_table"), F.col("to_column")).alias("display"), "seq", "keep"))
    for k in ("role", "expression", "function"):
        own.append(m.shared(k).select("model", "id", F.lit(k).alias("kind"), F.lit(None).cast("string").alias("owner_table"), "name", names.display(F.lit(k), F.lit(""), F.col("name")).alias("display"), "seq", (F.col("keep") if k != "role" else F.lit(None).cast("string")).alias("keep")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return once(union(own), "id").withColumn("kind_rank", rank)


def dax_expressions(m: Model) -> DataFrame:
    """model, owner, kind, home_key, text of every DAX expression of a model, whatever object holds it."""
    out = []

    def add(rows: DataFrame, owner: Column, kinds: dict[str, str], home: str | None = "tbl") -> None:
        held = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("text")) for c, kind in kinds.items()))
        home_key = fold(home) if home else F.lit(None).cast("string")
        out.append(rows.select("model", owner.alias("owner"), home_key.alias("home_key"), F.inline(held)).where("text is not null"))

    add(m.owned("measure"), F.col("id"), {"expr": "measure", "format": "measure_format_string", "detail": "measure_detail_rows", "kpi_target": "kpi_target", "kpi_status": "kpi_status", "kpi_trend": "kpi_trend"})
    add(m.owned("column"), F.col("id"), {"expr": "calculated_column"})
    add(m.owned("partition").where("partition_kind = 'calculated'"), F.col("id"), {"text": "calculated_table"})
    add(m.tables(), F.col("id"), {"detail_rows": "table_detail_rows"}, "name")
    add(m.owned("calculation_item"), F.col("id"), {"expr": "calculation_item", "format": "calculation_item_format_string"})
    add(m.of("calculation_group"), object_id("table", "tbl"), {"no_selection": "no_selection", "no_selection_format": "no_selection_format_string", "multiple": "multiple_selection", "multiple_format": "multiple_selection_format_string"})
    add(m.of("table_permission"), object_id("role", "name"), {"filter": "row_filter"})
    add(m.shared("function"), F.col("id"), {"text": "function"}, None)
    policy = m.of("refresh_policy").select("model", fold("tbl").alias("table_key"), "polling")
    add(m.owned("partition").drop("text").join(policy, ["model", "table_key"]), F.col("id"), {"polling": "change_detection"})
    return union(out).select("model", "owner", "kind", "home_key", "text")


def m_expressions(m: Model) -> DataFrame:
    """model, owner, table_key, kind, text of every M expression; a policy's text once for each partition of its table."""
    parts = m.owned("partition")
    own = parts.where("partition_kind = 'm' and text is not null").select("model", F.col("id").alias("owner"), "table_key", F.lit("partition").alias("kind"), "text")
    policy = m.of("refresh_policy").select("model", fold("tbl").alias("table_key"), F.stack(F.lit(2), F.lit("policy_source"), F.col("source"), F.lit("policy_polling"), F.col("polling")).alias("kind", "text")).where("text is not null")
    each = parts.select("model", "table_key", F.col("id").alias("owner")).join(policy, ["model", "table_key"]).select("model", "owner", "table_key", "kind", "text")
    shared = m.shared("expression").where("text is not null").select("model", F.col("id").alias("owner"), F.lit(None).cast("string").alias("table_key"), F.lit("expression").alias("kind"), "text")
    return own.unionByName(each).unionByName(shared)


def kept(m: Model) -> DataFrame:
    """id, reason of all objects that an annotation keeps."""
    return objects(m).where("keep is not null").select("id", F.col("keep").alias("reason"))


def kept_by(m: Model, ids: DataFrame) -> DataFrame:
    """ids(id) with the reason that keeps each: its own, or that of its table."""
    o = objects(m)
    own = o.select("id", F.col("keep").alias("own"), object_id("table", "owner_table").alias("table_id"))
    tables = o.where("kind = 'table'").select(F.col("id").alias("table_id"), F.col("keep").alias("of_table"))
    return ids.join(own, "id").join(tables, "table_id", "left").select("id", F.coalesce("own", "of_table").alias("reason")).where("reason is not null")


def _edges(rows: DataFrame, src: Column, dst: Column, prov: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(prov).alias("prov"))


def structural_edges(m: Model) -> DataFrame:
    """src, dst, prov: what objects use by how the model is built."""
    columns, tables, hierarchies, partitions, items = m.owned("column"), m.tables(), m.owned("hierarchy"), m.owned("partition"), m.owned("calculation_item")
    column_ids = columns.select("model", "table_key", F.col("name_key").alias("column_key"), F.col("id").alias("dst"))
    table_id = object_id("table", "tbl")
    out = [_edges(m.owned(k), F.col("id"), table_id, "table_member") for k in ("column", "measure", "hierarchy", "calculation_item")]

    def to_column(rows: DataFrame, src: Column, table: str | Column, column: str, prov: str) -> DataFrame:
        own = rows.withColumns({"table_key": fold(table), "column_key": fold(column), "src": src}).select("model", "table_key", "column_key", "src")
        return own.join(column_ids, ["model", "table_key", "column_key"]).select("src", "dst", F.lit(prov).alias("prov"))

    groups = tables.where("is_calculation_group").select("model", "table_key")
    out.append(_edges(columns.where("column_kind = 'calculated_table'"), table_id, F.col("id"), "engine_managed"))
    out.append(_edges(columns.join(groups, ["model", "table_key"], "left_semi"), table_id, F.col("id"), "engine_managed"))
    out.append(to_column(m.of("calendar_column"), table_id, "tbl", "name", "engine_managed"))
    out.append(to_column(columns.where("sort_by is not null"), F.col("id"), "tbl", "sort_by", "sort_by_column"))
    out.append(to_column(columns.where("group_by is not null").select("*", F.explode("group_by").alias("by")), F.col("id"), "tbl", "by", "group_by_column"))
    out.append(_edges(partitions, table_id, F.col("id"), "table_partition"))
    levels = m.of("level")
    out.append(to_column(levels, object_id("hierarchy", "tbl", "hierarchy"), "tbl", "column", "hierarchy_level"))
    r = relationships(m)
    for active, prov in ((True, "relationship"), (False, "inactive_relationship")):
        mine = r.where(F.col("is_active") == active)
        out += [_edges(mine, object_id("table", c), F.col("id"), prov) for c in ("from_table", "to_table")]
        out += [_edges(mine, F.col("id"), object_id("column", f"{end}_table", f"{end}_column"), f"{prov}_endpoint") for end in ("from", "to")]
    known = tables.select(F.col("id").alias("dst"))
    permissions = _edges(m.of("table_permission"), object_id("role", "name"), table_id, "role_permission").join(known, "dst", "left_semi").select("src", "dst", "prov")
    out.append(permissions)
    out.append(to_column(m.of("column_permission"), object_id("role", "name"), "tbl", "column", "role_permission"))
    out.append(to_column(m.shared("expression").where("parameter_column is not null"), F.col("id"), "parameter_table", "parameter_column", "m_parameter_binding"))
    return union(out)


def relationships(m: Model) -> DataFrame:
    """Relationships whose key columns both exist."""
    columns = m.owned("column").select(F.col("id").alias("end"))
    r = m.relationships()
    for end in ("from", "to"):
        r = r.join(columns, object_id("column", f"{end}_table", f"{end}_column") == F.col("end"), "left_semi")
    return r


def filter_flows(m: Model) -> DataFrame:
    """rel, is_active, src, dst: the tables between which filters pass, from the one side, and back where they pass both ways."""
    r = relationships(m).select(F.col("id").alias("rel"), "is_active", "both_ways", object_id("table", "from_table").alias("f"), object_id("table", "to_table").alias("t"))
    there = r.select("rel", "is_active", F.col("t").alias("src"), F.col("f").alias("dst"))
    return there.unionByName(r.where("both_ways").select("rel", "is_active", F.col("f").alias("src"), F.col("t").alias("dst")))


def seeds(m: Model, roots: DataFrame, queried: DataFrame | None = None) -> DataFrame:
    """id, why: roots (id), roles, kept objects (of a kept table its members too) and queried ones (of a queried table its columns too)."""
    o = objects(m).select("id", "kind", "keep", object_id("table", "owner_table").alias("table_id"))
    out = [roots.select("id").withColumn("why", F.lit("root")), o.where("kind = 'role'").select("id").withColumn("why", F.lit("role")), o.where("keep is not null").select("id").withColumn("why", F.lit("kept"))]
    tables = o.where("kind = 'table' and keep is not null").select(F.col("id").alias("table_id"))
    out.append(o.where("kind not in ('table', 'relationship', 'partition')").join(tables, "table_id", "left_semi").select("id").withColumn("why", F.lit("kept")))
    if queried is not None:
        out.append(queried.select("id").withColumn("why", F.lit("queried")))
        out.append(o.where("kind = 'column'").join(queried.select(F.col("id").alias("table_id")), "table_id", "left_semi").select("id").withColumn("why", F.lit("queried")))
    return union(out).dropDuplicates()


def kept_keys(m: Model) -> DataFrame:
    """Key columns of kept relationships: weak seeds."""
    r = relationships(m).where("keep is not null")
    return r.select(F.explode(F.array(object_id("column", "from_table", "from_column"), object_id("column", "to_table", "to_column"))).alias("id")).distinct()


def storage(m: Model) -> DataFrame:
    """id, bytes, rows, cardinality of the storage statistics, keyed by identity."""
    s = m.of("storage")
    by_kind = F.when(F.col("object_kind") == "table", object_id("table", "name")).when(F.col("object_kind") == "relationship", object_id("relationship", "from_table", "from_column", "to_table", "to_column"))
    return s.select("model", F.coalesce(by_kind, F.concat_ws(SEP, "model", "object_kind", fold("tbl"), fold("name"))).alias("id"), "bytes", "rows", "cardinality")


def attach_storage(objects_: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects with their sizes, and how many of them have one."""
    out = objects_.join(sizes.drop("model"), "id", "left")
    return out, out.agg(F.count("*").alias("objects"), F.count("bytes").alias("sized"))


def has_loaded_rows(m: Model) -> DataFrame:
    """model, loaded: whether any table of the statistics has rows."""
    return m.of("storage").where("object_kind = 'table'").groupBy("model").agg(F.bool_or(F.coalesce("rows", F.lit(0)) > 0).alias("loaded"))


def date_sources(m: Model) -> DataFrame:
    """id of each date table that a variation leads to, and the display of the column it serves."""
    r = m.relationships().select("model", fold("name").alias("rel_key"), F.col("to_table").alias("rel_to"))
    own = m.of("variation").withColumn("rel_key", fold("relationship"))
    target = F.coalesce("target_table", "rel_to")
    return own.join(r, ["model", "rel_key"], "left").where(target.isNotNull()).select(object_id("table", target).alias("id"), names.display(F.lit("column"), F.col("tbl"), F.col("column")).alias("source_column")).distinct()
