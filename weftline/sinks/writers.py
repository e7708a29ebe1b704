"""Findings as SARIF, JSON, Markdown, build-log commands and JSON lines: one document or one line a row.

Documents are made for each model, so what is gathered in one row is bounded by a model's findings; ``save``
writes a DataFrame of texts with Spark's text sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators import model as md
from weftline.plans import scan

#: Rule ids in the order of their index, the kind each covers, and its level.
RULES = [(f"WEFT-UNUSED-{k.upper().replace('_', '-')}", k, "warning") for k in ("measure", "column", "hierarchy", "table", "partition", "relationship", "role", "calculation_item", "expression", "function", "report_measure")]
RULES += [("WEFT-STALE-BOOKMARK", "bookmark", "warning"), ("WEFT-BROKEN-VISUAL", "broken_visual", "error"), ("WEFT-BROKEN-ARTIFACT", "broken_artifact", "error"), ("WEFT-AUTO-DATE-TIME", "auto_date_time", "warning")]
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
CAP = 50


def _lookup(pairs: list[tuple[str, object]], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in pairs for x in kv)), key)


def locations(a: scan.Analysis) -> DataFrame:
    """id, path, line of what declares each object; an object that no line declares points at its model's file."""
    f = a.model.facts
    own = [f.where(F.col("kind") == k).select("model", md.object_id(k, "name").alias("id"), "path", "line") for k in ("table", "role", "expression", "function")]
    own += [f.where(F.col("kind") == k).select("model", md.object_id(k, "tbl", "name").alias("id"), "path", "line") for k in ("column", "measure", "hierarchy", "partition", "calculation_item")]
    own.append(a.model.relationships().select("model", "id", "path", "line"))
    first = f.where("kind = 'model'").groupBy("model").agg(F.min("path").alias("model_path"))
    rows = md.union(own).groupBy("model", "id").agg(F.min(F.struct("path", "line")).alias("at"))
    return rows.join(first, "model", "left").select("id", F.coalesce("at.path", "model_path").alias("path"), F.col("at.line").alias("line"))


def issues(a: scan.Analysis, existing: DataFrame | None = None) -> DataFrame:
    """One row a finding, in the order of the log: unused objects, date tables, broken bindings, broken artifacts; new ones, then those that ``existing`` (key) knows.

    model, existing, bucket, seq, kind, rule, rule_index, level, id, message, path, line, key, fingerprint.
    """
    dates = scan.auto_date_tables(a).where("verdict <> 'in_use'")
    unused = scan.unused(a).join(dates.select("id"), "id", "left_anti")
    by = F.when(F.size("used_by") == 0, "nothing uses it").otherwise(F.concat(F.lit("used only by "), F.array_join(F.slice(F.transform("used_by", lambda u: u["by"]), 1, 3), ", ")))
    parts = [unused.select("model", F.lit(0).alias("bucket"), "seq", "kind", F.col("display").alias("id"), F.col("id").alias("object"), F.concat("display", F.lit(" is unused: "), by).alias("message"), names.object_key(F.col("kind"), F.col("display")).alias("key"))]
    parts.append(dates.select("model", F.lit(1).alias("bucket"), F.lit(0).cast("long").alias("seq"), F.lit("auto_date_time").alias("kind"), F.col("display").alias("id"), F.col("id").alias("object"), F.concat("display", F.lit(" is a hidden date table, "), F.replace("verdict", F.lit("_"), F.lit(" "))).alias("message"), names.object_key(F.lit("auto_date_time"), F.col("display"), F.col("verdict")).alias("key")))
    bad = scan.broken(a).withColumn("seq", F.monotonically_increasing_id())
    parts.append(bad.select("model", F.lit(2).alias("bucket"), "seq", F.lit("broken_visual").alias("kind"), F.col("target").alias("id"), F.lit(None).cast("string").alias("object"), F.concat("target", F.lit(": "), reason_phrase(), F.lit(" — "), "provenance").alias("message"), names.object_key(F.lit("broken_visual"), F.col("target"), F.col("reason"), F.col("report"), F.col("provenance")).alias("key")))
    artifacts = a.artifacts.join(a.objects.select(F.col("id").alias("owner"), "model", "seq", "display"), "owner")
    parts.append(artifacts.select("model", F.lit(3).alias("bucket"), "seq", F.lit("broken_artifact").alias("kind"), F.col("display").alias("id"), F.col("owner").alias("object"), F.concat("display", F.lit(" refers to "), F.array_join("refs", ", "), F.lit(", which is not in the model")).alias("message"), names.object_key(F.lit("broken_artifact"), F.col("display")).alias("key")))
    rows = md.union(parts).join(locations(a).withColumnRenamed("id", "object"), "object", "left").drop("object")
    known = existing.select("key", F.lit(True).alias("existing")).distinct() if existing is not None else None
    rows = rows.join(known, "key", "left").withColumn("existing", F.coalesce("existing", F.lit(False))) if known is not None else rows.withColumn("existing", F.lit(False))
    rows = rows.withColumns({"rule": _lookup([(k, r) for r, k, _ in RULES], F.col("kind")), "rule_index": _lookup([(k, i) for i, (_, k, _) in enumerate(RULES)], F.col("kind")), "level": _lookup([(k, x) for _, k, x in RULES], F.col("kind")), "fingerprint": names.fingerprint(F.col("key"))})
    return rows.orderBy("model", "existing", "bucket", "seq", "id")


def reason_phrase() -> Column:
    """Why a binding is broken, for people."""
    return F.when(F.col("reason") == "bound_artifact_broken", F.concat(F.lit("bound artifact "), F.coalesce("artifact", F.col("target")), F.lit(" has unresolvable references"))).otherwise(F.concat(F.replace(F.regexp_replace("reason", "_not_found$", ""), F.lit("_"), F.lit(" ")), F.lit(" not found in the model")))


def _in_order(columns: list[str], order: list[str]) -> Column:
    """Rows of a group as an array, in order."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("row"))))
    return F.transform(held, lambda x: x["row"])


def sarif(rows: DataFrame, tool: str = "weftline") -> DataFrame:
    """model, document: a SARIF 2.1.0 log of each model's issues, with the whole rule catalogue; known ones are suppressed."""
    place = F.when(F.col("path").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"))).alias("region")).alias("physicalLocation"), F.array(F.struct(F.col("id").alias("fullyQualifiedName"), "kind")).alias("logicalLocations")))).otherwise(
        F.array(F.struct(F.lit(None).cast("struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:struct<startLine:int>>").alias("physicalLocation"), F.array(F.struct(F.col("id").alias("fullyQualifiedName"), "kind")).alias("logicalLocations")))
    )
    result = rows.select("model", "existing", "bucket", "seq", "id", F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("finding/v1")).alias("partialFingerprints"), F.when(F.col("existing"), F.array(F.struct(F.lit("external").alias("kind")))).alias("suppressions"))
    held = result.groupBy("model").agg(_in_order(["ruleId", "ruleIndex", "level", "message", "locations", "partialFingerprints", "suppressions"], ["existing", "bucket", "seq", "id"]).alias("results"))
    rules = F.array(*(F.struct(F.lit(r).alias("id"), F.struct(F.lit(x).alias("level")).alias("defaultConfiguration")) for r, _, x in RULES))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), "results")
    return held.select("model", F.to_json(F.struct(F.lit(SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def escape_property(text: Column) -> Column:
    """A property of a build-log command: as data, and semicolons and closing brackets too."""
    out = names.escape_command(text)
    for a, b in ((";", "%3B"), ("]", "%5D")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def commands(rows: DataFrame) -> DataFrame:
    """model, value: a build-log command for each new issue."""
    part = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}="), escape_property(value), F.lit(";")), F.lit(""))
    text = F.concat(F.lit("##vso[task.logissue "), part("type", F.col("level")), part("sourcepath", F.col("path")), part("linenumber", F.when(F.col("path").isNotNull(), F.col("line").cast("string"))), part("code", F.col("rule")), F.lit("]"), names.escape_command(F.col("message")))
    return rows.where("not existing").select("model", text.alias("value"))


def scan_json(a: scan.Analysis) -> DataFrame:
    """model, document: summary, unused objects with who uses them, broken bindings and artifacts, duplicates, date tables and notices."""
    unused = scan.unused(a).select("model", "kind_rank", "seq", F.col("kind").alias("type"), F.col("display").alias("id"), F.when(F.col("owner_table").isNotNull(), names.quoted(F.col("owner_table"))).alias("table"), F.transform("used_by", lambda u: F.struct(u["by"].alias("id"), u["prov"].alias("provenance"), u["also_unused"].alias("also_unused"))).alias("used_by"), F.coalesce("named_in_m", F.array().cast("array<string>")).alias("named_in_power_query"))
    broken = scan.broken(a).select("model", "target", "reason", F.col("artifact").alias("bound_artifact"), "provenance", F.coalesce("report", F.lit("")).alias("report"))
    artifacts = a.artifacts.join(a.objects.select(F.col("id").alias("owner"), "model", "seq", "display", "kind"), "owner").select("model", "seq", F.col("display").alias("id"), F.col("kind").alias("type"), F.col("refs").alias("unresolved_references"))
    twins = scan.duplicates(a).select("model", F.col("first").cast("string").alias("first"), "members")
    dates = scan.auto_date_tables(a).select("model", F.col("display").alias("id"), "verdict", "source_column")
    skips = a.notices.select("model", "path", "location", F.col("skip_kind").alias("kind"), "detail")
    out = scan.summary(a).select("model", F.struct("objects", "reachable", "roots", "unused", "broken").alias("summary"))
    for name, rows, columns, order in (
        ("unused", unused, ["type", "id", "table", "used_by", "named_in_power_query"], ["kind_rank", "seq", "id"]),
        ("broken", broken, ["target", "reason", "bound_artifact", "provenance"], ["report", "target", "reason"]),
        ("broken_artifacts", artifacts, ["id", "type", "unresolved_references"], ["seq", "id"]),
        ("duplicates", twins, ["members"], ["first"]),
        ("auto_date_time", dates, ["verdict", "id", "source_column"], ["id"]),
        ("skips", skips, ["path", "location", "kind", "detail"], ["path", "location", "detail"]),
    ):
        out = out.join(rows.groupBy("model").agg(_in_order(columns, order).alias(name)), "model", "left")
    parts = ["unused", "broken", "broken_artifacts", "duplicates", "auto_date_time", "skips"]
    filled = out.select("model", "summary", *(F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c) for c in parts))
    return filled.select("model", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("model").alias("target"), "summary", *parts)).alias("document"))


def markdown(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """model, document: counts by kind, and a table of the new issues, cut at ``cap`` rows with the number left out."""
    new = rows.where("not existing")
    by_kind = new.groupBy("model", "kind").agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, md.GROUP_ORDER)), F.col("kind"))
    counts = by_kind.groupBy("model").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat(F.lit("| "), "kind", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line")))), lambda x: x["line"]), "\n").alias("counts"))
    from pyspark.sql import Window

    ranked = new.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy("bucket", "seq", "id"))).where(F.col("place") <= cap)
    cell = lambda c: F.replace(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    shown = ranked.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("| "), "kind", F.lit(" | `"), cell("id"), F.lit("` |")).alias("line")))), lambda x: x["line"]), "\n").alias("shown"))
    more = F.when(F.col("total") > cap, F.concat(F.lit("\n\n… and "), (F.col("total") - cap).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(F.lit("### Scan of `"), "model", F.lit("`\n\n**"), F.col("total").cast("string"), F.lit(" findings**\n\n| Finding | Count |\n|---|--:|\n"), "counts", F.lit("\n\n| Type | Object |\n|---|---|\n"), "shown", more, F.lit("\n"))
    return counts.join(shown, "model").select("model", text.alias("document"))


def ascii_json(text: Column) -> Column:
    """JSON whose letters beyond ASCII are escaped, those beyond the first plane as pairs."""
    points = F.transform(F.split(text, ""), lambda c: F.when(c == "", "").otherwise(F.when(c.rlike(r"\A[\x00-\x7F]\z"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1"))))
    return F.array_join(points, "")


def removable(a: scan.Analysis) -> DataFrame:
    """model, value: a JSON line for each unused object of the model that can be removed; what lives in a report gives a comment."""
    rows = scan.unused(a).where("kind <> 'bookmark'")
    named = F.when(F.col("kind").isin("column", "measure", "hierarchy", "partition", "calculation_item"), F.col("owner_table"))
    line = F.to_json(F.struct("kind", named.alias("table"), "name", F.when((F.col("kind") == "relationship") & F.col("name").isNull(), F.regexp_replace("display", "^relationship ", "")).alias("path"), F.col("display").alias("id")))
    text = F.when(F.col("kind") == "report_measure", F.concat(F.lit("# skipped "), "display", F.lit(": lives in the report, not the model"))).otherwise(ascii_json(line))
    return rows.orderBy("model", "kind_rank", "seq").select("model", text.alias("value"))


def inventory_json(rows: DataFrame) -> DataFrame:
    """report, document: pages, their visuals, and the bindings of each, nested; page and visual are null where a binding stands above them."""
    binding = ["site", "role", "display", "reason", "bookmark", "mobile"]
    visuals = rows.groupBy("report", "page", "page_label", "visual", "visual_type", "title").agg(_in_order(binding, ["site", "role", "display"]).alias("bindings"), F.count("reason").alias("unresolved"))
    pages = visuals.groupBy("report", "page", "page_label").agg(_in_order(["visual", "visual_type", "title", "unresolved", "bindings"], ["visual"]).alias("visuals"), F.sum("unresolved").alias("unresolved"))
    reports = pages.groupBy("report").agg(_in_order(["page", "page_label", "unresolved", "visuals"], ["page"]).alias("pages"), F.sum("unresolved").alias("unresolved"))
    return reports.select("report", F.to_json(F.struct("report", "unresolved", "pages")).alias("document"))


def search_json(hits: DataFrame) -> DataFrame:
    """value: a JSON line for each hit."""
    return hits.select(F.to_json(F.struct(F.col("display").alias("id"), F.col("object_kind").alias("type"), "property", "line", "column", "text")).alias("value"))


def stub_files(name: str, dataset_path: str) -> list[tuple[str, str]]:
    """(path, text) of the least report folder that is bound to a model."""
    import json

    return [
        (f"{name}.Report/definition.pbir", json.dumps({"version": "4.0", "datasetReference": {"byPath": {"path": dataset_path}}})),
        (f"{name}.Report/definition/report.json", json.dumps({"annotations": [{"name": "stub", "value": "true"}]})),
        (f"{name}.Report/definition/pages/pages.json", json.dumps({"pageOrder": []})),
    ]


def save(rows: DataFrame, column: str, path: str) -> None:
    """Write a column of documents or lines as text files."""
    rows.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)
