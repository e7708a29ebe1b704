"""TMDL, the indented text format of semantic models, as facts.

A file is a tree of lines: ``key [name] (: value | = value)``, nested by tabs; a bare ``=`` opens a block of
deeper lines or a fence of three backticks, whose text is kept as it is. The tree is mapped to facts by what
each key means; keys that cannot use another object are known and passed over, others become notices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.tables import written
from weftline.sources.facts import Facts, decode_text, parse_files, read_files

#: Keys that name no model object, by what they stand in; ``*`` holds everywhere.
IGNORED = {
    "*": "lineageTag sourceLineageTag changedProperty description annotation extendedProperty isHidden",
    "column": "dataType formatString summarizeBy sourceColumn sourceProviderType dataCategory isKey isNameInferred isDataTypeInferred isUnique isNullable isDefaultLabel isDefaultImage isAvailableInMdx keepUniqueRows tableDetailPosition type encodingHint alignment",
    "measure": "displayFolder excludeFromModelRefresh formatString dataType dataCategory",
    "table": "excludeFromModelRefresh showAsVariationsOnly isPrivate dataCategory excludeFromAutomaticAggregations",
    "partition": "mode queryGroup dataView",
    "role": "modelPermission member",
    "kpi": "statusGraphic trendGraphic targetFormatString",
    "hierarchy": "ordinal displayFolder hideMembers",
    "level": "ordinal",
    "relationship": "joinOnDateBehavior hideArrows securityFilteringBehavior reliability relyOnReferentialIntegrity",
    "refreshPolicy": "incrementalGranularity incrementalPeriods incrementalPeriodsOffset rollingWindowGranularity rollingWindowPeriods mode",
    "expression": "queryGroup resultType kind",
    "function": "",
    "calculationItem": "ordinal",
    "calculationGroup": "precedence",
    "variation": "isDefault",
    "calendar": "",
}
ROOTS = "model culture sourceQueryCulture defaultPowerBIDataSourceVersion discourageImplicitMeasures dataAccessOptions valueFilterBehavior compatibilityLevel createOrReplace retainDataTillForceCalculate queryGroup cultureInfo annotation database ref perspective extendedProperty dataSource".split()
#: An annotation of this ending keeps its object, and gives the reason.
KEEP_ENDING = "_keep"
DATE_MARKS = {"__pbi_localdatetable": "local_date", "__pbi_templatedatetable": "template_date"}


@dataclass(slots=True)
class Node:
    key: str
    name: str | None
    tail: str | None
    value: str | None
    line: int
    depth: int
    opens: bool = False
    mark: str | None = None
    children: list[Node] = field(default_factory=list)

    def get(self, key: str) -> Node | None:
        for c in self.children:
            if c.key == key:
                return c
        return None

    def text(self, key: str) -> str | None:
        return (n := self.get(key)) and n.value


LINE = re.compile(r"""(?P<key>[A-Za-z_][\w.]*)(?:\s+(?P<name>'(?:''|[^'])*'(?:\[[^\]]*\])?|[^\s:='][^:=]*?))?\s*(?:(?P<mark>[:=])\s*(?P<value>.*))?\Z""", re.S)


def plain(name: str | None) -> str | None:
    """A name without its quotes."""
    if name is None:
        return None
    name = name.strip()
    return name[1:-1].replace("''", "'") if len(name) > 1 and name[0] == name[-1] == "'" else name


def split_dotted(text: str | None) -> tuple[str, str] | None:
    """Table and column of ``Table.Column``, either in quotes."""
    m = re.fullmatch(r"\s*('(?:''|[^'])*'|[^'.]+)\.('(?:''|[^'])*'|.+?)\s*", text or "", re.S)
    return (plain(m[1]), plain(m[2])) if m else None


def _tokens(content: str) -> tuple[str, str | None, str | None, str | None, bool, str | None] | None:
    """key, name, tail, value, opens and mark of a line; none if it has no key."""
    m = LINE.match(content)
    if not m:
        return None
    key, name, mark, value = m.groups()
    tail = None
    if key == "ref" and name:
        key_of = name.split(None, 1)
        name, tail = key_of[0], key_of[1] if len(key_of) > 1 else None
    value = value.strip() if mark and value is not None else None
    return key, name, tail, value or None, mark == "=" and not value, mark


_tokens_again = lru_cache(4096)(_tokens)  # most lines of models are short and stand in many tables


def token_line(content: str, line: int, depth: int) -> Node:
    found = _tokens_again(content) if len(content) <= 80 else _tokens(content)
    if not found:
        raise ValueError(f"line {line}: no key in {content[:60]!r}")
    key, name, tail, value, opens, mark = found
    return Node(key, name, tail, value, line, depth, opens, mark)


def _dedented(lines: list[str], tabs: int) -> str:
    out = [x[tabs:] if x[:tabs].strip("\t ") == "" else x.lstrip("\t") for x in lines]
    while out and not out[-1].strip():
        out.pop()
    return "\n".join(out)


def tree(text: str, facts: Facts) -> list[Node]:
    """The root nodes of a document."""
    lines = text.removeprefix("\ufeff").split("\n")
    if "\r" in text:
        lines = [x.removesuffix("\r") for x in lines]
    roots: list[Node] = []
    stack: list[Node] = []
    i, n = 0, len(lines)
    while i < n:
        raw, number = lines[i], i + 1
        i += 1
        content = raw.lstrip("\t")
        if not content or content.isspace() or content.startswith("///"):
            continue
        depth = len(raw) - len(content)
        if content[0] == " ":
            spaces = len(content) - len(content.lstrip(" "))
            depth += spaces // 4
            content = content.lstrip(" ")
            facts.skip("malformed_value", "indented with spaces", number)
        node = token_line(content, number, depth)
        while stack and stack[-1].depth >= depth:
            stack.pop()
        (stack[-1].children if stack else roots).append(node)
        stack.append(node)
        if node.value is not None and node.value.startswith("```"):
            first, held = i, []
            while i < n and lines[i].strip() != "```":
                held.append(lines[i])
                i += 1
            i += 1
            some = [x for x in held if x.strip()]
            tabs = min((len(x) - len(x.lstrip("\t")) for x in some), default=0)
            node.value = _dedented(held, tabs)
            if i > n:
                facts.skip("malformed_value", "a fence is not closed", first)
        elif node.opens:
            held, base = [], None
            while i < n:
                x = lines[i]
                if x and not x.isspace():
                    deep = len(x) - len(x.lstrip("\t"))
                    base = deep if base is None else base
                    if deep < max(base, depth + 2):
                        break
                held.append(x)
                i += 1
            if held and base is not None:
                node.value = _dedented(held, base) if base >= depth + 2 else None
        elif node.mark == "=":  # an expression that starts on this line goes on below the properties' depth
            held, some, deeper = [], False, "\t" * (depth + 2)
            while i < n and ((goes := lines[i].startswith(deeper)) or not lines[i] or lines[i].isspace()):
                some = some or goes and not lines[i].isspace()
                held.append(lines[i])
                i += 1
            if some:
                tabs = min(len(x) - len(x.lstrip("\t")) for x in held if x.strip())
                node.value += "\n" + _dedented(held, tabs)
    return roots


def _keep(node: Node) -> str | None:
    for c in node.children:
        if c.key == "annotation" and (plain(c.name) or "").lower().endswith(KEEP_ENDING):
            return c.value or ""
    return None


def _flag(node: Node, key: str) -> bool:
    found = node.get(key)
    return found is not None and (found.value or "true").lower() == "true"


@cache
def _known_keys(kind: str, read: str) -> frozenset[str]:
    return frozenset((*IGNORED["*"].split(), *IGNORED.get(kind, "").split(), *read.split()))


def _known(facts: Facts, node: Node, kind: str, read: str) -> None:
    if not node.children:
        return
    known = _known_keys(kind, read)
    for c in node.children:
        if c.key not in known:
            facts.skip("unknown_property", f"{c.key} on {kind} {plain(node.name) or ''}".strip(), c.line)


def _expression(node: Node, key: str) -> tuple[str | None, str | None]:
    """An expression object's text and format string."""
    found = node.get(key)
    return (found.value, found.text("formatStringDefinition")) if found else (None, None)


def _measure(facts: Facts, table: str, m: Node) -> None:
    kpi = m.get("kpi")
    if facts.wants("measure"):
        facts.add(
            "measure", table, plain(m.name), m.line, expr=m.value, format=m.text("formatStringDefinition"), detail=m.text("detailRowsDefinition"), hidden=_flag(m, "isHidden"), keep=_keep(m),
            kpi_target=kpi and kpi.text("targetExpression"), kpi_status=kpi and kpi.text("statusExpression"), kpi_trend=kpi and kpi.text("trendExpression"), has_kpi=kpi is not None,
        )
    _known(facts, m, "measure", "formatStringDefinition detailRowsDefinition kpi")
    if kpi:
        _known(facts, kpi, "kpi", "targetExpression statusExpression trendExpression")


def _column(facts: Facts, table: str, c: Node) -> None:
    if facts.wants("column"):
        details = c.get("relatedColumnDetails")
        groups = [plain(g.value) for g in (details.children if details else []) if g.key == "groupByColumn"]
        kind = (c.text("type") or "").lower()
        facts.add(
            "column", table, plain(c.name), c.line, expr=c.value, column_kind="calculated" if c.value is not None or kind == "calculated" else "calculated_table" if kind == "calculatedtablecolumn" else "data",
            sort_by=plain(c.text("sortByColumn")), group_by=groups or None, source_column=c.text("sourceColumn"), hidden=_flag(c, "isHidden"), keep=_keep(c),
        )
    for v in c.children:
        if v.key == "variation":
            hierarchy, column = v.text("defaultHierarchy"), v.text("defaultColumn")
            pair = split_dotted(hierarchy) or split_dotted(column) or (None, None)
            facts.add("variation", table, plain(v.name), v.line, column=plain(c.name), relationship=plain(v.text("relationship")), target_table=pair[0], target_hierarchy=pair[1] if hierarchy else None, target_column=pair[1] if not hierarchy else None, is_default=_flag(v, "isDefault"))
            _known(facts, v, "variation", "relationship defaultHierarchy defaultColumn")
    _known(facts, c, "column", "sortByColumn relatedColumnDetails variation")


def _hierarchy(facts: Facts, table: str, h: Node) -> None:
    if facts.wants("hierarchy"):
        facts.add("hierarchy", table, plain(h.name), h.line, hidden=_flag(h, "isHidden"), keep=_keep(h))
    for i, level in enumerate(x for x in h.children if x.key == "level"):
        if facts.wants("level"):
            facts.add("level", table, plain(level.name), level.line, hierarchy=plain(h.name), column=plain(level.text("column")), ordinal=i)
        _known(facts, level, "level", "column")
    _known(facts, h, "hierarchy", "level")


def _partition(facts: Facts, table: str, p: Node) -> None:
    if facts.wants("partition"):
        kind = (p.value or "").lower()
        source = p.get("source")
        text = source.value if source else None
        if source and text is None:  # nested: an expression or a query of the source
            text = source.text("expression") or source.text("query")
        facts.add("partition", table, plain(p.name), p.line, partition_kind=kind if kind in ("m", "calculated", "query") else "other", text=text, mode=p.text("mode"), expression_source=plain(p.text("expressionSource") or (source.text("expressionSource") if source else None)))
    _known(facts, p, "partition", "source expressionSource")


def _policy(facts: Facts, table: str, p: Node) -> None:
    facts.add("refresh_policy", table, table, p.line, source=p.text("sourceExpression"), polling=p.text("pollingExpression"), policy_type=p.text("policyType"))
    _known(facts, p, "refreshPolicy", "sourceExpression pollingExpression policyType")


def _group(facts: Facts, table: str, g: Node) -> None:
    none, none_format = _expression(g, "noSelectionExpression")
    many, many_format = _expression(g, "multipleOrEmptySelectionExpression")
    facts.add("calculation_group", table, table, g.line, no_selection=none, no_selection_format=none_format, multiple=many, multiple_format=many_format)
    for c in g.children:
        if c.key == "calculationItem":
            facts.add("calculation_item", table, plain(c.name), c.line, expr=c.value, format=c.text("formatStringDefinition"), keep=_keep(c))
            _known(facts, c, "calculationItem", "formatStringDefinition")
    _known(facts, g, "calculationGroup", "calculationItem noSelectionExpression multipleOrEmptySelectionExpression")


def _calendar(facts: Facts, table: str, c: Node) -> None:
    facts.add("calendar", table, plain(c.name), c.line)
    for g in c.children:
        if g.key == "calendarColumnGroup":
            named = [("primary", plain(g.text("primaryColumn")))] if g.get("primaryColumn") else []
            named += [("associated", plain(x.value)) for x in g.children if x.key in ("associatedColumn", "column")]
            for role, column in named:
                facts.add("calendar_column", table, column, g.line, calendar=plain(c.name), role=role, group=plain(g.name) or g.value)
    _known(facts, c, "calendar", "calendarColumnGroup")


OF_TABLES = {"measure": _measure, "column": _column, "hierarchy": _hierarchy, "partition": _partition, "refreshPolicy": _policy, "calculationGroup": _group, "calendar": _calendar}
IN_TABLES = " ".join(("defaultDetailRowsDefinition", *OF_TABLES))


def _table(facts: Facts, t: Node) -> None:
    name = plain(t.name)
    if facts.wants("table"):
        marks = {DATE_MARKS[a]: (c.value or "true").lower() == "true" for c in t.children if c.key == "annotation" and (a := (plain(c.name) or "").lower()) in DATE_MARKS}
        private = _flag(t, "isPrivate")
        facts.add(
            "table", name, name, t.line, hidden=_flag(t, "isHidden"), keep=_keep(t), detail_rows=t.text("defaultDetailRowsDefinition"), is_private=private,
            is_local_date=marks.get("local_date", False) or private and name.startswith("LocalDateTable_"), is_template_date=marks.get("template_date", False) or private and name.startswith("DateTableTemplate_"), is_calculation_group=t.get("calculationGroup") is not None,
        )
    for c in t.children:
        if c.key in OF_TABLES:
            OF_TABLES[c.key](facts, name, c)
    _known(facts, t, "table", IN_TABLES)


def _relationship(facts: Facts, r: Node) -> None:
    ends = [split_dotted(r.text(k)) for k in ("fromColumn", "toColumn")]
    if None in ends:
        facts.skip("malformed_value", f"relationship {plain(r.name)} lacks a column", r.line)
        return
    if facts.wants("relationship"):
        active = r.get("isActive")
        facts.add(
            "relationship", None, plain(r.name), r.line, from_table=ends[0][0], from_column=ends[0][1], to_table=ends[1][0], to_column=ends[1][1], is_active=active is None or (active.value or "true").lower() == "true",
            cross=r.text("crossFilteringBehavior"), from_cardinality=r.text("fromCardinality"), to_cardinality=r.text("toCardinality"), keep=_keep(r),
        )
    _known(facts, r, "relationship", "fromColumn toColumn isActive crossFilteringBehavior fromCardinality toCardinality")


def _role(facts: Facts, r: Node) -> None:
    name = plain(r.name)
    facts.add("role", None, name, r.line)
    for p in r.children:
        if p.key == "tablePermission":
            facts.add("table_permission", plain(p.name), name, p.line, filter=p.value or p.text("filterExpression"))
            for c in p.children:
                if c.key == "columnPermission":
                    facts.add("column_permission", plain(p.name), name, c.line, column=plain(c.name), permission=c.value or c.text("metadataPermission"))
        elif p.key == "columnPermission" and (m := re.fullmatch(r"('(?:''|[^'])*'|[^\[]+)\[([^\]]*)\]", (p.name or "").strip())):
            facts.add("column_permission", plain(m[1]), name, p.line, column=m[2], permission=p.value or p.text("metadataPermission"))
    _known(facts, r, "role", "tablePermission columnPermission")


def _shared(facts: Facts, e: Node) -> None:
    pair = split_dotted(e.text("parameterValuesColumn")) or (None, None)
    facts.add("expression", None, plain(e.name), e.line, text=e.value, parameter_table=pair[0], parameter_column=pair[1], keep=_keep(e))
    _known(facts, e, "expression", "parameterValuesColumn")


def _function(facts: Facts, f: Node) -> None:
    facts.add("function", None, plain(f.name), f.line, text=f.value, keep=_keep(f))
    _known(facts, f, "function", "")


#: The key without which a file has no fact of a kind, for kinds that most files lack.
WORDS = {"function": "function", "expression": "expression", "role": "role", "table_permission": "tablePermission", "column_permission": "columnPermission", "refresh_policy": "refreshPolicy", "calculation_group": "calculationGroup", "calculation_item": "calculationItem", "calendar": "calendar", "calendar_column": "calendarColumnGroup", "variation": "variation", "table_ref": "ref"}


def parse(facts: Facts, content: bytes) -> None:
    """The facts of one file. One that has none of the words that the wanted kinds are written with is not taken apart."""
    text = decode_text(content)
    if facts.kinds is not None and not any(WORDS.get(kind, "") in text for kind in facts.kinds):
        return
    maps = {"table": _table, "relationship": _relationship, "role": _role, "expression": _shared, "function": _function}

    def walk(nodes: list[Node]) -> None:
        for node in nodes:
            if node.key in maps:
                if node.name is None:
                    raise ValueError(f"line {node.line}: {node.key} without a name")
                maps[node.key](facts, node)
            elif node.key == "ref" and node.name == "table":
                facts.add("table_ref", plain(node.tail), plain(node.tail), node.line)
            elif node.key == "model":
                facts.add("model", None, plain(node.name), node.line)
                walk([c for c in node.children if c.key in maps or c.key == "ref"])
            elif node.key in ("database", "createOrReplace"):
                walk(node.children)
            elif node.key not in ROOTS:
                facts.skip("unknown_object", f"'{node.key}' is not known here", node.line)

    walk(tree(text, facts))


def in_order(facts: DataFrame) -> DataFrame:
    """Facts with ``seq`` over the whole model: tables as ``ref table`` lines order them, others by file; of tables named alike the first stays."""
    facts = written(facts, "facts")  # read three times, parsed once
    fold = lambda c: F.lower(F.col(c))
    refs = facts.where("kind = 'table_ref'").groupBy("model", fold("name").alias("key")).agg(F.min("seq").alias("place"))
    own = facts.where("kind <> 'table_ref'")
    first = own.where("kind = 'table'").groupBy("model", fold("name").alias("key")).agg(F.min("path").alias("first_path"))
    rows = own.withColumn("key", fold("tbl")).join(refs, ["model", "key"], "left").join(first, ["model", "key"], "left")
    rows = rows.where(F.col("first_path").isNull() | F.col("kind").isin("table_permission", "column_permission") | (F.col("first_path") == F.col("path")))
    order = F.struct(F.col("place").isNull().alias("a"), F.coalesce("place", F.lit(0)).alias("b"), F.col("path").alias("c"), F.col("seq").alias("d"))
    return rows.select(*facts.columns, order.alias("place"))


def read_model(spark: SparkSession, folder: str) -> DataFrame:
    """Facts, in order, of all TMDL models below a folder."""
    return in_order(parse_files(read_files(spark, folder, "*.tmdl").where(~F.col("path").rlike("/cultures/")), parse))
