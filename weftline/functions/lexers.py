"""Tokens and references of DAX, and layout-independent fingerprints, natively; MDX and M chains as Python helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Branches of the DAX token pattern, tried in this order. Every text is the concatenation of its tokens.
DAX_BRANCHES = [
    ("space", r"\s+"),
    ("comment", r"(?:--|//)[^\r\n]*|/\*.*?(?:\*/|\z)"),
    ("date", r'[dD][tT]"(?:""|[^"])*+"?'),
    ("string", r'"(?:""|[^"])*+"?'),
    ("table", r"'(?:''|[^'])*+'?"),
    ("bracket", r"\[[^\]]*+\]?"),
    ("parameter", r"@[\p{L}\p{N}_]*"),
    ("number", r"(?:[0-9]|\.(?=[0-9]))[0-9.]*(?:[eE][+-]?[0-9]+)?"),
    ("name", r"[\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}\p{N}_]+)*"),
    ("operator", r"&&|\|\||<=|>=|<>|=="),
    ("other", r"."),
]
DAX = "(?s)" + "|".join(f"(?:{p})" for _, p in DAX_BRANCHES)
#: Words that never qualify a bracket (fixed values).
DAX_KEYWORDS = ["AND", "ASC", "BY", "DEFINE", "DESC", "EVALUATE", "IN", "NOT", "OR", "RETURN"]


def dax_kind(token: Column) -> Column:
    """The branch that a token came from, by how it starts."""
    return (
        F.when(token.rlike(r"\A\s"), "space")
        .when(token.startswith("--") | token.startswith("//") | token.startswith("/*"), "comment")
        .when(token.startswith("'"), "table")
        .when(token.startswith('"'), "string")
        .when(token.startswith("["), "bracket")
        .when(token.startswith("@"), "parameter")
        .when(token.rlike(r'\A[dD][tT]"'), "date")
        .when(token.rlike(r"\A(?:[0-9]|\.[0-9])"), "number")
        .when(token.rlike(r"\A[\p{L}_]"), "name")
        .when(token.isin("&&", "||", "<=", ">=", "<>", "=="), "operator")
        .otherwise("other")
    )


def dax_tokens(exprs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """expr_id, pos, token, kind, start (characters): every token, in order; no white space is lost."""
    each = exprs.select(F.col(id_col).alias("expr_id"), F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(DAX), F.lit(0)).alias("tokens"))
    rows = each.select("expr_id", F.posexplode("tokens").alias("pos", "token")).withColumn("kind", dax_kind(F.col("token")))
    before = Window.partitionBy("expr_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.char_length("token")).over(before), F.lit(0)).cast("int"))


def significant(exprs: DataFrame, text_col: str) -> DataFrame:
    """``exprs`` with ``sig``: the tokens but for white space and comments, as (pos, token, kind), in one array a text."""
    all_tokens = F.transform(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(DAX), F.lit(0)), lambda t, i: F.struct(i.alias("pos"), t.alias("token"), dax_kind(t).alias("kind")))
    return exprs.withColumn("sig", F.filter(all_tokens, lambda t: ~t["kind"].isin("space", "comment")))


def _inner(token: Column, mark: str) -> Column:
    """A name without its delimiters, doubled ones put back."""
    return F.replace(F.regexp_replace(token, r"\A['\[\"]|['\]\"]\z", ""), F.lit(mark * 2), F.lit(mark))


def dax_refs(exprs: DataFrame, text_col: str = "text") -> DataFrame:
    """``exprs`` joined with pos, shape (field, table, function), table_name, name of each reference, by what stands next to each other.

    A qualifier and the bracket after it are one reference. Any bare name is a table reference, keywords too:
    that can only keep a table that is there.
    """
    keyword = lambda c: F.upper(c).isin(*DAX_KEYWORDS)

    def one(t: Column, i: Column) -> Column:
        after, before = F.get("sig", i + 1), F.get("sig", i - 1)
        field = t["kind"] == "bracket"
        qualifies = F.coalesce(after["kind"] == "bracket", F.lit(False)) & ((t["kind"] == "table") | (t["kind"] == "name") & ~keyword(t["token"]))
        shape = F.when(field, "field").when(qualifies, None).when(t["kind"] == "table", "table").when((t["kind"] == "name") & F.coalesce(after["token"] == "(", F.lit(False)), "function").when(t["kind"] == "name", "table")
        table = F.when(field, F.when(before["kind"] == "table", _inner(before["token"], "'")).when((before["kind"] == "name") & ~keyword(before["token"]), before["token"]))
        name = F.when(field, F.regexp_replace(t["token"], r"\A\[|\]\z", "")).when(t["kind"] == "table", _inner(t["token"], "'")).otherwise(t["token"])
        return F.struct(t["pos"].alias("pos"), shape.alias("shape"), table.alias("table_name"), name.alias("name"))

    rest = [c for c in exprs.columns if c != text_col]
    found = significant(exprs, text_col).withColumn("refs", F.transform("sig", one))
    return found.select(*rest, F.inline(F.filter("refs", lambda r: r["shape"].isNotNull())))


def activations(exprs: DataFrame, text_col: str = "text") -> DataFrame:
    """``exprs`` joined with the two qualified columns after each USERELATIONSHIP: table_a, column_a, table_b, column_b."""
    rest = [c for c in exprs.columns if c != text_col]
    found = dax_refs(exprs.where(F.upper(text_col).contains("USERELATIONSHIP")), text_col)  # few texts do; only their references are gathered
    ordered = F.array_sort(F.collect_list(F.struct("pos", "shape", "table_name", "name")))
    each = found.groupBy(*rest).agg(ordered.alias("refs"))
    pair = F.transform("refs", lambda r, i: F.struct(r.alias("call"), F.get("refs", i + 1).alias("a"), F.get("refs", i + 2).alias("b")))
    calls = F.filter(pair, lambda p: (p["call"]["shape"] == "function") & (F.upper(p["call"]["name"]) == "USERELATIONSHIP") & p["a"]["table_name"].isNotNull() & p["b"]["table_name"].isNotNull())
    return each.select(*rest, F.inline(F.transform(calls, lambda p: F.struct(p["a"]["table_name"].alias("table_a"), p["a"]["name"].alias("column_a"), p["b"]["table_name"].alias("table_b"), p["b"]["name"].alias("column_b")))))


def dax_fingerprints(exprs: DataFrame, text_col: str = "text") -> DataFrame:
    """``exprs`` with fingerprint and n_tokens: what an expression says whatever its layout, the case of its names, and the quotes of its tables."""
    tags = {"name": "i", "table": "i", "bracket": "b", "string": "s", "date": "d", "number": "n", "parameter": "q"}
    tag = lambda k: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in tags.items() for x in kv)), k), F.lit("o"))
    word = lambda t: F.when(t["kind"] == "table", F.lower(_inner(t["token"], "'"))).when(t["kind"].isin("name", "bracket", "parameter", "date"), F.lower(t["token"])).otherwise(t["token"])
    parts = F.transform("sig", lambda t: F.concat(tag(t["kind"]), word(t)))
    return significant(exprs, text_col).select(*[c for c in exprs.columns if c != text_col], F.sha2(F.array_join(parts, "\u001f"), 256).alias("fingerprint"), F.size("sig").cast("long").alias("n_tokens"))


def quoted_names(exprs: DataFrame, text_col: str = "text") -> DataFrame:
    """``exprs`` joined with ``name``, folded: the string literals, which may name columns made in the query."""
    strings = F.transform(F.filter("sig", lambda t: t["kind"] == "string"), lambda t: F.lower(_inner(t["token"], '"')))
    return significant(exprs, text_col).select(*[c for c in exprs.columns if c != text_col], F.explode(F.array_distinct(strings)).alias("name"))


def variables(exprs: DataFrame, text_col: str = "text") -> DataFrame:
    """``exprs`` joined with ``name``, folded: what VAR declares."""
    pairs = F.transform("sig", lambda t, i: F.when((F.upper(t["token"]) == "VAR") & (F.get("sig", i + 1)["kind"] == "name"), F.lower(F.get("sig", i + 1)["token"])))
    return significant(exprs, text_col).select(*[c for c in exprs.columns if c != text_col], F.explode(F.array_distinct(F.array_compact(pairs))).alias("name"))


def structural_errors(exprs: DataFrame, text_col: str = "text") -> DataFrame:
    """``exprs`` with ``error``: unterminated, unbalanced, empty, or null. The open brackets are folded over the tokens."""
    tokens = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(DAX), F.lit(0))
    last = lambda t: F.substring(t, -1, 1)
    marks = lambda t, m: F.char_length(t) - F.char_length(F.replace(t, F.lit(m), F.lit("")))
    open_text = lambda t, m: t.startswith(m) & ((F.char_length(t) < 2) | (last(t) != m) | (marks(t, m) % 2 == 1))
    dated = lambda t: t.rlike(r'\A[dD][tT]"') & (marks(t, '"') % 2 == 1)
    unterminated = F.exists(tokens, lambda t: open_text(t, '"') | open_text(t, "'") | dated(t) | t.startswith("[") & (last(t) != "]") | t.startswith("/*") & (~t.endswith("*/") | (F.char_length(t) < 4)))
    held = F.aggregate(
        F.filter(tokens, lambda t: t.isin("(", ")", "{", "}")),
        F.lit(""),
        lambda acc, t: F.when(t.isin("(", "{"), F.concat(acc, t))
        .when((t == ")") & acc.endswith("(") | (t == "}") & acc.endswith("{"), F.substring(acc, F.lit(1), F.char_length(acc) - 1))
        .otherwise(F.concat(acc, F.lit("!"), t)),
    )
    some = F.exists(tokens, lambda t: ~dax_kind(t).isin("space", "comment"))
    return exprs.withColumn("error", F.when(unterminated, "unterminated").when(held != "", "unbalanced").when(~some, "empty"))


def structural_error(text: str | None) -> str | None:
    """The same of one text, for readers that meet texts one by one."""
    pattern = re.compile(r"""\s+|(?:--|//)[^\r\n]*|/\*.*?(?:\*/|\Z)|"(?:""|[^"])*"?|'(?:''|[^'])*'?|\[[^\]]*\]?|.""", re.S)
    stack, some = [], False
    for t in pattern.findall(text or ""):
        if t.isspace() or t.startswith(("--", "//")):
            continue
        if t.startswith("/*"):
            if not t.endswith("*/") or len(t) < 4:
                return "unterminated"
            continue
        some = True
        if t[0] in "\"'" and (len(t) < 2 or t[-1] != t[0] or t.count(t[0]) % 2):
            return "unterminated"
        if t[0] == "[" and t[-1] != "]":
            return "unterminated"
        if t in "({":
            stack.append({"(": ")", "{": "}"}[t])
        elif t in ")}" and (not stack or stack.pop() != t):
            return "unbalanced"
    return "unbalanced" if stack else None if some else "empty"


def mdx_chains(text: str | None) -> list[list[tuple[str, bool]]]:
    """Bracketed chains outside strings and comments: segments (name, is key)."""
    out: list[list[tuple[str, bool]]] = []
    token = re.compile(r"""//[^\n]*|--[^\n]*|/\*.*?(?:\*/|\Z)|"(?:""|[^"])*"?|'(?:''|[^'])*'?|(\.?\s*&?)\[((?:\]\]|[^\]])*)\]""", re.S)
    end = -1
    for m in token.finditer(text or ""):
        if m[2] is None:
            continue
        joined = m[1].startswith(".") and m.start() == end or (m[1].startswith("&") and m.start() == end)
        if not joined or not out:
            out.append([])
        out[-1].append((m[2].replace("]]", "]"), "&" in m[1]))
        end = m.end()
    return out


#: Power Query keywords, case-sensitive.
M_KEYWORDS = "and as each else error false if in is let meta not null or otherwise section shared then true try type".split()
M_TOKEN = re.compile(r"""\s+|//[^\r\n]*|/\*.*?(?:\*/|\Z)|\#"(?:""|[^"])*"?|"(?:""|[^"])*"?|\#[A-Za-z]+|[^\W\d][\w]*(?:\.[^\W\d]\w*)*|\d[\w.]*|=>|\.\.\.?|<=|>=|<>|.""", re.S)


def m_tokens(text: str | None) -> list[str]:
    return M_TOKEN.findall(text or "")


#: Built-ins whose text arguments name columns, in lower case, and those whose text is a query of another language.
M_COLUMN_CALLS = "#table record.field record.fieldordefault table.addcolumn table.addindexcolumn table.combinecolumns table.column table.duplicatecolumn table.expandlistcolumn table.expandtablecolumn table.filldown table.group table.join table.nestedjoin table.pivot table.removecolumns table.reordercolumns table.replaceerrorvalues table.replacevalue table.selectcolumns table.sort table.splitcolumn table.transformcolumns table.transformcolumntypes table.unpivot table.unpivotothercolumns".split()
M_NATIVE_CALLS = ["odbc.query", "value.nativequery"]


def m_names(text: str | None) -> list[str]:
    """Names an M expression mentions: identifiers and quoted identifiers; dotted ones whole and in parts."""
    return list(dict.fromkeys(n for shape, _, n in m_refs(text) if shape == "name"))


def m_refs(text: str | None) -> list[tuple[str, str | None, str]]:
    """(shape, table, name): name, field (with or without a table), column_string, shared, native.

    A bracket is a field if it holds a plain name, a projection if it holds brackets, and a record if it holds an
    equals sign; a record's values are read on.
    """
    tokens = [t for t in m_tokens(text) if not t.isspace() and not t.startswith(("//", "/*"))]
    raw = [t for t in m_tokens(text)]
    at_raw, k = [], 0
    for j, t in enumerate(raw):
        if not t.isspace() and not t.startswith(("//", "/*")):
            at_raw.append(j)
            k += 1
    out: list[tuple[str, str | None, str]] = []
    calls: list[bool] = []  # for each open parenthesis: does it belong to a call whose texts name columns?
    i = 0
    plain = lambda t: t[2:].removesuffix('"').replace('""', '"') if t.startswith('#"') else t
    is_name = lambda t: t.startswith('#"') or (t[0].isalpha() or t[0] == "_") and t not in M_KEYWORDS
    while i < len(tokens):
        t, after = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else ""
        if t == "[":
            j, depth, equals, inner = i + 1, 1, False, False
            while j < len(tokens) and depth:
                depth += (tokens[j] == "[") - (tokens[j] == "]")
                equals |= depth == 1 and tokens[j] == "="
                inner |= tokens[j] == "["
                j += 1
            if not equals and not inner and j > i + 1:
                body = "".join(raw[at_raw[i] + 1 : at_raw[j - 1]]).strip() if tokens[j - 1] == "]" else ""
                table = plain(tokens[i - 1]) if i and is_name(tokens[i - 1]) and "." not in tokens[i - 1] else None
                if body:
                    out.append(("field", table, plain(body)))
                i = j
                continue
            i += 1  # a record or a projection: its parts are read on
            if equals:
                while i < len(tokens) and tokens[i] != "]":
                    if i + 1 < len(tokens) and tokens[i + 1] == "=":
                        i += 2  # a record's own names use nothing
                        break
                    i += 1
            continue
        if t == "(":
            before = tokens[i - 1].lower() if i else ""
            calls.append(before in M_COLUMN_CALLS or bool(calls and calls[-1]))
        elif t == ")":
            if calls:
                calls.pop()
        elif t.lower() == "#shared":
            out.append(("shared", None, t))
        elif t.startswith('"'):
            if calls and calls[-1]:
                out.append(("column_string", None, t[1:].removesuffix('"').replace('""', '"')))
        elif t.lower() in M_NATIVE_CALLS and after == "(":
            out.append(("native", None, t))
        elif is_name(t):
            name = plain(t)
            out.append(("name", None, name))
            if not t.startswith("#") and "." in name:
                out += [("name", None, part) for part in name.split(".")]
        i += 1
    return out


def m_refs_of(exprs: DataFrame, text_col: str = "text") -> DataFrame:
    """``exprs`` joined with shape, table_name, name of each M reference (nesting needs a stack, so texts go through Arrow)."""
    return _explode_python(exprs, text_col, m_refs, ["shape", "table_name", "name"])


def mdx_targets(text: str | None) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, dimension or measure, hierarchy, level) of each chain; member keys are values and are dropped."""
    out = []
    for chain in mdx_chains(text):
        named = [n for n, key in chain if not key]
        if not named:
            continue
        if named[0].lower() == "measures":
            if len(named) > 1:
                out.append(("measure", named[1], None, None))
        else:
            out.append(("field", named[0], named[1] if len(named) > 1 else None, named[2] if len(named) > 2 else None))
    return list(dict.fromkeys(out))


def mdx_targets_of(exprs: DataFrame, text_col: str = "text") -> DataFrame:
    return _explode_python(exprs, text_col, mdx_targets, ["mdx_kind", "name", "hierarchy", "level"])


def _explode_python(rows: DataFrame, text_col: str, read: Callable[[str | None], list[tuple]], names: list[str]) -> DataFrame:
    """Rows joined with what ``read`` finds in their text, batch by batch."""
    rest = [f for f in rows.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(t) for t in batch.column(0).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [x for f in found for x in f]
            own = [c.take(at) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([x[k] for x in flat], pa.string()) for k in range(len(names)))], names=[*batch.schema.names[1:], *names])

    schema = StructType([*rest, *(StructField(n, StringType()) for n in names)])
    return rows.select(text_col, *(F.col(f.name) for f in rest)).mapInArrow(run, schema)


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: insert, delete, replace, and swap of neighbours cost one each."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def osa(a: Column, b: Column) -> Column:
    """osa_distance of two columns; null where either is null. Quadratic in the names: narrow the pairs down first, as :func:`near_names` does."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa_distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)


def near_names(rows: DataFrame, name: str, wanted: str) -> DataFrame:
    """``rows`` whose name is near ``wanted``, with the distance: at most a quarter of its length, two at least.

    Lengths and the built-in edit distance (a swap costs it two, so it is at most twice as large) leave few to compare.
    """
    most = max(2, len(wanted) // 4)
    close = rows.where(F.abs(F.char_length(name) - len(wanted)) <= most).where(F.levenshtein(F.lower(name), F.lit(wanted.lower())) <= 2 * most)
    return close.withColumn("distance", osa(F.lower(name), F.lit(wanted.lower()))).where(F.col("distance") <= most)
