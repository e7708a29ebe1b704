"""Workbooks that are connected to a model, as report facts: sheets are pages; pivots, slicers, timelines and formula cells are visuals.

Parts are found by their relationships and elements by local names, so both flavours of the format read alike.
Fields are unique names of an MDX cube, exact where the workbook stores them whole.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from weftline.functions.lexers import mdx_chains, mdx_targets
from weftline.sources.facts import Facts, parse_files

#: Cube functions, and the places of the arguments that name members or sets (from 0; None: all from the second on).
CUBE_ARGUMENTS = {"CUBEVALUE": None, "CUBEMEMBER": [1], "CUBESET": [1, 4], "CUBERANKEDMEMBER": [1], "CUBEMEMBERPROPERTY": [1], "CUBEKPIMEMBER": [1], "CUBESETCOUNT": []}


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


class Package:
    """A zip of XML parts with relationships between them."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def xml(self, part: str) -> ElementTree.Element | None:
        name = self.names.get(part.lstrip("/").lower())
        return ElementTree.fromstring(self.zip.read(name)) if name else None

    def related(self, part: str, kind: str) -> list[tuple[str, str]]:
        """(id, part) of the relationships whose type ends so."""
        folder, name = posixpath.split(part)
        rels = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = []
        for r in rels if rels is not None else []:
            if r.get("Type", "").endswith("/" + kind):
                target = r.get("Target", "")
                out.append((r.get("Id", ""), target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))))
        return out


def cube_calls(formula: str) -> list[tuple[str, list[str]]]:
    """(function, arguments) of every cube call, nested ones too; arguments are split at commas outside quotes and parentheses."""
    out = []
    for m in re.finditer(r"\b(CUBE[A-Z]+)\s*\(", formula, re.I):
        args, depth, i, held, quoted = [], 0, m.end(), "", False
        while i < len(formula):
            c = formula[i]
            if c == '"':
                quoted = not quoted
            elif not quoted:
                if c in "({":
                    depth += 1
                elif c in ")}":
                    if depth == 0:
                        break
                    depth -= 1
                elif c in ",;" and depth == 0:
                    args.append(held.strip())
                    held, i = "", i + 1
                    continue
            held += c
            i += 1
        out.append((m[1].upper(), [*args, held.strip()]))
    return out


def member_arguments(function: str, count: int) -> list[int]:
    """Places of a call's arguments that name members or sets."""
    places = CUBE_ARGUMENTS.get(function, [])
    return list(range(1, count)) if places is None else [p for p in places if p < count]


def literal(argument: str) -> str | None:
    """The text of an argument that is one string literal."""
    m = re.fullmatch(r'"((?:""|[^"])*)"', argument)
    return m[1].replace('""', '"') if m else None


def bind(facts: Facts, site: str, unique_name: str, exact: bool, **where) -> None:
    for kind, name, hierarchy, level in mdx_targets(unique_name):
        if kind == "measure":
            facts.add("binding", "Measures", name, site=site, tkind="mdx", exact=exact, **where)
        elif level != "(All)":
            facts.add("binding", name, name, site=site, tkind="mdx", hierarchy=hierarchy, level=level, exact=exact, **where)


def pivot_fields(package: Package, part: str) -> list[tuple[str, str]]:
    """(well, unique name) of a pivot: its fields are indexes into the cache's."""
    pivot = package.xml(part)
    caches = package.related(part, "pivotCacheDefinition")
    cache = package.xml(caches[0][1]) if caches else None
    if pivot is None or cache is None:
        return []
    fields = [attribute(f, "name") or "" for f in cache.iter() if local(f.tag) == "cacheField"]
    trees = [attribute(h, "uniqueName") or "" for h in cache.iter() if local(h.tag) == "cacheHierarchy"]
    out = []
    for e in pivot.iter():
        name = local(e.tag)
        well = {"rowFields": "Rows", "colFields": "Columns"}.get(name)
        if well:
            out += [(well, fields[int(x)]) for f in e if (x := attribute(f, "x")) and x != "-2" and int(x) < len(fields)]
        elif name == "pageField":
            if (h := attribute(e, "hier")) and h != "-1" and int(h) < len(trees):
                out.append(("Filters", trees[int(h)]))
            elif (x := attribute(e, "fld")) and int(x) < len(fields):
                out.append(("Filters", fields[int(x)]))
        elif name == "dataField" and (x := attribute(e, "fld")) and int(x) < len(fields):
            out.append(("Values", fields[int(x)]))
    return [(w, n) for w, n in out if n.startswith("[")]


def parse(facts: Facts, content: bytes) -> None:
    package = Package(content)
    book = next((p for _, p in package.related("", "officeDocument")), "xl/workbook.xml")
    workbook = package.xml(book)
    if workbook is None:
        raise ValueError("no workbook inside")
    facts.add("report", None, None)
    facts.add("dataset", None, None, how="unresolved")
    sheets = {attribute(s, "id"): attribute(s, "name") for s in workbook.iter() if local(s.tag) == "sheet"}
    caches = {p: package.xml(p) for kind in ("slicerCache", "timelineCache") for _, p in package.related(book, kind)}
    drawn: set[str] = set()
    for rid, part in package.related(book, "worksheet"):
        page = sheets.get(rid)
        facts.add("page", None, page, display_name=page, folder=page)
        sheet = package.xml(part)
        for _, p in package.related(part, "pivotTable"):
            root = package.xml(p)
            name = (attribute(root, "name") if root is not None else None) or p
            facts.add("visual", None, name, page=page, visual_type="pivotTable")
            for well, field in pivot_fields(package, p):
                bind(facts, "well", field, True, page=page, visual=name, role=well)
        for kind in ("slicer", "timeline"):
            for _, p in package.related(part, kind):
                for s in package.xml(p).iter() if package.xml(p) is not None else []:
                    cache = attribute(s, "cache")
                    held = next((c for c in caches.values() if c is not None and attribute(c, "name") == cache), None)
                    if cache and held is not None:
                        drawn.add(cache)
                        facts.add("visual", None, attribute(s, "name"), page=page, visual_type=kind)
                        for u in cache_names(held):
                            bind(facts, "well", u, True, page=page, visual=attribute(s, "name"), role="Field")
        for c in sheet.iter() if sheet is not None else []:
            if local(c.tag) != "c":
                continue
            formula = next((f.text for f in c if local(f.tag) == "f" and f.text), None)
            calls = cube_calls(formula) if formula else []
            if calls:
                cell = attribute(c, "r")
                facts.add("visual", None, cell, page=page, visual_type="cubeFormula")
                for function, args in calls:
                    for i in member_arguments(function, len(args)):
                        text = literal(args[i])
                        if text is not None:
                            name = f"[Measures].[{text}]" if function == "CUBEKPIMEMBER" else text
                            bind(facts, "well", name, False, page=page, visual=cell, role=function)
                        elif not re.fullmatch(r"\$?[A-Z]+\$?\d+|CUBE.*", args[i], re.I | re.S):
                            facts.skip("not_analyzed", f"a computed argument at {page}!{cell}", at=f"{page}!{cell}")
    for held in caches.values():
        if held is not None and attribute(held, "name") not in drawn:
            for u in cache_names(held):
                bind(facts, "filter", u, True)
    for _, part in package.related(book, "connections"):
        for c in package.xml(part).iter() if package.xml(part) is not None else []:
            if local(c.tag) == "connection":
                db = next((x for x in c if local(x.tag) == "dbPr"), None)
                olap = any(local(x.tag) == "olapPr" for x in c) or db is not None and "MSOLAP" in (attribute(db, "connection") or "").upper()
                if not olap:
                    facts.skip("not_analyzed", f"connection {attribute(c, 'name')} is not to a model")
                elif db is not None and attribute(db, "command") and attribute(db, "commandType") != "1":
                    facts.add("report_query", None, attribute(c, "name"), text=attribute(db, "command"))


def cache_names(cache: ElementTree.Element) -> list[str]:
    """The levels of a slicer or timeline, else its source."""
    levels = [u for e in cache.iter() if local(e.tag) == "level" and (u := attribute(e, "uniqueName")) and not u.endswith("[(All)]")]
    source = attribute(cache, "sourceName") or ""
    return levels or ([source] if mdx_chains(source) else [])


def read_workbooks(files: DataFrame) -> DataFrame:
    return parse_files(files, parse)
