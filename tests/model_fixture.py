"""A small model and report, written as the files that readers take."""

import json

TMDL = {
    "model.tmdl": "model Model\n\tculture: en-US\n\nref table Shop\nref table Date\n",
    "relationships.tmdl": "relationship r1\n\tfromColumn: Shop.DateKey\n\ttoColumn: Date.Key\n\nrelationship r2\n\tisActive: false\n\tfromColumn: Shop.ShipKey\n\ttoColumn: Date.Key\n\nrelationship r3\n\tfromColumn: Bridge.ShopId\n\ttoColumn: Shop.Id\n\tcrossFilteringBehavior: bothDirections\n\nrelationship r4\n\tfromColumn: Bridge.TagId\n\ttoColumn: Tag.Id\n\tcrossFilteringBehavior: bothDirections\n",
    "expressions.tmdl": "expression Server = \"x\" meta [IsParameterQuery=true]\n\nexpression Unused =\n\t\tlet\n\t\t    a = 1\n\t\tin\n\t\t    a\n",
    "roles/r.tmdl": "role Sellers\n\tmodelPermission: read\n\n\ttablePermission Shop = [Region] = \"N\"\n",
    "tables/Shop.tmdl": (
        "/// shops\ntable Shop\n\tlineageTag: 1\n\n\tmeasure Total = SUM(Shop[Amount])\n\t\tformatString: 0\n\n\tmeasure 'Total 2' =\n\t\t\tVAR x = [Total]\n\t\t\tRETURN x * 2\n\t\tisHidden\n\t\tkpi\n\t\t\ttargetExpression = [Goal]\n\n"
        "\tmeasure Goal = 5\n\n\tmeasure Dead = [Dead Too] + 1\n\n\tmeasure 'Dead Too' = SUM('Shop'[Old])\n\n\tmeasure Broken = SUM(Shop[Gone]) + [Nothing]\n\n\tmeasure Copy = sum ( 'shop'[AMOUNT] ) -- same\n\n\tmeasure Ships = CALCULATE([Total], USERELATIONSHIP('Date'[Key], Shop[ShipKey]))\n\n"
        "\tcolumn Amount\n\t\tdataType: double\n\t\tsourceColumn: Amount\n\n\tcolumn Old\n\t\tsourceColumn: Old\n\n\tcolumn Region\n\t\tsourceColumn: Region\n\t\tsortByColumn: Rank\n\n\tcolumn Rank\n\n\tcolumn DateKey\n\n\tcolumn ShipKey\n\n\tcolumn Id\n\n"
        "\tcolumn Kept\n\t\tannotation app_keep = read elsewhere\n\n\thierarchy Geo\n\t\tlevel Area\n\t\t\tcolumn: Region\n\n\tpartition Shop-1 = m\n\t\tmode: import\n\t\tsource =\n\t\t\t\tlet\n\t\t\t\t    Source = Sql.Database(Server, \"db\"),\n\n\t\t\t\t    Cut = Table.RemoveColumns(Source, {\"Old\"})\n\t\t\t\tin\n\t\t\t\t    Cut\n"
    ),
    "tables/Date.tmdl": "table Date\n\n\tcolumn Key\n\n\tcolumn Month\n\n\tpartition D = calculated\n\t\tsource = CALENDAR(1, 2)\n",
    "tables/Bridge.tmdl": "table Bridge\n\n\tcolumn ShopId\n\n\tcolumn TagId\n",
    "tables/Tag.tmdl": "table Tag\n\n\tcolumn Id\n\n\tcolumn Name\n\twhatever: 1\n",
}


def column(table, name, alias=None):
    return {"Column": {"Expression": {"SourceRef": {"Source": alias} if alias else {"Entity": table}}, "Property": name}}


def measure(table, name):
    return {"Measure": {"Expression": {"SourceRef": {"Entity": table}}, "Property": name}}


VISUAL = {
    "name": "V1",
    "visual": {
        "visualType": "card",
        "query": {"queryState": {"Values": {"projections": [{"field": measure("Shop", "Total 2")}, {"field": measure("Shop", "Missing")}, {"field": measure("Shop", "Goal Status")}]}, "Rows": {"projections": [{"field": {"HierarchyLevel": {"Expression": {"Hierarchy": {"Expression": {"SourceRef": {"Entity": "Shop"}}, "Hierarchy": "Geo"}}, "Level": "Area"}}}, {"field": column("Tag", "Name")}, {"field": column("Shop", "Gone"), "active": False}]}}, "sortDefinition": {"sort": [{"field": measure("Shop", "Broken")}]}},
        "objects": {"general": [{"properties": {"filter": {"filter": {"From": [{"Name": "s", "Entity": "Shop"}], "Where": [{"Condition": {"In": {"Expressions": [column("", "Region", "s")], "Values": [[{"Literal": {"Value": "'N'"}}]]}}}]}}}}]},
    },
}
REPORT = {
    "definition.pbir": {"datasetReference": {"byPath": {"path": "../M.SemanticModel"}}},
    "definition/report.json": {"filterConfig": {"filters": [{"field": column("Date", "Month"), "filter": {}}]}},
    "definition/reportExtensions.json": {"entities": [{"name": "Shop", "measures": [{"name": "RM", "expression": "SUM(Shop[Amount])"}, {"name": "RM2", "expression": "[RM] + 1"}]}]},
    "definition/pages/pages.json": {"pageOrder": ["P1", "P9"]},
    "definition/pages/P1/page.json": {"name": "P1", "displayName": "Front"},
    "definition/pages/P1/visuals/V1/visual.json": VISUAL,
    "definition/bookmarks/B1.bookmark.json": {"name": "B1", "explorationState": {"sections": {"Gone": {"filters": {"byExpr": [{"expression": column("Shop", "Old")}]}}}}},
    "definition/bookmarks/B2.bookmark.json": {"name": "B2", "explorationState": {"sections": {"p1": {"visualContainers": {"V1": {"singleVisual": {"projections": {"Values": [{"field": column("Date", "Key")}]}}}}}}}},
}


def model_files(root="/w/M.SemanticModel"):
    return [(root, f"{root}/definition/{name}", text.encode()) for name, text in TMDL.items()]


def report_files(root="/w/R.Report"):
    return [(root, f"{root}/{name}", json.dumps(value).encode()) for name, value in REPORT.items()]


def files_df(spark, rows):
    return spark.createDataFrame(rows, "model string, path string, content binary")
