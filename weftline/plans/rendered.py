"""Models, reports, logs and apps written out of the supplied tables, as the files that readers take.

Every part k is a table of one of twenty models, with a measure that uses that of part n (twice as far on in the
same model); so what a reader finds, and what is reached from where, can be said in SQL over ``part`` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.tables import table

MODELS = 20
#: Rows of a task: each becomes a file, which takes about half a millisecond to read.
ROWS = 2000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (a supplied table, or columns of it) dealt out by ``key`` to as many tasks as files of them are worth; Parquet holds a million in one piece, which is one task."""
    n = rows.count()  # of the footers
    return rows.repartition(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 100)), -(-n // ROWS)), key)


def parts(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """k, n (the part that k uses), model, brand, size, last (the largest k) of every part, or of those that become files here: what is chosen first is dealt out to no more tasks than it needs."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    last = p.agg(F.max("k").alias("last"))
    return spread(p.where(only), "k").crossJoin(F.broadcast(last)).withColumn("n", F.expr(f"k + {MODELS} * (k div {MODELS} + 1)")).withColumn("model", F.concat(F.lit("/w/m"), (F.col("k") % MODELS).cast("string"), F.lit(".SemanticModel")))


def _t(template: str, when: str | None = None) -> Column:
    """A text with ``{expression}`` filled in; empty unless ``when`` holds."""
    pieces, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        inner, rest = rest.split("}", 1)
        pieces += [F.lit(before), F.expr(inner).cast("string")]
    text = F.concat(*pieces, F.lit(rest))
    return text if when is None else F.when(F.expr(when), text).otherwise("")


def model_files(spark: SparkSession, d: str) -> DataFrame:
    """model, path, content: a TMDL file for each part, and one of shared objects for each model."""
    p = parts(spark, d)
    tables = F.concat(
        _t("/// part {k}\ntable 'T {k}'\n\tlineageTag: {k}\n"),
        _t("\tisHidden\n", "k % 7 = 0"),
        _t("\n\tmeasure 'M {k}' = SUM('T {k}'[{brand}]) + [M {n}]\n"),
        _t('\t\tformatStringDefinition = "0"\n', "k % 5 = 0"),
        _t("\t\tdetailRowsDefinition =\n\t\t\t\tSELECTCOLUMNS('T {k}',\n\t\t\t\t\t\"a\", [Key])\n", "k % 6 = 0"),
        _t("\t\tkpi\n\t\t\tstatusGraphic: x\n\t\t\ttargetExpression = [M {n}]\n", "k % 4 = 0"),
        _t("\t\tannotation app_keep = why {k}\n", "k % 97 = 0"),
        _t("\n\tcolumn Key\n\t\tdataType: int64\n"),
        _t("\t\tvariation V\n\t\t\trelationship: r{k}\n\t\t\tdefaultHierarchy: 'T {n}'.H\n", "k % 12 = 0"),
        _t("\n\tcolumn '{brand}'\n\t\tsortByColumn: Key\n"),
        _t("\t\trelatedColumnDetails\n\t\t\tgroupByColumn: Key\n", "k % 8 = 0"),
        _t("\n\tcolumn 'C {k}'\n\t\tsourceColumn: C\n"),
        _t("\n\tcolumn Calc = [Key] * {size}\n\n\thierarchy H\n\t\tlevel L1\n\t\t\tcolumn: '{brand}'\n\t\tlevel L2\n\t\t\tcolumn: Key\n"),
        _t("\n\tpartition P = m\n\t\tmode: import\n\t\tsource =\n\t\t\t\tlet\n\t\t\t\t    Source = #\"T {n}\",\n\n\t\t\t\t    Out = Table.RemoveColumns(Source, {'{'}\"C {k}\"{'}'})\n\t\t\t\tin\n\t\t\t\t    Out\n".replace("{'{'}", "{chr(123)}").replace("{'}'}", "{chr(125)}")),
        _t("\n\trefreshPolicy\n\t\tpolicyType: basic\n\t\tsourceExpression = #\"E {k % 20}\"\n", "k % 10 = 0"),
        _t("\n\tcalculationGroup\n\t\tprecedence: 1\n\t\tcalculationItem 'I {k}' = SELECTEDMEASURE()\n\t\t\tformatStringDefinition = \"x\"\n", "k % 50 = 3"),
        _t("\n\tcalendar C\n\t\tcalendarColumnGroup = month\n\t\t\tprimaryColumn: Key\n\t\t\tassociatedColumn: '{brand}'\n", "k % 60 = 4"),
        _t("\todd: 1\n", "k % 13 = 0"),
        _t("\nrelationship r{k}\n\tfromColumn: 'T {k}'.Key\n\ttoColumn: 'T {n}'.Key\n", "n <= last"),
        _t("\tisActive: false\n", "n <= last and k % 4 = 1"),
        _t("\tcrossFilteringBehavior: bothDirections\n", "n <= last and k % 3 = 0"),
    )
    own = p.select("model", F.concat("model", _t("/definition/tables/T{lpad(k, 9, '0')}.tmdl")).alias("path"), tables.alias("content"))
    shared = F.concat(
        _t("expression 'E {k}' = \"x\"\n"),
        _t("\tparameterValuesColumn: 'T {k}'.Key\n", "k % 2 = 0"),
        _t("\nfunction 'F {k}' = ```\n\t\t(a) =>\n\t\t    a + {k}\n\t\t```\n"),
        _t("\nrole 'R {k}'\n\tmodelPermission: read\n\n\ttablePermission 'T {k}' = [Key] > {k}\n\t\tcolumnPermission '{brand}' = none\n"),
        _t("\nref table 'T {n}'\n"),
    )
    first = parts(spark, d, f"k < {MODELS}")
    return own.unionByName(first.select("model", F.concat("model", F.lit("/definition/shared.tmdl")).alias("path"), shared.alias("content")))


def model_json(spark: SparkSession, d: str) -> DataFrame:
    """model, path, content: the same tables as one TMSL document a part (each a model of its own file)."""
    p = parts(spark, d)
    text = F.concat(
        _t('{chr(123)}"model": {chr(123)}"tables": [{chr(123)}"name": "T {k}", "isHidden": {k % 7 = 0}, "columns": [{chr(123)}"name": "Key"{chr(125)}, {chr(123)}"name": "{brand}", "sortByColumn": "Key"{chr(125)}, {chr(123)}"type": "calculated", "name": "Calc", "expression": ["[Key] *", "{size}"]{chr(125)}], '),
        _t('"measures": [{chr(123)}"name": "M {k}", "expression": "SUM(\'T {k}\'[{brand}])"'),
        _t(', "kpi": {chr(123)}"targetExpression": "[M {k}]"{chr(125)}', "k % 4 = 0"),
        _t('{chr(125)}], "partitions": [{chr(123)}"name": "P", "mode": "import", "source": {chr(123)}"type": "m", "expression": ["let", "  a = 1", "in a"]{chr(125)}{chr(125)}]{chr(125)}], '),
        _t('"relationships": [{chr(123)}"name": "r", "fromTable": "T {k}", "fromColumn": "Key", "toTable": "T {k}", "toColumn": "Calc"{chr(125)}]{chr(125)}{chr(125)}'),
    )
    return p.select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("model"), F.concat(F.lit("/w/"), F.col("k").cast("string"), F.lit(".bim")).alias("path"), text.alias("content"))


def report_of(k: Column) -> Column:
    return F.concat(F.lit("/w/r"), (k % MODELS).cast("string"), F.lit(".Report"))


def report_files(spark: SparkSession, d: str) -> DataFrame:
    """model (the report), path, content: a visual for each part of size 45 or more, on one of three pages; a bookmark for each twelfth."""
    of = lambda only: parts(spark, d, only).withColumn("report", report_of(F.col("k")))
    shown = of("size >= 45")
    field = lambda kind, table_, name: f'{{chr(123)}}"{kind}": {{chr(123)}}"Expression": {{chr(123)}}"SourceRef": {{chr(123)}}"Entity": "{table_}"{{chr(125)}}{{chr(125)}}, "Property": "{name}"{{chr(125)}}{{chr(125)}}'
    well = lambda f, more="": f'{{chr(123)}}"field": {f}{more}{{chr(125)}}'
    level = '{chr(123)}"HierarchyLevel": {chr(123)}"Expression": {chr(123)}"Hierarchy": {chr(123)}"Expression": {chr(123)}"SourceRef": {chr(123)}"Entity": "T {k}"{chr(125)}{chr(125)}, "Hierarchy": "H"{chr(125)}{chr(125)}, "Level": "L1"{chr(125)}{chr(125)}'
    visual = F.concat(
        _t('{chr(123)}"name": "V{k}", "position": {chr(123)}{chr(125)}, "visual": {chr(123)}"visualType": "card", "query": {chr(123)}"queryState": {chr(123)}"Values": {chr(123)}"projections": [' + well(field("Measure", "T {k}", "M {k}"))),
        _t(", " + well(field("Column", "T {k}", "Gone")), "k % 17 = 0"),
        _t(", " + well(field("Measure", "T {k}", "Nope")), "k % 19 = 0"),
        _t(", " + well(field("Column", "X {k}", "Key")), "k % 23 = 0"),
        _t(", " + well(level, ', "active": false'), "k % 2 = 0"),
        _t("]{chr(125)}{chr(125)}"),
        _t(', "sortDefinition": {chr(123)}"sort": [{chr(123)}"field": ' + field("Column", "T {k}", "{brand}") + "{chr(125)}]{chr(125)}", "k % 5 = 0"),
        _t("{chr(125)}{chr(125)}"),
        _t(', "filterConfig": {chr(123)}"filters": [{chr(123)}"field": ' + field("Column", "T {k}", "Key") + ', "filter": {chr(123)}"From": [{chr(123)}"Name": "t", "Entity": "T {k}"{chr(125)}], "Where": [{chr(123)}"Column": {chr(123)}"Expression": {chr(123)}"SourceRef": {chr(123)}"Source": "T"{chr(125)}{chr(125)}, "Property": "Calc"{chr(125)}{chr(125)}]{chr(125)}{chr(125)}]{chr(125)}', "k % 3 = 0"),
        _t(', "odd": 1', "k % 29 = 0"),
        _t("{chr(125)}"),
    )
    visuals = shown.select(F.col("report").alias("model"), F.concat("report", _t("/definition/pages/P{k % 3}/visuals/V{k}/visual.json")).alias("path"), visual.alias("content"))
    pages = spark.range(MODELS * 3).select((F.col("id") % MODELS).alias("k"), F.floor(F.col("id") / MODELS).alias("page")).withColumn("report", report_of(F.col("k")))
    page = _t('{chr(123)}"name": "P{page}", "displayName": "Page {page}", "visibility": "{if(page = 2, \'HiddenInViewMode\', \'AlwaysVisible\')}"{chr(125)}')
    page_files = pages.select(F.col("report").alias("model"), F.concat("report", _t("/definition/pages/P{page}/page.json")).alias("path"), page.alias("content"))
    order = pages.where("page = 0").select(F.col("report").alias("model"), F.concat("report", F.lit("/definition/pages/pages.json")).alias("path"), _t('{chr(123)}"pageOrder": ["p0", "P1", "P{7 + k % 2}"]{chr(125)}').alias("content"))
    dataset = pages.where("page = 0").select(F.col("report").alias("model"), F.concat("report", F.lit("/definition.pbir")).alias("path"), F.when(F.expr("k % 2 = 0"), _t('{chr(123)}"datasetReference": {chr(123)}"byPath": {chr(123)}"path": "../m{k}.SemanticModel"{chr(125)}{chr(125)}{chr(125)}')).otherwise(_t('{chr(123)}"datasetReference": {chr(123)}"byConnection": {chr(123)}"connectionString": "Data Source=x;Initial Catalog=m{k};"{chr(125)}{chr(125)}{chr(125)}')).alias("content"))
    mark = _t('{chr(123)}"name": "B{k}", "explorationState": {chr(123)}"sections": {chr(123)}"p{k % 6}": {chr(123)}"filters": {chr(123)}"byExpr": [{chr(123)}"expression": ' + field("Column", "T {k}", "Key") + "{chr(125)}]{chr(125)}{chr(125)}{chr(125)}{chr(125)}{chr(125)}")
    marks = of("k % 12 = 5").select(F.col("report").alias("model"), F.concat("report", _t("/definition/bookmarks/B{k}.bookmark.json")).alias("path"), mark.alias("content"))
    extension = _t('{chr(123)}"entities": [{chr(123)}"name": "T {k}", "measures": [{chr(123)}"name": "RM {k}", "expression": "[M {k}] + [Key]"{chr(125)}]{chr(125)}]{chr(125)}')
    extensions = of(f"k < {MODELS}").select(F.col("report").alias("model"), F.concat("report", F.lit("/definition/reportExtensions.json")).alias("path"), extension.alias("content"))
    parts_ = [visuals, page_files, order, dataset, marks, extensions]
    out = parts_[0]
    for x in parts_[1:]:
        out = out.unionByName(x)
    return out


def pairing(spark: SparkSession) -> DataFrame:
    ids = spark.range(MODELS).select(F.col("id").cast("string").alias("i"))
    return ids.select(F.concat(F.lit("/w/r"), "i", F.lit(".Report")).alias("report"), F.concat(F.lit("/w/m"), "i", F.lit(".SemanticModel")).alias("model"))


def log_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content: the events as query logs, a file for each user, in four formats by the user's number."""
    e = table(spark, d, "events").select(F.col("event_id").cast("long").alias("id"), F.col("user_id").cast("long").alias("user"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    operation = F.when(F.col("event_type").isin("purchase", "view"), "QueryEnd").when(F.col("event_type") == "click", "queryend").otherwise("ProgressReport")
    text = F.when(F.expr("id % 31 = 0"), "").when(F.expr("id % 5 = 0"), _t("SELECT [Measures].[M {id % 97}] ON 0 FROM [c]")).otherwise(_t('EVALUATE "a, b" [M {id % 97}] [WaitTime: {id % 3} ms]'))
    rows = e.select("user", "id", operation.alias("operation"), text.alias("text"), "ts", _t("m{id % 4}").alias("item"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    js = lambda *c: F.to_json(F.struct(*c))
    line = rows.withColumns({
        "csv": F.concat_ws(",", quoted("operation"), quoted("text"), quoted("ts"), quoted("item")),
        "object": js(F.col("operation").alias("OperationName"), F.col("text").alias("EventText"), F.col("ts").alias("Timestamp"), F.col("item").alias("ItemName")),
        "array": F.to_json(F.array("operation", "text", "ts", "item")),
    })
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda x: x[c]), "\n" if c == "csv" else ",").alias(c)
    held = line.groupBy("user").agg(*map(joined, ("csv", "object", "array")))
    columns = '"Columns": [{"ColumnName": "OperationName"}, {"ColumnName": "EventText"}, {"ColumnName": "TimeGenerated"}, {"ColumnName": "ArtifactName"}], "Rows": ['
    content = (
        F.when(F.expr("user % 4 = 0"), F.concat(F.lit("﻿OperationName,EventText,timestamp,itemname\n"), "csv"))
        .when(F.expr("user % 4 = 1"), F.concat(F.lit("["), "object", F.lit("]")))
        .when(F.expr("user % 4 = 2"), F.concat(F.lit('{"Tables": [{' + columns), "array", F.lit("]}]}")))
        .otherwise(F.concat(F.lit('[{"FrameType": "DataSetHeader"}, {"FrameType": "DataTable", "TableKind": "PrimaryResult", ' + columns), "array", F.lit("]}]")))
    )
    return held.select(_t("/log/{user}").alias("path"), content.alias("content"))


def app_files(spark: SparkSession, d: str) -> DataFrame:
    """model (the app), path, content: a script source for each part, and a manifest for each app."""
    p = parts(spark, d)
    source = _t("// \"no\" {k}\nconst a = 'T {k}';\nconst b = /[\"']x/.test(a) ? `EVALUATE 'T {k}' ${a} [M {k}]` : \"it\\'s\";\n".replace("${a}", "${chr(123)}a{chr(125)}"))
    return p.select(F.concat(F.lit("/app"), (F.col("k") % MODELS).cast("string")).alias("model"), F.concat(F.lit("/app"), (F.col("k") % MODELS).cast("string"), _t("/src/p{k}.ts")).alias("path"), source.alias("content"))
