"""Resolution ladders, aggregates, comparisons and search over normalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import fold_name


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by source order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def resolve_qualified(refs: DataFrame, columns: DataFrame, measures: DataFrame) -> DataFrame:
    """refs(table_key, name_key) with the column of that table, else the model-wide measure of that name."""
    return (
        refs.join(columns.select("table_key", "name_key", F.col("id").alias("column_id")), ["table_key", "name_key"], "left")
        .join(measures.select("name_key", F.col("id").alias("measure_id")), "name_key", "left")
        .withColumn("target", F.coalesce("column_id", "measure_id"))
    )


def resolve_unqualified(refs: DataFrame, columns: DataFrame, measures: DataFrame) -> DataFrame:
    """refs(ref, home_key, name_key): all candidates, the measure and the home table's column."""
    m = refs.join(measures.select("name_key", F.col("id").alias("target")), "name_key").select("ref", "target", F.lit("measure").alias("via"))
    c = refs.join(columns.select(F.col("table_key").alias("home_key"), "name_key", F.col("id").alias("target")), ["home_key", "name_key"]).select("ref", "target", F.lit("column").alias("via"))
    return m.unionByName(c)


def queried_objects(uses: DataFrame) -> DataFrame:
    """uses(query_id, object_id, ts, user, report): per object, queries, last seen (as text), users, reports."""
    once = uses.distinct()
    return once.groupBy("object_id").agg(
        F.countDistinct("query_id").alias("queries"), F.max("ts").alias("last_seen"), F.countDistinct("user").alias("users"), F.array_join(F.sort_array(F.collect_set("report")), ",").alias("reports")
    )


def classify(findings: DataFrame, baseline: DataFrame, subjects: DataFrame | None = None, about_usage: Column | None = None) -> DataFrame:
    """findings(key, subject) with status new / existing; with ``subjects`` (a skipped baseline), usage findings are unverified where the subject was known."""
    out = findings.join(baseline.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
    plain = F.when(F.col("known"), "existing").otherwise("new")
    if subjects is None:
        return out.withColumn("status", plain).drop("known")
    out = out.join(subjects.select("subject", F.lit(True).alias("was_there")).distinct(), "subject", "left")
    usage = F.lit(True) if about_usage is None else about_usage
    return out.withColumn("status", F.when(usage, F.when(F.col("was_there"), "unverified").otherwise("new")).otherwise(plain)).drop("known", "was_there")


#: Findings that tell of breakage, not of use.
NOT_USAGE = ["broken_visual", "broken_artifact", "broken_binding"]


def about_usage(kind: Column) -> Column:
    """Does a finding say that nothing uses an object? Breakage and duplicates do not."""
    return ~kind.isin(*NOT_USAGE, "duplicate_measure")


def fixed(baseline: DataFrame, after: DataFrame, skipped: bool = False) -> DataFrame:
    """Findings of the baseline that are gone; duplicate groups are advice and never fixed.

    A baseline scanned without its reports (``skipped``) saw everything unused: of it only breakage can be fixed.
    """
    own = baseline.where("kind <> 'duplicate_measure'")
    if skipped:
        own = own.where(~about_usage(F.col("kind")))
    return own.join(after.select("key").distinct(), "key", "left_anti")


def duplicate_groups(prints: DataFrame, order: Column, keys: list[str], least_tokens: int = 4) -> DataFrame:
    """prints(keys, display, fingerprint, n_tokens): groups of two or more that say the same, members in order, by their first member."""
    members = F.array_sort(F.collect_list(F.struct(order.alias("at"), "display")))
    groups = prints.where(F.col("n_tokens") >= least_tokens).groupBy(*keys, "fingerprint").agg(members.alias("m")).where(F.size("m") > 1)
    return groups.select(*keys, "fingerprint", F.get("m", F.lit(0))["at"].alias("first"), F.transform("m", lambda x: x["display"]).alias("members")).orderBy("first")


def duplicates(prints: DataFrame, least_tokens: int = 4) -> DataFrame:
    """prints(id, fingerprint, n_tokens): groups of two or more, by their first member."""
    return prints.where(F.col("n_tokens") >= least_tokens).groupBy("fingerprint").agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("members > 1")


def unused_storage(dead: DataFrame, sizes: DataFrame) -> DataFrame:
    """dead(id, owner), sizes(id, bytes): bytes of dead objects; members of a dead owner are covered by it."""
    top = dead.join(dead.select(F.col("id").alias("owner")), "owner", "left_anti")
    return top.join(sizes, "id", "left").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.count("bytes").alias("sized"), F.count_if(F.col("bytes").isNull()).alias("unsized"))


def worst(findings: DataFrame, owner: str, top: int = 10) -> DataFrame:
    """The ``top`` owners by findings, then folded name, with the number of owners beyond them; findings without an owner do not count."""
    counts = findings.where(F.col(owner).isNotNull()).groupBy(F.lower(owner).alias("key")).agg(F.min(owner).alias(owner), F.count("*").alias("findings"))
    beyond = counts.agg(F.greatest(F.count("*") - top, F.lit(0)).cast("long").alias("more"))
    return counts.orderBy(F.desc("findings"), "key").limit(top).select(owner, "findings").crossJoin(F.broadcast(beyond))


#: The buckets of an overview.
BUCKETS = {"table": "tables", "column": "columns", "measure": "measures", "relationship": "relationships"}


def buckets(objects: DataFrame) -> DataFrame:
    """model, bucket, objects: the four large kinds, and all others together."""
    named = F.element_at(F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv)), F.col("kind"))
    return objects.groupBy("model", F.coalesce(named, F.lit("others")).alias("bucket")).agg(F.count("*").alias("objects"))


def capped(names: Column, most: int = 3) -> Column:
    """The first names, and how many more there are."""
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(shown, F.lit(" and "), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def search_lines(texts: DataFrame, id_col: str, text_col: str, needle: str, regex: bool = False, case: bool = False) -> DataFrame:
    """id, line (from 1), column (from 1, characters), text: the first match of each line; literals ignore case unless ``case``.

    Texts without a match anywhere are dropped before any is cut into lines. A line's match is looked for in its
    folded form; where folding changes the length, the column is that of the same place in the line itself.
    """
    if regex:
        pattern = needle if case else f"(?i){needle}"
        texts.sparkSession.range(1).select(F.lit("").rlike(pattern)).collect()  # a malformed pattern fails here, before any text is read
        some = texts.where(F.col(text_col).rlike(f"(?m){pattern}"))
    elif case:
        some = texts.where(F.instr(F.col(text_col), needle) > 0)
    else:
        some = texts.where(F.instr(fold_name(F.col(text_col)), needle.lower()) > 0)
    lines = some.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\r?\n", -1)).alias("at", "text"))
    if regex:
        hit = F.regexp_instr("text", F.lit(pattern))
    elif case:
        hit = F.instr("text", needle)
    else:
        low = fold_name(F.col("text"))
        at = F.instr(low, needle.lower())
        grown = F.char_length(low) != F.char_length("text")
        ends = F.transform(F.sequence(F.lit(0), F.char_length("text") - 1), lambda i: F.char_length(fold_name(F.substring(F.col("text"), F.lit(1), i))))
        own = F.size(F.filter(ends, lambda e: e < at))
        hit = F.when(at == 0, 0).when(grown, own).otherwise(at)
    return lines.withColumn("column", hit).where("column > 0").select("id", (F.col("at") + 1).cast("long").alias("line"), F.col("column").cast("long").alias("column"), "text")
