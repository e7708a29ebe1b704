"""Secrets in texts, judged by how many owners have them. DataFrame functions only.

A row-local pass finds candidate spans with regular expressions. Every candidate's value is hashed,
and the corpus tells how many distinct repositories and owners hold that hash: values that many
owners copied are examples from documentation, values of few owners look live. Counts go through
(hash, owner, repository) first, so a value in a third of all rows meets as one row per owner.

Defined results: null texts count as empty; null owners and repositories count as one each, apart from all others; an empty
table gives an empty result; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import MARKS, stage, tagged

#: Kinds in the order in which spans of one start are listed: name, pattern, group of the value, least length of the value.
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("provider", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 20),
]
BASE_KINDS = 3
HIT = "struct<start:int,kind:int,end:int,hash:string>"


#: Matches that one step of the position count takes up: a text of n matches costs n * CHUNK + (n / CHUNK)^2, not n^2.
CHUNK = 512


def _hits(text: Column, whole: Column, kind: int) -> Column:
    """Spans of one kind: positions follow from the lengths of what lies between the matches."""
    _, pattern, group, least = KINDS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    matches = F.transform(
        F.arrays_zip(whole.alias("w"), values.alias("v"), between.alias("b")),
        lambda x: F.struct(F.char_length(x["b"]).alias("b"), F.coalesce(F.char_length(x["w"]), F.lit(0)).alias("w"), F.when(F.char_length(x["v"]) >= least, F.sha2(x["v"], 256)).alias("hash")),
    )
    none = F.array().cast(f"array<{HIT}>")

    def of_chunk(chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["b"] + x["w"]).alias("at"),
                F.when(
                    x["hash"].isNotNull(),
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["b"] + x["w"]).alias("end"), x["hash"].alias("hash")))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )

    def moved(hits: Column, by: Column) -> Column:
        return F.transform(hits, lambda h: F.struct((h["start"] + by).alias("start"), h["kind"].alias("kind"), (h["end"] + by).alias("end"), h["hash"].alias("hash")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda c: of_chunk(F.slice(matches, c * CHUNK + 1, CHUNK)))
    spans = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{HIT}>>").alias("out")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved(c["out"], acc["at"]))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.size(whole) > 0, spans).otherwise(none)


def find_spans(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a column ``hits``: all spans by start, then kind (code points, end exclusive)."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = rows.withColumns({f"__m{k}": F.regexp_extract_all(t, F.lit(KINDS[k][1]), F.lit(0)) for k in range(len(KINDS))})
    hits = F.array_sort(F.concat(*(_hits(t, F.col(f"__m{k}"), k) for k in range(len(KINDS)))))
    return found.withColumn("hits", hits).drop(*(f"__m{k}" for k in range(len(KINDS))))


def ownership(hits: DataFrame) -> DataFrame:
    """Per hash: owners, repositories, places. Null owners and repositories are one each, apart from all others."""
    each = hits.select("owner", "repository", F.explode("hits.hash").alias("hash"))
    by_repo = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("places"))


def judge_hits(hits: DataFrame, example_owners: int, example_repositories: int, salts: int = 32) -> DataFrame:
    """tag and ``judged``, an array of (start, kind, end, live), for rows with hits (tag, owner, repository, hits).

    A value is a widely copied example if ``example_owners`` owners or ``example_repositories`` repositories
    have it, else it looks live. The examples' hashes are broadcast while they are few; beyond that they meet
    the hits by hash and salt, so that a value in a third of all rows does not gather in one task.
    """
    wide = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    examples = stage(ownership(hits).where(wide).select("hash", F.lit(True).alias("example")), "examples")
    each = hits.select("tag", F.inline("hits"))
    if examples.limit(MARKS + 1).count() <= MARKS:
        met = each.join(F.broadcast(examples), "hash", "left")
    else:
        salted = examples.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("tag", "start"), F.lit(salts)).cast("int")).join(salted, ["hash", "salt"], "left")
    return met.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", F.col("example").isNull().alias("live")))).alias("judged"))


def _owned(docs: DataFrame, owner: str | Column, repository: str | Column | None) -> list[Column]:
    """owner and repository; where documents have no repository of their own it is their owner and language."""
    owner = F.col(owner) if isinstance(owner, str) else owner
    if repository is None:
        repository = F.struct(owner.cast("string"), *([F.col("lang").cast("string")] if "lang" in docs.columns else []))
    elif isinstance(repository, str):
        repository = F.col(repository)
    return [owner.cast("string").alias("owner"), repository.alias("repository")]


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda h: F.concat_ws(":", names[h["kind"]], h["start"].cast("string"), h["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str | Column = "source", repository: str | Column | None = None, example_owners: int = 3, example_repositories: int = 6) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_spans, base_sha256, spans, n_live, n_example.

    ``spans`` lists the base kinds' spans, and of further kinds those that look live. Where documents
    have no repository of their own, it is their owner and language.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_owned(docs, owner, repository), F.monotonically_increasing_id().alias("tag"), F.col(text_col).alias("text"))
    rows = stage(find_spans(rows, "text").drop("text"), "hits")
    out = rows.join(judge_hits(rows.where(F.size("hits") > 0), example_owners, example_repositories), "tag", "left")
    count = lambda k: F.size(F.filter("hits", lambda h: h["kind"] == k)).cast("long")
    base = _listed(F.filter("hits", lambda h: h["kind"] < BASE_KINDS))
    judged = F.coalesce("judged", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>"))
    live = F.size(F.filter(judged, lambda h: h["live"])).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        base.alias("base_spans"),
        F.sha2(base, 256).alias("base_sha256"),
        _listed(F.filter(judged, lambda h: (h["kind"] < BASE_KINDS) | h["live"])).alias("spans"),
        live.alias("n_live"),
        (F.size(judged).cast("long") - live).alias("n_example"),
    )


def redact(docs: DataFrame, text_col: str = "text", owner: str | Column = "source", repository: str | Column | None = None, example_owners: int = 3, example_repositories: int = 6, mask: str = "<secret>", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with live-looking secrets masked; widely copied examples and all other text stay as they are.

    Every row stays, with all its columns, of whatever names; null texts stay null; repeated rows are masked
    each; an empty table stays empty. Only the spans to mask meet the rows again.
    """
    rows, tag = tagged(docs)
    hits = find_spans(rows.select(F.col(tag).alias("tag"), *_owned(docs, owner, repository), F.col(text_col).alias("text")), "text").drop("text").where(F.size("hits") > 0)
    judged = judge_hits(stage(hits, "hits"), example_owners, example_repositories)
    live = F.transform(F.filter("judged", lambda h: h["live"]), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    masks = stage(judged.select("tag", live.alias("spans")).where(F.size("spans") > 0), "masks")
    few = masks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole = rows.select(F.struct(*own).alias("doc"), F.col(tag).alias("tag")).join(F.broadcast(masks) if few["n"] + few["spans"] <= MARKS else masks, "tag", "left")
    text = F.col("doc")[text_col]
    parts = F.aggregate(  # what lies between the masked spans; overlapping spans are one
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("keep")),
        lambda acc, h: F.struct(
            F.greatest(acc["at"], h["end"]).alias("at"),
            F.when(h["start"] < acc["at"], acc["keep"]).otherwise(F.concat(acc["keep"], F.array(F.struct(acc["at"].alias("start"), h["start"].alias("end"))))).alias("keep"),
        ),
        lambda acc: F.concat(acc["keep"], F.array(F.struct(acc["at"].alias("start"), F.char_length(text).alias("end")))),
    )
    masked = F.array_join(F.transform(parts, lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"])), mask)
    fields = {text_col: masked}
    if length_col in docs.columns:
        fields[length_col] = F.char_length(masked).cast(docs.schema[length_col].dataType)
    changed = F.col("doc")
    for name, value in fields.items():
        changed = changed.withField(f"`{name}`", value)
    return whole.select(F.when(F.col("spans").isNull(), F.col("doc")).otherwise(changed).alias("doc")).select("doc.*")
