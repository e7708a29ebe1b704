"""The queries of this subpackage: thin callers of its operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact_dedup, html_extract, jaccard_join, license_scan, packing, pieces, quality_classifier, quality_rules, secret_scan, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(_table(spark, sf_dir, "documents")).drop("row_seq")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents")).drop("base_spans")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("blocks", "windows")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_groups(_table(spark, sf_dir, "documents")).drop("tag", "row_seq", "component")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), keep_ids=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return warc.read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extract": op4_html_extract,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_pieces": op9_pieces,
    "op10_warc": op10_warc,
}

WORDS_SQL = r"[^\x20\x09-\x0D]+"


def _secrets_sql() -> str:
    """Matches of each kind with their places: what lies between the matches is counted up."""

    def found(kind: int) -> str:
        name, pattern, group, least = secret_scan.KINDS[kind]
        pattern = pattern.replace("'", "''")
        return (
            f"select doc_id, source, lang, {kind} as kind, '{name}' as name, {least} as least, regexp_extract_all(coalesce(text, ''), '{pattern}') as ws, "
            f"regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) as vs, string_split_regex(coalesce(text, ''), '{pattern}') as bs from documents"
        )

    kinds = " union all ".join(found(k) for k in range(len(secret_scan.KINDS)))
    return f"""
        with f as ({kinds}),
        e as (select doc_id, source, lang, kind, name, least, unnest(ws) as w, unnest(vs) as v, unnest(bs[1 : len(ws)]) as b, unnest(range(len(ws))) as i from f where len(ws) > 0),
        p as (select *, sum(length(b) + length(w)) over (partition by doc_id, kind order by i) as fin from e),
        h as (select *, cast(fin - length(w) as bigint) as start from p where length(v) >= least),
        o as (select v, count(*) as owners from (select distinct v, source from h) group by v),
        r as (select v, count(*) as repositories from (select distinct v, source, lang from h) group by v),
        j as (select h.*, not (owners >= 3 or repositories >= 6) as live, name || ':' || start || ':' || cast(fin as bigint) as span from h join o using (v) join r using (v)),
        g as (
            select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
                string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) filter (kind < 3 or live) as spans,
                count(*) filter (live) as n_live, count(*) filter (not live) as n_example
            from j group by doc_id
        )
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
            coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
        from documents left join g using (doc_id)
    """


ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": _secrets_sql(),
    "op5_quality_rules": rf"""
        with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') as ws from documents),
        pos as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from t where len(ws) >= 3),
        tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from pos),
        twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from tri) where n > 1),
        cover as (select doc_id, count(distinct i + k) as n_repeat_words from twice, range(3) r(k) group by doc_id),
        lines as (select doc_id, unnest(string_split(text, chr(10))) as line from t),
        l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '{WORDS_SQL}') group by doc_id),
        m as (
            select t.doc_id, lang, source, len(ws) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
                case when len(ws) = 0 then 0 else length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) end as n_symbols,
                coalesce(l.n_dup_lines, 0) as n_dup_lines, coalesce(l.n_lines, 0) as n_lines, case when len(ws) > 3 then coalesce(c.n_repeat_words, 0) else 0 end as n_repeat_words
            from t left join l using (doc_id) left join cover c using (doc_id)
        ),
        v as (
            select doc_id, lang, source, unnest(['symbols', 'dup', 'repeat', 'chars']) as signal, unnest([0.10, 0.35, 0.45, 2.0]) as slack,
                unnest([n_symbols / n_words, n_dup_lines / n_lines, n_repeat_words / n_words, word_chars / n_words]) as value
            from m where n_words > 0
        ),
        b as (select *, floor(ln(greatest(value, 1e-3) / 1e-3) / ln(1.02)) as bin from v),
        r as (
            select *, count(*) over (partition by signal) as t0, count(*) over (partition by signal, lang) as t1, count(*) over (partition by signal, lang, source) as t2,
                row_number() over (partition by signal order by bin) as r0, row_number() over (partition by signal, lang order by bin) as r1, row_number() over (partition by signal, lang, source order by bin) as r2 from b
        ),
        q as (
            select *, min(case when r0 >= 0.5 * t0 then bin end) over (partition by signal) as a0, min(case when r0 >= 0.75 * t0 then bin end) over (partition by signal) as c0,
                min(case when r1 >= 0.5 * t1 then bin end) over (partition by signal, lang) as a1, min(case when r1 >= 0.75 * t1 then bin end) over (partition by signal, lang) as c1,
                min(case when r2 >= 0.5 * t2 then bin end) over (partition by signal, lang, source) as a2, min(case when r2 >= 0.75 * t2 then bin end) over (partition by signal, lang, source) as c2 from r
        ),
        h as (
            select *, 1e-3 * pow(1.02, c0 + 0.5) + greatest(6 * (1e-3 * pow(1.02, c0 + 0.5) - 1e-3 * pow(1.02, a0 + 0.5)), slack) as l0,
                1e-3 * pow(1.02, c1 + 0.5) + greatest(6 * (1e-3 * pow(1.02, c1 + 0.5) - 1e-3 * pow(1.02, a1 + 0.5)), slack) as l1,
                1e-3 * pow(1.02, c2 + 0.5) + greatest(6 * (1e-3 * pow(1.02, c2 + 0.5) - 1e-3 * pow(1.02, a2 + 0.5)), slack) as l2 from q
        ),
        over_ as (select doc_id, bool_or(value > (l2 * t2 + (l1 * t1 + l0 * 200) / (t1 + 200) * 200) / (t2 + 200)) as too_much from h group by doc_id)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
            not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(too_much, false) as kept
        from m left join over_ using (doc_id)
    """,
    "op7_jaccard_join": rf"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}') as ws from documents
        ),
        each as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0),
        s as (select distinct doc_id, array_to_string(case when len(ws) < 5 then ws else ws[i : i + 4] end, ' ') as shingle from each),
        n as (select doc_id, count(*) as n from s group by doc_id),
        x as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
        l as (select x.a, x.b from x join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b where 100 * common >= 80 * (na.n + nb.n - common)),
        r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b),
        c as (select a as doc_id, min(b) as component_id from r group by a),
        k as (select a as doc_id, count(*) as n_links from l group by a)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, coalesce(k.n_links, 0) as n_links from documents d left join n using (doc_id) left join c using (doc_id) left join k using (doc_id)
    """,
    "op1_exact_dedup": r"""
        with rows as (
            select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
            from documents
        )
        select doc_id,
               first_value(doc_id) over best as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               doc_id = first_value(doc_id) over best as kept,
               text_sha256
        from rows
        window best as (partition by text_sha256 order by n desc, doc_id)
    """,
    "op10_warc": """
        with rows as (
            select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
        ), firsts as (
            select *, min(page_id) over (partition by payload_digest) as first_id from rows
        )
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
        from firsts
    """,
}
