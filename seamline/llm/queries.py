"""The queries of this subpackage and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocation, decontaminate, divergence, exact_dedup, langid, line_dedup, quality, simhash, suffix_dedup, tiktoken_codec, token_shards, warc, wordpiece_count
from .common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digests=True)
    return out.withColumnRenamed("full", "text_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score_documents(docs, model, threshold=0.3)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.removed_spans(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeat"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiktoken_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_shards.write_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_shards.read_shards(manifest)


def rehearsed(page_id: int | None) -> bool:
    """Whether a page is damaged in the rehearsal of the audit: about one of 85."""
    return page_id is not None and hashlib.md5(str(page_id).encode()).digest()[0] < 3


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas, of which the second stores some records with a byte changed: those whose page_id's MD5 starts with 00, 01 or 02."""
    index, uris, damaged = warc.audit(table(spark, sf_dir, "pages"), 2, fault=lambda side, page: side == 1 and rehearsed(page))
    rows = warc.whole_records(warc.fixity_report(index, uris, damaged), uris)
    return rows.select("page_id", F.sha2("html", 256).alias("html_sha256"), "replicas_whole", F.array_join(F.col("damaged_in").cast("array<string>"), ",").alias("damaged_in"))


def op11_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=30, top_terms=50)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), least_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language": op6_language,
    "op7_decontaminate": op7_decontaminate,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_shards": op9_token_shards,
    "op10_warc_audit": op10_warc_audit,
    "op11_collocation": op11_collocation,
    "op12_divergence": op12_divergence,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL = {
    "op10_warc_audit": """
        SELECT page_id, sha256(coalesce(html, '')) AS html_sha256,
               CAST(CASE WHEN hit THEN 1 ELSE 2 END AS INTEGER) AS replicas_whole, CASE WHEN hit THEN '1' ELSE '' END AS damaged_in
        FROM (SELECT *, coalesce(substr(md5(CAST(page_id AS VARCHAR)), 1, 2) < '03', false) AS hit FROM pages)
    """,
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op5_suffix_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT r, i, md5(array_slice(b, i + 1, i + 400)) AS h FROM d, unnest(range(0, greatest(n - 399, 0))) AS t(i)),
        again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
        m AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM w JOIN again USING (h)),
        s AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM m) GROUP BY r, k),
        runs AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a) AS BIGINT) AS n_removed FROM s GROUP BY r),
        k AS (SELECT doc_id, n, b, coalesce(n_removed, 0) AS n_removed, coalesce(len(a), 0) AS n_spans, list_prepend(0, coalesce(z, [])) AS lo, list_append(coalesce(a, []), n) AS hi FROM d LEFT JOIN runs USING (r))
        SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(lo) + 1), lambda j: CASE WHEN hi[j] > lo[j] THEN hex(array_slice(b, lo[j] + 1, hi[j])) ELSE '' END), ''))) AS kept_sha256, n_removed > 0 AS has_repeat
        FROM k
    """,
    "op7_decontaminate": r"""
        WITH w AS (
            SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
            UNION ALL
            SELECT 'b', item_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')
            FROM benchmark
        ), s AS (
            SELECT DISTINCT side, id, list_aggregate(words[i : i + 4], 'string_agg', ' ') AS shingle
            FROM w, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS r(i)
            WHERE len(words) > 0
        ), n AS (SELECT id, count(*) AS n_shingles FROM s WHERE side = 'b' GROUP BY id),
        hits AS (
            SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_found
            FROM s AS b JOIN s AS d ON b.shingle = d.shingle AND b.side = 'b' AND d.side = 'd' GROUP BY ALL
        )
        SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
        FROM hits JOIN n ON n.id = hits.item_id WHERE n_found >= 0.8 * n_shingles - 1e-9
    """,
    "op11_collocation": r"""
        WITH w AS (
            SELECT coalesce(lang, 'und') AS lang, doc_id, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words
            FROM (SELECT lang, doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM (
                SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents))
        ), g AS (
            SELECT lang, len(ws) AS m, ws, count(*) AS f FROM (SELECT lang, words[i : i + m - 1] AS ws FROM w, range(1, 6) AS r(m), unnest(range(1, len(words) - m + 2)) AS s(i)) GROUP BY lang, ws
        ), sizes AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM g WHERE m = 1 GROUP BY lang),
        c AS (SELECT * FROM g WHERE m > 1 AND f >= 100),
        cuts AS (
            SELECT c.lang, c.ws, c.m, c.f AS a, x.f AS l, y.f AS r, n, k, (CAST(1000 AS HUGEINT) * c.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
            FROM c, unnest(range(1, c.m)) AS t(k) JOIN g AS x ON x.lang = c.lang AND x.ws = c.ws[1 : k] JOIN g AS y ON y.lang = c.lang AND y.ws = c.ws[k + 1 : c.m] JOIN sizes ON sizes.lang = c.lang
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, ws[i : i + m2 - 1] AS ws, max(a) AS longer FROM best, range(2, 5) AS t(m2), unnest(range(1, m - m2 + 2)) AS s(i) WHERE m2 < m GROUP BY ALL),
        kept AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best LEFT JOIN inner_ USING (lang, ws) WHERE longer IS NULL OR 100 * longer < 100 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept QUALIFY rank <= 2000
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents
        ), o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
        kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
        size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        cnt AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        total AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY 1, 2),
        p AS (
            SELECT g.lang, g.source, kept.term, coalesce(cnt.c, 0) AS c, 1 + (1000000000 * (coalesce(cnt.c, 0) + 5)) // (coalesce(total.n, 0) + 5 * size.v) AS p,
                   1 + (1000000000 * (kept.c + 5)) // (size.n + 5 * size.v) AS q
            FROM g JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term
            LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
        ), apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(apart.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM parts QUALIFY part = 'pair' OR rank <= 50
    """,
    "op13_line_dedup": r"""
        WITH t AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
        ), k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM t),
        s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        g AS (SELECT doc_id, line, place, first IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id
    """,
}
