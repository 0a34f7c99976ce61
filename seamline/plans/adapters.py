"""Views that turn the supplied star-schema tables into interface rows, in Spark and, word for word, in DuckDB SQL.

``iface``: orders with their line items - partner is the order's priority, columns are supplier numbers modulo 12.
``brands``: parts by brand and type - at most 150 rows at any scale, for operators that are quadratic by definition.
``msa``: documents as aligned sequences. ``ovl``: events as overlays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, LETTERS = "0123456789abcdef", "ACDEFGHIKLMN-QRS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has line items. Line items are aggregated by order before the join."""
    distinct = lambda e: F.array_sort(F.collect_set(F.expr(e).cast("int")))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        distinct("l_suppkey % 12").alias("interface_msa_columns_a"),
        distinct("l_partkey % 15").alias("surface_msa_columns_a"),
        distinct("l_suppkey").alias("interface_residues_a"),
        distinct("l_linenumber").alias("interface_residues_b"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    start = F.expr("1 + o_custkey % 7")
    fragment = F.concat(start.cast("string"), F.lit("-"), F.expr("6 + o_custkey % 7 + o_orderkey % 40").cast("string"))
    other = F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), F.expr("o_orderkey + 9").cast("string"))
    protein = F.concat(F.lit("P"), F.col("o_custkey").cast("string"))
    return orders.join(items, "o_orderkey").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderpriority").alias("partner_domain"),
        F.concat_ws("_", protein, fragment, other).alias("interface_row_key"),
        protein.alias("protein_id"),
        fragment.alias("fragment_key"),
        other.alias("partner_fragment_key"),
        F.concat(F.lit("F"), F.expr("o_custkey % 97").cast("string")).alias("family"),
        F.concat_ws("/", "o_orderstatus", F.year("o_orderdate").cast("string")).alias("path"),
        F.translate(F.md5(F.col("o_orderkey").cast("string")), HEX, LETTERS).alias("aligned_seq"),
        F.size("interface_residues_a").alias("interface_size_a"),
        F.size("interface_residues_b").alias("interface_size_b"),
        "interface_msa_columns_a",
        "surface_msa_columns_a",
        "interface_residues_a",
        "interface_residues_b",
        F.expr("cast(o_custkey % 6 - 1 as int)").alias("cluster_label"),
    )


IFACE = f"""
    items AS (
        SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_suppkey % 12 AS INTEGER)))) AS cols,
               list_sort(list_distinct(list(CAST(l_partkey % 15 AS INTEGER)))) AS surf,
               list_sort(list_distinct(list(CAST(l_suppkey AS INTEGER)))) AS res_a,
               list_sort(list_distinct(list(l_linenumber))) AS res_b
        FROM lineitem GROUP BY l_orderkey
    ), iface AS (
        SELECT o_orderkey, o_custkey, o_orderpriority AS partner_domain,
               'P' || o_custkey || '_' || (1 + o_custkey % 7) || '-' || (6 + o_custkey % 7 + o_orderkey % 40) || '_' || o_orderkey || '-' || (o_orderkey + 9) AS interface_row_key,
               'P' || o_custkey AS protein_id, (1 + o_custkey % 7) || '-' || (6 + o_custkey % 7 + o_orderkey % 40) AS fragment_key,
               o_orderkey || '-' || (o_orderkey + 9) AS partner_fragment_key, 1 + o_custkey % 7 AS frag_s, 6 + o_custkey % 7 + o_orderkey % 40 AS frag_e,
               'F' || (o_custkey % 97) AS family, o_orderstatus || '/' || year(o_orderdate) AS path,
               translate(md5(CAST(o_orderkey AS VARCHAR)), '{HEX}', '{LETTERS}') AS aligned_seq,
               CAST(len(res_a) AS INTEGER) AS interface_size_a, CAST(len(res_b) AS INTEGER) AS interface_size_b,
               cols, surf, res_a, res_b, CAST(o_custkey % 6 - 1 AS INTEGER) AS cluster_label
        FROM orders JOIN items ON l_orderkey = o_orderkey
    )"""


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partner_domain, interface_row_key and columns of parts by type and brand."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("partner_domain"), F.col("p_brand").alias("interface_row_key"))
        .agg(F.array_sort(F.collect_set(F.expr("cast(p_size % 31 as int)"))).alias("interface_msa_columns_a"))
    )


BRANDS = """
    brands AS (
        SELECT p_type AS partner_domain, p_brand AS row_key, list_sort(list_distinct(list(CAST(p_size % 31 AS INTEGER)))) AS cols
        FROM part GROUP BY p_type, p_brand
    ), groups AS (
        SELECT partner_domain, cols, count(*) AS member_count, min(row_key) AS row_key,
               row_number() OVER (ORDER BY partner_domain, cols) - 1 AS group_index
        FROM brands GROUP BY partner_domain, cols
    )"""


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as sequences of letters and gaps, with one fragment each."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("interface_row_key"),
        F.col("lang").alias("partner_domain"),
        "source",
        F.expr("concat(3, '-', 3 + n_chars div 2, ',', 9 + n_chars div 2, '-', 20 + n_chars div 2)").alias("fragment_key"),
        F.regexp_replace("text", "[^A-Za-z]", "-").alias("aligned_seq"),
    )


MSA = """
    msa AS (
        SELECT CAST(doc_id AS VARCHAR) AS interface_row_key, lang AS partner_domain, source, n_chars // 2 AS half,
               regexp_replace(text, '[^A-Za-z]', '-', 'g') AS aligned_seq
        FROM documents
    )"""


def ovl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks: row_key, partner_domain, col and kind, each once."""
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").cast("string").alias("row_key"), F.col("event_type").alias("partner_domain"), F.expr("cast(event_id % 40 as int)").alias("col"), F.when(F.expr("event_id % 3 = 0"), "surface").otherwise("interface").alias("kind"))
        .distinct()
    )


OVL = """
    ovl AS (
        SELECT DISTINCT CAST(user_id AS VARCHAR) AS row_key, event_type AS partner_domain, CAST(event_id % 40 AS INTEGER) AS col,
               CASE WHEN event_id % 3 = 0 THEN 'surface' ELSE 'interface' END AS kind
        FROM events
    )"""
