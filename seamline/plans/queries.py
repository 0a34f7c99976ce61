"""One query per operator group over the supplied tables, and its DuckDB SQL.

Every query runs over whole tables. Those that are quadratic or sequential by definition run on ``brands``, which has at most
150 rows at any scale.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, keys, sequences, tables, text
from ..operators import cluster, compare, compress, dendrogram, distance, embed, overlay, represent, rows, stats, structure
from ..settings import ClusteringSettings, EmbeddingSettings, PageSettings
from ..sources import interfaces, structures
from .adapters import BRANDS, IFACE, MSA, OVL, brands, iface, msa, ovl, table
from .registry import ORACLE_SQL, QUERIES, joined, query

KEY = ["partner_domain", "interface_row_key"]


# ---- ingestion


@query(
    "s4_flatten_json",
    f"""WITH {IFACE}
    SELECT row_number() OVER (ORDER BY partner_domain, interface_row_key) - 1 AS row_order, partner_domain, interface_row_key, protein_id, fragment_key,
           partner_fragment_key, interface_size_a, interface_size_b, array_to_string(cols, ',') AS columns FROM iface""",
)
def s4_flatten_json(spark, sf):
    base = iface(spark, sf)
    payload = F.struct("aligned_seq", "interface_msa_columns_a", "surface_msa_columns_a", "interface_residues_a", "interface_residues_b")
    doc = F.create_map("partner_domain", F.create_map("interface_row_key", payload))
    docs = base.select(F.col("o_orderkey").alias("doc_id"), F.parse_json(F.to_json(doc)).alias("doc"))
    parsed = interfaces.interface_rows(interfaces.flatten(docs, ["doc_id"]), [])
    out = parsed.select(*KEY, "protein_id", "fragment_key", "partner_fragment_key", "interface_size_a", "interface_size_b", joined("interface_msa_columns_a").alias("columns"))
    return interfaces.numbered_rows(out).select("row_order", *out.columns)


@query("x9_json_counts", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def x9_json_counts(spark, sf):
    return table(spark, sf, "events").select("event_id", text.count_value(F.variant_get(F.parse_json("props"), "$.k", "variant")).alias("k"))


@query("w1_row_order", f"WITH {IFACE} SELECT partner_domain, interface_row_key, row_number() OVER (ORDER BY partner_domain, interface_row_key) - 1 AS row_order FROM iface")
def w1_row_order(spark, sf):
    return interfaces.numbered_rows(iface(spark, sf).select(*KEY))


# ---- filters and paging (F1-F16)


@query("f1_size_filter", f"WITH {IFACE} SELECT partner_domain, interface_row_key, interface_size_a, interface_size_b FROM iface WHERE interface_size_a >= 5 AND interface_size_b >= 5")
def f1_size_filter(spark, sf):
    return rows.by_size(iface(spark, sf), 5).select(*KEY, "interface_size_a", "interface_size_b")


@query(
    "f5_alignment_page",
    f"""WITH {IFACE}, n AS (SELECT *, row_number() OVER (ORDER BY partner_domain, interface_row_key) - 1 AS row_order FROM iface)
    SELECT row_order, partner_domain, interface_row_key FROM n WHERE row_order >= 240 AND row_order < 1440""",
)
def f5_alignment_page(spark, sf):
    return rows.page(interfaces.numbered_rows(iface(spark, sf).select(*KEY)), PageSettings(240, 1200)).select("row_order", *KEY)


@query(
    "f6_filtered_page",
    f"""WITH {IFACE} SELECT partner_domain, interface_row_key, array_to_string(cols, ',') AS columns, array_to_string(surf, ',') AS surface
    FROM iface WHERE interface_size_a >= 3 AND interface_size_b >= 3 ORDER BY interface_row_key, partner_domain LIMIT 1200 OFFSET 240""",
)
def f6_filtered_page(spark, sf):
    some = rows.by_size(iface(spark, sf), 3).withColumn("row_order", F.struct("interface_row_key", "partner_domain"))
    return rows.page_of_filtered(some, PageSettings(240, 1200)).select(*KEY, joined("interface_msa_columns_a").alias("columns"), joined("surface_msa_columns_a").alias("surface"))


@query("f7_columns_only", f"WITH {IFACE} SELECT partner_domain, interface_row_key, array_to_string(cols, ',') AS columns FROM iface")
def f7_columns_only(spark, sf):
    return rows.columns_only(iface(spark, sf)).select(*KEY, joined("interface_msa_columns_a").alias("columns"))


@query("f8_row_lookup", f"WITH {IFACE} SELECT partner_domain, interface_row_key FROM iface WHERE interface_row_key = (SELECT min(interface_row_key) FROM iface)")
def f8_row_lookup(spark, sf):
    all_rows = iface(spark, sf)
    first = all_rows.agg(F.min("interface_row_key")).first()[0]
    return rows.row_of(all_rows, first or "").select(*KEY)


@query("f9_candidates", f"WITH {IFACE} SELECT partner_domain, interface_row_key, aligned_seq, len(cols) AS n_columns, (SELECT coalesce(max(length(aligned_seq)), 0) FROM iface) AS alignment_length FROM iface")
def f9_candidates(spark, sf):
    return rows.candidates(iface(spark, sf)).select(*KEY, "aligned_seq", F.size("interface_msa_columns_a").cast("long").alias("n_columns"), F.col("alignment_length").cast("long").alias("alignment_length"))


@query(
    "f10_page_completeness",
    """SELECT count(*) AS row_count, CAST(240 AS BIGINT) AS row_offset, CAST(1200 AS BIGINT) AS row_limit,
    CAST(least(greatest(count(*) - 240, 0), 1200) AS BIGINT) AS rows_loaded, 240 + least(greatest(count(*) - 240, 0), 1200) >= count(*) AS rows_complete FROM orders""",
)
def f10_page_completeness(spark, sf):
    return rows.completeness(table(spark, sf, "orders"), PageSettings(240, 1200))


@query("f11_partner_filter", f"WITH {IFACE} SELECT partner_domain, interface_row_key FROM iface WHERE partner_domain = '5-LOW'")
def f11_partner_filter(spark, sf):
    return rows.of_partner(iface(spark, sf), "5-LOW").select(*KEY)


@query("f13_option_search", "SELECT p_partkey, p_brand, p_name FROM part WHERE contains(lower(p_brand || ' ' || p_name), 'brand#1')")
def f13_option_search(spark, sf):
    return table(spark, sf, "part").filter(text.option_matches(" Brand#1", F.col("p_brand"), F.col("p_name"))).select("p_partkey", "p_brand", "p_name")


FUZZY = """contains(lower({0}), 'p1-9') OR contains(regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g'), 'p19') OR regexp_matches(regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g'), 'p.*1.*9')"""


@query("f14_fuzzy_search", f"WITH {IFACE} SELECT partner_domain, interface_row_key FROM iface WHERE {FUZZY.format('interface_row_key')}")
def f14_fuzzy_search(spark, sf):
    return rows.searched(iface(spark, sf), "P1-9", "interface_row_key").select(*KEY)


@query(
    "f15_visible_rows",
    f"""WITH {IFACE} SELECT partner_domain, interface_row_key FROM iface WHERE ({FUZZY.format('interface_row_key')}) AND len(cols) > 0
    AND interface_row_key IN (SELECT interface_row_key FROM iface WHERE cluster_label IN (0, 2))""",
)
def f15_visible_rows(spark, sf):
    base = iface(spark, sf).withColumn("row_key", F.col("interface_row_key")).withColumn("display_row_key", F.col("interface_row_key"))
    some = base.filter(F.size("interface_msa_columns_a") > 0)
    return rows.visible(base, "P1-9", some, base.select("row_key", "cluster_label"), [0, 2]).select(*KEY)


@query(
    "f16_used_columns",
    f"WITH {IFACE} SELECT DISTINCT CAST(i AS INTEGER) AS col FROM iface, range(0, 32) AS r(i) WHERE regexp_matches(substr(aligned_seq, i + 1, 1), '[A-Za-z]')",
)
def f16_used_columns(spark, sf):
    return rows.used_columns(sequences.cells(iface(spark, sf), []))


# ---- counts and statistics


@query("a3_partner_counts", f"WITH {IFACE} SELECT partner_domain, count(*) AS row_count FROM iface GROUP BY 1")
def a3_partner_counts(spark, sf):
    return stats.partner_counts(iface(spark, sf))


SUMMARY = """count(DISTINCT (protein_id, fragment_key)) AS dataset_domains, count(*) AS dataset_interfaces, count(*) FILTER (len(cols) > 0) AS nonempty_interfaces,
    count(DISTINCT (partner_domain, cols)) FILTER (len(cols) > 0) AS unique_interfaces, CAST(coalesce(max(length(aligned_seq)), 0) AS INTEGER) AS alignment_length"""


@query("a7_summary", f"WITH {IFACE} SELECT {SUMMARY} FROM iface")
def a7_summary(spark, sf):
    return stats.summary(iface(spark, sf))


@query("a8_partner_summary", f"WITH {IFACE} SELECT partner_domain, {SUMMARY} FROM iface GROUP BY 1")
def a8_partner_summary(spark, sf):
    return stats.summary(iface(spark, sf), ["partner_domain"])


@query("a6_size_histogram", f"WITH {IFACE} SELECT partner_domain, CAST(len(cols) AS INTEGER) AS size, count(*) AS count FROM iface WHERE len(cols) > 0 GROUP BY ALL")
def a6_size_histogram(spark, sf):
    return stats.size_histogram(iface(spark, sf), ["partner_domain"])


@query(
    "a31_rebinned_histogram",
    """WITH h AS (SELECT CAST(n AS INTEGER) AS size, count(*) AS c FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey) GROUP BY 1),
    s AS (SELECT min(size) AS low, max(size) AS high, CASE WHEN count(*) <= 24 THEN 1 ELSE greatest(1, CAST(ceil((max(size) - min(size) + 1) / 24) AS INTEGER)) END AS w FROM h)
    SELECT CAST(low + ((size - low) // w) * w AS INTEGER) AS start, CAST(least(high, low + ((size - low) // w) * w + w - 1) AS INTEGER) AS "end", CAST(sum(c) AS BIGINT) AS count
    FROM h, s GROUP BY 1, 2""",
)
def a31_rebinned_histogram(spark, sf):
    sizes = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("int").alias("size"))
    return stats.rebinned(sizes.groupBy("size").agg(F.count("*").alias("count")))


STATS = """stats AS (
        SELECT family, CAST(coalesce(max(length(aligned_seq)), 0) AS INTEGER) AS alignment_length, count(DISTINCT (protein_id, fragment_key)) AS dataset_domains, count(DISTINCT interface_row_key) AS interface_rows,
               count(*) FILTER (len(cols) > 0) AS dataset_interfaces, count(DISTINCT (path, partner_domain, cols)) FILTER (len(cols) > 0) AS unique_interfaces, count(DISTINCT partner_domain) AS interaction_partners
        FROM iface GROUP BY family
    ), per_key AS (SELECT family, interface_row_key, len(list_distinct(flatten(list(cols)))) AS n FROM iface GROUP BY ALL),
    means AS (SELECT family, round(avg(n), 2) AS avg_interface_residues_per_row FROM per_key GROUP BY 1)"""


@query("a9_selector_stats", f"WITH {IFACE}, {STATS} SELECT * FROM stats JOIN means USING (family)")
def a9_selector_stats(spark, sf):
    return stats.selector_stats(iface(spark, sf))


def _categories(metric: str) -> str:
    z = f"(ln(1 + {metric}) - avg(ln(1 + {metric})) OVER ()) / nullif(stddev_pop(ln(1 + {metric})) OVER (), 0)"
    case = f"CASE WHEN {z} IS NULL THEN 'normal' WHEN {z} <= -3 THEN 'very_small' WHEN {z} <= -1 THEN 'small' WHEN {z} < 1 THEN 'normal' WHEN {z} < 3 THEN 'big' ELSE 'very_big' END"
    return f"CASE WHEN stddev_pop(ln(1 + {metric})) OVER () < 1e-12 THEN 'normal' ELSE {case} END AS {metric}_category"


@query("a11_categories", f"WITH {IFACE}, {STATS} SELECT family, {', '.join(map(_categories, stats.METRICS))} FROM stats JOIN means USING (family)")
def a11_categories(spark, sf):
    return stats.with_categories(stats.selector_stats(iface(spark, sf))).select("family", *[f"{m}_category" for m in stats.METRICS])


@query(
    "f12_badge_filter",
    f"""WITH {IFACE}, {STATS}, c AS (SELECT family, {', '.join(map(_categories, stats.METRICS))} FROM stats JOIN means USING (family))
    SELECT family FROM c WHERE interface_rows_category IN ('big', 'very_big', 'small', 'very_small') AND avg_interface_residues_per_row_category IN ('small', 'very_small')""",
)
def f12_badge_filter(spark, sf):
    made = stats.with_categories(stats.selector_stats(iface(spark, sf)))
    return rows.with_badges(made, {"interface_rows": {"big", "small"}, "avg_interface_residues_per_row": {"small"}, "dataset_interfaces": set()}).select("family")


@query(
    "j8_stats_with_names",
    f"""WITH {IFACE}, {STATS}, names AS (SELECT 'F' || n_nationkey AS family, n_name AS display_name FROM nation)
    SELECT family, interface_rows, coalesce(display_name, '') AS display_name FROM stats LEFT JOIN names USING (family)""",
)
def j8_stats_with_names(spark, sf):
    names = table(spark, sf, "nation").select(F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("family"), F.col("n_name").alias("display_name"))
    return stats.with_metadata(stats.selector_stats(iface(spark, sf)), names).select("family", "interface_rows", "display_name")


@query(
    "a12_clean_identity",
    f"""WITH {IFACE}, f AS (SELECT interface_row_key, arg_min(aligned_seq, partner_domain) AS seq, arg_min(frag_s, partner_domain) AS s, arg_min(frag_e, partner_domain) AS e FROM iface GROUP BY 1),
    x AS (SELECT interface_row_key, i AS col, substr(seq, i + 1, 1) AS ch, s, e FROM f, unnest(range(0, length(seq))) AS r(i)),
    y AS (SELECT *, regexp_matches(ch, '[A-Za-z]') AS letter, s - 1 + sum(CAST(regexp_matches(ch, '[A-Za-z]') AS INTEGER)) OVER (PARTITION BY interface_row_key ORDER BY col) AS res FROM x),
    c AS (SELECT col, upper(ch) AS letter, count(*) AS n FROM y WHERE letter AND res BETWEEN s AND e GROUP BY 1, 2)
    SELECT CAST(col AS INTEGER) AS col, CAST(max(n) * 100 // (SELECT count(*) FROM f) AS INTEGER) AS identity FROM c GROUP BY 1""",
)
def a12_clean_identity(spark, sf):
    return stats.clean_identity(iface(spark, sf))


@query(
    "a13_letter_identity",
    f"""WITH {MSA}, x AS (SELECT i AS col, upper(substr(aligned_seq, i + 1, 1)) AS letter FROM msa, unnest(range(0, length(aligned_seq))) AS r(i)),
    c AS (SELECT col, letter, count(*) AS n FROM x WHERE regexp_matches(letter, '[A-Z]') GROUP BY 1, 2)
    SELECT CAST(col AS INTEGER) AS col, arg_max(letter, (n, -ascii(letter))) AS letter, CAST(max(n) * 100 // (SELECT count(*) FROM documents) AS INTEGER) AS identity FROM c GROUP BY 1""",
)
def a13_letter_identity(spark, sf):
    return stats.letter_identity(msa(spark, sf))


# ---- keys, sequences and text


@query(
    "x1_row_keys",
    f"""WITH {IFACE} SELECT interface_row_key, protein_id, fragment_key, partner_fragment_key, CAST(frag_s AS INTEGER) AS fragment_start, frag_s || '-' || frag_e AS envelope,
    CAST(frag_e - frag_s + 1 AS INTEGER) AS residues, interface_row_key || '@@' || partner_domain AS interaction_key, partner_domain AS partner FROM iface""",
)
def x1_row_keys(spark, sf):
    k = F.col("interface_row_key")
    fragment = keys.key_part(k, 2)
    both = keys.interaction_key(k, F.col("partner_domain"))
    return iface(spark, sf).select(
        k, keys.key_part(k, 1).alias("protein_id"), fragment.alias("fragment_key"), keys.key_part(k, 3).alias("partner_fragment_key"), keys.fragment_start(fragment).alias("fragment_start"),
        keys.fragment_envelope(fragment).alias("envelope"), F.size(keys.expand_ranges(keys.fragment_ranges(fragment))).alias("residues"), both.alias("interaction_key"), keys.split_interaction_key(both)["partner_domain"].alias("partner"),
    )


@query(
    "m2_masked_sequences",
    f"""WITH {MSA}, x AS (SELECT interface_row_key, half, i AS col, substr(aligned_seq, i + 1, 1) AS ch FROM msa LEFT JOIN LATERAL (SELECT unnest(range(0, length(aligned_seq))) AS i) ON true),
    y AS (SELECT *, regexp_matches(ch, '[A-Za-z]') AS letter, 2 + sum(CAST(regexp_matches(ch, '[A-Za-z]') AS INTEGER)) OVER (PARTITION BY interface_row_key ORDER BY col) AS res FROM x),
    z AS (SELECT *, res BETWEEN 3 AND 3 + half OR res BETWEEN 9 + half AND 20 + half AS inside FROM y)
    SELECT interface_row_key, md5(coalesce(string_agg(CASE WHEN letter AND NOT inside THEN '-' ELSE ch END, '' ORDER BY col), '')) AS masked_md5, count(*) FILTER (letter AND inside) AS residues,
           CAST(coalesce(sum(res) FILTER (letter AND inside), 0) AS BIGINT) AS residue_sum FROM z GROUP BY 1""",
)
def m2_masked_sequences(spark, sf):
    out = msa(spark, sf).select("interface_row_key", sequences.masked("aligned_seq", "fragment_key").alias("m"))
    ids = F.filter("m.residue_ids", lambda x: x.isNotNull())
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("interface_row_key", F.md5("m.aligned_sequence").alias("masked_md5"), F.size(ids).cast("long").alias("residues"), total.alias("residue_sum"))


@query(
    "m3_alignment_rows",
    f"""WITH {IFACE} SELECT protein_id, fragment_key, fragment_key AS alignment_fragment_key, partner_fragment_key, interface_row_key, partner_domain, interface_row_key || '@@' || partner_domain AS row_key,
    interface_row_key || ' | ' || partner_domain AS display_row_key, 40 AS length, length(aligned_seq) > 0 AS has_alignment FROM iface""",
)
def m3_alignment_rows(spark, sf):
    out = sequences.alignment_rows(iface(spark, sf), 40)
    return out.select(*[c for c in out.columns if c not in ("aligned_sequence", "residue_ids")], F.greatest(F.length("aligned_sequence"), F.size("residue_ids")).alias("length"))


@query("x6_squeezed_names", "SELECT s_suppkey, trim(regexp_replace(s_name, '\\s+', ' ', 'g')) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'PF' || s_suppkey ELSE '' END AS accession FROM supplier")
def x6_squeezed_names(spark, sf):
    raw = F.when(F.expr("s_suppkey % 2 = 0"), F.concat(F.lit(" pf"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("PFx"), F.col("s_suppkey").cast("string")))
    return table(spark, sf, "supplier").select("s_suppkey", text.squeeze(F.col("s_name")).alias("name"), text.accession(raw).alias("accession"))


@query(
    "c_display_colours",
    """WITH s AS (SELECT c_custkey, greatest(0, least(100, c_acctbal / 100)) / 100 AS f FROM customer)
    SELECT c_custkey, 'rgb(' || CAST(floor(241 + (47 - 241) * f + 0.5) AS BIGINT) || ', ' || CAST(floor(229 + (125 - 229) * f + 0.5) AS BIGINT) || ', ' || CAST(floor(191 + (90 - 191) * f + 0.5) AS BIGINT) || ')' AS colour,
    CASE WHEN c_custkey % 4 = 0 THEN '#8a847a' WHEN c_custkey % 4 = 2 THEN 'b' ELSE 'a' END AS label_colour FROM s""",
)
def c_display_colours(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", colour.conservation(F.col("c_acctbal") / 100).alias("colour"), colour.palette(F.expr("c_custkey % 4 - 1"), ["a", "b"]).alias("label_colour"))


# ---- compression, distances, clusters


@query(
    "a16_compress",
    f"""WITH {IFACE} SELECT row_number() OVER (ORDER BY partner_domain, cols) - 1 AS group_index, 'g' || (row_number() OVER (ORDER BY partner_domain, cols) - 1) AS group_id, partner_domain,
    array_to_string(cols, ',') AS columns, count(*) AS member_count, min(interface_row_key) AS row_key FROM iface WHERE len(cols) > 0 GROUP BY partner_domain, cols""",
)
def a16_compress(spark, sf):
    out = compress.groups(compress.entries(iface(spark, sf)))
    return out.select("group_index", "group_id", "partner_domain", joined("columns").alias("columns"), "member_count", "row_key")


@query(
    "j5_group_members",
    f"""WITH {IFACE}, g AS (SELECT partner_domain, cols, row_number() OVER (ORDER BY partner_domain, cols) - 1 AS group_index FROM iface WHERE len(cols) > 0 GROUP BY partner_domain, cols)
    SELECT group_index, partner_domain, interface_row_key AS row_key FROM iface JOIN g USING (partner_domain, cols)""",
)
def j5_group_members(spark, sf):
    return compress.materialised(compress.entries(iface(spark, sf)))[1]


def _brand_groups(spark, sf):
    return compress.materialised(compress.entries(brands(spark, sf)))


PAIRS = f"""{BRANDS}, pairs AS (
        SELECT a.group_index AS i, b.group_index AS j, len(list_intersect(a.cols, b.cols)) AS n, len(a.cols) AS na, len(b.cols) AS nb
        FROM groups a JOIN groups b ON a.group_index < b.group_index
    ), d AS (SELECT i, j, 1.0 - n / CAST(na + nb - n AS DOUBLE) AS jaccard, 1.0 - n / CAST(least(na, nb) AS DOUBLE) AS overlap, 1.0 - 2 * n / CAST(na + nb AS DOUBLE) AS dice FROM pairs)"""


@query("j1_pair_distances", f"WITH {PAIRS} SELECT i, j, round(jaccard, 9) AS jaccard, round(overlap, 9) AS overlap, round(dice, 9) AS dice FROM d")
def j1_pair_distances(spark, sf):
    out = distance.all_pairs(_brand_groups(spark, sf)[0], ["jaccard", "overlap", "dice"])
    return out.select("i", "j", *[F.round(m, 9).alias(m) for m in ("jaccard", "overlap", "dice")])


@query("j1_near_pairs", f"WITH {PAIRS} SELECT i, j, round(jaccard, 9) AS distance FROM d WHERE jaccard <= 0.6")
def j1_near_pairs(spark, sf):
    return distance.near_pairs(_brand_groups(spark, sf)[0], "jaccard", 0.6).withColumn("distance", F.round("distance", 9))


@query("d6_quantised", f"WITH {PAIRS} SELECT i * ((SELECT count(*) FROM groups)) - i * (i + 1) // 2 + j - i - 1 AS place, CAST(round_even(greatest(0, least(1, overlap)) * 65535, 0) AS INTEGER) AS q FROM d")
def d6_quantised(spark, sf):
    g = _brand_groups(spark, sf)[0]
    n = g.agg(F.count("*").alias("n"))
    out = distance.all_pairs(g, ["overlap"]).crossJoin(F.broadcast(n))
    return out.select(distance.condensed_index(F.col("i"), F.col("j"), F.col("n")).alias("place"), distance.quantised(F.col("overlap")).alias("q"))


@query(
    "d8_expanded_distances",
    f"""WITH {BRANDS}, e AS (SELECT partner_domain, cols, row_number() OVER (ORDER BY partner_domain, row_key) - 1 AS entry FROM brands)
    SELECT a.entry AS i, b.entry AS j, round(1.0 - len(list_intersect(a.cols, b.cols)) / CAST(len(a.cols) + len(b.cols) - len(list_intersect(a.cols, b.cols)) AS DOUBLE), 9) AS distance
    FROM e a JOIN e b ON a.entry < b.entry""",
)
def d8_expanded_distances(spark, sf):
    g, members = _brand_groups(spark, sf)
    pairs = distance.all_pairs(g, ["jaccard"]).withColumnRenamed("jaccard", "distance")
    entries = tables.numbered(members, ["partner_domain", "row_key"], "entry")
    return distance.expanded(pairs, entries).withColumn("distance", F.round("distance", 9))


@query("d9_indicator", f"WITH {BRANDS} SELECT group_index, unnest(cols) AS col FROM groups")
def d9_indicator(spark, sf):
    return distance.indicator(_brand_groups(spark, sf)[0])


@query(
    "c4_single_linkage",
    f"""WITH RECURSIVE {PAIRS}, e AS (SELECT i AS a, j AS b FROM d WHERE jaccard <= 0.5 UNION ALL SELECT j, i FROM d WHERE jaccard <= 0.5),
    r AS (SELECT group_index AS a, group_index AS root FROM groups UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b)
    SELECT a AS group_index, min(root) AS component FROM r GROUP BY 1""",
)
def c4_single_linkage(spark, sf):
    return cluster.single_linkage_components(_brand_groups(spark, sf)[0], "jaccard", 0.5)


def _clustered(spark, sf, **settings):
    g, members = _brand_groups(spark, sf)
    return cluster.hierarchical(g, members, ClusteringSettings.of({"distance": "jaccard", "hierarchical_min_cluster_size": "1", **settings}))


@query(
    "c6_single_linkage_points",
    f"""WITH RECURSIVE {PAIRS}, e AS (SELECT i AS a, j AS b FROM d WHERE jaccard <= 0.5 UNION ALL SELECT j, i FROM d WHERE jaccard <= 0.5),
    r AS (SELECT group_index AS a, group_index AS root FROM groups UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b),
    l AS (SELECT a AS group_index, min(root) AS root FROM r GROUP BY 1), m AS (SELECT row_key, partner_domain, root FROM brands JOIN groups USING (partner_domain, cols) JOIN l USING (group_index))
    SELECT m2.row_key, m2.partner_domain, CAST(k.rank AS INTEGER) AS cluster_label FROM (SELECT b.row_key, b.partner_domain, l.root FROM brands b JOIN groups g ON g.partner_domain = b.partner_domain AND g.cols = b.cols JOIN l ON l.group_index = g.group_index) m2
    JOIN (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS rank FROM (SELECT b.row_key, l.root FROM brands b JOIN groups g ON g.partner_domain = b.partner_domain AND g.cols = b.cols JOIN l ON l.group_index = g.group_index) GROUP BY root) k USING (root)""",
)
def c6_single_linkage_points(spark, sf):
    return _clustered(spark, sf, linkage="single", distance_threshold="0.5")


@query(
    "a17_ranked_labels",
    """WITH k AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS rank FROM embeddings WHERE label > 2 GROUP BY 1)
    SELECT vec_id, CAST(coalesce(rank, -1) AS INTEGER) AS cluster_label FROM embeddings LEFT JOIN k USING (label)""",
)
def a17_ranked_labels(spark, sf):
    label = F.when(F.col("label") > 2, F.col("label")).otherwise(-1).alias("cluster_label")
    return cluster.rank_labels(table(spark, sf, "embeddings").select("vec_id", label))


@query("a18_clustering_counts", "SELECT count(*) AS sample_count, count(DISTINCT label) FILTER (label > 2) AS cluster_count, count(*) FILTER (label <= 2) AS noise_count FROM embeddings")
def a18_clustering_counts(spark, sf):
    return cluster.payload(table(spark, sf, "embeddings").select(F.when(F.col("label") > 2, F.col("label")).otherwise(-1).alias("cluster_label")))


# ---- cluster contents


def _points(spark, sf):
    base = iface(spark, sf)
    return base.select(F.col("interface_row_key").alias("row_key"), "partner_domain", "cluster_label"), base


@query(
    "a20_column_chart",
    f"""WITH {IFACE}, s AS (SELECT cluster_label, count(*) AS size FROM iface GROUP BY 1), c AS (SELECT cluster_label, unnest(cols) AS col FROM iface)
    SELECT cluster_label, col, count(*) AS count, size, round(count(*) / size, 9) AS relative FROM c JOIN s USING (cluster_label) WHERE col < 10 GROUP BY cluster_label, col, size""",
)
def a20_column_chart(spark, sf):
    return compare.column_chart(*_points(spark, sf), 10).withColumn("relative", F.round("relative", 9))


@query(
    "x18_dense_chart",
    f"""WITH {IFACE}, s AS (SELECT cluster_label, count(*) AS size FROM iface GROUP BY 1), c AS (SELECT cluster_label, unnest(cols) AS col FROM iface), n AS (SELECT cluster_label, col, count(*) AS n FROM c GROUP BY ALL)
    SELECT s.cluster_label, CAST(i AS INTEGER) AS col, coalesce(n, 0) AS count, size, round(coalesce(n, 0) / size, 9) AS relative FROM s CROSS JOIN range(0, 20) AS r(i) LEFT JOIN n ON n.cluster_label = s.cluster_label AND n.col = i""",
)
def x18_dense_chart(spark, sf):
    return compare.dense_chart(compare.column_chart(*_points(spark, sf), 20), 20).withColumn("relative", F.round("relative", 9))


@query("x19_merged_counts", f"WITH {IFACE} SELECT partner_domain, CAST(count(*) + count(*) FILTER (cluster_label = 1) AS BIGINT) AS row_count FROM iface GROUP BY 1")
def x19_merged_counts(spark, sf):
    base = iface(spark, sf)
    return compare.merged_counts([stats.partner_counts(base), stats.partner_counts(base.filter("cluster_label = 1"))])


@query(
    "j13_lens_residues",
    f"""WITH {IFACE}, sizes AS (SELECT cluster_label, count(*) AS member_count FROM iface WHERE cluster_label >= 0 GROUP BY 1),
    cc AS (SELECT cluster_label, col, count(*) AS column_count FROM (SELECT cluster_label, unnest(cols) AS col FROM iface WHERE cluster_label >= 0) GROUP BY ALL),
    s AS (SELECT *, column_count / member_count AS support FROM cc JOIN sizes USING (cluster_label) WHERE column_count / member_count >= 0.04),
    d AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY support DESC, column_count DESC, cluster_label) AS k FROM s)
    SELECT CAST(event_id AS INTEGER) AS residue_id, d.col, d.cluster_label, round(d.support, 9) AS support FROM events JOIN d ON d.col = event_id % 40 AND k = 1""",
)
def j13_lens_residues(spark, sf):
    points, base = _points(spark, sf)
    dominant = compare.dominant_clusters(compare.column_counts(points, base), compare.summaries(points))
    cells = table(spark, sf, "events").selectExpr("cast(event_id % 40 as int) AS col", "cast(event_id as int) AS residue_id")
    return compare.lens_residues(cells, dominant).select("residue_id", "col", "cluster_label", F.round("support", 9).alias("support"))


@query("k8_nearest_signal", f"WITH {IFACE} SELECT CAST(arg_min(col, (abs(col - 7), col)) AS INTEGER) AS col FROM (SELECT DISTINCT unnest(cols) AS col FROM iface)")
def k8_nearest_signal(spark, sf):
    return compare.nearest_signal(compare.column_chart(*_points(spark, sf), 40), 7)


@query(
    "a20_stack_maximum",
    f"""WITH {IFACE}, s AS (SELECT cluster_label, count(*) AS size FROM iface GROUP BY 1), c AS (SELECT cluster_label, unnest(cols) AS col FROM iface),
    r AS (SELECT col, count(*) / max(size) AS rel FROM c JOIN s USING (cluster_label) GROUP BY cluster_label, col)
    SELECT round(max(t), 6) AS max_stack_value FROM (SELECT sum(rel) AS t FROM r GROUP BY col)""",
)
def a20_stack_maximum(spark, sf):
    return compare.stack_maximum(compare.column_chart(*_points(spark, sf), 12)).withColumn("max_stack_value", F.round("max_stack_value", 6))


@query("a22_cluster_sizes", f"WITH {IFACE} SELECT cluster_label, count(*) AS member_count FROM iface WHERE cluster_label >= 0 GROUP BY 1")
def a22_cluster_sizes(spark, sf):
    return compare.summaries(_points(spark, sf)[0])


@query(
    "a23_partner_shares",
    f"""WITH {IFACE}, t AS (SELECT partner_domain, count(*) AS total FROM iface GROUP BY 1)
    SELECT cluster_label, partner_domain, count(*) AS count, total, CAST(greatest(1, floor(count(*) * 100.0 / total + 0.5)) AS BIGINT) AS percent FROM iface JOIN t USING (partner_domain) WHERE cluster_label >= 0 GROUP BY cluster_label, partner_domain, total""",
)
def a23_partner_shares(spark, sf):
    return compare.partner_shares(_points(spark, sf)[0])


COLUMN_COUNTS = f"""{IFACE}, sizes AS (SELECT cluster_label, count(*) AS member_count FROM iface WHERE cluster_label >= 0 GROUP BY 1),
    cc AS (SELECT cluster_label, col, count(*) AS column_count FROM (SELECT cluster_label, unnest(cols) AS col FROM iface WHERE cluster_label >= 0) GROUP BY ALL)"""


@query("a22_column_counts", f"WITH {COLUMN_COUNTS} SELECT * FROM cc")
def a22_column_counts(spark, sf):
    return compare.column_counts(*_points(spark, sf))


@query(
    "a24_compare_shares",
    f"""WITH {IFACE}, c AS (SELECT cluster_label, count(*) AS compare_member_count FROM iface WHERE cluster_label >= 0 AND partner_domain = '5-LOW' GROUP BY 1)
    SELECT cluster_label, compare_member_count, CAST(sum(compare_member_count) OVER () AS BIGINT) AS total_member_count, round(compare_member_count / sum(compare_member_count) OVER (), 9) AS coverage_fraction FROM c""",
)
def a24_compare_shares(spark, sf):
    return compare.compare_shares(_points(spark, sf)[0], "5-LOW").withColumn("coverage_fraction", F.round("coverage_fraction", 9))


@query(
    "a29_dominant_clusters",
    f"""WITH {COLUMN_COUNTS}, s AS (SELECT *, column_count / member_count AS support FROM cc JOIN sizes USING (cluster_label) WHERE column_count / member_count >= 0.04),
    r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY support DESC, column_count DESC, cluster_label) AS k FROM s)
    SELECT col, cluster_label, column_count, member_count, round(support, 9) AS support FROM r WHERE k = 1""",
)
def a29_dominant_clusters(spark, sf):
    points, base = _points(spark, sf)
    return compare.dominant_clusters(compare.column_counts(points, base), compare.summaries(points)).withColumn("support", F.round("support", 9))


@query("a30_supported_columns", f"WITH {COLUMN_COUNTS} SELECT cluster_label, col, column_count, member_count, round(column_count / member_count, 9) AS support FROM cc JOIN sizes USING (cluster_label) WHERE column_count / member_count >= 0.2")
def a30_supported_columns(spark, sf):
    points, base = _points(spark, sf)
    return compare.supported_columns(compare.column_counts(points, base), compare.summaries(points), 0.2).withColumn("support", F.round("support", 9))


@query("j14_members_with_column", f"WITH {IFACE} SELECT DISTINCT interface_row_key AS row_key, partner_domain FROM iface WHERE cluster_label = 1 AND list_contains(cols, 3)")
def j14_members_with_column(spark, sf):
    return compare.members_with_column(*_points(spark, sf), 1, 3)


EVENT_POINTS = "SELECT CAST(user_id AS VARCHAR) AS row_key, event_type AS partner_domain, CAST(event_id % 7 - 1 AS INTEGER) AS cluster_label FROM events"


def _event_points(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("row_key"), F.col("event_type").alias("partner_domain"), F.expr("cast(event_id % 7 - 1 as int)").alias("cluster_label"))


@query(
    "a15_row_clusters",
    f"""WITH p AS ({EVENT_POINTS}), c AS (SELECT row_key, partner_domain, cluster_label, count(*) AS n FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY row_key, partner_domain ORDER BY n DESC, cluster_label < 0, cluster_label) AS k FROM c),
    m AS (SELECT row_key, partner_domain, string_agg(CAST(cluster_label AS VARCHAR), ',' ORDER BY cluster_label) AS memberships FROM c GROUP BY ALL)
    SELECT row_key, partner_domain, cluster_label, memberships FROM r JOIN m USING (row_key, partner_domain) WHERE k = 1""",
)
def a15_row_clusters(spark, sf):
    return compare.row_clusters(_event_points(spark, sf)).withColumn("memberships", joined("memberships"))


@query(
    "a14_majority_labels",
    """WITH c AS (SELECT user_id AS group_index, CAST(event_id % 7 - 1 AS INTEGER) AS l, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY group_index ORDER BY n DESC, l) AS k FROM c)
    SELECT group_index, l AS cluster_label FROM r WHERE k = 1""",
)
def a14_majority_labels(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("group_index"), F.col("event_id").cast("string").alias("row_key"), F.col("event_type").alias("partner_domain"), F.expr("cast(event_id % 7 - 1 as int)").alias("cluster_label"))
    return embed.with_majority(e.drop("cluster_label"), e.select("row_key", "partner_domain", "cluster_label"))


@query("x20_partner_labels", f"SELECT DISTINCT cluster_label FROM ({EVENT_POINTS}) WHERE partner_domain = 'error' AND cluster_label >= 0")
def x20_partner_labels(spark, sf):
    return compare.labels_of_partner(_event_points(spark, sf), "error")


# ---- representatives

CELLS = f"""{IFACE}, cells AS (
        SELECT partner_domain, interface_row_key || '@@' || partner_domain AS key, len(cols) AS n_columns, CAST(i AS INTEGER) AS col,
               CASE WHEN regexp_matches(substr(upper(aligned_seq), i + 1, 1), '[A-Z]') THEN ascii(substr(upper(aligned_seq), i + 1, 1)) - 65 ELSE 26 END AS code
        FROM iface, range(0, 32) AS r(i) WHERE len(cols) > 0
    )"""


@query(
    "r2_balanced",
    f"""WITH {CELLS}, c AS (SELECT partner_domain, col, code, count(*) AS n FROM cells GROUP BY ALL), best AS (SELECT partner_domain, col, arg_max(code, (n, -code)) AS best FROM c GROUP BY ALL),
    s AS (SELECT partner_domain, key, n_columns, count(*) FILTER (code = best) AS matches, count(*) FILTER (code = best AND best = 26) AS gap_matches, count(*) FILTER (code < 26) AS coverage FROM cells JOIN best USING (partner_domain, col) GROUP BY ALL),
    m AS (SELECT *, median(coverage) OVER (PARTITION BY partner_domain) AS med, count(*) OVER (PARTITION BY partner_domain) AS candidate_count FROM s),
    k AS (SELECT *, matches / 32 AS mf, abs(coverage - med) AS cd, matches / 32 - 0.05 * (abs(coverage - med) / 32) AS score FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY partner_domain ORDER BY score DESC, mf DESC, cd, n_columns DESC, key) AS rk FROM k)
    SELECT partner_domain, key, candidate_count, round(score, 9) AS score, matches, gap_matches, coverage FROM r WHERE rk = 1""",
)
def r2_balanced(spark, sf):
    out = represent.balanced(iface(spark, sf), ["partner_domain"])
    return out.select("partner_domain", "key", "candidate_count", F.round("score", 9).alias("score"), "matches", "gap_matches", "coverage")


@query(
    "r3_residue_consensus",
    f"""WITH {CELLS}, c AS (SELECT partner_domain, col, code, count(*) AS n FROM cells WHERE code < 26 GROUP BY ALL), best AS (SELECT partner_domain, col, arg_max(code, (n, -code)) AS best FROM c GROUP BY ALL),
    s AS (SELECT partner_domain, key, count(*) FILTER (code = best) AS matches, count(*) FILTER (best IS NOT NULL AND code < 26) AS coverage FROM cells LEFT JOIN best USING (partner_domain, col) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY partner_domain ORDER BY matches DESC, coverage DESC, key) AS rk FROM s)
    SELECT partner_domain, key, matches, coverage, (SELECT count(*) FROM best b WHERE b.partner_domain = r.partner_domain) AS consensus_columns FROM r WHERE rk = 1""",
)
def r3_residue_consensus(spark, sf):
    return represent.residue_consensus(iface(spark, sf), ["partner_domain"]).select("partner_domain", "key", "matches", "coverage", "consensus_columns")


# ---- overlays


@query(
    "a25_column_stats",
    f"""WITH {OVL}, i AS (SELECT partner_domain, row_key, col FROM ovl WHERE kind = 'interface' UNION ALL SELECT DISTINCT '__all__', row_key, col FROM ovl WHERE kind = 'interface'),
    n AS (SELECT partner_domain, count(DISTINCT row_key) AS denominator FROM i GROUP BY 1) SELECT partner_domain, col, count(*) AS count, denominator FROM i JOIN n USING (partner_domain) GROUP BY ALL""",
)
def a25_column_stats(spark, sf):
    return overlay.column_stats(ovl(spark, sf))


@query(
    "a27_column_states",
    f"""WITH {IFACE}, x AS (SELECT interface_row_key, partner_domain, CAST(i AS INTEGER) AS col, CASE WHEN NOT regexp_matches(substr(aligned_seq, i + 1, 1), '[A-Za-z]') THEN 'gap'
    WHEN list_contains(cols, CAST(i AS INTEGER)) THEN 'interface' WHEN list_contains(surf, CAST(i AS INTEGER)) THEN 'surface' ELSE 'core' END AS state FROM iface, range(0, 32) AS r(i))
    SELECT col, state, count(*) AS count, CAST(floor(count(*) / (SELECT count(*) FROM iface) * 100 + 0.5) AS BIGINT) AS percent FROM x GROUP BY ALL""",
)
def a27_column_states(spark, sf):
    base = iface(spark, sf)
    return overlay.state_distribution(overlay.row_states(base), base)


@query(
    "a28_partner_distribution",
    f"""WITH {OVL}, i AS (SELECT partner_domain, row_key, col FROM ovl WHERE kind = 'interface'), n AS (SELECT partner_domain, count(DISTINCT row_key) AS denominator FROM i GROUP BY 1),
    f AS (SELECT col, partner_domain, count(*) AS count, denominator, count(*) / denominator AS fraction FROM i JOIN n USING (partner_domain) GROUP BY col, partner_domain, denominator)
    SELECT col, partner_domain, count, denominator, CAST(greatest(1, floor(fraction * 100 + 0.5)) AS BIGINT) AS percent, CAST(row_number() OVER (PARTITION BY col ORDER BY fraction DESC, count DESC, partner_domain) AS INTEGER) AS rank,
    round(fraction / sum(fraction) OVER (PARTITION BY col) * 100, 6) AS chart_percent FROM f""",
)
def a28_partner_distribution(spark, sf):
    out = overlay.partner_distribution(overlay.column_stats(ovl(spark, sf)))
    return out.select("col", "partner_domain", "count", "denominator", "percent", "rank", F.round("chart_percent", 6).alias("chart_percent"))


@query(
    "k3_top_residues",
    f"""WITH {IFACE}, x AS (SELECT CAST(i AS INTEGER) AS col, upper(substr(aligned_seq, i + 1, 1)) AS residue FROM iface, range(0, 32) AS r(i)), c AS (SELECT col, residue, count(*) AS count FROM x WHERE regexp_matches(residue, '[A-Z]') GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY count DESC, residue) AS k FROM c), s AS (SELECT *, max(CAST(residue = 'S' AND k > 5 AS INTEGER)) OVER (PARTITION BY col) AS lost FROM k),
    t AS (SELECT * FROM s WHERE k <= 5 - lost OR (residue = 'S' AND lost = 1))
    SELECT col, residue, count, CAST(floor(count / (SELECT count(*) FROM iface) * 100 + 0.5) AS BIGINT) AS percent, CAST(row_number() OVER (PARTITION BY col ORDER BY count DESC, residue) AS INTEGER) AS rank, residue = 'S' AS is_selected FROM t""",
)
def k3_top_residues(spark, sf):
    base = iface(spark, sf)
    return overlay.top_residues(sequences.cells(base, []), base, "s")


@query(
    "j9_residue_lookup",
    f"""WITH {IFACE}, x AS (SELECT interface_row_key || '@@' || partner_domain AS row_key, CAST(i AS INTEGER) AS col, substr(aligned_seq, i + 1, 1) AS letter, frag_s, frag_e FROM iface, range(0, 32) AS r(i)),
    y AS (SELECT *, frag_s - 1 + sum(CAST(regexp_matches(letter, '[A-Za-z]') AS INTEGER)) OVER (PARTITION BY row_key ORDER BY col) AS res FROM x)
    SELECT row_key, CAST(res AS INTEGER) AS residue_id, col, letter, col * 3 AS identity FROM y WHERE regexp_matches(letter, '[A-Za-z]') AND res BETWEEN frag_s AND frag_e""",
)
def j9_residue_lookup(spark, sf):
    identity = spark.range(32).select(F.col("id").cast("int").alias("col"), (F.col("id").cast("int") * 3).alias("identity"))
    return overlay.residue_lookup(sequences.alignment_rows(iface(spark, sf), 32), identity).select("row_key", "residue_id", "col", "letter", "identity")


# ---- layouts and trees


@query("e1_gram", f"WITH {IFACE}, c AS (SELECT o_orderkey, unnest(cols) AS col FROM iface) SELECT x.col AS a, y.col AS b, count(*) AS n FROM c x JOIN c y USING (o_orderkey) WHERE x.col <= y.col GROUP BY ALL")
def e1_gram(spark, sf):
    return embed.gram(iface(spark, sf).select(F.col("o_orderkey").alias("group_index"), F.explode("interface_msa_columns_a").alias("col")))


@query(
    "e3_unit_ball",
    """WITH p AS (SELECT vec_id AS group_index, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    c AS (SELECT group_index, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, z - avg(z) OVER () AS z FROM p), r AS (SELECT max(sqrt(x * x + y * y + z * z)) AS r FROM c)
    SELECT group_index, round(x / r, 6) AS x, round(y / r, 6) AS y, round(z / r, 6) AS z FROM c, r""",
)
def e3_unit_ball(spark, sf):
    at = lambda k: F.element_at("embedding", k).cast("double")
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("group_index"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))
    out = embed.normalised(p)
    return out.select("group_index", *[F.round(c, 6).alias(c) for c in "xyz"])


# ---- structures (A36, J10, J11) and sets


@query(
    "j10_contact_lines",
    """WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    c AS (SELECT DISTINCT user_id AS a, event_id % 611 AS b FROM events)
    SELECT a, b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) AS length FROM c JOIN p ON p.id = a JOIN p AS q ON q.id = b""",
)
def j10_contact_lines(spark, sf):
    at = lambda k: F.element_at("embedding", k).cast("double")
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("residue_id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))
    contacts = table(spark, sf, "events").select(F.col("user_id").alias("a"), F.expr("event_id % 611").alias("b"))
    return structure.contact_lines(contacts, p, p).select("a", "b", F.round("length", 6).alias("length"))


@query(
    "j11_chosen_predictions",
    """WITH w AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 50 AS s, o_orderkey % 50 + 9 AS e FROM orders), p AS (SELECT o_custkey AS k, o_orderkey AS ordinal, o_orderkey % 40 AS start, o_orderkey % 40 + 30 AS stop FROM orders),
    u AS (SELECT DISTINCT k, s, e FROM w), r AS (SELECT k, s, e, ordinal, row_number() OVER (PARTITION BY k, s, e ORDER BY CASE WHEN start <= s AND stop >= e THEN 0 ELSE 1 END, ordinal) AS n FROM u JOIN p USING (k))
    SELECT k, s, e, ordinal FROM r WHERE n = 1""",
)
def j11_chosen_predictions(spark, sf):
    orders = table(spark, sf, "orders")
    wanted = orders.selectExpr("o_custkey AS k", "o_orderkey % 50 AS s", "o_orderkey % 50 + 9 AS e").distinct()
    predictions = orders.selectExpr("o_custkey AS k", "o_orderkey AS ordinal", "o_orderkey % 40 AS start", "o_orderkey % 40 + 30 AS stop")
    return structures.choose_predictions(wanted, predictions, ["k"]).select("k", "s", "e", "ordinal")


@query(
    "u_set_algebra",
    f"""WITH {IFACE} SELECT interface_row_key, array_to_string(list_sort(list_distinct(list_concat(cols, surf))), ',') AS both, len(list_intersect(cols, surf)) AS common,
    array_to_string(list_sort(list_filter(cols, lambda x: NOT list_contains(surf, x))), ',') AS only_interface, list_has_all(surf, cols) AS inside FROM iface""",
)
def u_set_algebra(spark, sf):
    a, b = "interface_msa_columns_a", "surface_msa_columns_a"
    return iface(spark, sf).select(
        "interface_row_key", joined(F.array_sort(F.array_union(a, b))).alias("both"), F.size(F.array_intersect(a, b)).cast("long").alias("common"),
        joined(F.array_sort(F.array_except(a, b))).alias("only_interface"), (F.size(F.array_except(a, b)) == 0).alias("inside"),
    )


from . import display_queries, file_queries, tree_queries  # noqa: E402, F401  they register theirs
