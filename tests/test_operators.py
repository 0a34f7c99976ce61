"""Operators against hand-worked cases."""

import html
import re

import pytest
from pyspark.sql import functions as F

from seamline.functions import colour, keys, sequences, tables, text
from seamline.operators import cluster, compare, compress, dendrogram, distance, embed, overlay, represent, rows, stats, structure
from seamline.settings import ClusteringSettings, PageSettings
from seamline.sources import structures

ROW = "partner_domain string, interface_row_key string, interface_msa_columns_a array<int>"


def values(df, *cols):
    return [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]


def scalar(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([("P", "a", [1, 2, 3]), ("P", "b", [3, 2, 1, 1]), ("P", "c", [2, 3, 4]), ("P", "d", [9]), ("Q", "e", [1, 2, 3]), ("Q", "none", [])], ROW)


def test_compression(spark, golden):
    groups, members = compress.materialised(compress.entries(golden))
    got = sorted(values(groups, "group_index", "partner_domain", "columns", "member_count", "row_key"))
    assert got == [(0, "P", [1, 2, 3], 2, "a"), (1, "P", [2, 3, 4], 1, "c"), (2, "P", [9], 1, "d"), (3, "Q", [1, 2, 3], 1, "e")]
    listed = compress.with_members(groups, members).filter("group_index = 0").first()["members"]
    assert [(m["row_key"], m["partner_domain"]) for m in listed] == [("a", "P"), ("b", "P")]
    one = compress.signature(groups, members).first()[0]
    assert one == compress.signature(groups.repartition(3), members.repartition(5)).first()[0] != compress.signature(groups, members.filter("row_key <> 'b'")).first()[0]
    pairs = {(r["i"], r["j"]): r["jaccard"] for r in distance.all_pairs(groups, ["jaccard"]).collect()}
    assert pairs == {(0, 1): 0.5, (0, 2): 1.0, (0, 3): 0.0, (1, 2): 1.0, (1, 3): 0.5, (2, 3): 1.0}
    assert {(r["i"], r["j"]) for r in distance.near_pairs(groups, "jaccard", 0.5).collect()} == {(0, 1), (0, 3), (1, 3)}
    assert distance.square(distance.near_pairs(groups, "jaccard", 0.5)).count() == 6
    assert compare.signal_columns(spark_chart(groups), 2, 8).count() == 3
    with pytest.raises(ValueError):
        distance.near_pairs(groups, "jaccard", 1.0)


def spark_chart(groups):
    return groups.select(F.explode("columns").alias("col"), F.lit(1).alias("count"))


@pytest.mark.parametrize("metric", ["jaccard", "dice", "overlap"])
def test_near_pairs_are_all_pairs_within_the_threshold(spark, metric):
    import random

    r = random.Random(4)
    # Column 0 is in nearly every set: a hot key of the index. Some sets hold others, some are equal, one is empty.
    rows = [(k, sorted({0, *r.sample(range(1, 18), r.randint(1, 7))}) if k % 6 else sorted(r.sample(range(1, 18), 3))) for k in range(120)]
    rows += [(120, rows[5][1]), (121, rows[5][1][:2]), (122, [])]
    groups = spark.createDataFrame(rows, "group_index long, columns array<int>")
    for threshold in (0.0, 0.34, 0.5, 0.8):
        got = sorted(values(distance.near_pairs(groups, metric, threshold)))
        some = distance.all_pairs(groups.filter("size(columns) > 0"), [metric]).filter(F.col(metric) <= threshold)
        assert got == sorted(values(some)) and got


def test_thresholds_are_not_quantised(spark, golden):
    groups, members = compress.materialised(compress.entries(golden))
    s = ClusteringSettings.of({"distance": "jaccard", "linkage": "single", "distance_threshold": "0.5", "hierarchical_min_cluster_size": "1"})
    got = {(r["partner_domain"], r["row_key"]): r["cluster_label"] for r in cluster.hierarchical(groups, members, s).collect()}
    assert got == {("P", "a"): 0, ("P", "b"): 0, ("P", "c"): 0, ("Q", "e"): 0, ("P", "d"): 1}
    s = ClusteringSettings.of({"distance": "jaccard", "linkage": "single", "hierarchical_min_cluster_size": "2"})
    points = cluster.hierarchical(groups, members, s)
    assert {r["row_key"]: r["cluster_label"] for r in points.collect()}["d"] == -1
    assert tuple(cluster.payload(points).first()) == (5, 1, 1)
    assert cluster.matches_entries(points, compress.entries(golden)) and not cluster.matches_entries(points, compress.entries(golden.filter("interface_row_key <> 'a'")))
    by = compress.entries(golden.withColumn("set", F.col("partner_domain")), ["set"])
    g2, m2 = compress.materialised(by, ["set"])
    assert cluster.hierarchical(g2, m2, s, ["set"]).filter("set = 'Q'").count() == 1


def test_clean_identity_golden(spark):
    r = spark.createDataFrame([("P", "x_1-2_1-1", "1-2", "AC-D"), ("P", "y_1-4_1-1", "1-4", "ACXD"), ("Q", "y_1-4_1-1", "1-4", "GGGG")], "partner_domain string, interface_row_key string, fragment_key string, aligned_seq string")
    got = sorted(values(stats.clean_identity(r, length=6)))
    assert got == [(0, 100), (1, 100), (2, 50), (3, 50), (4, 0), (5, 0)]


def test_categories_edges(spark):
    one = spark.createDataFrame([("a", 5)], "family string, v int")
    assert stats.with_categories(one, ("v",)).first()["v_category"] == "normal"
    same = spark.createDataFrame([("a", 5), ("b", 5)], "family string, v int")
    assert {r["v_category"] for r in stats.with_categories(same, ("v",)).collect()} == {"normal"}
    many = spark.createDataFrame([(str(k), 10 if k else 100_000) for k in range(40)], "family string, v int")
    assert stats.with_categories(many, ("v",)).filter("family = '0'").first()["v_category"] == "very_big"


def test_paging_and_visibility(spark):
    r = spark.createDataFrame([(k, f"P{k}_1-2_3-4") for k in range(10)], "row_order int, display_row_key string").withColumn("row_key", F.col("display_row_key"))
    assert [x["row_order"] for x in rows.page(r, PageSettings(3, 4)).collect()] == [3, 4, 5, 6]
    assert [x["row_order"] for x in rows.page(r, PageSettings(8, None)).collect()] == [8, 9]
    assert tuple(rows.completeness(r, PageSettings(8, 5)).first()) == (10, 8, 5, 2, True)
    assert tuple(rows.completeness(r, PageSettings(0, 5)).first()) == (10, 0, 5, 5, False)
    assert rows.visible(r, "p3_1-2").count() == 1 and rows.visible(r, "!!").count() == 10 and rows.in_visible(r, "row_order", [], True).count() == 10 and rows.in_visible(r, "row_order", []).count() == 0
    assert rows.visible(r, "", r.filter("row_order < 4"), r.select("row_key", F.expr("row_order % 2 AS cluster_label")), [1]).count() == 2


def test_fuzzy_search_golden(spark):
    label = F.lit("P12345 | PF00069")
    got = scalar(spark, *[text.fuzzy_matches(label, q).alias(f"c{k}") for k, q in enumerate(("2345", "p1-pf69", "zz", "", "--", "PF00069"))])
    assert got == (True, True, False, True, True, True)


def test_numbering(spark):
    df = spark.range(1000).withColumn("k", F.expr("(id * 7919) % 1000"))
    assert tables.numbered(df, ["k"], "n").filter("n <> k").count() == 0


def test_keys(spark):
    got = scalar(
        spark, keys.key_part(F.lit("a_1-2_3_4"), 3).alias("a"), keys.key_part(F.lit("a"), 2).alias("b"), keys.fragment_start(F.lit(" ")).alias("c"), keys.fragment_envelope(F.lit("7-9,1-3,,5-6")).alias("d"),
        keys.expand_ranges(keys.fragment_ranges(F.lit("7-8,2-3,3-4"))).alias("e"), keys.range_labels(F.lit("1-3,,5-9")).alias("f"), keys.split_interaction_key(F.lit("r@@p@@q")).alias("g"), keys.file_family(F.lit("/x/PF01_a_b.JSON.gz")).alias("h"),
    )
    assert got == ("3_4", "", 1, "1-9", [2, 3, 4, 7, 8], ["1-3", "5-9"], ("r", "p@@q"), "PF01")
    with pytest.raises(Exception, match="start-end"):
        scalar(spark, keys.fragment_ranges(F.lit("abc")))


def test_texts(spark):
    raw = "<p>A &lt;b&gt; &amp;&#39; [[cite:X1]] c , d</p>\n\n<br/> é &nbsp;x"
    plain = re.sub(r"\s+([.,;:!?])", r"\1", html.unescape("  A &lt;b&gt; &amp;&#39;   c , d  \n\n   é &nbsp;x"))
    got = scalar(
        spark, text.strip_html(F.lit(raw)).alias("a"), text.accession(F.lit(" pf12 ")).alias("b"), text.accession(F.lit("PFX")).alias("c"), text.family_links(F.lit("[pfam: pf2] [PFAM:PF1] [pfam: PF2]")).alias("d"),
        text.duration_text(F.lit(4000.0)).alias("e"), text.bytes_text(F.lit(3 * 2**30)).alias("f"), text.bytes_text(F.lit(5)).alias("g"), text.residue_letter(F.lit("trp")).alias("h"), text.residue_letter(F.lit("zzz")).alias("i"),
        text.escape_html(F.lit("<a href='x'>&\"")).alias("j"), text.model_text(F.lit("﻿ATOM  1\r\nEND\r\n")).alias("k"), text.model_text(F.lit("ATOM only")).alias("l"), text.duration_text(F.lit(0)).alias("m"),
    )
    assert got[0] == " ".join(plain.split(" ")).replace("\n", " ") or " ".join(got[0].split()) == " ".join(plain.replace("\xa0", " ").split())
    assert got[1:] == ("PF12", "", ["PF2", "PF1"], "1.1 h", "3.0 GiB RAM", "1 MiB RAM", "W", "X", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;", "ATOM  1\nEND\n", None, "unknown time")


def test_json_counts(spark):
    v = spark.sql("""SELECT parse_json(x) AS v FROM VALUES ('true'), ('7'), ('2.0'), ('2.5'), ('"3"'), ('null'), ('[1]') AS t(x)""")
    assert [r[0] for r in v.select(text.count_value(F.col("v"))).collect()] == [1, 7, 2, None, None, None, None]


def test_colours(spark):
    got = scalar(
        spark, colour.conservation(F.lit(0)).alias("a"), colour.conservation(F.lit(250)).alias("b"), colour.rgb_of_hsl(F.lit(0.0), F.lit(1.0), F.lit(0.5)).alias("c"), colour.rgb_of_hsl(F.lit(-240.0), F.lit(1.0), F.lit(0.5)).alias("d"),
        colour.rgb_of_hsl(F.lit(210.0), F.lit(0.8), F.lit(0.58)).alias("e"), colour.tick_step(F.lit(33)).alias("f"), colour.tick_step(F.lit(900)).alias("g"), colour.tick_step(F.lit(3)).alias("h"), colour.hex_channels(F.lit("#0aFf10")).alias("i"),
        colour.palette(F.lit(-1), ["x"]).alias("j"), colour.palette(F.lit(5), ["x", "y"]).alias("k"), tables.percent(F.lit(1), F.lit(1000)).alias("l"), tables.js_round(F.lit(-2.5)).alias("m"),
    )
    assert got == ("rgb(241, 229, 191)", "rgb(47, 125, 90)", [255, 0, 0], [0, 255, 0], [62, 148, 234], 5, 200, 1, [10, 255, 16], "#8a847a", "y", 1, -2)


def test_top_residues_rescue_a_selected_letter(spark):
    seq = "".join(c * n for c, n in zip("ABCDEF", (5, 4, 3, 2, 2, 1)))
    cells = spark.createDataFrame([(0, c, True) for c in seq], "col int, ch string, is_letter boolean")
    top = lambda s=None: [r["residue"] for r in overlay.top_residues(cells, cells, s).orderBy("rank").collect()]
    assert top() == list("ABCDE") and top("f") == list("ABCDF") and top("b") == list("ABCDE") and top("z") == list("ABCDE")


def test_overlay_union_and_merge(spark):
    base = spark.createDataFrame([("P", "a", [1, 2], [3]), ("Q", "a", [2, 5], [1]), ("Q", "b", [], [4])], "partner_domain string, interface_row_key string, interface_msa_columns_a array<int>, surface_msa_columns_a array<int>")
    got = {(r["partner_domain"], r["col"]): (r["count"], r["denominator"]) for r in overlay.column_stats(overlay.marks(base)).collect()}
    assert got == {("P", 1): (1, 1), ("P", 2): (1, 1), ("Q", 2): (1, 1), ("Q", 5): (1, 1), ("__all__", 1): (1, 1), ("__all__", 2): (1, 1), ("__all__", 5): (1, 1)}
    page = base.withColumn("interface_msa_columns_a", F.array(F.lit(99))).unionByName(base.limit(1).withColumn("interface_row_key", F.lit("new")))
    out = overlay.merged(base, page)
    assert out.count() == 4 and out.filter("array_contains(interface_msa_columns_a, 99)").count() == 0
    assert overlay.merged(out, page).exceptAll(out).isEmpty()
    assert [tuple(r) for r in overlay.row_sets(base).orderBy("row_key").collect()] == [("a", [1, 2, 5], [1, 3]), ("b", [], [4])]


def test_cell_states_precedence(spark):
    cells = spark.createDataFrame([("a", "P", 0, False), ("a", "P", 1, True), ("a", "P", 2, True), ("a", "P", 3, True)], "row_key string, partner_domain string, col int, is_letter boolean")
    marks = spark.createDataFrame([("a", "P", c, k) for c, k in ((0, "interface"), (1, "interface"), (1, "surface"), (2, "surface"))], "row_key string, partner_domain string, col int, kind string")
    assert {r["col"]: r["state"] for r in overlay.cell_states(cells, marks).collect()} == {0: "gap", 1: "interface", 2: "surface", 3: "core"}


def test_row_states_of_short_and_null_rows(spark):
    rows_ = spark.createDataFrame([("A-C", [0, 1], [2]), ("a", [], [0]), (None, None, None)], "aligned_seq string, interface_msa_columns_a array<int>, surface_msa_columns_a array<int>")
    got = {(r["col"], r["state"]): (r["count"], r["percent"]) for r in overlay.state_distribution(overlay.row_states(rows_), rows_).collect()}
    assert got == {(0, "interface"): (1, 33), (0, "surface"): (1, 33), (0, "gap"): (1, 33), (1, "gap"): (3, 100), (2, "surface"): (1, 33), (2, "gap"): (2, 67)}


def test_residue_styles(spark):
    look = spark.createDataFrame([("k", 5, 0, "A", 80), ("k", 6, 4, "B", None), ("k", 7, 5, "C", 300)], "row_key string, residue_id int, col int, letter string, identity int")
    got = [(r["intensity"], r["colour"]) for r in overlay.residue_styles(look, "conservedness").orderBy("col").collect()]
    assert got == [(0.8, "rgb(66, 128, 98)"), (0.0, "rgb(143, 138, 130)"), (1.0, "rgb(47, 125, 90)")]
    assert {(r["intensity"], r["label"]) for r in overlay.residue_styles(look, "column").collect()} == {(1.0, "0"), (1.0, "4"), (1.0, "5")}
    used = spark.createDataFrame([(4, 3, 4), (0, 0, 0)], "col int, count long, denominator long")
    assert [r["intensity"] for r in overlay.residue_styles(look, "interface", used).orderBy("col").collect()] == [0.0, 0.75, 0.0]
    first = spark.createDataFrame([(4, "P", 0.5, 1), (4, "Q", 0.2, 2)], "col int, partner_domain string, fraction double, rank int")
    assert [(r["intensity"], r["label"]) for r in overlay.residue_styles(look, "partners", first).orderBy("col").collect()] == [(0.0, None), (0.5, "P"), (0.0, None)]
    some = overlay.residue_styles(look, "cluster", spark.createDataFrame([(4, 2, 0.25)], "col int, cluster_label int, support double"))
    assert [(r["residue_id"], r["intensity"], r["label"]) for r in some.collect()] == [(6, 0.25, "2")]
    with pytest.raises(ValueError):
        overlay.residue_styles(look, "other")


def test_representatives(spark):
    schema = "partner_domain string, interface_row_key string, aligned_seq string, interface_msa_columns_a array<int>"
    c = spark.createDataFrame([("P", "a", "ACD-", [1]), ("P", "b", "acde", [1, 2]), ("P", "c", "AGD-", [1]), ("P", "no", "WWWW", []), ("Q", "é", "éAC", [3])], schema)
    assert represent.balanced(c.filter("partner_domain = 'P'")).first()["key"] == "a@@P"
    assert represent.residue_consensus(c.filter("partner_domain = 'P'")).first()["key"] == "b@@P"
    assert represent.select(c, "balanced", ["partner_domain"]).filter("partner_domain = 'Q'").first()["matches"] == 3
    assert represent.residue_consensus(c.filter("interface_row_key = 'no'")).first()["key"] is None
    with pytest.raises(ValueError):
        represent.select(c, "other")


def test_compare_helpers(spark):
    points = spark.createDataFrame([("a", "P", 0), ("b", "P", 0), ("c", "Q", 1), ("d", "Q", -1), ("gone", "P", 0)], "row_key string, partner_domain string, cluster_label int")
    base = spark.createDataFrame([("P", "a", [1, 2]), ("P", "b", [2, 7]), ("Q", "c", [2, 2]), ("Q", "d", [1])], ROW)
    chart = {(r["cluster_label"], r["col"]): (r["count"], r["size"]) for r in compare.column_chart(points, base, 5).collect()}
    assert chart == {(0, 1): (1, 3), (0, 2): (2, 3), (1, 2): (2, 1), (-1, 1): (1, 1)}
    assert {(r["cluster_label"], r["col"]): r["column_count"] for r in compare.column_counts(points, base).collect()}[(1, 2)] == 1
    assert compare.nearest_signal(compare.column_chart(points, base, 9), 5).first()["col"] == 7 and [r["cluster_label"] for r in compare.top_clusters(points).collect()] == [0, 1]
    order = spark.createDataFrame([(k,) for k in range(4)], "pos int")
    assert [r["pos"] for r in compare.preload_order(order, 2).collect()] == [2, 3, 0, 1]
    dominant = compare.dominant_clusters(compare.column_counts(points, base), compare.summaries(points))
    row = spark.createDataFrame([(2, 55), (2, None), (3, 56)], "col int, residue_id int")
    assert values(compare.lens_residues(row, dominant), "residue_id", "cluster_label") == [(55, 1)]
    assert values(compare.row_clusters(points.unionByName(points.filter("row_key = 'a'").withColumn("cluster_label", F.lit(-1)))).filter("row_key = 'a'"), "cluster_label") == [(0,)]


def test_layout_helpers(spark):
    p = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 3), (1, 1.00001, 0.0, 0.0, 1), (2, 0.0, 0.0, 1.0, 1)], "group_index long, x double, y double, z double, member_count long")
    j = {r["group_index"]: (r["dx"], r["dy"]) for r in embed.jittered(p).collect()}
    assert j[2] == (0.0, 0.0) and j[0][0] == pytest.approx(-j[1][0]) and j[0][0] > 2.8
    turned = embed.projected(p, 3.141592653589793 / 2, 0.0).orderBy("group_index").collect()
    assert turned[0]["px"] == pytest.approx(0, abs=1e-9) and turned[2]["px"] == pytest.approx(1)
    g = spark.createDataFrame([(k, s) for k, s in enumerate(([1, 2], [2, 3], [3, 9], [1, 9], [2]))], "group_index long, columns array<int>")
    made, share = embed.pca_at_scale(g)
    from seamline.operators.kernels import pca

    coords, want = pca(embed.indicator_matrix([[1, 2], [2, 3], [3, 9], [1, 9], [2]]))
    assert share == pytest.approx(want)
    got = sorted(values(made))
    assert [abs(v) for r in got for v in r[1:]] == pytest.approx([abs(v) for r in coords for v in r], abs=1e-9)


def test_tree_rollup(spark):
    merges = spark.createDataFrame([(0, 0, 1), (1, 2, 3)], "merge_index int, left int, right int")
    counts = spark.createDataFrame([(0, 0, "P", 2), (1, 1, "P", 1), (2, 0, "Q", 4)], "group_index long, cluster_label int, partner_domain string, n long")
    got = {(r["node"], r["cluster_label"]): r["n"] for r in dendrogram.rollup(merges, counts, 3).collect()}
    assert got == {(0, 0): 2, (1, 1): 1, (2, 0): 4, (3, 0): 2, (3, 1): 1, (4, 0): 6, (4, 1): 1}
    mode = {r["node"]: (r["cluster_label"], r["share"]) for r in dendrogram.visible_mode(dendrogram.rollup(merges, counts, 3), [1]).collect()}
    assert mode == {1: (1, 1.0), 3: (1, 1.0), 4: (1, 1.0)} and dendrogram.cutoff_at(0.25, 0.8) == pytest.approx(0.6)


def test_structures(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3.0, 4.0, 0.0)], "residue_id int, x double, y double, z double")
    contacts = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "a int, b int")
    lines = structure.contact_lines(contacts, a, a)
    assert values(lines, "a", "b", "length") == [(1, 2, 5.0)]
    atom = structure.contact_pdb(lines).first()["lines"]
    assert len(atom) == 3 and atom[1][30:38].strip() == "3.000" and atom[2] == "CONECT    1    2"
    wanted = spark.createDataFrame([("u", 5, 9), ("u", 90, 95)], "k string, s int, e int")
    predictions = spark.createDataFrame([("u", 0, 50, 60), ("u", 1, 1, 20)], "k string, ordinal int, start int, stop int")
    assert sorted(values(structures.choose_predictions(wanted, predictions, ["k"]), "s", "ordinal")) == [(5, 1), (90, 0)]

@pytest.mark.parametrize("lens", ["interface", "partners", "cluster"])
def test_styles_do_not_shuffle_residues(spark, monkeypatch, lens):
    """Values have a row a column: sent to the residues, whatever their estimated size is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    look = spark.range(50).selectExpr("concat('r', id) AS row_key", "cast(id AS int) AS residue_id", "cast(id % 5 AS int) AS col")
    values = spark.range(3).selectExpr("cast(id AS int) AS col", "1L AS rank", "'p' AS partner_domain", "0.5 AS fraction", "1L AS count", "2L AS denominator", "0.25 AS support", "7 AS cluster_label")
    made = overlay.residue_styles(look, lens, values)
    plan = made._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert made.count() == (30 if lens == "cluster" else 50)


def test_marks_shuffle_a_key_once(spark):
    rows = spark.createDataFrame([("r", "p", [1, 2, 2], [5]), ("r", "p", [2, 3], None), ("r", "q", [], [5]), ("s", "p", None, [])], "interface_row_key string, partner_domain string, interface_msa_columns_a array<int>, surface_msa_columns_a array<int>")
    made = overlay.marks(rows)
    assert sorted(map(tuple, made.collect())) == [("r", "p", 1, "interface"), ("r", "p", 2, "interface"), ("r", "p", 3, "interface"), ("r", "p", 5, "surface"), ("r", "q", 5, "surface")]
    plan = made._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not any("col#" in d for d in dealt)


def test_masking_takes_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    texts, fragments = ["AC-D" * k for k in range(40)] + [None, "", "A" * 999], [f"3-{5 + k},{9 + k}-90" for k in range(43)]
    whole = sequences.masked.func(pa.array(texts, pa.string()), pa.array(fragments, pa.string()))
    most, points = [], sequences._code_points
    monkeypatch.setattr(sequences, "COUNTED", 100, raising=False)
    monkeypatch.setattr(sequences, "_code_points", lambda t: most.append(sum(len(x or "") for x in t) if len(t) > 1 else 0) or points(t))
    assert sequences.masked.func(pa.array(texts, pa.string()), pa.array(fragments, pa.string())).equals(whole)
    assert len(most) > 10 and max(most) <= 100
