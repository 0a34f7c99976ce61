"""Every query against DuckDB."""

import os

import pytest
from oracle import connect, same

from seamline.plans.queries import ORACLE_SQL, QUERIES

import __spark_entry__


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLE_SQL[name])


def test_every_query_has_its_sql_but_one_that_the_kernel_checks():
    assert set(QUERIES) - set(ORACLE_SQL) == {"c7_density_spread"} and not set(ORACLE_SQL) - set(QUERIES)


def test_spread_density_equals_the_kernel(spark, sf):
    from seamline.operators import cluster, compress
    from seamline.plans.tree_queries import DENSITY, density_entries
    from seamline.settings import ClusteringSettings

    want = cluster.density(*compress.materialised(density_entries(spark, sf)), ClusteringSettings.of(DENSITY)).collect()
    made = {(r.row_key, r.partner_domain): r.cluster_label for r in QUERIES["c7_density_spread"](spark, sf).collect()}
    pairs = {(made[r.row_key, r.partner_domain], r.cluster_label) for r in want}
    assert len(made) == len(want) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 2
    assert all((a == -1) == (b == -1) for a, b in pairs)


def with_table(sf, folder, name, sql):
    """The tables of ``sf`` with ``name`` made by SQL, in ``folder``."""
    for t in os.listdir(sf):
        if t != f"{name}.parquet":
            os.symlink(f"{sf}/{t}", folder / t)
    connect(sf).execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
    return str(folder)


def test_picks_of_clusters_that_are_picked_whole_equal_the_sql(spark, sf, tmp_path):
    """All brands of a type have the same sizes but those of one type: 16 groups, of which one cluster has six."""
    size = "CASE WHEN i // 25 % 6 = 0 AND i // 150 > least(i % 25, 10) THEN 0 ELSE i // 150 END"
    at = with_table(sf, tmp_path, "part", f"SELECT i AS p_partkey, 'B' || i % 25 AS p_brand, 'T' || i // 25 % 6 AS p_type, CAST({size} AS INTEGER) AS p_size FROM range(4650) AS r(i)")
    made = QUERIES["c14_diverse_picks"](spark, at)
    same(made, connect(at), ORACLE_SQL["c14_diverse_picks"])


def test_structures_of_more_vectors_than_residue_numbers_equal_the_sql(spark, sf, tmp_path):
    at = with_table(sf, tmp_path, "embeddings", "SELECT vec_id + r * 9999 AS vec_id, * EXCLUDE (vec_id) FROM embeddings, range(3) AS t(r)")
    for name in ("s19_ca_coordinates", "s20_usable_models"):
        same(QUERIES[name](spark, at), connect(at), ORACLE_SQL[name])


def test_pages_with_broken_off_entities_equal_the_sql(spark, sf, tmp_path):
    broken = "[html, '<h1>a&amp</h1>', 'a&am<b>b</b>&amp;quot; & &&amp;&amp&quot;', '&amp;amp; x&lt'][1 + page_id % 4]"
    at = with_table(sf, tmp_path, "pages", f"SELECT page_id, {broken} AS html FROM pages")
    same(QUERIES["x7_plain_pages"](spark, at), connect(at), ORACLE_SQL["x7_plain_pages"])


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
