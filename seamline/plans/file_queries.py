"""Queries over files: each writes its files to the shared folder first, from the supplied tables, and then reads them as a user would."""

from __future__ import annotations

import gzip
import io
import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from .. import api
from ..functions import tables, text
from ..operators import cluster, compress, distance, overlay, stats
from ..settings import ClusteringSettings, EmbeddingSettings, FilterSettings, PageSettings, cleaned_preferences, flag, to_query
from ..sources import hierarchies, interfaces, structures
from ..sources.store import Store, run_summaries
from ..streaming import sync
from .adapters import BRANDS, IFACE, brands, iface, table
from .registry import joined, query
from .tree_queries import JACCARD


def _folder(spark, name: str) -> str:
    return f"{tables.run_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- interface files (S1-S9, A21): brands by their number modulo 5, one file gzipped

#: The rows of the files, in SQL: one per part type (partner) and brand.
FILES = """f AS (
        SELECT 'F' || (CAST(substr(p_brand, 7) AS INTEGER) % 5) AS family, p_type AS partner_domain, 'B' || substr(p_brand, 7) || '_2-7,9-9_1-' || substr(p_brand, 7) AS interface_row_key, substr(p_brand, 7) AS number,
               CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 THEN '' ELSE 'AC-DEFGHIKL' END AS aligned_seq, list_sort(list_distinct(list(CAST(p_size % 31 AS INTEGER)))) AS cols
        FROM part GROUP BY p_brand, p_type
    )"""


def _documents(spark, sf) -> dict[str, dict]:
    """The files' documents by family. Brands are 150 rows at most, so they are gathered."""
    found: dict[str, dict] = {}
    for partner, brand, columns in brands(spark, sf).collect():
        key, number = f"B{brand[6:]}_2-7,9-9_1-{brand[6:]}", int(brand[6:])
        payload = {"aligned_seq": "" if number % 2 == 0 else "AC-DEFGHIKL", "interface_msa_columns_a": [*reversed(columns), columns[0], "x"], "interface_residues_a": columns, "interface_residues_b": [str(c) for c in columns]}
        found.setdefault(f"F{number % 5}", {}).setdefault(partner, {})[key] = payload
    return found


def _written_files(spark, documents: dict[str, dict], folder: str) -> str:
    for family, doc in documents.items():
        data = json.dumps(doc | {"not a partner": 7}).encode()
        tables.put(spark, f"{folder}/{family}_parts.json" + ".gz" * (family == "F2"), gzip.compress(data) if family == "F2" else data)
    tables.put(spark, f"{folder}/broken.json", b"[1, 2]")
    tables.put(spark, f"{folder}/notes.txt", b"nothing")
    return folder


def _files(spark, sf) -> str:
    return _written_files(spark, _documents(spark, sf), _folder(spark, "files"))


NAME = "family || '_parts.json' || CASE WHEN family = 'F2' THEN '.gz' ELSE '' END"


@query("s1_scanned_files", f"WITH {FILES} SELECT DISTINCT {NAME} AS name, family || '_parts' AS stem, family, true AS sized FROM f UNION ALL SELECT 'broken.json', 'broken', 'broken', true")
def s1_scanned_files(spark, sf):
    return interfaces.scan(spark, _files(spark, sf)).select("name", "stem", "family", (F.col("size_bytes") > 0).alias("sized"))


@query(
    "s2_rows_of_files",
    f"""WITH {FILES} SELECT row_number() OVER (ORDER BY partner_domain, interface_row_key) - 1 AS row_order, family, partner_domain, interface_row_key, split_part(interface_row_key, '_', 1) AS protein_id, '2-7,9-9' AS fragment_key,
    '1-' || number AS partner_fragment_key, CAST(len(cols) AS INTEGER) AS interface_size_a, CAST(len(cols) AS INTEGER) AS interface_size_b, array_to_string(cols, ',') AS columns FROM f""",
)
def s2_rows_of_files(spark, sf):
    folder = _files(spark, sf)
    paths = [r["path"] for r in interfaces.scan(spark, folder).filter("name <> 'broken.json'").select("path").collect()]
    out = interfaces.load(spark, paths)
    return out.select("row_order", "family", "partner_domain", "interface_row_key", "protein_id", "fragment_key", "partner_fragment_key", "interface_size_a", "interface_size_b", joined("interface_msa_columns_a").alias("columns"))


def _twice_synced(spark, sf):
    """(store, folder): F1 shrinks to its first partner after the first import."""
    folder, store = _files(spark, sf), Store(spark, _folder(spark, "store"))
    store.sync(folder)
    doc = _documents(spark, sf)["F1"]
    _written_files(spark, {"F1": {min(doc): doc[min(doc)]}}, folder)
    return store, folder


@query("s5_changed_files", "SELECT 'F1_parts.json' AS name UNION ALL SELECT 'broken.json'")
def s5_changed_files(spark, sf):
    store, folder = _twice_synced(spark, sf)
    return store.changed(folder).select("name")


@query(
    "s6_replaced_rows",
    f"""WITH {FILES}, kept AS (SELECT * FROM f WHERE family <> 'F1' OR partner_domain = (SELECT min(partner_domain) FROM f WHERE family = 'F1'))
    SELECT {NAME} AS name, row_number() OVER (PARTITION BY family ORDER BY partner_domain, interface_row_key) - 1 AS row_order, partner_domain, interface_row_key, array_to_string(cols, ',') AS columns FROM kept""",
)
def s6_replaced_rows(spark, sf):
    store, folder = _twice_synced(spark, sf)
    store.sync(folder)
    names = store.sources().select("source_id", "name")
    return store.rows().join(names, "source_id").select("name", "row_order", "partner_domain", "interface_row_key", joined("interface_msa_columns_a").alias("columns"))


@query(
    "s7_import_log",
    f"""WITH {FILES} SELECT {NAME} AS name, 'ready' AS status, count(*) AS row_count, CAST(max(greatest(length(aligned_seq), list_max(cols) + 1)) AS INTEGER) AS alignment_length, CAST(NULL AS VARCHAR) AS error FROM f GROUP BY family
    UNION ALL SELECT 'broken.json', 'failed', NULL, NULL, 'not a JSON object with distinct keys'""",
)
def s7_import_log(spark, sf):
    store = Store(spark, _folder(spark, "store"))
    folder = _files(spark, sf)
    store.sync(folder)
    store.sync(folder)  # failed files are tried again, which leaves one latest entry
    return store.sources().select("name", "status", "row_count", F.col("alignment_length").cast("int").alias("alignment_length"), "error")


@query("s8_streamed_rows", f"WITH {FILES} SELECT family, partner_domain, interface_row_key, array_to_string(cols, ',') AS columns FROM f")
def s8_streamed_rows(spark, sf):
    folder, out = _files(spark, sf), _folder(spark, "stream")
    for _ in range(2):  # the second run finds nothing new
        sync.start_sync(spark, folder, f"{out}/rows", f"{out}/errors", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("family", "partner_domain", "interface_row_key", joined("interface_msa_columns_a").alias("columns"))


@query("a21_alignment_length", f"WITH {FILES} SELECT family, CAST(max(greatest(length(aligned_seq), list_max(cols) + 1)) AS INTEGER) AS alignment_length, count(*) AS n FROM f WHERE aligned_seq = '' GROUP BY 1")
def a21_alignment_length(spark, sf):
    folder = _files(spark, sf)
    paths = [r["path"] for r in interfaces.scan(spark, folder).filter("name <> 'broken.json'").select("path").collect()]
    return interfaces.alignment_length(interfaces.load(spark, paths).filter("aligned_seq = ''"), ["family"])


# ---- results and precomputed hierarchies


@query("s10_distance_cache", f"WITH {BRANDS} SELECT a.group_index AS i, b.group_index AS j, round({JACCARD}, 9) AS distance FROM groups a JOIN groups b ON a.group_index < b.group_index")
def s10_distance_cache(spark, sf):
    store = Store(spark, _folder(spark, "store"))
    groups, members = compress.materialised(compress.entries(brands(spark, sf)))
    distance.stored(store, groups, members, "jaccard")
    return distance.stored(store, groups, members, "jaccard").withColumn("distance", F.round("distance", 9))


def _precomputed(spark, store, family: str, folder: str, settings: ClusteringSettings, drop: int = 0) -> None:
    """Hierarchy files of a family, with the groups as leaves in reverse order; ``drop`` leaves are missing from the resolver."""
    source = store.sources().filter(F.col("family") == family).first()["source_id"]
    groups, members = compress.materialised(compress.entries(store.rows().filter(F.col("source_id") == source)))
    merges = cluster.hierarchy(groups, settings.distance, settings.linkage).orderBy("merge_index").toPandas()
    n = len(merges) + 1
    children = merges[["left", "right"]].to_numpy()
    children = np.where(children < n, n - 1 - children, children)
    data = io.BytesIO()
    np.savez(data, children=children, distance=merges["distance"].to_numpy(), count=merges["count"].to_numpy(), metric=settings.distance, linkage=settings.linkage)
    listed = {r["group_index"]: r for r in compress.with_members(groups, members).collect()}
    leaves = [{"leaf_id": n - 1 - g, "interface_msa_columns_a": list(listed[g]["columns"]), "interfaces": [{"partner_domain": m["partner_domain"], "row_key": m["row_key"]} for m in listed[g]["members"]]} for g in range(n - drop)]
    linkage, resolver = hierarchies.paths(folder, settings.distance, settings.linkage, family)
    tables.put(spark, linkage, data.getvalue())
    tables.put(spark, resolver, json.dumps({"leaves": leaves}).encode())


SINGLE = {"file": "F1_parts.json", "distance": "jaccard", "linkage": "single", "distance_threshold": "0.6", "hierarchical_min_cluster_size": "1", "min_interface_size": "0"}


def _synced(spark, sf):
    store = Store(spark, _folder(spark, "store"))
    store.sync(_files(spark, sf))
    return store


#: Single-linkage components of one file at 0.6; ``order`` places clusters of equal size.
SINGLE_SQL = f"""{FILES}, groups AS (SELECT partner_domain, cols, count(*) AS member_count, row_number() OVER (ORDER BY partner_domain, cols) - 1 AS group_index FROM f WHERE family = 'F1' GROUP BY partner_domain, cols),
    e AS (SELECT a.group_index AS a, b.group_index AS b FROM groups a JOIN groups b ON a.group_index <> b.group_index AND {JACCARD} <= 0.6),
    r AS (SELECT group_index AS a, group_index AS root FROM groups UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b),
    l AS (SELECT a AS group_index, min(root) AS root FROM r GROUP BY 1), m AS (SELECT interface_row_key AS row_key, f.partner_domain, root, group_index FROM f JOIN groups g ON g.partner_domain = f.partner_domain AND g.cols = f.cols JOIN l USING (group_index) WHERE family = 'F1')"""


@query(
    "c9_precomputed_points",
    f"""WITH RECURSIVE {SINGLE_SQL}, k AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, max(group_index) DESC) - 1 AS rank FROM m GROUP BY 1)
    SELECT row_key, partner_domain, CAST(rank AS INTEGER) AS cluster_label FROM m JOIN k USING (root)""",
)
def c9_precomputed_points(spark, sf):
    """Leaves in reverse order: the same clusters as from the local hierarchy, those of equal size named in the leaves' order."""
    store, folder = _synced(spark, sf), _folder(spark, "hierarchies")
    _precomputed(spark, store, "F1", folder, ClusteringSettings.of(SINGLE))
    return api.clustering_points(store, SINGLE, folder)


@query(
    "c10_local_points",
    f"""WITH RECURSIVE {SINGLE_SQL}, k AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, min(group_index)) - 1 AS rank FROM m GROUP BY 1)
    SELECT row_key, partner_domain, CAST(rank AS INTEGER) AS cluster_label FROM m JOIN k USING (root)""",
)
def c10_local_points(spark, sf):
    """A resolver that lacks leaves is refused, and the local hierarchy takes its place."""
    store, folder = _synced(spark, sf), _folder(spark, "hierarchies")
    _precomputed(spark, store, "F1", folder, ClusteringSettings.of(SINGLE), drop=1)
    return api.clustering_points(store, SINGLE, folder)


@query(
    "c11_hierarchy_status",
    """SELECT * FROM (VALUES (1, 'local', true, 'unavailable'), (2, 'local', true, 'unavailable'), (3, 'local', true, 'mismatch'), (4, 'local_cache', false, 'mismatch'), (5, 'precalculated', false, NULL)) AS t(step, source, local_calculation_required, precomputed_state)""",
)
def c11_hierarchy_status(spark, sf):
    """Without a folder; with an empty one; with files that do not fit; once a local hierarchy is cached; with files that fit."""
    store, folder = _synced(spark, sf), _folder(spark, "hierarchies")
    settings, steps = ClusteringSettings.of(SINGLE), []
    ask = lambda f: steps.append(json.loads(api.hierarchy_status(store, SINGLE, f).first()["json"]))
    ask(None)
    ask(folder)
    _precomputed(spark, store, "F1", folder, settings, drop=1)
    ask(folder)
    api.clustering_points(store, SINGLE, folder)
    ask(folder)
    _precomputed(spark, store, "F1", folder, settings)
    ask(folder)
    rows = [(k + 1, s["source"], s["local_calculation_required"], s.get("precomputed_state")) for k, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, source string, local_calculation_required boolean, precomputed_state string")


@query("c13_signatures", "SELECT * FROM (VALUES ('same rows in another order', true), ('one member less', false), ('other columns', false)) AS t(what, same)")
def c13_signatures(spark, sf):
    entries = tables.written(compress.entries(brands(spark, sf)), "entries")
    key = entries.agg(F.min("row_key")).first()[0]
    told = lambda e: compress.signature(*compress.materialised(e)).first()["signature"]
    own = told(entries)
    changed = F.when(F.col("row_key") == key, F.array_append("columns", F.lit(99))).otherwise(F.col("columns"))
    others = {"same rows in another order": entries.orderBy(F.desc("row_key")), "one member less": entries.filter(F.col("row_key") != key), "other columns": entries.withColumn("columns", changed)}
    return spark.createDataFrame([(what, told(e) == own) for what, e in others.items()], "what string, same boolean")


@query("j15_same_entries", "SELECT * FROM (VALUES ('all', true), ('one less', false), ('another label', true)) AS t(what, same)")
def j15_same_entries(spark, sf):
    entries = tables.written(compress.entries(brands(spark, sf)), "entries")
    points = entries.select("row_key", "partner_domain", F.lit(0).alias("cluster_label"))
    key = entries.agg(F.min("row_key")).first()[0]
    others = {"all": points, "one less": points.filter(F.col("row_key") != key), "another label": points.withColumn("cluster_label", F.lit(4))}
    return spark.createDataFrame([(what, cluster.matches_entries(p, entries)) for what, p in others.items()], "what string, same boolean")


@query("s15_cached_results", "SELECT * FROM (VALUES ('first', 1, false), ('again', 1, false), ('other settings', 2, false), ('missing', 2, true)) AS t(what, made, stale)")
def s15_cached_results(spark, sf):
    store, made, seen = Store(spark, _folder(spark, "store")), [], []

    def make():
        made.append(1)
        return table(spark, sf, "region")

    for what, size in (("first", 5), ("again", 5), ("other settings", 6)):
        store.result("regions", make, size=size).count()
        seen.append((what, len(made), store.is_stale("regions", 1, size=size)))
    seen.append(("missing", len(made), store.is_stale("regions", 1, size=7)))
    return spark.createDataFrame(seen, "what string, made int, stale boolean")


RUNS = """runs AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'jaccard' ELSE 'dice' END AS metric, CASE WHEN n_nationkey % 3 = 0 THEN 'single' ELSE 'average' END AS linkage,
        CASE WHEN n_nationkey % 5 = 4 THEN 'failed' ELSE 'ok' END AS status, 20 + 30 * n_nationkey AS leaf_count, 1.5 * n_nationkey + 1 AS total_seconds, n_name AS pfam_id FROM nation)"""


def _runs(spark, sf) -> str:
    """A summary file for each metric and linkage, whose own columns do not name them."""
    folder, files = _folder(spark, "runs"), {}
    for r in sorted(table(spark, sf, "nation").collect()):
        k = r["n_nationkey"]
        where = f"{'dice' if k % 2 else 'jaccard'}/{'average' if k % 3 else 'single'}/summary.csv"
        files.setdefault(where, ["status,leaf_count,total_seconds,pfam_id"]).append(f"{'failed' if k % 5 == 4 else 'ok'},{20 + 30 * k},{1.5 * k + 1},{r['n_name']}")
    for where, lines in files.items():
        tables.put(spark, f"{folder}/{where}", "\n".join(lines).encode())
    return folder


@query("s16_run_summaries", f"WITH {RUNS} SELECT metric, linkage, status, CAST(leaf_count AS DOUBLE) AS leaf_count, CAST(total_seconds AS DOUBLE) AS total_seconds, CAST(NULL AS DOUBLE) AS peak_rss_delta_bytes, pfam_id FROM runs")
def s16_run_summaries(spark, sf):
    return run_summaries(spark, _runs(spark, sf)).select("metric", "linkage", "status", "leaf_count", "total_seconds", "peak_rss_delta_bytes", "pfam_id")


@query(
    "c12_cost_estimate",
    f"""WITH {RUNS}, ok AS (SELECT *, row_number() OVER (ORDER BY CAST(linkage <> 'average' AS INTEGER), CAST(metric <> 'dice' AS INTEGER), abs(ln(1 + leaf_count) - ln(1 + 333)), leaf_count) AS r FROM runs WHERE status = 'ok')
    SELECT pfam_id, metric, linkage, CAST(leaf_count AS BIGINT) AS basis_leaf_count, round(55278.0 / (leaf_count * (leaf_count - 1) / 2), 9) AS scale, round(total_seconds * 55278.0 / (leaf_count * (leaf_count - 1) / 2), 9) AS estimated_total_seconds FROM ok WHERE r = 1""",
)
def c12_cost_estimate(spark, sf):
    out = cluster.cost_estimate(run_summaries(spark, _runs(spark, sf)), "dice", "average", 333)
    return out.select("pfam_id", "metric", "linkage", "basis_leaf_count", F.round("scale", 9).alias("scale"), F.round("estimated_total_seconds", 9).alias("estimated_total_seconds"))


# ---- structure files (S19, S20, X13): one file a label, a residue a vector

CODES = "GLY ALA SER TRP XYZ SEC".split()


def _structures(spark, sf) -> str:
    """Fixed-column files, written by tasks. Each has a second CA line of its first residue, a CB line and a line that does not parse; those of label 3
    have no END. Residue numbers are below 9999, so a label has a file for every 9999 vector numbers."""
    folder = _folder(spark, "structures")
    at = [F.floor(F.element_at("embedding", k).cast("double") * 1000) / 1000 for k in (1, 2, 3)]
    line = "ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C"
    code = F.element_at(F.array(*map(F.lit, CODES)), F.expr("cast(vec_id % 6 + 1 as int)"))
    number = F.expr("cast(vec_id % 9999 as int)")
    rows = table(spark, sf, "embeddings").select("label", F.expr("vec_id div 9999").alias("part"), F.struct("vec_id", F.format_string(line, number, code, number, *at).alias("line")).alias("row"))
    lines = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"])
    first = F.col("lines")[0]
    again = [F.concat(F.substring(first, 1, 30), F.lit("   9.000   9.000   9.000"), F.substring(first, 55, 80)), F.replace(first, F.lit(" CA "), F.lit(" CB ")), F.lit("ATOM      1  CA  GLY A   x")]
    end = F.when(F.col("label") != 3, F.array(F.lit("END"))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(F.lit("HEADER")), "lines", F.array(*again), end), "\n")
    rows.groupBy("label", "part").agg(lines.alias("lines")).select("label", "part", text.alias("value")).write.partitionBy("label", "part").text(folder)
    return folder


def _model(path="path"):
    return F.regexp_extract(path, r"label=(\d+)/", 1).cast("int")


@query(
    "s19_ca_coordinates",
    """SELECT label, CAST(vec_id % 9999 AS INTEGER) AS residue_id, ['G', 'A', 'S', 'W', 'X', 'U'][CAST(vec_id % 6 + 1 AS INTEGER)] AS residue,
    floor(CAST(embedding[1] AS DOUBLE) * 1000) / 1000 AS x, floor(CAST(embedding[2] AS DOUBLE) * 1000) / 1000 AS y, floor(CAST(embedding[3] AS DOUBLE) * 1000) / 1000 AS z FROM embeddings""",
)
def s19_ca_coordinates(spark, sf):
    out = structures.ca_coordinates(structures.read_pdb(spark, _structures(spark, sf)))
    return out.select(_model().alias("label"), "residue_id", "residue", "x", "y", "z")


@query("s20_usable_models", "SELECT DISTINCT label, label <> 3 AS usable FROM embeddings")
def s20_usable_models(spark, sf):
    out = structures.usable_models(structures.read_pdb(spark, _structures(spark, sf)))
    return out.select(_model().alias("label"), "usable").distinct()


# ---- documents and settings


@query(
    "x11_family_entries",
    """SELECT 'PF' || n_nationkey AS pfam_id, n_name AS display_name, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE '' END AS short_name, 'About ' || n_name || ' & more.' || chr(10) || chr(10) || 'End' AS description,
    CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'CL' || n_regionkey END AS set_accession, CAST(n_nationkey * 7 AS BIGINT) AS proteins, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE CAST(n_nationkey AS BIGINT) END AS taxa FROM nation""",
)
def x11_family_entries(spark, sf):
    folder = _folder(spark, "entries")
    for r in table(spark, sf, "nation").collect():
        k, name = r["n_nationkey"], r["n_name"]
        meta = {"accession": f" pf{k} ", "name": {"name": name, "short": f"n{k}"} if k % 2 == 0 else name, "description": [{"text": f"<p>About  <b>{name}</b> &amp; more [[cite:PUB1]] .</p>"}, {"text": ""}, {"text": "End"}]}
        meta |= {"set_info": {"accession": f"CL{r['n_regionkey']}"} if k % 3 else None, "counters": {"proteins": k * 7, "taxa": "many" if k % 4 == 1 else float(k)}}
        tables.put(spark, f"{folder}/{k}.json", json.dumps({"metadata": meta}).encode())
    out = api.family_info(spark, f"{folder}/*.json")
    return out.select("pfam_id", "display_name", "short_name", "description", F.col("set_info.accession").alias("set_accession"), F.col("stats.proteins").alias("proteins"), F.col("stats.taxa").alias("taxa"))


@query("s17_family_names", "SELECT 'PF' || n_nationkey AS family, n_name AS display_name FROM nation")
def s17_family_names(spark, sf):
    """List pages of nine entries; every fifth family is on an earlier page too, under a name that the later one replaces."""
    folder, rows = _folder(spark, "pages"), sorted(table(spark, sf, "nation").collect())
    entry = lambda k, name: {"metadata": {"accession": f" PF{k} ", "name": name}}
    entries = [entry(r["n_nationkey"], "old") for r in rows if r["n_nationkey"] % 5 == 0] + [entry(r["n_nationkey"], f" {r['n_name']}  ") for r in rows]
    for k in range(0, len(entries), 9):
        tables.put(spark, f"{folder}/page-{k:04d}.json", json.dumps({"results": [*entries[k : k + 9], {"metadata": {"name": "x"}}, 7], "next": None}).encode())
    return api.family_names(spark, f"{folder}/*.json")


@query(
    "s17_chosen_predictions",
    """WITH p AS (SELECT n_regionkey AS r, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ordinal, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey * 3 END AS start, n_nationkey * 3 + 40 AS stop FROM nation),
    w AS (SELECT DISTINCT n_regionkey AS r, s, s + 9 AS e FROM nation, range(0, 90, 7) AS t(s)), c AS (SELECT w.*, p.*, row_number() OVER (PARTITION BY w.r, s ORDER BY CASE WHEN start <= s AND stop >= e THEN 0 ELSE 1 END, ordinal) AS n FROM w JOIN p ON p.r = w.r)
    SELECT 'A' || c.r AS accession, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, 'E' || k AS entry, CASE WHEN k % 3 = 0 THEN 'http://x.example/' || k || '.cif' ELSE 'http://x.example/' || k || '.pdb' END AS url FROM c WHERE n = 1""",
)
def s17_chosen_predictions(spark, sf):
    folder, documents = _folder(spark, "predictions"), {}
    for r in sorted(table(spark, sf, "nation").collect()):
        k = r["n_nationkey"]
        item = {"uniprotStart": "none" if k % 4 == 0 else k * 3, "uniprotEnd": str(k * 3 + 40) if k % 2 else k * 3 + 40, "entryId": f"E{k}", "cifUrl": f"http://x.example/{k}.cif"}
        documents.setdefault(r["n_regionkey"], []).append(item | ({} if k % 3 == 0 else {"pdbUrl": f"http://x.example/{k}.pdb"}))
    for region, items in documents.items():
        tables.put(spark, f"{folder}/A{region}.json", json.dumps(items).encode())
    predictions = structures.read_predictions(spark, f"{folder}/*.json")
    wanted = predictions.select("accession").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(84), F.lit(7)))).withColumn("e", F.col("s") + 9)
    return structures.choose_predictions(wanted, predictions, ["accession"]).select("accession", "s", "e", "entry", "url")


@query("x10_named_references", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '4' WHEN 3 THEN NULL ELSE 'A' || s_nationkey END AS accession, CASE s_suppkey % 4 WHEN 3 THEN NULL WHEN 1 THEN s_name ELSE '' END AS name FROM supplier")
def x10_named_references(spark, sf):
    doc = F.expr("parse_json(CASE s_suppkey % 4 WHEN 0 THEN '{\"r\": {\"accession\": 4}}' WHEN 3 THEN '{\"r\": {\"accession\": \" \"}}' WHEN 1 THEN concat('{\"r\": {\"accession\": \" A', s_nationkey, '\", \"name\": \"', s_name, ' \"}}') ELSE concat('{\"r\": {\"accession\": \"A', s_nationkey, '\"}}') END)")
    made = table(spark, sf, "supplier").withColumn("d", doc).select("s_suppkey", text.named_reference(F.col("d"), "$.r").alias("r"))
    return made.select("s_suppkey", F.col("r.accession").alias("accession"), F.col("r.name").alias("name"))


@query("s21_json_rows", "SELECT '{\"service\":\"x\",\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"missing\":null}' AS json FROM nation")
def s21_json_rows(spark, sf):
    return api.to_json(table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit(None).cast("int").alias("missing")), service="x")


@query(
    "c8_settings",
    """SELECT * FROM (VALUES ('default', 'hierarchical average overlap distance_threshold None 0.5 10'), ('count', 'hierarchical average overlap n_clusters 8 None 10'), ('lifetime', 'hierarchical single dice persistence None None 10'),
    ('density', 'hdbscan average overlap distance_threshold None 0.5 10'), ('both', 'refused'), ('no count', 'refused'), ('blank threshold', 'refused'), ('unknown linkage', 'refused'), ('zero', 'refused'), ('layout', 'tsne jaccard None 100.0 0.5 42'),
    ('layout again', 'tsne jaccard None 100.0 0.5 42'), ('theta', 'refused'), ('filter', '7'), ('filter default', '5'), ('filter below 0', 'refused'), ('page', '3 None'), ('page of nothing', 'refused'), ('flags', 'True False True False'), ('saved', '9 average')) AS t(what, told)""",
)
def c8_settings(spark, sf):
    """What settings come to, case by case: F4, F18, F19, E6, C8."""
    from urllib.parse import parse_qs

    def clustering(**q):
        s = ClusteringSettings.of(q)
        return f"{s.method} {s.linkage} {s.distance} {s.hierarchical_target} {s.n_clusters} {s.distance_threshold} {s.hierarchical_min_cluster_size}"

    def layout(q):
        s = EmbeddingSettings.of(q)
        return f"{s.method} {s.distance} {s.perplexity} {s.learning_rate} {s.theta} {s.random_state}"

    asked = {"embedding_method": "TSNE", "distance": "jaccard", "perplexity": "auto", "learning_rate": "100"}
    flags = {"a": " Yes", "b": "2", "d": ""}
    saved = '{"filter": {"min_interface_size": 9}, "clustering": {"linkage": "no"}}'

    def kept():
        got = cleaned_preferences(saved, {"filter": FilterSettings, "clustering": ClusteringSettings})
        return f"{got['filter']['min_interface_size']} {got['clustering']['linkage']}"

    cases = {
        "default": lambda: clustering(), "count": lambda: clustering(n_clusters=["8"]), "lifetime": lambda: clustering(hierarchical_target="lifetime", n_clusters="3", linkage="Single", distance="dice"),
        "density": lambda: clustering(method="hdbscan"), "both": lambda: clustering(n_clusters="3", distance_threshold="0.1"), "no count": lambda: clustering(hierarchical_target="clusters"),
        "blank threshold": lambda: clustering(distance_threshold=""), "unknown linkage": lambda: clustering(linkage="ward"), "zero": lambda: clustering(n_clusters="0"), "layout": lambda: layout(asked),
        "layout again": lambda: layout(parse_qs(to_query(EmbeddingSettings.of(asked)))), "theta": lambda: layout({"theta": "2"}), "filter": lambda: str(FilterSettings.of({"min_interface_size": "7"}).min_interface_size),
        "filter default": lambda: str(FilterSettings.of({"min_interface_size": ""}).min_interface_size), "filter below 0": lambda: str(FilterSettings.of({"min_interface_size": "-1"})),
        "page": lambda: "{0.offset} {0.limit}".format(PageSettings.of({"row_offset": "3"})), "page of nothing": lambda: str(PageSettings.of({"row_limit": "0"})),
        "flags": lambda: " ".join(str(flag(flags, k, d)) for k, d in (("a", False), ("b", True), ("c", True), ("d", False))), "saved": kept,
    }

    def told(case):
        try:
            return case()
        except ValueError:
            return "refused"

    return spark.createDataFrame([(what, told(case)) for what, case in cases.items()], "what string, told string")


@query("x17_dataset_options", f"WITH {IFACE}, n AS (SELECT family, count(DISTINCT interface_row_key) AS interface_rows FROM iface GROUP BY 1) SELECT DISTINCT family, path AS name, interface_rows FROM iface JOIN n USING (family)")
def x17_dataset_options(spark, sf):
    base = iface(spark, sf)
    files = base.select("family", F.col("path").alias("name"))
    return stats.dataset_options(files, stats.selector_stats(base)).select("family", "name", "interface_rows")


@query(
    "a26_merged_overlays",
    f"""WITH {IFACE} SELECT interface_row_key AS row_key, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN o_orderkey % 3 = 0 THEN cols ELSE surf END)))), ',') AS interface FROM iface WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 GROUP BY 1""",
)
def a26_merged_overlays(spark, sf):
    """Pages overlap: rows seen first keep their columns, whatever a later page says."""
    base = iface(spark, sf)
    cols = ["interface_row_key", "partner_domain", "interface_msa_columns_a", "surface_msa_columns_a"]
    seen = base.filter("o_orderkey % 3 = 0").select(*cols)
    page = base.filter("o_orderkey % 2 = 0").withColumn("interface_msa_columns_a", F.col("surface_msa_columns_a")).select(*cols)
    return overlay.row_sets(overlay.merged(overlay.merged(seen, page), page)).select("row_key", joined("interface").alias("interface"))
