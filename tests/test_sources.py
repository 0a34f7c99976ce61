"""Files, stores, streams and requests, from JSON to results."""

import gzip
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline import api
from seamline.functions import sequences
from seamline.operators import cluster, compress, distance
from seamline.settings import ClusteringSettings, EmbeddingSettings, FilterSettings, PageSettings, cleaned_preferences, flag, to_query
from seamline.sources import hierarchies, interfaces, structures
from seamline.sources.store import Store, run_summaries
from seamline.streaming import sync


def payload(columns, n=6, seq="ACD-EFGHIK", **more):
    return {"aligned_seq": seq, "interface_msa_columns_a": columns, "surface_msa_columns_a": [8, 9], "interface_residues_a": list(range(n)), "interface_residues_b": list(range(n)), **more}


DOCUMENT = {
    "PX": {"P1_5-9_20-30": payload([1, 2, 3]), "P2_1-20_7-9": payload([3, 2, 1, 1]), "P3_1-8_2-4": payload([2, 3, 4], seq="ACDXEFGHIK"), "P4_1-9_1-3": payload([9], n=3), "bad": None},
    "PY": {"P1_5-9_20-30": payload([1, 2, 3], fragments_b=[[3, 5], [8, 8], [1]], residue_contacts=[[1, 4], [1, 4], [2, "x"], [3]]), "odd": 7},
    "none": [],
}


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    (d / "PF00001_a.json").write_text(json.dumps(DOCUMENT))
    with gzip.open(d / "PF00002_b.JSON.gz".replace("JSON", "json"), "wt") as f:
        json.dump({"PZ": {f"Q{k}_1-30_5-6": payload([k % 3, k % 4, k % 5 + 3]) for k in range(25)}}, f)
    (d / "broken.json").write_text("[1, 2]")
    (d / "notes.txt").write_text("x")
    return str(d)


def test_scan_and_names(spark, folder):
    got = {r["name"]: (r["stem"], r["family"]) for r in interfaces.scan(spark, folder).collect()}
    assert got == {"PF00001_a.json": ("PF00001_a", "PF00001"), "PF00002_b.json.gz": ("PF00002_b", "PF00002"), "broken.json": ("broken", "broken")}
    assert interfaces.scan(spark, folder + "/missing").count() == 0


def test_rows_of_a_document(spark, folder):
    got = interfaces.load(spark, folder + "/PF00001_a.json").orderBy("row_order").collect()
    assert [(r["partner_domain"], r["interface_row_key"]) for r in got] == [("PX", "P1_5-9_20-30"), ("PX", "P2_1-20_7-9"), ("PX", "P3_1-8_2-4"), ("PX", "P4_1-9_1-3"), ("PY", "P1_5-9_20-30")]
    assert [r["row_order"] for r in got] == [0, 1, 2, 3, 4] and got[1]["interface_msa_columns_a"] == [1, 2, 3]
    assert [tuple(c) for c in got[4]["residue_contacts"]] == [(1, 4), (1, 4)] and [tuple(f) for f in got[4]["fragments_b"]] == [(3, 5), (8, 8)]
    assert got[3]["interface_size_a"] == 3 and got[0]["partner_fragment_key"] == "20-30" and got[0]["family"] == "PF00001"


def test_lenient_values_and_errors(spark):
    doc = {"P": {"a_1-2_3_4": {"aligned_seq": 5, "interface_msa_columns_a": ["7", 2.7, "x", True, None, [1]], "interface_msa_columns_b": [1, 2], "interface_residues_a": []}, "b": {}}}
    docs = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.parse_json("t").alias("doc"), F.lit(1).alias("k"))
    a, b = interfaces.interface_rows(interfaces.flatten(docs, ["k"]), ["k"]).orderBy("interface_row_key").collect()
    assert a["aligned_seq"] == "" and a["interface_msa_columns_a"] == [1, 2, 7] and a["partner_fragment_key"] == "3_4"
    assert (a["interface_size_a"], a["interface_size_b"], b["interface_size_a"]) == (0, 2, 0)
    with pytest.raises(Exception, match="JSON object"):
        interfaces.flatten(spark.sql("SELECT parse_json('[1]') AS doc, 1 AS k"), ["k"]).collect()
    with pytest.raises(Exception, match="(?i)duplicate"):
        spark.sql("""SELECT parse_json('{"a": 1, "a": 2}')""").collect()


def test_numbered_rows_are_parsed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    docs = spark.range(0, 400, 1, 4).select(F.create_map(F.concat(F.lit("P"), (F.col("id") % 3).cast("string")), F.create_map(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit(1))).alias("m"))
    rows = docs.select(F.explode("m").alias("partner_domain", "r")).select("partner_domain", F.explode("r").alias("key", "v")).select("partner_domain", F.udf(seen, "string")("key").alias("interface_row_key"))
    out = interfaces.numbered_rows(rows)
    got = [(r.partner_domain, r.interface_row_key) for r in out.orderBy("row_order").collect()]
    assert got == sorted(got) and len(got) == 400 and dict(out.dtypes)["row_order"] == "bigint"
    assert calls.value == 400


def test_integers_of_a_list_of_anything(spark):
    values = [3, "12", " 7 ", "x", "", 1.7, -1.9, True, False, None, [1], {"a": 1}, 99999999999, 1e30, "1.5", 3]
    doc = {"P": {"a": {"interface_residues_a": values, "interface_residues_b": None, "interface_msa_columns_b": [2, 2, 1]}, "b": [1], "c": "x", "d": None}, "Q": [{"a": {}}], "R": "x", "S": None}
    docs = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.parse_json("t").alias("doc"), F.lit(1).alias("k"))
    (row,) = interfaces.interface_rows(interfaces.flatten(docs, ["k"]), ["k"]).collect()
    assert row["interface_residues_a"] == [-1, 0, 1, 3, 7, 12] and row["interface_residues_b"] == []
    assert (row["interface_size_a"], row["interface_size_b"]) == (6, 2)


def test_store_imports_replaces_and_caches(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.rows().count() == 0
    states = {e["name"]: e["status"] for e in store.sync(folder)}
    assert states == {"PF00001_a.json": "ready", "PF00002_b.json.gz": "ready", "broken.json": "failed"}
    assert store.rows().count() == 30
    assert [e["name"] for e in store.sync(folder)] == ["broken.json"]  # failed ones are tried again
    with open(folder + "/PF00001_a.json", "w") as f:
        json.dump({"PX": {"N_1-9_1-2": payload([1])}}, f)
    assert {e["name"] for e in store.sync(folder)} == {"PF00001_a.json", "broken.json"}
    assert store.rows().count() == 26 and store.sources().filter("status = 'ready'").count() == 2
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert store.result("x", make, size=5).count() == 3
    assert store.result("x", make, size=6).count() == 3 and len(calls) == 2
    assert not store.is_stale("x", 1, size=5) and store.is_stale("x", 1, size=7)


def test_stream_equals_batch(spark, folder, tmp_path):
    rows, errors, check = (str(tmp_path / x) for x in ("rows", "errors", "check"))
    for _ in range(2):  # the second run finds nothing new
        sync.start_sync(spark, folder, rows, errors, check).awaitTermination()
    key = ["partner_domain", "interface_row_key", "interface_msa_columns_a"]
    batch = interfaces.load(spark, [folder + "/PF00001_a.json", folder + "/PF00002_b.json.gz"]).select(*key)
    stream = spark.read.parquet(rows).select(*key)
    assert stream.count() == 30 and batch.exceptAll(stream).isEmpty()
    assert [r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(errors).collect()] == ["broken.json"]


def test_requests(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.sync(folder)
    one = lambda df: json.loads(df.first()["json"])
    q = {"file": "PF00001_a.json"}
    page = one(api.interface_page(store, q | {"row_limit": "2", "include_data": "1", "include_clean_column_identity": "true"}))
    assert page["row_count"] == 4 and page["rows_loaded"] == 2 and not page["rows_complete"] and len(page["rows"]) == 2 and len(page["data"]) == 2
    whole = one(api.interface_page(store, q | {"row_offset": "1", "row_limit": "2", "data_limit": "9"}))
    assert len(whole["data"]) == 3 and len(whole["clean_column_identity"]) == 10 and "data" not in one(api.interface_page(store, q | {"include_data": "0", "include_clean": "0"}))
    with pytest.raises(api.Gone):
        api.msa(store, q)
    assert len(page["clean_column_identity"]) == 10 and {r["row_key"] for r in page["rows"]} == {"P1_5-9_20-30@@PX", "P2_1-20_7-9@@PX"}
    assert {f["name"] for f in one(api.files(store))["files"]} == {"PF00001_a.json", "PF00002_b.json.gz"}
    c = {"file": "PF00002_b.json.gz", "hierarchical_min_cluster_size": "1", "distance": "jaccard", "distance_threshold": "0.7"}
    assert one(api.hierarchy_status(store, c))["source"] == "local"
    made = one(api.clustering(store, c))
    assert made["sample_count"] == 25 and made["noise_count"] == 0 and made["cluster_count"] >= 2
    assert one(api.hierarchy_status(store, c))["source"] == "local_cache"
    tree = one(api.dendrogram_nodes(store, c | {"merge_depth": "2"}))
    assert len(tree["edges"]) == len(tree["nodes"]) - 1 and max(n["depth"] for n in tree["nodes"]) == 2
    picks = one(api.cluster_compare(store, c | {"cluster_label": "0"}))["selected_entries"]
    assert [p["selection_rank"] for p in picks] == list(range(len(picks))) and sum(p["coverage_count"] for p in picks) == picks[0]["remaining_count"]
    for extra in ({}, {"representative_method": "residue"}, {"representative_scope": "cluster", "cluster_label": "0"}):
        assert one(api.representative(store, c | extra))["key"].endswith("@@PZ")
    assert len(one(api.embedding(store, c | {"distance": "binary"}))["points"]) > 3
    sets = one(api.structure_preview(store, q | {"row_key": "P1_5-9_20-30"}))
    assert sets["matched_partners"] == ["PX", "PY"] and sets["partner_fragment_residue_ids"] == [3, 4, 5, 8, *range(20, 31)] and len(sets["residue_contacts"]) == 1
    with pytest.raises(ValueError):
        api.interface_page(store, {"file": "missing"})
    with pytest.raises(ValueError):
        api.cluster_compare(store, c)


def test_family_info(spark, tmp_path):
    path = tmp_path / "entry.json"
    path.write_text(json.dumps({"metadata": {"accession": "pf00069", "name": {"name": "Protein  kinase", "short": "Pk"}, "description": [{"text": "<p>One &amp; two [[cite:PUB1]] .</p>"}, {"text": ""}, {"text": "Three"}], "type": "domain", "integrated": None, "set_info": {"accession": "CL1", "name": ""}, "counters": {"proteins": 12, "taxa": 3.0, "matches": "x", "structural_models": {"alphafold": 5}}}}))
    r = api.family_info(spark, str(path)).first()
    assert (r["pfam_id"], r["display_name"], r["short_name"], r["description"]) == ("PF00069", "Protein kinase", "Pk", "One & two.\n\nThree")
    assert r["set_info"]["accession"] == "CL1" and r["representative_structure"] is None and (r["stats"]["proteins"], r["stats"]["taxa"], r["stats"]["matches"], r["stats"]["alphafold_models"]) == (12, 3, None, 5)


def test_precomputed_hierarchies(spark, tmp_path):
    def npz(**a):
        out = io.BytesIO()
        np.savez(out, **a)
        return out.getvalue()

    children = np.array([[0, 1], [2, 3]])
    got = hierarchies.merges_of_npz(npz(children=children, distance=np.array([13107, 65535], np.uint16), distance_scale=65535.0, metric="jaccard", linkage="single"), "jaccard", "single")
    assert got["distance"].tolist() == pytest.approx([0.2, 1.0]) and got["right"].tolist() == [1, 3]
    assert hierarchies.merges_of_npz(npz(Z=np.array([[0, 1, 0.5, 2], [2, 3, 0.75, 3]])), "dice", "single")["count"].tolist() == [2, 3]
    for bad in ({"metric": "dice", "Z": np.ones((1, 4))}, {"x": np.ones(3)}, {"children": children, "distance": np.ones(3)}):
        with pytest.raises(ValueError):
            hierarchies.merges_of_npz(npz(**bad), "jaccard", "single")
    with pytest.raises(ValueError):
        hierarchies.merges_of_npz(npz(Z=np.ones((1, 4))), "jaccard", "average")
    path = tmp_path / "x.npz"
    path.write_bytes(npz(Z=np.array([[0, 1, 0.5, 2]])))
    assert hierarchies.read_merges(spark, str(path), "jaccard", "single").count() == 1
    assert hierarchies.paths("/h/", "jaccard", "single", "PF1") == ("/h/jaccard/single/linkage/PF1.linkage.npz", "/h/jaccard/single/resolver/PF1.resolver.json")
    entries = spark.createDataFrame([("P", "a", [1, 2]), ("P", "b", [1, 2]), ("Q", "a", [1, 2]), ("Q", "c", [3])], "partner_domain string, row_key string, columns array<int>")
    groups, members = compress.materialised(entries)
    resolver = tmp_path / "r.json"
    leaf = lambda i, c, *m: {"leaf_id": i, "interface_msa_columns_a": c, "interfaces": [{"partner_domain": p, "row_key": r} for p, r in m]}
    resolver.write_text(json.dumps({"leaves": [leaf(0, [2, 1], ("P", "a"), ("P", "b"), ("P", "z")), leaf(1, [1, 2]), leaf(2, [3])]}))
    leaves = hierarchies.read_resolver(spark, str(resolver))
    assert {(r["leaf"], r["group_index"]) for r in hierarchies.map_leaves(leaves, groups, members).collect()} == {(0, 0), (1, 1), (2, 2)}
    for some in (leaves.filter("leaf < 2"), leaves.filter("leaf > 0"), leaves.unionByName(leaves)):
        with pytest.raises(hierarchies.HierarchyMismatch):
            hierarchies.map_leaves(some, groups, members)
    # Without members to name, one leaf takes all groups of its columns, and a leaf may have none.
    resolver.write_text(json.dumps({"leaves": [leaf(0, [2, 1]), leaf(1, [3]), leaf(2, [7, 8])]}))
    leaves = hierarchies.read_resolver(spark, str(resolver))
    of_groups = hierarchies.map_leaves(leaves, groups, members)
    assert {(r["leaf"], r["group_index"]) for r in of_groups.collect()} == {(0, 0), (0, 1), (1, 2)}
    merges = spark.createDataFrame([(0, 1, 2, 0.2, 1), (1, 0, 3, 0.9, 4)], "merge_index int, left int, right int, distance double, count long")
    s = ClusteringSettings.of({"distance_threshold": "0.5", "hierarchical_min_cluster_size": "1"})
    got = {(r["partner_domain"], r["row_key"]): r["cluster_label"] for r in cluster.hierarchical(groups, members, s, merges=merges, leaves=of_groups).collect()}
    assert got == {("P", "a"): 0, ("P", "b"): 0, ("Q", "a"): 0, ("Q", "c"): 1}


def test_requests_with_precomputed_hierarchies(spark, tmp_path):
    """Leaves in another order than the groups: the answers are those of the local hierarchy."""
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    rows = {"A_1-2_1-2": [1, 2, 3], "B_1-2_1-2": [1, 2, 4], "C_1-2_1-2": [11, 12, 13], "D_1-2_1-2": [11, 12, 14]}
    (folder / "PF9_x.json").write_text(json.dumps({"P": {key: payload(c) for key, c in rows.items()}}))
    store.sync(str(folder))
    q = {"file": "PF9_x.json", "distance": "jaccard", "hierarchical_min_cluster_size": "1", "distance_threshold": "0.6"}
    labels = lambda f: {r["row_key"][0]: r["cluster_label"] for r in api.clustering_points(store, q, f).collect()}
    assert labels(None) == {"A": 0, "B": 0, "C": 1, "D": 1}
    where = tmp_path / "h" / "jaccard" / "average"
    (where / "linkage").mkdir(parents=True), (where / "resolver").mkdir()
    order = ["A", "C", "B", "D"]
    leaves = [{"leaf_id": k, "interface_msa_columns_a": rows[f"{x}_1-2_1-2"], "interfaces": [{"partner_domain": "P", "row_key": f"{x}_1-2_1-2"}]} for k, x in enumerate(order)]
    (where / "resolver" / "PF9.resolver.json").write_text(json.dumps({"leaves": leaves}))
    np.savez(where / "linkage" / "PF9.linkage.npz", children=np.array([[0, 2], [1, 3], [4, 5]]), distance=np.array([0.5, 0.5, 1.0]), count=np.array([2, 2, 4]), linkage_leaf_weighting="interface_count")
    h = str(tmp_path / "h")
    status = lambda f: json.loads(api.hierarchy_status(store, q, f).first()["json"])
    assert labels(h) == labels(None) and status(h)["source"] == "precalculated" and not status(h)["local_calculation_required"]
    tree = json.loads(api.dendrogram_nodes(store, q, h).first()["json"])
    assert tree["hierarchy_source"] == "precalculated" and {n["member_count"] for n in tree["nodes"] if n["is_leaf"]} == {1}
    assert {n["node_id"]: n["cluster_label"] for n in tree["nodes"] if n["is_leaf"]} == {0: 0, 1: 1, 2: 0, 3: 1}
    rows_ = api.clustering(store, q, h, as_rows=True).orderBy("place").collect()
    assert [r["part"] for r in rows_] == ["header"] + ["points"] * 4 and json.loads(rows_[0]["json"])["sample_count"] == 4
    # One that was made for something else is named and passed over; one that is broken is an error.
    (where / "resolver" / "PF9.resolver.json").write_text(json.dumps({"leaves": leaves[:3]}))
    assert status(h)["precomputed_state"] == "mismatch" and labels(h) == labels(None)
    (where / "resolver" / "PF9.resolver.json").write_text(json.dumps({"leaves": leaves}))
    (where / "linkage" / "PF9.linkage.npz").write_bytes(b"PK broken")
    with pytest.raises(Exception, match="(?i)zip|pickle"):
        api.clustering_points(store, q, h)


def test_a_name_from_two_folders_needs_its_path(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "PF1_x.json").write_text(json.dumps({"P": {"A_1-2_1-2": payload([1, 2 if k == "a" else 3])}}))
        store.sync(str(tmp_path / k))
    with pytest.raises(ValueError, match="path"):
        api.interface_page(store, {"file": "PF1_x.json"})
    path = [r["path"] for r in store.sources().collect() if "/b/" in r["path"]][0]
    page = json.loads(api.interface_page(store, {"file": "PF1_x.json", "path": path, "include_data": "1"}).first()["json"])
    assert page["data"][0]["interface_msa_columns_a"] == [1, 3]


def test_a_source_that_loses_its_rows_and_one_that_cannot_be_read(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"P": {"A_1-2_1-2": payload([1])}}))
    (folder / "b.json.gz").write_bytes(b"\x1f\x8bnot gzip at all")
    assert {e["name"]: e["status"] for e in store.sync(str(folder))} == {"a.json": "ready", "b.json.gz": "failed"}
    (folder / "a.json").write_text(json.dumps({"P": {}, "nothing": True}))
    store.sync(str(folder))
    entry = store.sources().filter("name = 'a.json'").first()
    assert (entry["status"], entry["row_count"]) == ("ready", 0) and store.rows().filter(F.col("source_id") == entry["source_id"]).count() == 0


def test_an_import_that_dies_leaves_the_old_snapshot_and_none_is_lost(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    put = lambda name, n: (folder / name).write_text(json.dumps({"P": {f"A{k}_1-2_1-2": payload([1]) for k in range(n)}}))
    put("a.json", 2)
    store.sync(str(folder))
    held = store.pinned()
    put("a.json", 5)
    with monkeypatch.context() as m:  # rows are there, the snapshot is not
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.sync(str(folder))
    assert store.rows().count() == 2 and [e["row_count"] for e in store.sources().collect()] == [2]
    # A second writer commits between the first one's look at the snapshot and its commit.
    put("b.json", 3)
    other, real = Store(spark, store.root), Store._state
    b = [f for f in other.changed(str(folder)).collect() if f["name"] == "b.json"]
    a = [f for f in other.changed(str(folder)).collect() if f["name"] == "a.json"]
    raced = []

    def late(self, n):
        if self is store and not raced:
            raced.append(n)
            other.import_files(b)
        return real(self, n)

    monkeypatch.setattr(Store, "_state", late)
    store.import_files(a)
    assert raced and {e["name"]: e["row_count"] for e in store.sources().collect()} == {"a.json": 5, "b.json": 3} and store.rows().count() == 8
    assert held.rows().count() == 2 and {e["row_count"] for e in held.sources().collect()} == {2}
    (folder / "a.json").write_text("[1]")
    store.sync(str(folder))
    entry = store.sources().filter("name = 'a.json'").first()
    assert entry["status"] == "failed" and store.rows().count() == 8  # what could not be read does not replace what could
    assert store.vacuum() == 2 and store.rows().count() == 8 and store.latest() == 3


def test_a_stored_distance_table_is_validated(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    entries = spark.createDataFrame([("P", k, c) for k, c in (("a", [1, 2]), ("b", [2, 3]), ("c", [9]))], "partner_domain string, row_key string, columns array<int>")
    groups, members = compress.materialised(entries)
    want = sorted(map(tuple, distance.stored(store, groups, members, "dice").collect()))
    (path,) = [str(p) for p in (tmp_path / "store" / "results" / "distances").iterdir()]
    spark.read.parquet(path).limit(1).write.mode("overwrite").parquet(str(tmp_path / "x"))
    spark.read.parquet(str(tmp_path / "x")).write.mode("overwrite").parquet(path)
    assert sorted(map(tuple, distance.stored(store, groups, members, "dice").collect())) == want and len(want) == 3


def test_tables_are_discarded_and_files_put_whole(spark, tmp_path):
    import os

    from seamline.functions import tables

    kept, gone = tables.written(spark.range(5), "kept"), tables.written(spark.range(7), "gone")
    own = spark.range(3)
    own.write.parquet(str(tmp_path / "own"))
    folder = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and tables.RUN in folder
    tables.discard(gone, spark.read.parquet(str(tmp_path / "own")))
    assert not os.path.exists(folder) and kept.count() == 5 and spark.read.parquet(str(tmp_path / "own")).count() == 3
    for data in (b"first", b"second \x00\xff"):
        tables.put(spark, str(tmp_path / "deep" / "file"), data)
        assert (tmp_path / "deep" / "file").read_bytes() == data
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["file"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from seamline.functions import tables

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError, match="share"):
        tables.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))
