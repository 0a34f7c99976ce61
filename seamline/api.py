"""The service's requests as functions (S21, S22): settings in as texts, one DataFrame of JSON out.

Each function takes a ``Store`` and the request's parameters, and returns a DataFrame with one column ``json`` and one row. Only
the page or the one dataset that a request names is gathered, and no more than ``MAX_LISTED`` rows of it; ``as_rows`` gives answers of
any size as rows: place, part and json, the header's object at place 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequences, text
from .functions.tables import numbered, written
from .operators import cluster, compare, compress, dendrogram, distance, embed, represent, rows, stats, structure
from .settings import ALL_PARTNERS, ClusteringSettings, EmbeddingSettings, FilterSettings, PageSettings, choice, flag, number, text_of
from .sources import hierarchies
from .sources.store import Store, run_summaries

Query = Mapping[str, Any]

#: Most rows that are put into one JSON array.
MAX_LISTED = 200_000


def to_json(df: DataFrame, **constants: Any) -> DataFrame:
    """One JSON object a row, constants first."""
    return df.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in constants.items()], "*"), {"ignoreNullFields": "false"}).alias("json"))


def listed(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """All rows of a small result - a page, one value a column or a cluster - as one array, in order. Only the order's columns
    are compared: rows may hold maps."""
    cols = F.struct(F.struct(*(order or [F.lit(0).alias("k")])).alias("key"), F.struct("*").alias("row"))
    compared = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return df.agg(F.transform(F.array_sort(F.collect_list(cols), compared), lambda x: x["row"]).alias(name))


def with_list(header: DataFrame, rows_: DataFrame, name: str, order: list[str], as_rows: bool, **constants: Any) -> DataFrame:
    """An answer whose rows ``name`` grow with the data: in one object, or as rows of their own that are never gathered."""
    if not as_rows:
        if rows_.limit(MAX_LISTED + 1).count() > MAX_LISTED:
            raise ValueError(f"more than {MAX_LISTED} {name} for one object; ask for them as rows")
        return to_json(header.crossJoin(listed(rows_, name, order)), **constants)
    made = numbered(rows_, order, "place", start=1).withColumn("place", F.col("place").cast("long"))
    one = F.to_json(F.struct(*rows_.columns), {"ignoreNullFields": "false"}).alias("json")
    return to_json(header, **constants).select(F.lit(0).cast("long").alias("place"), F.lit("header").alias("part"), "json").unionByName(made.select("place", F.lit(name).alias("part"), one))


def _rows(store: Store, query: Query) -> DataFrame:
    """the filtered rows of the file that the request names."""
    name = text_of(query, "file")
    return rows.by_size(store.rows().filter(F.col("source_id") == _source(store, query)["source_id"]), FilterSettings.of(query).min_interface_size)


def _source(store: Store, query: Query):
    """The one imported file of the request's name; a name from several folders needs ``path`` as well."""
    name, path = text_of(query, "file"), text_of(query, "path")
    ready = store.sources().filter((F.col("name") == name) & (F.col("status") == "ready"))
    found = (ready.filter(F.col("path") == path) if path else ready).select("source_id", "path", "size_bytes", "modified", "family").orderBy("path").take(2)
    if not found:
        raise ValueError(f"no imported file {name!r}")
    if len(found) > 1:
        raise ValueError(f"{name!r} was imported from {found[0]['path']} and elsewhere; the request must give its path")
    return found[0]


def _signature(store: Store, query: Query) -> str:
    s = _source(store, query)
    return hashlib.sha1(str((s["path"], s["size_bytes"], s["modified"])).encode()).hexdigest()


def files(store: Store, metadata: DataFrame | None = None) -> DataFrame:
    """``files``: the imported files with the statistics and categories of their families."""
    sources = store.sources().filter("status = 'ready'").select("family", "name", "source_id", "path")
    with_family = store.rows().join(sources.select("source_id", "family", "path"), "source_id")
    made = stats.with_categories(stats.selector_stats(with_family))
    names = metadata if metadata is not None else store.spark.createDataFrame([], "family string, display_name string")
    options = stats.dataset_options(sources, stats.with_metadata(made, names))
    return to_json(listed(options, "files", ["family", "name"]))


def interface_page(store: Store, query: Query, as_rows: bool = False) -> DataFrame:
    """``interface``: summary, partners and a page of alignment rows, with overlay lists and column identity if asked for."""
    base = _rows(store, query)
    page = PageSettings.of(query)
    total = stats.summary(base)
    length = total.first()["alignment_length"]
    out = rows.completeness(base, page).crossJoin(total)
    out = out.crossJoin(listed(stats.partner_counts(base), "interface_partner_counts", ["partner_domain"]))
    out = out.crossJoin(listed(stats.size_histogram(base), "interface_size_histogram", ["size"]))
    if flag(query, "include_data", True):
        # The data's page is the rows' page where it has none of its own.
        own = PageSettings.of(query | {k: query[k.replace("data", "row")] for k in ("data_offset", "data_limit") if not text_of(query, k) and k.replace("data", "row") in query}, "data")
        data = rows.page_of_filtered(base, own).select("partner_domain", "interface_row_key", "interface_msa_columns_a", "surface_msa_columns_a")
        out = out.crossJoin(listed(data, "data", ["partner_domain", "interface_row_key"]))
    if flag(query, "include_clean_column_identity", flag(query, "include_clean", True)):
        out = out.crossJoin(listed(stats.clean_identity(base, length=length), "clean_column_identity", ["col"]))
    if not flag(query, "include_rows", True):
        return to_json(out, file=text_of(query, "file"))
    some = sequences.alignment_rows(rows.page_of_filtered(base, page), length)
    return with_list(out, some, "rows", ["partner_domain", "interface_row_key"], as_rows, file=text_of(query, "file"))


def _compressed(store: Store, query: Query) -> tuple[DataFrame, DataFrame]:
    groups, members = compress.materialised(compress.entries(_rows(store, query)))
    if groups.agg(F.sum("member_count")).first()[0] in (None, 1):
        raise ValueError("fewer than two interfaces have columns")
    return groups, written(members, "members")


class Gone(ValueError):
    """A request that is no longer served."""


def msa(store: Store, query: Query) -> DataFrame:
    """``msa``: alignment files are served as rows of ``interface``."""
    raise Gone("alignment files are no longer served; ask for the interface's rows")


def embedding(store: Store, query: Query, as_rows: bool = False) -> DataFrame:
    """``embedding``: E1-E5."""
    s = EmbeddingSettings.of(query)
    groups, _ = _compressed(store, query)
    depends = {"source": _signature(store, query), "filter": asdict(FilterSettings.of(query)), **asdict(s)}
    laid = store.result("layout", lambda: embed.layout(groups, s), **depends)
    points = embed.embedding_points(laid, groups)
    head = laid.agg(F.array(*[F.coalesce(F.max(f"share{k}"), F.lit(0.0)) for k in range(3)]).alias("explained_variance_ratio"))
    head = head if s.method == "pca" else head.select(F.lit(None).cast("array<double>").alias("explained_variance_ratio"))
    return with_list(head, points, "points", ["group_id"], as_rows, method=s.method, distance=s.distance, dimensions=3)


@dataclass(frozen=True)
class Hierarchy:
    """Where the merges of a request come from, and the leaf of every group where leaves are not the groups themselves."""

    merges: DataFrame | None
    source: str
    leaves: DataFrame | None = None
    state: str = "unavailable"
    reason: str = "no folder of hierarchies is given"


def _hierarchy(store: Store, query: Query, groups: DataFrame, members: DataFrame, s: ClusteringSettings, folder: str | None, make: bool = True) -> Hierarchy:
    """The precomputed hierarchy of the file's family if one fits, else the cached one, else - if it is to be made - a
    new local one. One that does not fit is named with its reason; one that cannot be read raises."""
    state, reason = "unavailable", Hierarchy.reason
    if folder:
        try:
            found = hierarchies.precomputed(store.spark, folder, s.distance, s.linkage, _source(store, query)["family"], groups, members)
            if found is not None:
                return Hierarchy(found[0], "precalculated", written(found[1], "leaves"), "ready", "")
            reason = "no matching precalculated hierarchy files were found"
        except hierarchies.HierarchyMismatch as e:
            state, reason = "mismatch", str(e)
    depends = {"source": _signature(store, query), "filter": asdict(FilterSettings.of(query)), "distance": s.distance, "linkage": s.linkage}
    kept = store.has_result("hierarchy", **depends)
    merges = store.result("hierarchy", lambda: cluster.hierarchy(groups, s.distance, s.linkage), **depends) if kept or make else None
    return Hierarchy(merges, "local_cache" if kept else "local", None, state, reason)


def clustering_points(store: Store, query: Query, folder: str | None = None) -> DataFrame:
    """Points of the clustering that the request asks for, cached by everything it depends on, a precomputed hierarchy included."""
    s = ClusteringSettings.of(query)
    groups, members = _compressed(store, query)
    depends = {"source": _signature(store, query), "filter": asdict(FilterSettings.of(query)), **asdict(s)}
    if s.method == "hdbscan":
        return store.result("clustering", lambda: cluster.density(groups, members, s), **depends)
    h = _hierarchy(store, query, groups, members, s, folder, make=not store.has_result("clustering", **depends, precalculated=False))
    return store.result("clustering", lambda: cluster.hierarchical(groups, members, s, merges=h.merges, leaves=h.leaves), **depends, precalculated=h.source == "precalculated")


def clustering(store: Store, query: Query, folder: str | None = None, as_rows: bool = False) -> DataFrame:
    """``clustering``: points, counts and the column chart."""
    base = _rows(store, query)
    points = clustering_points(store, query, folder)
    length = stats.summary(base).first()["alignment_length"]
    chart = compare.column_chart(points, base, length)
    out = cluster.payload(points).crossJoin(listed(chart, "columns_chart", ["cluster_label", "col"])).crossJoin(compare.stack_maximum(chart))
    return with_list(out, points, "points", ["partner_domain", "row_key"], as_rows, alignment_length=length)


def dendrogram_nodes(store: Store, query: Query, folder: str | None = None) -> DataFrame:
    """``dendrogram``: T1."""
    s = ClusteringSettings.of(query)
    if s.method != "hierarchical":
        raise ValueError("a dendrogram needs hierarchical clustering")
    groups, members = _compressed(store, query)
    h = _hierarchy(store, query, groups, members, s, folder)
    source, counts = h.source, dendrogram.leaf_counts(members, clustering_points(store, query, folder))
    if h.leaves is not None:
        counts = counts.join(h.leaves, "group_index").groupBy(F.col("leaf").alias("group_index"), "cluster_label", "partner_domain").agg(F.sum("n").alias("n"))
        groups = cluster.as_leaves(groups, h.leaves, h.merges)
    nodes = written(dendrogram.nodes(groups, h.merges, counts, number(query, "merge_depth", 5, int, above=0), s.distance_threshold), "nodes")
    out = listed(nodes, "nodes", ["node_id"]).crossJoin(listed(dendrogram.edges(nodes), "edges", ["target"]))
    return to_json(out, hierarchy_source=source, linkage=s.linkage, distance=s.distance)


def hierarchy_status(store: Store, query: Query, folder: str | None = None) -> DataFrame:
    """``hierarchy-status``: C11, C12."""
    s = ClusteringSettings.of(query)
    spark = store.spark
    if s.method != "hierarchical":
        return to_json(spark.range(1).select(F.lit(False).alias("local_calculation_required")), method=s.method)
    groups, members = _compressed(store, query)
    n = groups.count()
    h = _hierarchy(store, query, groups, members, s, folder, make=False)
    source = h.source
    if source == "local" and store.has_result("clustering", source=_signature(store, query), filter=asdict(FilterSettings.of(query)), **asdict(s), precalculated=False):
        source = "clustering_cache"
    out = members.agg(F.count("*").alias("interface_count")).withColumn("leaf_count", F.lit(n))
    if source == "local" and folder:
        out = out.crossJoin(listed(cluster.cost_estimate(run_summaries(spark, folder), s.distance, s.linkage, n), "estimate"))
    told = {"precomputed_state": h.state, "precomputed_reason": h.reason}
    if source == "precalculated":
        told = dict(zip(("linkage_file", "resolver_file"), hierarchies.paths(folder, s.distance, s.linkage, _source(store, query)["family"])))
    return to_json(out, method=s.method, distance=s.distance, linkage=s.linkage, source=source, local_calculation_required=source == "local", **told)


def cluster_compare(store: Store, query: Query, folder: str | None = None) -> DataFrame:
    """``cluster-compare``: C14, C15 for one cluster."""
    s = ClusteringSettings.of(query)
    label = number(query, "cluster_label", None, int, least=0)
    if label is None:
        raise ValueError("cluster_label is missing")
    groups, members = _compressed(store, query)
    inside = members.join(clustering_points(store, query, folder).filter(F.col("cluster_label") == label), ["row_key", "partner_domain"])
    own = inside.groupBy("group_index").agg(F.count("*").alias("member_count"), F.min("row_key").alias("row_key"), F.first("cluster_label").alias("cluster_label"))
    items = own.join(groups.select("group_index", "partner_domain", "columns"), "group_index")
    picks = compare.diverse_picks(items, s.distance, number(query, "limit", 9, int, above=0))
    return to_json(listed(picks, "selected_entries", ["selection_rank"]), cluster_label=label, distance=s.distance)


def representative(store: Store, query: Query, folder: str | None = None) -> DataFrame:
    """``representative``: R4, overall or of a cluster."""
    method = choice(query, "representative_method", "balanced", ("balanced", "residue"))
    scope = choice(query, "representative_scope", "overall", ("overall", "cluster"))
    base = rows.of_partner(_rows(store, query), text_of(query, "partner", ALL_PARTNERS) or ALL_PARTNERS)
    if scope == "cluster":
        label = number(query, "cluster_label", None, int, least=0)
        if label is None:
            raise ValueError("cluster_label is missing")
        base = compare.rows_of_cluster(base, clustering_points(store, query, folder), label)
    length = base.agg(F.coalesce(F.max(F.length("aligned_seq")), F.lit(0)).alias("n")).first()["n"]
    return to_json(represent.rows_of(represent.select(base, method, length=length), base, length), scope=scope, representative_method=method, alignment_length=length)


def structure_preview(store: Store, query: Query) -> DataFrame:
    """``structure-preview``: P1, the residue sets of one row."""
    partner = text_of(query, "partner", ALL_PARTNERS) or ALL_PARTNERS
    found = rows.row_of(_rows(store, query), text_of(query, "row_key"), partner)
    own = structure.fragment_residues(found).select("interface_row_key", F.col("residue_ids").alias("fragment_residue_ids")).distinct()
    return to_json(structure.residue_sets(found).join(own, "interface_row_key"))


def family_names(spark: SparkSession, path: str) -> DataFrame:
    """Family and display_name of every entry of list pages that were fetched beforehand; of a family on several pages the
    name that comes last in order of file and place. Entries without an accession are left out; a page without a list raises."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_variant_get(F.try_parse_json("value"), "$.results", "array<variant>").alias("r"))
    bad = F.raise_error(F.concat(F.lit("a page without a list of results: "), F.col("file"))).cast("array<variant>")
    entries = pages.select("file", F.posexplode(F.coalesce("r", bad)).alias("at", "d"))
    found = entries.select("file", "at", text.variant_text(F.col("d"), "$.metadata.accession").alias("family"), text.variant_text(F.col("d"), "$.metadata.name").alias("display_name"))
    found = found.withColumn("family", F.coalesce("family", F.lit(""))).filter("family <> ''")
    return found.groupBy("family").agg(F.max_by(F.coalesce("display_name", F.lit("")), F.struct("file", "at")).alias("display_name"))


def family_info(spark: SparkSession, path: str) -> DataFrame:
    """``pfam-info``: X11, an entry document that was fetched beforehand, flattened."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("d"))
    d = F.col("d")
    kind = F.schema_of_variant(F.try_variant_get(d, "$.metadata", "variant"))
    doc = doc.select(F.when(kind.startswith("OBJECT"), d).otherwise(F.raise_error(F.lit("the entry has no metadata object")).cast("variant")).alias("d"))
    meta = lambda p: text.variant_text(F.col("d"), f"$.metadata.{p}")
    named = F.schema_of_variant(F.try_variant_get("d", "$.metadata.name", "variant")).startswith("OBJECT")
    count = lambda p: text.count_value(F.try_variant_get("d", f"$.metadata.counters.{p}", "variant"))
    paragraphs = F.transform(F.try_variant_get("d", "$.metadata.description", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))
    long = doc.select("d", F.coalesce(paragraphs, F.array(F.try_variant_get("d", "$.metadata.description", "string"))).alias("ps"))
    # Paragraphs are cleaned one by one: the clean-up works on columns of texts.
    clean = long.select("d", F.posexplode_outer("ps").alias("k", "p")).withColumn("p", text.strip_html(F.col("p")))
    joined = clean.groupBy(F.to_json("d").alias("j")).agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("ps")).select(F.parse_json("j").alias("d"), text.joined_paragraphs(F.col("ps.p")).alias("description"))
    counts = {"proteins": "proteins", "matches": "matches", "proteomes": "proteomes", "taxa": "taxa", "structures": "structures", "domain_architectures": "domain_architectures", "alphafold_models": "structural_models.alphafold"}
    return joined.select(
        text.accession(meta("accession")).alias("pfam_id"), F.when(named, meta("name.name")).otherwise(meta("name")).alias("display_name"), F.when(named, meta("name.short")).otherwise("").alias("short_name"),
        "description", meta("type").alias("type"), meta("integrated").alias("integrated_interpro"), text.named_reference(F.col("d"), "$.metadata.set_info").alias("set_info"),
        text.named_reference(F.col("d"), "$.metadata.representative_structure").alias("representative_structure"), F.struct(*[count(p).alias(k) for k, p in counts.items()]).alias("stats"),
    )


__all__ = ["clustering", "cluster_compare", "dendrogram_nodes", "distance", "embedding", "family_info", "family_names", "files", "hierarchy_status", "interface_page", "msa", "representative", "structure_preview"]
