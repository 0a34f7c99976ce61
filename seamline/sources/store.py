"""A parquet store of imported sources and cached results (S5-S8, S10-S16, S18, A26 inputs).

``<root>/rows`` is partitioned by the import's ``version`` and by ``source_id``; an import only adds files. ``<root>/snapshots/<n>`` is one small file that
names a table of ``<root>/states``: the latest entry of every path and the version that has its rows. An import ends by creating the next
snapshot if it does not exist yet, so rows and log change together or not at all; a writer that comes second takes the other's
snapshot for its base and tries again. Readers hold one snapshot. Results live under ``<root>/results/<kind>/<key>``, where the key
hashes everything that the result depends on - the size filter included - so results never overwrite each other.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.tables import content, create_once, delete, discard, names_in, written
from . import interfaces

SCHEMA_VERSION = 1
LOG = "source_id string, path string, name string, family string, size_bytes long, modified timestamp, status string, error string, row_count long, alignment_length long, schema_version int, at double"

ENTRY = LOG + ", version string"

NOT_A_DOCUMENT = "not a JSON object with distinct keys"


def source_id(path: str) -> str:
    return hashlib.sha1(path.encode()).hexdigest()[:16]


class Store:
    """Imported interface files and cached results below one folder. With ``snapshot`` it is read as it was then."""

    def __init__(self, spark: SparkSession, root: str, snapshot: int | None = None):
        self.spark, self.root, self.snapshot = spark, root.rstrip("/"), snapshot

    # ---- snapshots

    def latest(self) -> int:
        """The number of the snapshot that is read: the given one, else the last; -1 without one."""
        if self.snapshot is not None:
            return self.snapshot
        return max((int(n) for n in names_in(self.spark, f"{self.root}/snapshots") if n.isdigit()), default=-1)

    def pinned(self) -> Store:
        """This store as it is now, whatever is imported later."""
        return Store(self.spark, self.root, self.latest())

    def _state(self, n: int) -> DataFrame:
        """Entries of a snapshot, each path once."""
        if n < 0:
            return self.spark.createDataFrame([], ENTRY)
        name = content(self.spark, f"{self.root}/snapshots/{n:010d}")
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/states/{name}")

    def _commit(self, entries: list[tuple]) -> None:
        """The next snapshot with these entries in the place of their paths' old ones. A failed import keeps the version it had."""
        new = self.spark.createDataFrame(entries, ENTRY)
        while True:
            n = self.latest()
            old = self._state(n)
            kept = new.join(old.select("path", F.col("version").alias("__old")), "path", "left").withColumn("version", F.coalesce("version", "__old")).drop("__old")
            name = uuid.uuid4().hex
            old.join(new.select("path"), "path", "left_anti").unionByName(kept).write.parquet(f"{self.root}/states/{name}")
            if create_once(self.spark, f"{self.root}/snapshots/{n + 1:010d}", name.encode()):
                return
            delete(self.spark, f"{self.root}/states/{name}")

    def vacuum(self) -> int:
        """Delete states and versions that the snapshot does not need, and older snapshots; the number of deleted versions. Not while others
        read an older snapshot or import."""
        n = self.latest()
        if n < 0:
            return 0
        name = content(self.spark, f"{self.root}/snapshots/{n:010d}")
        used = {f"version={r.version}" for r in self._state(n).select("version").distinct().collect()}  # one row an import
        gone = [v for v in names_in(self.spark, f"{self.root}/rows") if v.startswith("version=") and v not in used]
        for old in names_in(self.spark, f"{self.root}/snapshots"):
            if old.isdigit() and int(old) < n:
                delete(self.spark, f"{self.root}/snapshots/{old}")
        for path in [f"rows/{v}" for v in gone] + [f"states/{s}" for s in names_in(self.spark, f"{self.root}/states") if s != name]:
            delete(self.spark, f"{self.root}/{path}")
        return len(gone)

    # ---- sources and rows

    def sources(self) -> DataFrame:
        """The latest log entry of every path."""
        return self._state(self.latest()).drop("version")

    def changed(self, folder: str) -> DataFrame:
        """Files of a folder whose path, size, time or schema version is not imported yet."""
        done = self.sources().filter((F.col("status") == "ready") & (F.col("schema_version") == SCHEMA_VERSION))
        return interfaces.scan(self.spark, folder).join(done.select("path", "size_bytes", "modified"), ["path", "size_bytes", "modified"], "left_anti")

    def _files(self) -> DataFrame:
        """All rows of all versions, with ``version``. The schema is told: names of partitions must not be taken for numbers."""
        empty = interfaces.interface_rows(self.spark.sql("SELECT '' AS source_id, '' AS partner_domain, '' AS interface_row_key, parse_json('{}') AS payload").filter("false"), ["source_id"])
        empty = empty.withColumn("row_order", F.lit(0).cast("long")).withColumn("version", F.lit(""))
        own = [c for c in empty.columns if c not in ("version", "source_id")]
        try:
            return self.spark.read.schema(empty.select(*own, "version", "source_id").schema).parquet(f"{self.root}/rows")
        except AnalysisException:
            return empty

    def rows(self) -> DataFrame:
        """Rows of all imported sources, partitioned by source_id."""
        current = self._state(self.latest()).filter("version IS NOT NULL").select("version", "source_id")
        return self._files().join(current, ["version", "source_id"], "left_semi").drop("version")

    def import_files(self, files: list) -> list[dict[str, Any]]:
        """Replace the rows of these sources and log the outcomes, in one snapshot; bad files are logged, not raised."""
        if not files:
            return []
        entries = {f["path"]: {k: f[k] for k in ("path", "name", "family", "size_bytes", "modified")} | {"source_id": source_id(f["path"]), "schema_version": SCHEMA_VERSION} for f in files}
        version = f"v{uuid.uuid4().hex}"
        found = self._added(list(entries), version)
        for entry in entries.values():
            got = found.get(entry["source_id"], "the file could not be found")
            bad = got if isinstance(got, str) else None
            entry |= {"status": "failed" if bad else "ready", "error": bad, "row_count": None if bad else got[0], "alignment_length": None if bad else got[1], "at": time.time(), "version": None if bad else version}
        self._commit([tuple(e[c.split()[0]] for c in ENTRY.split(", ")) for e in entries.values()])
        return [{k: v for k, v in e.items() if k != "version"} for e in entries.values()]

    def _added(self, paths: list[str], version: str) -> dict[str, tuple[int, int] | str]:
        """Row count and alignment length of every source, written as ``version``, or the error of a source without a document."""
        text = written(interfaces.try_texts(self.spark, paths).withColumn("source_id", F.substring(F.sha1("path"), 1, 16)), "texts")
        parsed = text.withColumn("doc", F.try_parse_json("value")).withColumn("ok", F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))
        told = parsed.select("source_id", F.when(~F.col("ok"), F.coalesce("error", F.lit(NOT_A_DOCUMENT))).alias("error")).collect()  # one row a file
        rows = interfaces.interface_rows(interfaces.flatten(parsed.filter("ok"), ["source_id"]), ["source_id"])
        rows = interfaces.numbered_rows(rows, ["source_id"]).withColumn("version", F.lit(version))
        rows.write.mode("append").partitionBy("version", "source_id").parquet(f"{self.root}/rows")
        counts = interfaces.alignment_length(self._files().filter(F.col("version") == version), ["source_id"])
        out = {r["source_id"]: (r["n"], r["alignment_length"]) for r in counts.collect()}
        discard(text)
        return {r["source_id"]: r["error"] or out.get(r["source_id"], (0, 0)) for r in told}

    def sync(self, folder: str) -> list[dict[str, Any]]:
        """Import every changed file of a folder. The list of file names is small; their contents stay in Spark."""
        return self.import_files(self.changed(folder).orderBy("path").collect())

    # ---- results

    def result_path(self, kind: str, **depends: Any) -> str:
        """The folder of a result, named by the hash of all it depends on."""
        key = hashlib.sha1(json.dumps(depends, sort_keys=True, default=str).encode()).hexdigest()
        return f"{self.root}/results/{re.sub(r'[^a-z0-9_-]', '_', kind.lower())}/{key}"

    def result(self, kind: str, make: Callable[[], DataFrame], anew: bool = False, **depends: Any) -> DataFrame:
        """The cached result, or ``make()`` written and read back. A partly written result has no
        ``_SUCCESS`` file and is made anew, and so is any with ``anew``."""
        path = self.result_path(kind, **depends)
        if anew or not self.has_result(kind, **depends):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def has_result(self, kind: str, **depends: Any) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.result_path(kind, **depends) + "/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def is_stale(self, kind: str, max_age_days: float, **depends: Any) -> bool:
        """Whether a result is missing or older than so many days."""
        if not self.has_result(kind, **depends):
            return True
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.result_path(kind, **depends) + "/_SUCCESS")
        status = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        return time.time() - status.getModificationTime() / 1000 > max_age_days * 86400


def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``<metric>/<linkage>/summary.csv`` below a folder; columns that a file lacks come from its path."""
    schema = "status string, leaf_count double, total_seconds double, peak_rss_delta_bytes double, metric string, linkage string, source_file string, pfam_id string"
    try:
        rows = spark.read.csv(f"{folder.rstrip('/')}/*/*/summary.csv", header=True)
    except AnalysisException:
        return spark.createDataFrame([], schema + ", summary_file string")
    path = F.col("_metadata.file_path")
    part = lambda k: F.element_at(F.split(path, "/"), -k)
    rows = rows.withColumn("summary_file", path).withColumn("__metric", part(3)).withColumn("__linkage", part(2))
    have = set(rows.columns)
    cols = []
    for field in schema.split(", "):
        name, kind = field.split()
        value = F.expr(f"try_cast(trim(`{name}`) AS {kind})") if name in have else F.lit(None).cast(kind)
        if f"__{name}" in ("__metric", "__linkage"):
            value = F.coalesce(F.when(value != "", value), F.col(f"__{name}"))
        cols.append(value.alias(name))
    return rows.select(*cols, "summary_file")
