"""WARC files and a Merkle fixity audit of their replicas.

``write_replicas`` turns pages into gzipped WARC/1.1 response records, one file per task, written to every replica, and
returns the index: each record's place and the SHA-256 of its stored bytes, taken when it was written. The audit hashes the stored bytes
again. Over each file's records in offset order stands a binary hash tree; a node covers an ordered offset
range. The roots of all replicas are compared with each other and with the index's, and only where two of them differ is the
next level looked at, down to the records that differ; there the index tells which replicas are damaged. Work below the roots is thus in
proportion to the damage. ``whole_records`` reads every record from a replica that holds it whole.

Leaves are SHA-256(0x00, record), inner nodes SHA-256(0x01, left, right); a last node without a partner moves up as it is.

Edge cases: a null html is an empty page, a null url leaves the target header out, a null id stays null; repeated pages
are records of their own; a missing or short replica file is damage of the records it lacks; bytes after a file's last
record are a damaged range of their own, without a record; an empty table has no file and an empty audit.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch_path, written
from .token_shards import open_fs

#: A fixed date, so that a retried task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
INDEX = "shard int, record int, page_id long, offset long, length long, sha256 string, leaf binary"


def record_bytes(page_id, url, html, date: str = DATE) -> bytes:
    """One response record as a gzip member."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url or ''} {hashlib.sha256(body).hexdigest()}")
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> dict:
    """Headers (names in lower case) and the html of one gzip member."""
    head, _, body = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    body = body[: int(out["content-length"])]
    return out | {"version": lines[0], "html": body.partition(b"\r\n\r\n")[2].decode()}


def spoilt(data: bytes) -> bytes:
    """A record with one bit of its middle byte turned."""
    k = len(data) // 2
    return data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]


def write_replicas(pages: DataFrame, uris: list[str], fault: Callable[[int, int | None], bool] | None = None) -> DataFrame:
    """Write the pages to every replica; the index has one row per record. No shuffle: a task writes what it reads.

    ``fault`` rehearses damage: where it holds for a replica's number and a page_id, that replica stores the record ``spoilt``. The index
    always has the digests of what should be stored.
    """

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        places = [open_fs(u) for u in uris]
        streams, offset, n = [], 0, 0
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                page, url, html = (b.column(i)[k].as_py() for i in range(3))
                data = record_bytes(page, url, html)
                if not streams:
                    for files, folder in places:
                        files.create_dir(folder, recursive=True)
                    streams = [f.open_output_stream(f"{d}/{shard:06d}.{attempt}") for f, d in places]
                for side, s in enumerate(streams):
                    s.write(spoilt(data) if fault and fault(side, page) else data)
                rows.append((shard, n, page, offset, len(data), hashlib.sha256(data).hexdigest(), hashlib.sha256(b"\0" + data).digest()))
                offset, n = offset + len(data), n + 1
            if rows:
                names = ["shard", "record", "page_id", "offset", "length", "sha256", "leaf"]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for s, (f, d) in zip(streams, places):
            s.close()
            f.move(f"{d}/{shard:06d}.{attempt}", f"{d}/{shard:06d}.warc.gz")

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return written(rows.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, uri: str) -> DataFrame:
    """page_id, url and html of every indexed record, read back by its place."""

    def run(batches):
        for b in batches:
            files, folder = open_fs(uri)
            cols = [b.column(i).to_pylist() for i in range(4)]
            rows = []
            for shard, page, offset, length in zip(*cols):
                with files.open_input_file(f"{folder}/{shard:06d}.warc.gz") as file:
                    r = parse_record(bytes(file.read_at(length, offset)))
                rows.append((page, r.get("warc-target-uri"), r["html"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["page_id", "url", "html"]
            )

    return index.select("shard", "page_id", "offset", "length").mapInArrow(run, "page_id long, url string, html string")


def tree_levels(leaves: list[bytes]) -> list[list[bytes]]:
    """Levels of the tree, leaves first, the root alone in the last."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        up = [hashlib.sha256(b"\1" + below[i] + below[i + 1]).digest() for i in range(0, len(below) - 1, 2)]
        levels.append(up + below[len(up) * 2 :])
    return levels


NODES = "side string, shard int, level int, pos long, hash binary, start long, stop long"


def build_trees(index: DataFrame, uris: list[str]) -> DataFrame:
    """All tree nodes: of the index itself (side ``index``) and of each replica (its uri).

    The records of a file come together in offset order, once a file; a file is what one task wrote.
    """
    sides = F.explode(F.array(F.lit("index"), *map(F.lit, uris)))
    placed = index.select("shard", "offset", "length", "leaf", sides.alias("side"))
    placed = placed.withColumn("leaf", F.when(F.col("side") == "index", F.col("leaf")))
    placed = placed.repartition("side", "shard").sortWithinPartitions("side", "shard", "offset")

    def nodes(key, places, leaves):
        (side, shard), out = key, []
        if side != "index":
            leaves = _stored_leaves(side, shard, places)
        bounds = places
        for level, row in enumerate(tree_levels(leaves)):
            out += [(side, shard, level, k, h, bounds[k][0], bounds[k][1]) for k, h in enumerate(row)]
            bounds = [(bounds[k][0], bounds[min(k + 1, len(bounds) - 1)][1]) for k in range(0, len(bounds), 2)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["side", "shard", "level", "pos", "hash", "start", "stop"])

    def run(batches):
        key, places, leaves = None, [], []
        for b in batches:
            for shard, offset, length, leaf, side in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (side, shard) != key:
                    if key:
                        yield nodes(key, places, leaves)
                    key, places, leaves = (side, shard), [], []
                places.append((offset, offset + length))
                leaves.append(leaf)
        if key:
            yield nodes(key, places, leaves)

    return placed.mapInArrow(run, NODES)


def _stored_leaves(uri: str, shard: int, places: list[tuple[int, int]]) -> list[bytes]:
    """Leaf hashes of the bytes that a replica stores at these ranges; a missing file has no bytes."""
    files, folder = open_fs(uri)
    try:
        file = files.open_input_file(f"{folder}/{shard:06d}.warc.gz")
    except FileNotFoundError:
        return [hashlib.sha256(b"\0").digest()] * len(places)
    with file:
        size = file.size()
        return [hashlib.sha256(b"\0" + (bytes(file.read_at(min(b, size) - a, a)) if a < size else b"")).digest() for a, b in places]


def surplus(index: DataFrame, uris: list[str]) -> DataFrame:
    """side, shard, offset and length of what replica files hold after their last record. One row a file is looked at."""
    ends = index.groupBy("shard").agg(F.max(F.col("offset") + F.col("length")).alias("stop"))

    def run(batches):
        for b in batches:
            rows = []
            for shard, stop in zip(*(b.column(k).to_pylist() for k in range(2))):
                for uri in uris:
                    files, folder = open_fs(uri)
                    info = files.get_file_info(f"{folder}/{shard:06d}.warc.gz")
                    if info.size and info.size > stop:
                        rows.append((uri, shard, stop, info.size - stop))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["side", "shard", "offset", "length"])

    return ends.mapInArrow(run, "side string, shard int, offset long, length long")


def differing_nodes(trees: DataFrame) -> list[DataFrame]:
    """shard, level and pos of the nodes on which any two sides differ, a written table a step: roots first, then the differing
    children of each step's nodes. No other node is looked at."""
    at = ["shard", "level", "pos"]

    def differing(nodes: DataFrame) -> DataFrame:
        return written(nodes.groupBy(*at).agg(F.min("hash").alias("low"), F.max("hash").alias("high")).filter("low <> high").select(*at), "merkle-bad")

    tops = trees.groupBy("shard").agg(F.max("level").alias("level")).withColumn("pos", F.lit(0).cast("long"))
    steps = [differing(trees.join(tops, at, "left_semi"))]
    while (inner := steps[-1].filter("level > 0")).take(1):
        below = inner.select("shard", (F.col("level") - 1).alias("level"), F.explode(F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)).alias("pos"))
        steps.append(differing(trees.join(below, at, "left_semi")))
    return steps


def damaged_records(index: DataFrame, uris: list[str]) -> DataFrame:
    """side, shard, record, page_id, offset and length of every stored record whose bytes differ from the index, and of every range
    after a file's last record (record and page_id null); a written table.

    Descends one level of the trees at a time, looking only at children of nodes on which any two sides differ.
    """
    trees = written(build_trees(index, uris), "merkle")
    steps = differing_nodes(trees)
    found = steps[0]
    for more in steps[1:]:
        found = found.unionByName(more)
    leaves = trees.join(found.filter("level = 0"), ["shard", "level", "pos"], "left_semi").select("side", "shard", F.col("pos").cast("int").alias("record"), "hash")
    damaged = leaves.filter("side <> 'index'").join(index, ["shard", "record"]).filter(~F.col("hash").eqNullSafe(F.col("leaf")))
    after = surplus(index, uris).select("side", "shard", F.lit(None).cast("int").alias("record"), F.lit(None).cast("long").alias("page_id"), "offset", "length")
    out = written(damaged.select("side", "shard", "record", "page_id", "offset", "length").unionByName(after), "damaged-records")
    discard(trees, *steps)
    return out


def audit(pages: DataFrame, replicas: int = 2, fault: Callable[[int, int | None], bool] | None = None) -> tuple[DataFrame, list[str], DataFrame]:
    """(index, replica folders, damaged records) after writing the pages to so many replicas and auditing them."""
    uris = [scratch_path(pages.sparkSession, f"warc-{k}") for k in range(replicas)]
    index = write_replicas(pages, uris, fault)
    return index, uris, damaged_records(index, uris)


def fixity_report(index: DataFrame, uris: list[str], damaged: DataFrame) -> DataFrame:
    """One row per record: its place, digest, the number of replicas that hold it whole, and the numbers of those that do not."""
    number = F.array_position(F.array(*map(F.lit, uris)), F.col("side")).cast("int") - 1
    bad = damaged.filter("record IS NOT NULL").groupBy("shard", "record").agg(F.array_sort(F.collect_set(number)).alias("damaged_in"))
    out = index.join(bad, ["shard", "record"], "left").withColumn("damaged_in", F.coalesce("damaged_in", F.array().cast("array<int>")))
    whole = (F.lit(len(uris)) - F.size("damaged_in")).cast("int")
    return out.select("page_id", "shard", "record", "offset", "length", F.col("sha256").alias("record_sha256"), whole.alias("replicas_whole"), "damaged_in")


def whole_records(report: DataFrame, uris: list[str]) -> DataFrame:
    """page_id, html, replicas_whole and damaged_in of every record of a ``fixity_report``, read from the first replica that holds it whole; html
    is null where none does."""
    side = F.element_at(F.array_except(F.sequence(F.lit(0), F.lit(len(uris) - 1)), "damaged_in"), 1)
    placed = report.select("page_id", "shard", "offset", "length", "replicas_whole", "damaged_in", F.when(F.col("replicas_whole") > 0, side).alias("from_side"))

    def run(batches):
        file, held = None, None
        for b in batches:
            htmls = []
            for shard, offset, length, at in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 6))):
                if at is None:
                    htmls.append(None)
                    continue
                if held != (at, shard):
                    if file:
                        file.close()
                    files, folder = open_fs(uris[at])
                    file, held = files.open_input_file(f"{folder}/{shard:06d}.warc.gz"), (at, shard)
                htmls.append(parse_record(bytes(file.read_at(length, offset)))["html"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(htmls, pa.string()), b.column(4), b.column(5)], names=["page_id", "html", "replicas_whole", "damaged_in"])
        if file:
            file.close()

    return placed.sortWithinPartitions("from_side", "shard", "offset").mapInArrow(run, "page_id long, html string, replicas_whole int, damaged_in array<int>")
