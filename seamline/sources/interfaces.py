"""Interface files: scanning, parsing and flattening.

A file is a JSON object ``{partner: {row key: payload}}``, plain or gzipped. Parsing goes through VARIANT, which tolerates
wrong-typed values beside good ones; a document whose top level is not an object, or that repeats a key, is an error.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import file_family, file_stem, key_part
from ..functions.tables import numbered, written

#: Payload lists that become array columns.
LISTS = (
    "interface_msa_columns_a",
    "interface_msa_columns_b",
    "surface_msa_columns_a",
    "interface_residues_a",
    "interface_residues_b",
    "surface_residue_ids_a",
    "surface_residue_ids_b",
)

#: An object can be read as one of no fields. Unlike the schema of a variant, that does not go through what is in it.
IS_OBJECT = "try_variant_get({}, '$', 'struct<>') IS NOT NULL"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Path, name, stem, family, size and modification time of the interface files of a folder.

    A folder that is missing gives no rows. Only metadata is read.
    """
    schema = "path string, name string, stem string, family string, size_bytes long, modified timestamp"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][sS][oO][nN]*").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = files.select("path", name.alias("name"), file_stem(name).alias("stem"), file_family(name).alias("family"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return out.filter(F.lower("name").rlike(r"\.json(\.gz)?$"))


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, family and ``doc``, the whole file as a variant. Gzip is read by the file's suffix."""
    return read_texts(spark, paths).select("path", file_family(F.col("path")).alias("family"), F.parse_json("value").alias("doc"))


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and value, the whole text of every file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def try_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, value and error of every file that is there: bad ones are found in the one pass that reads all of them."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                value = error = None
                try:
                    raw = data.as_buffer().to_pybytes()
                    value = (gzip.decompress(raw) if path.as_py().lower().endswith(".gz") else raw).decode("utf-8", "replace")
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file is its import error
                    error = f"{type(e).__name__}: {e}"[:2000]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([value], pa.string()), pa.array([error], pa.string())], names=["path", "value", "error"])

    files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths)
    return files.select("path", "content").mapInArrow(run, "path string, value string, error string")


def checked(doc: Column) -> Column:
    """The document, if its top level is an object; raises otherwise."""
    bad = F.raise_error(F.lit("an interface document must be a JSON object")).cast("variant")
    return F.when(F.try_variant_get(doc, "$", "struct<>").isNotNull(), doc).otherwise(bad)


def flatten(documents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, partner_domain, interface_row_key and ``payload`` (variant) of every row that is an object.

    Values that are not objects are skipped at both levels.
    """
    names = ", ".join(keys)
    docs = documents.select(*keys, checked(F.col("doc")).alias("doc"))
    return docs.sparkSession.sql(
        f"""SELECT {names}, p.key AS partner_domain, r.key AS interface_row_key, r.value AS payload
            FROM {{docs}}, LATERAL variant_explode(doc) AS p,
                 LATERAL variant_explode(CASE WHEN {IS_OBJECT.format("p.value")} THEN p.value END) AS r
            WHERE {IS_OBJECT.format("r.value")}""",
        docs=docs,
    )


def int_list(payload: Column, field: str) -> Column:
    """A payload's list as sorted distinct integers; what is not a list is null."""
    return F.sort_array(distinct_ints(payload, field))


def distinct_ints(payload: Column, field: str) -> Column:
    """The distinct integers of a payload's list: fractions are cut, texts of integers parsed, the rest dropped."""
    return F.array_distinct(F.array_compact(F.try_variant_get(payload, f"$.{field}", "array<int>")))


def residue_count(payload: Column, side: str) -> Column:
    """distinct residues of a side; its alignment columns stand in only where the residue field is missing or null."""
    residues = F.try_variant_get(payload, f"$.interface_residues_{side}", "variant")
    missing = residues.isNull() | F.is_variant_null(residues)
    columns = distinct_ints(payload, f"interface_msa_columns_{side}")
    return F.coalesce(F.size(F.when(missing, columns).otherwise(distinct_ints(payload, f"interface_residues_{side}"))), F.lit(0)).cast("int")


def pairs(payload: Column, field: str, first: str, second: str) -> Column:
    """A payload's list of pairs as array of struct; items that are not two integers are dropped."""
    items = F.try_variant_get(payload, f"$.{field}", "array<variant>")
    made = F.transform(items, lambda x: F.struct(F.try_variant_get(x, "$[0]", "int").alias(first), F.try_variant_get(x, "$[1]", "int").alias(second)))
    return F.filter(made, lambda x: x[first].isNotNull() & x[second].isNotNull())


def interface_rows(flat: DataFrame, keys: list[str]) -> DataFrame:
    """S4 without numbering: one row per interface with its key parts, sizes and cleaned lists."""
    payload, key = F.col("payload"), F.col("interface_row_key")
    empty = F.array().cast("array<int>")
    return flat.select(
        *keys,
        "partner_domain",
        "interface_row_key",
        key_part(key, 1).alias("protein_id"),
        key_part(key, 2).alias("fragment_key"),
        key_part(key, 3).alias("partner_fragment_key"),
        F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(payload, "$.aligned_seq", "variant")) == "STRING", F.try_variant_get(payload, "$.aligned_seq", "string")), F.lit("")).alias("aligned_seq"),
        residue_count(payload, "a").alias("interface_size_a"),
        residue_count(payload, "b").alias("interface_size_b"),
        *[F.coalesce(int_list(payload, f), empty).alias(f) for f in LISTS],
        F.coalesce(pairs(payload, "residue_contacts", "a", "b"), F.array().cast("array<struct<a:int,b:int>>")).alias("residue_contacts"),
        F.coalesce(pairs(payload, "fragments_b", "s", "e"), F.array().cast("array<struct<s:int,e:int>>")).alias("fragments_b"),
    )


def numbered_rows(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``row_order`` from 0 in the order of partner and row key, over the whole input or within each ``by``.

    Sources are numbered on from each other and then shifted to begin at 0, so a large one is no window of one task. The
    rows are written first: numbering goes through them twice, and parsing them once is enough.
    """
    out = numbered(written(rows, "unnumbered"), [*(by or []), "partner_domain", "interface_row_key"], "row_order")
    if not by:
        return out
    out = written(out, "numbered")
    first = out.groupBy(*by).agg(F.min("row_order").alias("__first"))
    return out.join(first, by).withColumn("row_order", F.col("row_order") - F.col("__first")).select(*rows.columns, "row_order")


def load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files to numbered interface rows with path and family."""
    return numbered_rows(interface_rows(flatten(read_documents(spark, paths), ["path", "family"]), ["path", "family"]))


def alignment_length(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row, the longest sequence or the largest column plus one, 0 for no rows; or ``by``, with the number of rows ``n``."""
    last = F.greatest(F.length("aligned_seq"), F.array_max(F.concat("interface_msa_columns_a", "surface_msa_columns_a")) + 1)
    longest = F.coalesce(F.max(last), F.lit(0)).alias("alignment_length")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), longest) if by else rows.agg(longest)
