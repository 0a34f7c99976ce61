"""Structure files and model predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import file_stem
from ..functions.text import residue_letter, variant_text


def read_pdb(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line and text of structure files, in line order within a file."""
    whole = spark.read.text(paths, wholetext=True)
    lines = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return lines


def ca_coordinates(lines: DataFrame) -> DataFrame:
    """Path, residue_id, residue (one letter), x, y, z of the first CA atom of each residue.

    Fixed columns: atom name 13-16, residue name 18-20, residue number 23-26, coordinates 31-54; lines whose numbers do not
    parse are skipped.
    """
    t = F.col("text")
    cut = lambda a, n: F.trim(F.substring(t, a, n))
    atoms = lines.filter(t.rlike("^(ATOM  |HETATM)") & (cut(13, 4) == "CA")).select(
        "path",
        "line",
        cut(23, 4).try_cast("int").alias("residue_id"),
        residue_letter(cut(18, 3)).alias("residue"),
        *[cut(31 + 8 * k, 8).try_cast("double").alias(c) for k, c in enumerate("xyz")],
    )
    good = atoms.dropna(subset=["residue_id", "x", "y", "z"])
    first = Window.partitionBy("path", "residue_id").orderBy("line")
    return good.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "line")


def usable_models(lines: DataFrame) -> DataFrame:
    """Path and whether the file has an ATOM line and an END line."""
    return lines.groupBy("path").agg((F.bool_or(F.col("text").startswith("ATOM")) & F.bool_or(F.col("text").rlike("^END(MDL)?\\s*$"))).alias("usable"))


def read_predictions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Prediction documents that were fetched beforehand, one file an accession (its name's stem): accession, ordinal (place in
    the list), start, stop, entry and url (of the PDB file, else of the CIF file).

    Places that are no whole numbers are null, so the prediction is chosen only as an accession's first.
    """
    whole = spark.read.text(paths, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("accession"), F.try_parse_json("value").alias("d"))
    items = whole.select("accession", F.posexplode(F.try_variant_get("d", "$", "array<variant>")).alias("ordinal", "p"))
    place = lambda k: F.try_variant_get("p", f"$.{k}", "int")
    link = lambda k: F.nullif(variant_text(F.col("p"), f"$.{k}"), F.lit(""))
    return items.select("accession", "ordinal", place("uniprotStart").alias("start"), place("uniprotEnd").alias("stop"), variant_text(F.col("p"), "$.entryId").alias("entry"), F.coalesce(link("pdbUrl"), link("cifUrl")).alias("url"))


def choose_predictions(wanted: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Of each ``keys`` (with s and e) the first prediction whose range holds [s, e], else the first one.

    ``predictions`` has the keys, ``ordinal``, ``start``, ``stop`` and further columns. An equi-join on the
    keys and one aggregation: no range join.
    """
    rest = [c for c in predictions.columns if c not in keys]
    both = wanted.select(*keys, "s", "e").join(predictions, keys)
    holds = (F.col("start") <= F.col("s")) & (F.col("stop") >= F.col("e"))
    best = F.min_by(F.struct(*rest), F.struct((~F.coalesce(holds, F.lit(False))).alias("miss"), "ordinal"))
    return both.groupBy(*keys, "s", "e").agg(best.alias("p")).select(*keys, "s", "e", "p.*")
