"""Helpers shared by the operators of this folder."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.session import ensure_checkpoint_dir

#: ASCII white space that separates words, as a Java character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers (what ``--py-files``
    does), so that they import it wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="splitcraft-src-"), "splitcraft_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("splitcraft", os.path.relpath(full, package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; it may be a file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, a null text as the empty one.  Other
    columns, also ones named like an operator's own, never get further."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of id and text that tells rows apart, also those with one id."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder that the session names
    (``spark.checkpoint.dir``) and read it back: the lineage ends there, a
    lost executor costs no more than its running tasks, and later reads see
    only the columns they need."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
