"""Delimited-text and JSON-lines readers/writers.

Programs are full of double quotes, and pandas writes an embedded quote as
two quotes; ``escape='"'`` reads that back (Spark's default escape ``\\``
would leave the quotes doubled).  Columns are always read as strings
(never inferred: ids such as ``001`` stay text).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CSV = {"sep": "\t", "quote": '"', "escape": '"'}


def _reader(spark: SparkSession, header: bool):
    r = spark.read.option("header", header).option("inferSchema", False)
    for k, v in _CSV.items():
        r = r.option(k, v)
    return r


def read_pairs(spark: SparkSession, path, question_col: int = 1, query_col: int = 2,
               id_col: int | None = 0) -> DataFrame:
    """Headerless TSV -> (example_id, question, query, *other positional
    columns as c<k>).  Without an id column (None) the id is the row's place,
    as text, over all files and their splits (``read_numbered``)."""
    if id_col is None:
        from .shards import read_numbered
        names = {question_col: "question", query_col: "query"}
        rows = read_numbered(_reader(spark, False).csv, path, "example_id")
        return rows.select(F.col("example_id").cast("string").alias("example_id"),
                           *[F.col(f"_c{i}").alias(names.get(i, f"c{i}")) for i in range(len(rows.columns) - 1)])
    df = _reader(spark, False).csv(path)
    names = {id_col: "example_id", question_col: "question", query_col: "query"}
    return df.select(*[F.col(f"_c{i}").alias(names.get(i, f"c{i}")) for i in range(len(df.columns))])


def read_eval_templates(spark: SparkSession, paths, template_index: int = 5,
                        out_col: str = "abstract_template") -> DataFrame:
    """Distinct template column (6th by default) of the evaluation files."""
    df = _reader(spark, False).csv(list(paths) if not isinstance(paths, str) else paths)
    return df.select(F.col(f"_c{template_index}").alias(out_col)).distinct()


def read_splits(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """The split table, with or without a header row (tab is fixed)."""
    return _reader(spark, header).csv(path)


def write_pool(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", positional: bool = False) -> None:
    """Pool with header, no index; parquet by default, TSV on request.  With
    ``positional`` id, question and query are named by their places in the
    header ("0", "1", "2"), as trainer configurations expect them."""
    if positional:
        places = {"example_id": "0", "question": "1", "query": "2"}
        df = df.select(*[F.col(f"`{c}`").alias(places.get(c, c)) for c in df.columns])
    w = df.write.mode(mode)
    if fmt == "tsv":
        for k, v in _CSV.items():
            w = w.option(k, v)
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_splits(assignments: DataFrame, path: str, pool: DataFrame | None = None, id_col: str = "example_id",
                 split_names: list[str] | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Long assignments partitioned by split (parquet, partition pruning on
    ``split_name``), or the wide table (one label column per split, empty
    cell for unlabelled rows) as TSV when ``fmt='tsv'``."""
    if fmt == "tsv":
        from ..operators.splits import pivot_labels
        wide = pivot_labels(pool, assignments, id_col, split_names)
        write_pool(wide, path, "tsv", mode)
    else:
        assignments.write.mode(mode).partitionBy("split_name").parquet(path)


PREDICTION_SCHEMA = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("source_tokens", T.ArrayType(T.StringType())),
    T.StructField("target_tokens", T.ArrayType(T.StringType())),
    T.StructField("predicted_tokens", T.ArrayType(T.StringType())),
    T.StructField("predictions", T.ArrayType(T.LongType())),
    T.StructField("log_probabilities", T.DoubleType()),
    T.StructField("correct", T.BooleanType()),
])

HEAVY_FIELDS = ("decoder_logits",)
FILTER_DROPPED = ("decoder_logits", "predicted_tokens", "predictions")


def read_predictions(spark: SparkSession, path, schema: T.StructType = PREDICTION_SCHEMA) -> DataFrame:
    """JSON-lines prediction records with a fixed schema."""
    return spark.read.schema(schema).json(path)


def write_predictions(df: DataFrame, path: str, filter_mode: bool = False, mode: str = "overwrite") -> None:
    """JSON lines; heavy fields are dropped first (in filter mode also the
    predicted tokens and ids, leaving the id and the ``correct`` flag)."""
    drop = FILTER_DROPPED if filter_mode else HEAVY_FIELDS
    df.drop(*[c for c in drop if c in df.columns]).write.mode(mode).json(path)
