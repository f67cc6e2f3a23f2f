"""Pool building on a stream of new program rows.

Templating and the anti-join against a static set of held-out templates
are stateless, so they run unchanged in Structured Streaming: each
micro-batch gets its abstract (and typed) templates and loses rows whose
template is held out.  Samplers need the whole pool and stay batch jobs
over the table this stream appends to.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates as T


def templated_stream(stream: DataFrame, eval_templates: DataFrame, program_col: str = "query",
                     template_col: str = "abstract_template") -> DataFrame:
    """Streaming DataFrame -> same rows + templates, held-out templates removed
    (stream-static left anti join)."""
    s = stream.withColumn(template_col, T.template_abstract(F.col(program_col)))
    s = s.withColumn("template", T.template_typed(F.col(program_col)))
    return s.join(eval_templates.select(template_col).distinct(), template_col, "left_anti")


def run_pool_stream(spark: SparkSession, source_dir: str, schema, eval_templates: DataFrame,
                    sink_dir: str, checkpoint_dir: str, available_now: bool = True, program_col: str = "query"):
    """Read parquet files as they arrive in ``source_dir`` and append the
    templated pool to ``sink_dir`` (exactly-once through the checkpoint).
    Returns the started query."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    out = templated_stream(stream, eval_templates, program_col)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
