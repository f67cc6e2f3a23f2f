import os

from pyspark.sql import functions as F

from splitcraft.functions import templates as T
from splitcraft.plans.fixtures import programs
from splitcraft.streaming.pool_stream import run_pool_stream
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    progs = programs(spark, SF_SMALL).select("example_id", "query", "shape", "extra")
    progs.write.parquet(src)
    evalt = (progs.where("shape = 3").select(T.template_abstract(F.col("query")).alias("abstract_template"))
                  .distinct())
    q = run_pool_stream(spark, src, progs.schema, evalt, os.path.join(tmp_dir, "sink"),
                        os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(tmp_dir, "sink"))
    want = (progs.withColumn("abstract_template", T.template_abstract(F.col("query")))
                 .join(evalt, "abstract_template", "left_anti"))
    assert got.count() == want.count() > 0
    assert got.select("example_id").subtract(want.select("example_id")).count() == 0
