"""Stand-in inputs derived from the driver's tables.

The reference reads TSV files of (id, question, program).  The test data
holds no such table, so ``programs`` shapes one row per order into that
schema: it only writes program text; every template, sample and metric is
computed later by the library from that text.  Each view also exists as
DuckDB SQL (``*_SQL``) so the oracle reads the same rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.operators.sampling import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixed values of the program fixture (FIXTURES.md §2).
PROPERTIES = ["name", "servesCuisine", "genre", "address.addressLocality", "brandName"]


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, domain, question, query): one synthetic program per order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    domain = (F.when(F.col("o_orderstatus") == "F", "restaurants")
               .when(F.col("o_orderstatus") == "O", "books").otherwise("hotels"))
    tname = (F.when(F.col("o_orderstatus") == "F", "Restaurant")
              .when(F.col("o_orderstatus") == "O", "Book").otherwise("Hotel"))
    prio = F.lower(F.col("o_orderpriority"))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    m = ok % 100
    shape = (F.when(m < 40, 0).when(m < 60, 1).when(m < 80, 2)
              .when(m < 92, 3).when(m < 98, 4).otherwise(5))
    extra = ck % 4
    n = (ck % 90 + 1).cast("string")
    prop = F.element_at(F.array(*[F.lit(p) for p in PROPERTIES]), (ck % 5 + 1).cast("int"))
    cond = F.concat(F.lit("param:"), prop, F.lit(":String "),
                    F.when(ck % 3 == 0, F.lit("==")).otherwise(F.lit("=~")),
                    F.lit(' " '), prio, F.lit(' "'))
    cond = F.concat(cond,
                    F.when(extra >= 1, F.concat(F.lit(" and param:aggregateRating.ratingValue:Number >= "), n))
                     .otherwise(F.lit("")),
                    F.when(extra >= 2, F.lit(" and param:petsAllowed:Boolean == true")).otherwise(F.lit("")),
                    F.when(extra >= 3, F.lit(" or param:priceRange:Enum(cheap,luxury) == enum:cheap"))
                     .otherwise(F.lit("")))
    table_ = F.concat(F.lit("( @org.schema."), tname, F.lit("."), tname, F.lit(" )"))
    body = (F.when(shape == 0, F.concat(table_, F.lit(" filter "), cond))
             .when(shape == 1, F.concat(table_, F.lit(" filter not "), cond))
             .when(shape == 2, F.concat(F.lit("[ param:telephone:String ] of ( "), table_,
                                        F.lit(" filter "), cond, F.lit(" )")))
             .when(shape == 3, F.concat(F.lit("aggregate count of ( "), table_, F.lit(" filter "), cond, F.lit(" )")))
             .when(shape == 4, F.concat(F.lit("( sort param:datePublished:Date desc of ( "), table_,
                                        F.lit(" filter "), cond, F.lit(" ) )")))
             .otherwise(F.concat(table_, F.lit(" filter param:datePublished:Date >= new Date ( 2020 , 1 , "),
                                 n, F.lit(" ) - "), n, F.lit(" unit:day"))))
    return o.select(
        F.concat(domain, F.lit("-"), ok.cast("string")).alias("example_id"),
        domain.alias("domain"),
        F.concat(F.lit("show "), domain, F.lit(" "), prio, F.lit(" "), ck.cast("string")).alias("question"),
        F.concat(F.lit("now => "), body, F.lit(" => notify")).alias("query"),
        shape.alias("shape"), extra.cast("int").alias("extra"),
    )


PROGRAMS_SQL = """
programs AS (
  SELECT domain || '-' || CAST(o_orderkey AS VARCHAR) AS example_id, domain,
         'show ' || domain || ' ' || prio || ' ' || CAST(o_custkey AS VARCHAR) AS question,
         'now => ' || CASE shape
            WHEN 0 THEN tbl || ' filter ' || cond
            WHEN 1 THEN tbl || ' filter not ' || cond
            WHEN 2 THEN '[ param:telephone:String ] of ( ' || tbl || ' filter ' || cond || ' )'
            WHEN 3 THEN 'aggregate count of ( ' || tbl || ' filter ' || cond || ' )'
            WHEN 4 THEN '( sort param:datePublished:Date desc of ( ' || tbl || ' filter ' || cond || ' ) )'
            ELSE tbl || ' filter param:datePublished:Date >= new Date ( 2020 , 1 , ' || n || ' ) - ' || n || ' unit:day'
         END || ' => notify' AS query, shape, CAST(extra AS INTEGER) AS extra
  FROM (
    SELECT *, 'param:' || prop || ':String ' || CASE WHEN o_custkey % 3 = 0 THEN '==' ELSE '=~' END
              || ' " ' || prio || ' "'
              || CASE WHEN extra >= 1 THEN ' and param:aggregateRating.ratingValue:Number >= ' || n ELSE '' END
              || CASE WHEN extra >= 2 THEN ' and param:petsAllowed:Boolean == true' ELSE '' END
              || CASE WHEN extra >= 3 THEN ' or param:priceRange:Enum(cheap,luxury) == enum:cheap' ELSE '' END AS cond,
           '( @org.schema.' || tname || '.' || tname || ' )' AS tbl
    FROM (
      SELECT o_orderkey, o_custkey,
             CASE o_orderstatus WHEN 'F' THEN 'restaurants' WHEN 'O' THEN 'books' ELSE 'hotels' END AS domain,
             CASE o_orderstatus WHEN 'F' THEN 'Restaurant' WHEN 'O' THEN 'Book' ELSE 'Hotel' END AS tname,
             lower(o_orderpriority) AS prio,
             CASE WHEN o_orderkey % 100 < 40 THEN 0 WHEN o_orderkey % 100 < 60 THEN 1
                  WHEN o_orderkey % 100 < 80 THEN 2 WHEN o_orderkey % 100 < 92 THEN 3
                  WHEN o_orderkey % 100 < 98 THEN 4 ELSE 5 END AS shape,
             o_custkey % 4 AS extra,
             CAST(o_custkey % 90 + 1 AS VARCHAR) AS n,
             ['name', 'servesCuisine', 'genre', 'address.addressLocality', 'brandName'][o_custkey % 5 + 1] AS prop
      FROM orders) b) c)
"""


def eval_program_filter(shape="shape", extra="extra"):
    """Rows whose templates make up the held-out compositional set."""
    return ((F.col(shape).isin(2, 4) & (F.col(extra) == 3)) | ((F.col(shape) == 3) & (F.col(extra) == 2)))


EVAL_FILTER_SQL = "((shape IN (2, 4) AND extra = 3) OR (shape = 3 AND extra = 2))"


def token_id(t):
    """Fixture token ids: '<s>' 1, '</s>' 2, others from md5 (>= 3)."""
    return (F.when(t == "<s>", F.lit(1).cast("long")).when(t == "</s>", F.lit(2).cast("long"))
             .otherwise(F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long") + 3))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in model output, one row per order: gold = <s> program tokens
    </s>; predicted = gold without <s>, minus its first token when
    o_orderkey % 7 = 0, plus one token when % 11 = 0, without </s> when
    % 13 = 0.  Every 17th example has no gold (has_gold false)."""
    p = spread(programs(spark, sf_dir), "example_id")  # token ids and scores are the work, not the scan
    ok = F.col("o_orderkey")
    p = p.withColumn("o_orderkey", F.split(F.col("example_id"), "-", 2).getItem(1).cast("long"))
    gold = F.concat(F.array(F.lit("<s>")), F.split(F.col("query"), " "), F.array(F.lit("</s>")))
    pred = F.slice(gold, 2, F.size(gold) - 1)
    pred = F.when(ok % 7 == 0, F.slice(pred, 2, F.size(pred) - 1)).otherwise(pred)
    pred = F.when(ok % 11 == 0, F.concat(pred, F.array(F.lit("notify")))).otherwise(pred)
    pred = F.when(ok % 13 == 0, F.filter(pred, lambda x: x != "</s>")).otherwise(pred)
    out = p.select("example_id", "o_orderkey", F.col("question").alias("source"),
                   gold.alias("gold_tokens"), pred.alias("predicted_tokens"),
                   (ok % 17 != 0).alias("has_gold"))
    # a predicted token's id is that of the gold token it comes from (2 is </s> alone)
    ok = F.col("o_orderkey")
    ids = F.slice("gold_ids", 2, F.size("gold_ids") - 1)
    ids = F.when(ok % 7 == 0, F.slice("gold_ids", 3, F.size("gold_ids") - 2)).otherwise(ids)
    ids = F.concat(ids, F.when(ok % 11 == 0, F.array(token_id(F.lit("notify")))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("gold_ids", F.transform("gold_tokens", token_id))
    return out.withColumn("pred_ids", F.when(ok % 13 == 0, F.filter(ids, lambda x: x != 2)).otherwise(ids))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four beam candidates per example: rank r keeps all but the last r
    predicted ids and pads with r zeros; log_prob = -((o_orderkey*7 + r*3) % 17)."""
    p = predictions(spark, sf_dir)
    p = p.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(3))))
    ids = F.concat(F.slice("pred_ids", 1, F.greatest(F.size("pred_ids") - F.col("rank"), F.lit(0))),
                   F.array_repeat(F.lit(0).cast("long"), F.col("rank")))
    return p.select("example_id", F.col("rank").cast("int").alias("rank"), ids.alias("token_ids"),
                    (-((F.col("o_orderkey") * 7 + F.col("rank") * 3) % 17)).cast("double").alias("log_prob"))


def _tid_sql(t):
    return (f"CASE WHEN {t} = '<s>' THEN 1 WHEN {t} = '</s>' THEN 2 "
            f"ELSE ('0x' || substr(md5({t}), 1, 6))::BIGINT + 3 END")


PREDICTIONS_SQL = f"""
preds AS (
  SELECT example_id, o_orderkey, source, gold_tokens, predicted_tokens, has_gold,
         list_transform(gold_tokens, lambda t: {_tid_sql('t')}) AS gold_ids,
         list_transform(predicted_tokens, lambda t: {_tid_sql('t')}) AS pred_ids
  FROM (
    SELECT example_id, o_orderkey, source, gold_tokens, o_orderkey % 17 <> 0 AS has_gold,
           CASE WHEN o_orderkey % 13 = 0 THEN list_filter(p2, lambda x: x <> '</s>') ELSE p2 END AS predicted_tokens
    FROM (
      SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN list_append(p1, 'notify') ELSE p1 END AS p2
      FROM (
        SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN p0[2:] ELSE p0 END AS p1
        FROM (
          SELECT example_id, CAST(split_part(example_id, '-', 2) AS BIGINT) AS o_orderkey, question AS source,
                 list_concat(['<s>'], string_split(query, ' '), ['</s>']) AS gold_tokens,
                 list_concat(string_split(query, ' '), ['</s>']) AS p0
          FROM programs) a) b) c) d)
"""

CANDIDATES_SQL = """
cands AS (
  SELECT example_id, CAST(r AS INTEGER) AS rank,
         list_concat(pred_ids[1:greatest(len(pred_ids) - r, 0)], list_resize([]::BIGINT[], r, 0)) AS token_ids,
         CAST(-((o_orderkey * 7 + r * 3) % 17) AS DOUBLE) AS log_prob
  FROM preds, range(4) t(r))
"""
