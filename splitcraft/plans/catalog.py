"""Registered queries: each has a Spark plan over the driver tables and, when
SQL can state it, a DuckDB oracle over the same parquet views.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, sql_text | None)``
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates as T
from ..functions.text import ascii_fold, ascii_fold_sql
from ..operators import splits as S
from ..operators.joins import template_join
from ..operators.sampling import spread
from ..operators.templating import exclude_eval_templates, with_abstract_template
from . import sqlgen as Q
from ..session import materialize
from ..sources import tsv as TSV
from .fixtures import EVAL_FILTER_SQL, eval_program_filter, programs, table

QUERIES: dict = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared Spark inputs
# ---------------------------------------------------------------------------
def templated_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_abstract_template(programs(spark, sf_dir), "query", id_col="example_id")


def training_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs minus rows whose abstract template is held out (CLI
    ``--create_training_pool``)."""
    t = materialize(templated_programs(spark, sf_dir))
    evalt = t.where(eval_program_filter()).select("abstract_template").distinct()
    return exclude_eval_templates(t, evalt)


# ---------------------------------------------------------------------------
# 2.8 template scalars
# ---------------------------------------------------------------------------
def _level_query(level: str, fn):
    def q(spark, sf_dir):
        p = spread(programs(spark, sf_dir), "example_id")
        return p.select("example_id", fn(F.col("query")).alias(level))
    sql = Q.with_programs() + f" SELECT example_id, {T.template_sql(level, 'query')} AS {level} FROM programs"
    register(level, sql)(q)


_level_query("template_typed", T.template_typed)
_level_query("template_schemafree", lambda c: T.template_schemafree(T.template_typed(c)))
_level_query("template_untyped", T.template_untyped)
_level_query("template_noops", lambda c: T.template_noops(T.template_untyped(c)))
_level_query("template_abstract", T.template_abstract)


@register("fold_value_arithmetic",
          Q.with_programs() + " SELECT example_id, "
          + T._fold_sql(T.steps_sql(ascii_fold_sql("coalesce(query, 'nan')"), T.UNTYPED_VALUE_STEPS[:-1]))
          + " AS folded FROM programs")
def q_fold(spark, sf_dir):
    p = spread(programs(spark, sf_dir), "example_id")
    pre = T.apply_steps(ascii_fold(F.coalesce(F.col("query"), F.lit("nan"))), T.UNTYPED_VALUE_STEPS[:-1])
    return p.select("example_id", T.fold_value_arithmetic(pre).alias("folded"))


@register("ascii_fold", f"SELECT doc_id, {ascii_fold_sql('text')} AS folded FROM documents")
def q_ascii_fold(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", ascii_fold(F.col("text")).alias("folded"))


# ---------------------------------------------------------------------------
# pool building (CLI steps 2-3)
# ---------------------------------------------------------------------------
@register("exclude_eval_templates",
          Q.with_programs(Q.TEMPLATED, Q.EVAL_TEMPLATES, Q.POOL)
          + " SELECT example_id, abstract_template FROM pool")
def q_exclude_eval(spark, sf_dir):
    return training_pool(spark, sf_dir).select("example_id", "abstract_template")


# ---------------------------------------------------------------------------
# 2.9 samplers / split builders
# ---------------------------------------------------------------------------
UAT_ALPHAS = [-1, -0.5, 0]
UAT_SIZES = [60, 1000]
UAT_DEV_SHARE = 0.20
UAT_SPECS = S.uat_specs(UAT_ALPHAS, UAT_SIZES, 5)


def _uat_sql(specs, dev_share):
    return Q.with_programs(
        Q.TEMPLATED, Q.EVAL_TEMPLATES, Q.POOL, Q.specs_values(specs),
        "cnt AS (SELECT abstract_template, count(*) AS cnt FROM pool GROUP BY abstract_template)",
        "freq AS (SELECT abstract_template, cnt / sum(cnt) OVER () AS freq FROM cnt)",
        "src AS (SELECT p.*, f.freq FROM pool p JOIN freq f USING (abstract_template))",
        *Q.sample_and_label_sql("src", "pow(s.freq, x.alpha)", dev_share),
    ) + " SELECT split_name, example_id, label FROM final"


@register("uat_splits", _uat_sql(UAT_SPECS, UAT_DEV_SHARE))
def q_uat(spark, sf_dir):
    pool = training_pool(spark, sf_dir)
    return S.uat_splits(pool, "example_id", "abstract_template", "query", UAT_ALPHAS, UAT_SIZES,
                        replicates=5, dev_share=UAT_DEV_SHARE)


CLI_SPECS = S.uat_specs([-1], [20], 5)


@register("uat_cli", _uat_sql(CLI_SPECS, 0.20))
def q_uat_cli(spark, sf_dir):
    """The split CLI end to end: templates -> held-out anti join -> freq ->
    weighted sample (alpha -1, 20 rows, 5 replicates) -> 20 % dev ->
    coverage fix -> long labels."""
    pool = training_pool(spark, sf_dir)
    return S.uat_splits(pool, "example_id", "abstract_template", "query", [-1], [20],
                        replicates=5, dev_share=0.20)


# ---------------------------------------------------------------------------
# 2.3 / 2.4 / 2.7 template-level relational operators
# ---------------------------------------------------------------------------
from ..functions.templates import MUST_TRAIN_TEMPLATES  # noqa: E402
from ..operators import templating as TP  # noqa: E402
from ..operators.sampling import template_counts  # noqa: E402

POOL_CTES = (Q.TEMPLATED, Q.EVAL_TEMPLATES, Q.POOL)
MUST_TRAIN_SQL = "must(abstract_template) AS (VALUES " + ", ".join(f"({Q.sql_str(t)})" for t in MUST_TRAIN_TEMPLATES) + ")"


@register("template_freq", Q.with_programs(*POOL_CTES) +
          " SELECT abstract_template, count(*) AS cnt, count(*) / sum(count(*)) OVER () AS freq "
          "FROM pool GROUP BY abstract_template")
def q_template_freq(spark, sf_dir):
    return template_counts(training_pool(spark, sf_dir), "abstract_template")


@register("attach_template_freq", Q.with_programs(*POOL_CTES,
          "f AS (SELECT abstract_template, count(*) / sum(count(*)) OVER () AS freq FROM pool GROUP BY 1)") +
          " SELECT p.example_id, f.freq FROM pool p LEFT JOIN f USING (abstract_template)")
def q_attach_freq(spark, sf_dir):
    return TP.attach_template_freq(training_pool(spark, sf_dir), "abstract_template").select("example_id", "freq")


SKEW_ALPHAS = [-1.0, -0.5, 0.0]


@register("skew_weight", Q.with_programs(*POOL_CTES,
          "f AS (SELECT abstract_template, count(*) / sum(count(*)) OVER () AS freq FROM pool GROUP BY 1)",
          "a(alpha) AS (VALUES " + ", ".join(f"(CAST({a!r} AS DOUBLE))" for a in SKEW_ALPHAS) + ")") +
          " SELECT f.abstract_template, a.alpha, pow(f.freq, a.alpha) AS weight FROM f, a")
def q_skew_weight(spark, sf_dir):
    f = template_counts(training_pool(spark, sf_dir), "abstract_template")
    f = f.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in SKEW_ALPHAS])))
    return f.select("abstract_template", "alpha", F.pow(F.col("freq"), F.col("alpha")).alias("weight"))


@register("examples_per_template", Q.with_programs(*POOL_CTES) +
          " SELECT abstract_template, count(query) AS examples FROM pool GROUP BY abstract_template")
def q_examples_per_template(spark, sf_dir):
    return TP.examples_per_template(training_pool(spark, sf_dir), "abstract_template")


@register("distinct_templates", Q.with_programs(*POOL_CTES) + " SELECT DISTINCT abstract_template FROM pool")
def q_distinct_templates(spark, sf_dir):
    return TP.distinct_templates(training_pool(spark, sf_dir), "abstract_template")


@register("template_difference", Q.with_programs(*POOL_CTES, MUST_TRAIN_SQL) +
          " SELECT DISTINCT abstract_template FROM pool EXCEPT SELECT abstract_template FROM must")
def q_template_difference(spark, sf_dir):
    must = spark.createDataFrame([(t,) for t in MUST_TRAIN_TEMPLATES], "abstract_template string")
    return TP.template_difference(training_pool(spark, sf_dir), must, "abstract_template")


@register("rows_with_templates", Q.with_programs(Q.TEMPLATED, Q.EVAL_TEMPLATES) +
          " SELECT example_id FROM templated t WHERE EXISTS "
          "(SELECT 1 FROM evalt e WHERE e.abstract_template = t.abstract_template)")
def q_rows_with_templates(spark, sf_dir):
    t = materialize(templated_programs(spark, sf_dir))
    evalt = t.where(eval_program_filter()).select("abstract_template").distinct()
    return TP.rows_with_templates(t, evalt, "abstract_template").select("example_id")


@register("union_all", Q.with_programs(Q.TEMPLATED, Q.EVAL_TEMPLATES) +
          " SELECT example_id, 'comp_test' AS part FROM templated WHERE shape = 2 AND extra = 3 "
          "UNION ALL SELECT example_id, 'comp_dev' AS part FROM templated WHERE shape = 4 AND extra = 3")
def q_union_all(spark, sf_dir):
    """Appends the two held-out evaluation files (test, dev) by name."""
    p = programs(spark, sf_dir)
    test = p.where((F.col("shape") == 2) & (F.col("extra") == 3)).select("example_id", F.lit("comp_test").alias("part"))
    dev = p.where((F.col("shape") == 4) & (F.col("extra") == 3)).select("example_id", F.lit("comp_dev").alias("part"))
    return test.unionByName(dev)


def leveled_pool(spark, sf_dir, columns=None):
    """Training pool with all four template levels (materialized once), or with
    ``columns`` alone: the written rows are read whole by every later pass, and
    levels that nobody reads are not computed."""
    p = TP.with_template_levels(programs(spark, sf_dir), "query", id_col="example_id")
    p = p.withColumn("abstract_template", F.col("template_kbfree_untyped_noops"))
    if columns:
        p = p.select(*dict.fromkeys([*columns, "abstract_template", "shape", "extra"]))
    p = materialize(p)
    evalt = p.where(eval_program_filter()).select("abstract_template").distinct()
    return exclude_eval_templates(p, evalt)


@register("distinct_children", Q.with_programs(*POOL_CTES, Q.LEVELED) +
          " SELECT 'template_kbfree_untyped_noops' AS level, template_kbfree_untyped_noops AS parent, "
          "count(DISTINCT template_kbfree_untyped) AS children FROM leveled GROUP BY 2 "
          "UNION ALL SELECT 'template_kbfree_untyped', template_kbfree_untyped, count(DISTINCT template_kbfree) "
          "FROM leveled GROUP BY 2 UNION ALL SELECT 'template_kbfree', template_kbfree, count(DISTINCT template) "
          "FROM leveled GROUP BY 2")
def q_distinct_children(spark, sf_dir):
    levels = S.HIERARCHY_LEVELS
    lv = leveled_pool(spark, sf_dir, levels)
    parts = [TP.distinct_children(lv, p, c).select(F.lit(p).alias("level"), F.col(p).alias("parent"), "children")
             for p, c in zip(levels[:-1], levels[1:])]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


HW_SQL = ("hw AS (SELECT c.template, c.cnt, 1.0 / c.cnt / k1.k / k2.k / k3.k / t.top AS hweight FROM "
          "(SELECT template_kbfree_untyped_noops, template_kbfree_untyped, template_kbfree, template, count(*) AS cnt "
          "FROM leveled GROUP BY ALL) c "
          "JOIN (SELECT template_kbfree_untyped_noops, count(DISTINCT template_kbfree_untyped) AS k FROM leveled GROUP BY 1) k1 "
          "USING (template_kbfree_untyped_noops) "
          "JOIN (SELECT template_kbfree_untyped, count(DISTINCT template_kbfree) AS k FROM leveled GROUP BY 1) k2 "
          "USING (template_kbfree_untyped) "
          "JOIN (SELECT template_kbfree, count(DISTINCT template) AS k FROM leveled GROUP BY 1) k3 USING (template_kbfree), "
          "(SELECT count(DISTINCT template_kbfree_untyped_noops) AS top FROM leveled) t)")


@register("hierarchy_weight_lookup", Q.with_programs(*POOL_CTES, Q.LEVELED, HW_SQL) +
          " SELECT l.example_id, hw.hweight FROM leveled l JOIN hw USING (template)")
def q_hierarchy_weights(spark, sf_dir):
    lv = leveled_pool(spark, sf_dir)
    hw = S.hierarchy_weights(lv)
    return template_join(lv, hw.select(*S.HIERARCHY_LEVELS, "hweight"), S.HIERARCHY_LEVELS).select("example_id", "hweight")


# ---------------------------------------------------------------------------
# vocabulary / coverage
# ---------------------------------------------------------------------------
from ..functions import vocab as V  # noqa: E402
from ..operators import coverage as C  # noqa: E402


@register("extract_properties", Q.with_programs() +
          f" SELECT DISTINCT example_id, unnest({V.extract_properties_sql('query')}) AS prop FROM programs")
def q_extract_properties(spark, sf_dir):
    p = spread(programs(spark, sf_dir), "example_id")
    return p.select("example_id", F.explode_outer(V.extract_properties(F.col("query"))).alias("prop")).where("prop IS NOT NULL")  # distinct per row, ids are unique


@register("property_vocab", Q.with_programs(*POOL_CTES) +
          f" SELECT DISTINCT unnest({V.extract_properties_sql('query')}) AS prop FROM pool")
def q_property_vocab(spark, sf_dir):
    pool = training_pool(spark, sf_dir)
    return pool.select(F.explode_outer(V.extract_properties(F.col("query"))).alias("prop")).where("prop IS NOT NULL").distinct()


@register("has_operator", Q.with_programs() +
          " SELECT example_id, strpos(query, ' not ') > 0 AS has_not, strpos(query, ' sort ') > 0 AS has_sort "
          "FROM programs")
def q_has_operator(spark, sf_dir):
    p = programs(spark, sf_dir)
    return p.select("example_id", V.has_operator("query", "not").alias("has_not"),
                    V.has_operator("query", "sort").alias("has_sort"))


@register("constants_used", Q.with_programs(*POOL_CTES) +
          f" SELECT DISTINCT unnest({V.operators_present_sql('query')}) AS op FROM pool")
def q_constants_used(spark, sf_dir):
    pool = training_pool(spark, sf_dir)
    return pool.select(F.explode(V.operators_present(F.col("query"))).alias("op")).distinct()


@register("remove_by_token", Q.with_programs(*POOL_CTES) +
          " SELECT example_id FROM pool WHERE strpos(query, ' ' || trim(' not ') || ' ') = 0")
def q_remove_by_token(spark, sf_dir):
    return C.remove_by_token(training_pool(spark, sf_dir), " not ", "query", "example_id").select("example_id")


@register("occurs_before", Q.with_programs() +
          " SELECT example_id, (strpos(query, 'filter') > 0 AND strpos(query, 'and') > 0 AND "
          "strpos(query, 'filter') < strpos(query, 'and')) AS filter_before_and FROM programs")
def q_occurs_before(spark, sf_dir):
    from ..functions.text import occurs_before
    p = programs(spark, sf_dir)
    return p.select("example_id", occurs_before("query", "filter", "and").alias("filter_before_and"))


# validate_and_fix on a hash split of the pool, one group per domain: evaluation
# rows are 10 % of shapes 0-1 plus every row of the rarer shapes (>= 2), so
# many use operators/properties the train rows (shapes 0-1) lack
VF_GROUP = ["domain"]


def _vf_labeled(spark, sf_dir):
    from ..functions.hashing import uniform
    pool = training_pool(spark, sf_dir)
    u = uniform(F.col("example_id"), 7, "vf", "eval")
    return pool.select("domain", "shape", "extra", "example_id", "query",
                       F.when((u < 0.1) | (F.col("shape") >= 2), 2).otherwise(1)
                        .cast("int").alias("label"))


def _vf_sql_ctes():
    from ..functions.hashing import uniform_sql
    u = uniform_sql("example_id", "7", "'vf'", "'eval'")
    return [*POOL_CTES,
            f"lab AS (SELECT domain, shape, extra, example_id, query, CASE WHEN {u} < 0.1 OR shape >= 2 THEN 2 ELSE 1 END AS label "
            "FROM pool)",
            f"voc AS (SELECT domain, shape, extra, example_id, label, unnest({V.program_vocab_sql('query')}) AS tok "
            "FROM lab)",
            "missing AS (SELECT DISTINCT domain, tok FROM voc WHERE label = 2 "
            "EXCEPT SELECT DISTINCT domain, tok FROM voc WHERE label = 1)"]


@register("validate_and_fix", Q.with_programs(*_vf_sql_ctes(),
          "bad AS (SELECT DISTINCT l.example_id FROM lab l JOIN missing m USING (domain) WHERE l.label = 2 "
          "AND strpos(l.query, ' ' || regexp_replace(m.tok, '^\\s+|\\s+$', '', 'g') || ' ') > 0)") +
          " SELECT domain, example_id, label FROM lab WHERE example_id NOT IN (SELECT example_id FROM bad)")
def q_validate_and_fix(spark, sf_dir):
    lab = _vf_labeled(spark, sf_dir)
    return C.validate_and_fix(lab, VF_GROUP, "example_id", "query").select(*VF_GROUP, "example_id", "label")


@register("validate_and_fix_strict", Q.with_programs(*_vf_sql_ctes(),
          "bad AS (SELECT v.example_id FROM voc v JOIN missing m USING (domain, tok) WHERE v.label = 2)") +
          " SELECT domain, example_id, label FROM lab WHERE example_id NOT IN (SELECT example_id FROM bad)")
def q_validate_and_fix_strict(spark, sf_dir):
    """Every evaluation row goes whose own vocabulary has a member unseen in train."""
    lab = _vf_labeled(spark, sf_dir)
    return C.validate_and_fix(lab, VF_GROUP, "example_id", "query", strict=True).select(*VF_GROUP, "example_id", "label")


@register("split_coverage", Q.with_programs(*_vf_sql_ctes()) +
          " SELECT domain, tok, CASE WHEN tok IN (" + ", ".join(Q.sql_str(o) for o in V.OPERATORS) +
          ") THEN 'operator' ELSE 'property' END AS kind FROM missing")
def q_split_coverage(spark, sf_dir):
    return C.split_coverage(_vf_labeled(spark, sf_dir), VF_GROUP, "query")


@register("vocab_difference", Q.with_programs(*_vf_sql_ctes()) + " SELECT domain, tok FROM missing")
def q_vocab_difference(spark, sf_dir):
    lab = C.with_vocab(_vf_labeled(spark, sf_dir), "query")
    return C.missing_tokens(lab.where("label = 2"), lab.where("label = 1"), VF_GROUP)


@register("is_subset", Q.with_programs(*_vf_sql_ctes()) +
          " SELECT g.domain, coalesce(m.n, 0) AS n_missing, coalesce(m.n, 0) = 0 AS ok FROM "
          "(SELECT DISTINCT domain FROM lab) g LEFT JOIN "
          "(SELECT domain, count(*) AS n FROM missing GROUP BY ALL) m USING (domain)")
def q_is_subset(spark, sf_dir):
    return C.coverage_flags(_vf_labeled(spark, sf_dir), VF_GROUP, "query")


@register("vocab_union", Q.with_programs(*POOL_CTES) +
          " SELECT DISTINCT tok FROM (SELECT unnest(" + V.extract_properties_sql("query") + ") AS tok FROM pool "
          "WHERE shape = 5 UNION ALL SELECT unnest(" + V.operators_present_sql("query") + ") FROM pool WHERE shape = 3)")
def q_vocab_union(spark, sf_dir):
    pool = training_pool(spark, sf_dir)
    a = pool.where("shape = 5").select(F.explode(V.extract_properties(F.col("query"))).alias("tok"))
    b = pool.where("shape = 3").select(F.explode(V.operators_present(F.col("query"))).alias("tok"))
    return a.union(b).distinct()


@register("missing_vocab_union", Q.with_programs(*_vf_sql_ctes()) + " SELECT DISTINCT tok FROM missing")
def q_missing_vocab_union(spark, sf_dir):
    """Properties and operators missing in some group's train rows, as one set."""
    missing = materialize(C.split_coverage(_vf_labeled(spark, sf_dir), VF_GROUP, "query"))
    return missing.where("kind = 'property'").select("tok").union(missing.where("kind = 'operator'").select("tok")).distinct()


# ---------------------------------------------------------------------------
# 2.9 samplers
# ---------------------------------------------------------------------------
from ..functions.hashing import uniform_sql  # noqa: E402
from ..operators import sampling as SM  # noqa: E402

UNIFORM_SPECS = [{"split_name": f"uniform_{n}", "n": n, "alpha": 0.0} for n in (60, 1000, 20000)]


@register("uniform_sample", Q.with_programs(Q.specs_values(UNIFORM_SPECS),
          f"keyed AS (SELECT x.split_name, x.n, s.example_id, -ln({uniform_sql('s.example_id', '0', 'x.split_name', chr(39) + 'draw' + chr(39))}) AS k FROM programs s, specs x)") +
          " SELECT split_name, example_id FROM " + Q.rank_cut_sql("keyed", "k", "example_id", "n", "split_name"))
def q_uniform_sample(spark, sf_dir):
    """Uniform samples of 60, 1000 and 20000 rows (clamped to the table)."""
    p = programs(spark, sf_dir).select("example_id", "query")
    return SM.uniform_sample(p, "example_id", UNIFORM_SPECS).select("split_name", "example_id")


EVENT_SPECS = [{"split_name": f"events_{i}", "n": 500, "alpha": -1.0} for i in range(3)]


@register("weighted_sample", "WITH " + ", ".join([
          Q.specs_values(EVENT_SPECS),
          "f AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS freq FROM events GROUP BY 1)",
          "src AS (SELECT e.event_id, f.freq FROM events e JOIN f USING (event_type))",
          f"keyed AS (SELECT x.split_name, x.n, s.event_id, -ln({uniform_sql('s.event_id', '0', 'x.split_name', chr(39) + 'draw' + chr(39))}) / pow(s.freq, x.alpha) AS k FROM src s, specs x)"]) +
          " SELECT split_name, event_id FROM " + Q.rank_cut_sql("keyed", "k", "event_id", "n", "split_name"))
def q_weighted_sample(spark, sf_dir):
    """Events drawn with weight p(event_type)^-1 (every type the same mass)."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    ev = TP.attach_template_freq(ev, "event_type").withColumn("w", F.pow(F.col("freq"), F.lit(-1.0)))
    return SM.weighted_sample(ev, "event_id", "w", EVENT_SPECS, class_col="event_type").select(
        "split_name", "event_id")


TDS_SPECS = [{"split_name": f"tds_{n}", "n": n, "alpha": 0.0} for n in (100, 1000)]


@register("train_dev_split", Q.with_programs(Q.specs_values(TDS_SPECS),
          *Q.sample_and_label_sql("programs", "1.0", 0.05)[:3]) + " SELECT split_name, example_id, label FROM lab")
def q_train_dev_split(spark, sf_dir):
    p = programs(spark, sf_dir).select("example_id", "query")
    smp = SM.uniform_sample(p, "example_id", TDS_SPECS)
    return SM.train_dev_split(smp, ["split_name"], "example_id", 0.05).select("split_name", "example_id", "label")


UNIFORM_SPLIT_SPECS = [{"split_name": S.split_name(s, i, False), "n": s, "alpha": 0.0}
                       for s in (60, 1000) for i in range(5)]


@register("uniform_splits", Q.with_programs(*POOL_CTES, Q.specs_values(UNIFORM_SPLIT_SPECS),
          *Q.sample_and_label_sql("pool", "1.0", 0.05)) + " SELECT split_name, example_id, label FROM final")
def q_uniform_splits(spark, sf_dir):
    return S.uniform_splits(training_pool(spark, sf_dir), "example_id", "query", sizes=(60, 1000),
                            replicates=5, dev_share=0.05)


HIER_SPECS = [{"split_name": S.split_name(-2, s, i, False), "n": s, "alpha": 0.0} for s in (60, 1000) for i in range(5)]


@register("hierarchical_splits", Q.with_programs(*POOL_CTES, Q.LEVELED, HW_SQL, Q.specs_values(HIER_SPECS),
          "src AS (SELECT l.example_id, l.query, hw.hweight FROM leveled l JOIN hw USING (template))",
          *Q.sample_and_label_sql("src", "s.hweight", 0.05)) + " SELECT split_name, example_id, label FROM final")
def q_hierarchical_splits(spark, sf_dir):
    return S.hierarchical_splits(leveled_pool(spark, sf_dir), "example_id", "query", sizes=(60, 1000),
                                 replicates=5, dev_share=0.05)


def _cli_assignments(spark, sf_dir):
    pool = training_pool(spark, sf_dir)
    return pool, S.uat_splits(pool, "example_id", "abstract_template", "query", [-1], [20],
                              replicates=5, dev_share=0.20)


CLI_CTES = (*POOL_CTES, Q.specs_values(CLI_SPECS),
            "cnt AS (SELECT abstract_template, count(*) AS cnt FROM pool GROUP BY abstract_template)",
            "freq AS (SELECT abstract_template, cnt / sum(cnt) OVER () AS freq FROM cnt)",
            "src AS (SELECT p.*, f.freq FROM pool p JOIN freq f USING (abstract_template))",
            *Q.sample_and_label_sql("src", "pow(s.freq, x.alpha)", 0.20))
CLI_NAMES = [s["split_name"] for s in CLI_SPECS]


@register("attach_labels", Q.with_programs(*CLI_CTES) + " SELECT p.example_id, " + ", ".join(
          f"max(CASE WHEN f.split_name = {Q.sql_str(n)} THEN f.label END) AS \"{n}\"" for n in CLI_NAMES) +
          " FROM pool p LEFT JOIN final f USING (example_id) GROUP BY p.example_id")
def q_attach_labels(spark, sf_dir):
    """Wide label table: one nullable label column per CLI split."""
    pool, a = _cli_assignments(spark, sf_dir)
    return S.pivot_labels(pool.select("example_id"), a, "example_id", CLI_NAMES)


@register("sampled_any", Q.with_programs(*CLI_CTES) +
          " SELECT example_id FROM pool WHERE example_id IN (SELECT example_id FROM final)")
def q_sampled_any(spark, sf_dir):
    pool, a = _cli_assignments(spark, sf_dir)
    return S.sampled_any(pool, a, "example_id").select("example_id")


@register("remove_used", Q.with_programs(*CLI_CTES) +
          " SELECT example_id FROM pool WHERE example_id NOT IN (SELECT example_id FROM final)")
def q_remove_used(spark, sf_dir):
    pool, a = _cli_assignments(spark, sf_dir)
    return pool.join(a.select("example_id"), "example_id", "left_anti").select("example_id")


@register("split_sizes", _uat_sql(UAT_SPECS, UAT_DEV_SHARE).replace(
          " SELECT split_name, example_id, label FROM final",
          " SELECT split_name, label, count(*) AS rows FROM final GROUP BY ALL"))
def q_split_sizes(spark, sf_dir):
    return S.split_sizes(q_uat(spark, sf_dir))


TWO_PHASE_N = 600
TWO_PHASE_E = 0.0


def _two_phase_sql(n, e):
    u_row = uniform_sql("example_id", "0", "'two_phase'", "'row'")
    u_gap = uniform_sql("example_id", "0", "'two_phase'", "'gap'")
    return Q.with_programs(
        *POOL_CTES,
        "c AS (SELECT abstract_template, count(*) AS c FROM pool GROUP BY 1)",
        f"pre AS (SELECT p.example_id, p.abstract_template, c.c, row_number() OVER (PARTITION BY p.abstract_template "
        f"ORDER BY {u_row}, p.example_id) - 1 AS j FROM pool p JOIN c USING (abstract_template))",
        f"arr AS (SELECT example_id, sum(-ln({u_gap}) / pow(CAST(c - j AS DOUBLE), {float(e)!r})) OVER "
        f"(PARTITION BY abstract_template ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS arrival "
        f"FROM pre WHERE j < {n})") + " SELECT example_id FROM " + Q.rank_cut_sql("arr", "arrival", "example_id", str(n))


@register("two_phase_sample", _two_phase_sql(TWO_PHASE_N, TWO_PHASE_E))
def q_two_phase(spark, sf_dir):
    """Template drawn with probability (remaining rows)^0, then a uniform row
    of it, 600 times (closed form with arrival times)."""
    pool = training_pool(spark, sf_dir).select("example_id", "abstract_template")
    return SM.two_phase_sample(pool, "example_id", "abstract_template", TWO_PHASE_N, TWO_PHASE_E).select("example_id")


CAP_N = 1000


@register("cap_per_template", Q.with_programs(*POOL_CTES,
          "g AS (SELECT abstract_template, count(query) AS gsize FROM pool GROUP BY 1)") +
          " SELECT example_id FROM (SELECT p.example_id, g.gsize, row_number() OVER (PARTITION BY p.abstract_template "
          f"ORDER BY {uniform_sql('p.example_id', '42', 'p.abstract_template', chr(39) + 'cap' + chr(39))}, p.example_id) AS rn "
          f"FROM pool p JOIN g USING (abstract_template)) WHERE gsize <= {CAP_N} OR rn <= {CAP_N}")
def q_cap_per_template(spark, sf_dir):
    """At most 1,000 rows per template (seed 42); rarer templates whole."""
    pool = training_pool(spark, sf_dir)
    return SM.cap_per_group(pool, ["abstract_template"], "example_id", CAP_N, seed=42,
                            count_col="query").select("example_id")


COMP_TEST, COMP_DEV, COMP_IID = 0.2, 0.2, 0.05


def _comp_sql():
    u_t = uniform_sql("abstract_template", "0", "'compositional'", "'template'")
    u_it = uniform_sql("example_id", "0", "'compositional'", "'iid_test'")
    u_id = uniform_sql("example_id", "0", "'compositional'", "'iid_dev'")
    ceil_t = f"ceil({COMP_TEST!r} * T)"
    return Q.with_programs(
        Q.TEMPLATED, MUST_TRAIN_SQL,
        "tm AS (SELECT DISTINCT abstract_template FROM templated WHERE abstract_template NOT IN (SELECT * FROM must))",
        f"tr AS (SELECT abstract_template, row_number() OVER (ORDER BY {u_t}, abstract_template) AS rk, "
        "count(*) OVER () AS T FROM tm)",
        f"roles AS (SELECT abstract_template, CASE WHEN rk <= {ceil_t} THEN 'comp_test' "
        f"WHEN rk <= {ceil_t} + ceil({COMP_DEV!r} * (T - {ceil_t})) THEN 'comp_dev' END AS role FROM tr)",
        "r0 AS (SELECT t.example_id, t.query, coalesce(r.role, 'train') AS role FROM templated t "
        "LEFT JOIN roles r USING (abstract_template))",
        f"t1 AS (SELECT example_id, row_number() OVER (ORDER BY {u_it}, example_id) AS rk, count(*) OVER () AS N "
        "FROM r0 WHERE role = 'train')",
        f"it AS (SELECT example_id, N FROM t1 WHERE rk <= ceil({COMP_IID!r} * N))",
        f"t2 AS (SELECT t1.example_id, t1.N, row_number() OVER (ORDER BY {u_id}, example_id) AS rk FROM t1 "
        "WHERE example_id NOT IN (SELECT example_id FROM it))",
        f"idv AS (SELECT example_id FROM t2 WHERE rk <= ceil({COMP_IID!r} * (N - ceil({COMP_IID!r} * N))))",
        "r1 AS (SELECT r0.example_id, r0.query, CASE WHEN it.example_id IS NOT NULL THEN 'iid_test' "
        "WHEN idv.example_id IS NOT NULL THEN 'iid_dev' ELSE r0.role END AS role FROM r0 "
        "LEFT JOIN it USING (example_id) LEFT JOIN idv USING (example_id))",
        f"voc AS (SELECT example_id, role, unnest({V.program_vocab_sql('query')}) AS tok FROM r1)",
        "missing AS (SELECT DISTINCT role, tok FROM voc WHERE role <> 'train' "
        "EXCEPT SELECT DISTINCT rr.role, v.tok FROM voc v, (SELECT DISTINCT role FROM r1 WHERE role <> 'train') rr "
        "WHERE v.role = 'train')",
        "bad AS (SELECT DISTINCT r1.example_id FROM r1 JOIN missing m USING (role) "
        "WHERE strpos(r1.query, ' ' || regexp_replace(m.tok, '^\\s+|\\s+$', '', 'g') || ' ') > 0)",
    ) + " SELECT example_id, role FROM r1 WHERE example_id NOT IN (SELECT example_id FROM bad)"


@register("compositional_split", _comp_sql())
def q_compositional(spark, sf_dir):
    """Template-level held-out split (20 % test templates, 20 % of the rest
    dev), 5 % iid test and 5 % iid dev rows, all validated against train."""
    t = materialize(templated_programs(spark, sf_dir))
    out = S.compositional_split(t, "example_id", "abstract_template", "query", COMP_TEST, COMP_DEV, COMP_IID)
    return out.select("example_id", "role")


# ---------------------------------------------------------------------------
# shaping for the learner
# ---------------------------------------------------------------------------
from ..functions import text as TX  # noqa: E402
from ..operators import shaping as SH  # noqa: E402


def _sql_tokens(expr):
    """``x.split()`` in DuckDB (empty list for blank text)."""
    return (f"CASE WHEN trim(regexp_replace({expr}, '\\s+', ' ', 'g')) = '' THEN []::VARCHAR[] ELSE "
            f"string_split(trim(regexp_replace({expr}, '\\s+', ' ', 'g')), ' ') END")


@register("select_split", Q.with_programs(*CLI_CTES) +
          " SELECT p.example_id, p.question, p.query FROM pool p JOIN final f USING (example_id) "
          "WHERE f.split_name = '-1_20_0_false' AND f.label = 1")
def q_select_split(spark, sf_dir):
    pool, a = _cli_assignments(spark, sf_dir)
    return SH.select_split(a, pool, "example_id", "-1_20_0_false", 1)


@register("drop_empty_source", "SELECT conv_id, turn FROM conversations WHERE length(text) > 0")
def q_drop_empty(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return SH.drop_empty_source(c, "text").select("conv_id", "turn")


@register("debug_limit", Q.with_programs() + " SELECT example_id FROM programs ORDER BY example_id LIMIT 1001")
def q_debug_limit(spark, sf_dir):
    return SH.debug_limit(programs(spark, sf_dir), "example_id").select("example_id")


_DOM_SQL = "CASE split_part(example_id, '-', 1) " + " ".join(
    f"WHEN {Q.sql_str(k)} THEN {Q.sql_str(v)}" for k, v in TX.DOMAIN_MARKERS.items()) + " END"


@register("domain_prefix", Q.with_programs() + f" SELECT example_id, {_DOM_SQL} || ' ' || question AS source FROM programs")
def q_domain_prefix(spark, sf_dir):
    p = programs(spark, sf_dir)
    return p.select("example_id", TX.domain_prefix("example_id", "question").alias("source"))


TRUNC_MAX = 64


@register("truncate_tokens",
          f"SELECT conv_id, turn, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(list_concat(['@start@'], t[1:{TRUNC_MAX}], "
          f"['@end@']), ' ') AS source FROM (SELECT conv_id, turn, {_sql_tokens('text')} AS t FROM conversations)")
def q_truncate_tokens(spark, sf_dir):
    """Whole conversation turns tokenised, cut to 64 tokens, markers added."""
    c = spread(table(spark, sf_dir, "conversations"), "conv_id")
    toks = TX.whitespace_tokens(F.col("text"))
    return c.select("conv_id", "turn", F.size(toks).alias("n_tokens"),
                    F.array_join(TX.truncate_tokens(toks, TRUNC_MAX, SH.START_SYMBOL, SH.END_SYMBOL), " ").alias("source"))


@register("truncation_counts",
          f"SELECT CAST(sum(CASE WHEN len({_sql_tokens('text')}) > {TRUNC_MAX} THEN 1 ELSE 0 END) AS BIGINT) "
          "AS source_exceeded "
          "FROM conversations WHERE length(text) > 0")
def q_truncation_counts(spark, sf_dir):
    c = SH.drop_empty_source(table(spark, sf_dir, "conversations"), "text")
    inst = SH.instances(c, "conv_id", "text", None, source_max=TRUNC_MAX)
    return SH.truncation_counts(inst)


PAIR_SOURCE_MAX, PAIR_TARGET_MAX = 8, 24


@register("truncation_counts_pairs", Q.with_programs() +
          f" SELECT CAST(coalesce(sum(CASE WHEN len({_sql_tokens('question')}) > {PAIR_SOURCE_MAX} THEN 1 ELSE 0 END), 0) AS BIGINT) AS source_exceeded, "
          f"CAST(coalesce(sum(CASE WHEN len({_sql_tokens('query')}) > {PAIR_TARGET_MAX} THEN 1 ELSE 0 END), 0) AS BIGINT) AS target_exceeded "
          "FROM programs WHERE length(question) > 0")
def q_truncation_counts_pairs(spark, sf_dir):
    """Questions and programs over the source and the target length."""
    p = SH.drop_empty_source(programs(spark, sf_dir), "question")
    return SH.truncation_counts(SH.instances(p, "example_id", "question", "query", source_max=PAIR_SOURCE_MAX, target_max=PAIR_TARGET_MAX))


@register("lower_source", Q.with_programs() +
          " SELECT example_id, lower(question) AS source, "
          "lower(trim(regexp_replace(regexp_replace(query, '([a-z])([A-Z])', '\\1_\\2', 'g'), '\\s+', ' ', 'g'))) AS target "
          "FROM programs")
def q_lower_source(spark, sf_dir):
    p = programs(spark, sf_dir)
    return p.select("example_id", F.lower("question").alias("source"), TX.snake_lower("query").alias("target"))


@register("space_separators", Q.with_programs() +
          " SELECT example_id, regexp_replace(replace(regexp_replace(query, '([:.@\\(\\)\\[\\]\",])', ' \\1 ', 'g'), "
          "'^^', ' ^^ '), '\\s\\s+', ' ', 'g') AS spaced FROM programs")
def q_space_separators(spark, sf_dir):
    p = spread(programs(spark, sf_dir), "example_id")
    return p.select("example_id", TX.space_separators("query").alias("spaced"))


@register("snake_lower", Q.with_programs() +
          " SELECT example_id, lower(trim(regexp_replace(regexp_replace(query, '([a-z])([A-Z])', '\\1_\\2', 'g'), "
          "'\\s+', ' ', 'g'))) AS lowered FROM programs")
def q_snake_lower(spark, sf_dir):
    p = programs(spark, sf_dir)
    return p.select("example_id", TX.snake_lower("query").alias("lowered"))


def _quoted_sql():
    spaced = ("regexp_replace(replace(regexp_replace(query, '([:.@\\(\\)\\[\\]\",])', ' \\1 ', 'g'), "
              "'^^', ' ^^ '), '\\s\\s+', ' ', 'g')")
    pat = Q.sql_str(TX.QUOTED_SPAN)
    seg = ("(CASE WHEN i > 0 THEN '\" ' ELSE '' END || segs[i + 1] || CASE WHEN i < n THEN ' \"' ELSE '' END)")
    toks = (f"list_transform({_sql_tokens(seg)}, lambda t: {{'kind': 'tok', 'text': t}})")
    span = ("CASE WHEN i < n THEN [{'kind': 'span', 'text': regexp_replace(spans[i + 1][2:length(spans[i + 1]) - 1], "
            "'^\\s+|\\s+$', '', 'g')}] ELSE [] END")
    return (Q.with_programs(
        f"sp AS (SELECT example_id, s, regexp_extract_all(s, {pat}, 0) AS spans, "
        f"regexp_split_to_array(s, {pat}) AS segs FROM (SELECT example_id, {spaced} AS s FROM programs))",
        f"pieces AS (SELECT example_id, flatten(list_transform(range(0, len(spans) + 1), "
        f"lambda i: list_concat({toks.replace('n THEN', 'len(spans) THEN')}, "
        f"{span.replace('i < n', 'i < len(spans)')}))) AS items FROM sp)")
        + " SELECT example_id, CAST(pos AS INTEGER) AS pos, item.kind AS kind, item.text AS text FROM "
          "(SELECT example_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM pieces)")


@register("quoted_spans", _quoted_sql().replace("CASE WHEN i < n THEN ' \"'", "CASE WHEN i < len(spans) THEN ' \"'"))
def q_quoted_spans(spark, sf_dir):
    p = spread(programs(spark, sf_dir), "example_id")
    # posexplode() would compute the items three times (see coverage.vocab_table)
    x = p.select("example_id", F.posexplode_outer(TX.quoted_spans("query")).alias("pos", "item")).where("item IS NOT NULL")
    return x.select("example_id", "pos", "item.kind", "item.text")


def _rename_sql(renames):
    pairs = []
    for dom, mp in renames.items():
        for a, b in mp.items():
            pairs.append(f"({Q.sql_str(dom)}, {Q.sql_str(a)}, {Q.sql_str(b)})")
    return Q.with_programs(
        "rn(domain, src, dst) AS (VALUES " + ", ".join(pairs) + ")",
        f"tk AS (SELECT p.example_id, p.domain, u.t, u.i FROM programs p, "
        f"unnest({_sql_tokens('p.query')}) WITH ORDINALITY AS u(t, i))") + \
        (" SELECT example_id, string_agg(coalesce(rn.dst, tk.t), ' ' ORDER BY tk.i) AS renamed FROM tk "
         "LEFT JOIN rn ON rn.domain = tk.domain AND rn.src = tk.t GROUP BY example_id")


@register("rename_properties_crowd", _rename_sql(TX.CROWD_RENAMES))
def q_rename_crowd(spark, sf_dir):
    p = programs(spark, sf_dir)
    return p.select("example_id", TX.rename_properties_crowd("query", "domain").alias("renamed"))


@register("rename_properties_para", _rename_sql(TX.PARAPHRASE_RENAMES))
def q_rename_para(spark, sf_dir):
    p = programs(spark, sf_dir)
    return p.select("example_id", TX.rename_properties_para("query", "domain").alias("renamed"))


# ---------------------------------------------------------------------------
# 2.11 evaluation
# ---------------------------------------------------------------------------
from ..operators import evaluate as EV  # noqa: E402
from .fixtures import CANDIDATES_SQL, PREDICTIONS_SQL, candidates, predictions  # noqa: E402

EXACT_SQL = ("(gold_tokens[2:greatest(len(gold_tokens) - 1, 1)] = "
             "predicted_tokens[1:greatest(len(predicted_tokens) - 1, 0)])")


@register("exact_match", Q.with_programs(PREDICTIONS_SQL) + f" SELECT example_id, {EXACT_SQL} AS correct FROM preds")
def q_exact_match(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("example_id", EV.exact_match("gold_tokens", "predicted_tokens").alias("correct"))


@register("paraphrase_filter", Q.with_programs(PREDICTIONS_SQL) +
          f" SELECT example_id, question FROM programs WHERE example_id IN (SELECT example_id FROM preds WHERE {EXACT_SQL})")
def q_paraphrase_filter(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return EV.paraphrase_filter(p, programs(spark, sf_dir), "example_id").select("example_id", "question")


@register("attach_gold", Q.with_programs(PREDICTIONS_SQL) +
          " SELECT p.example_id, CAST(len(p.predicted_tokens) AS INTEGER) AS n_pred, "
          "CAST(len(g.gold_tokens) AS INTEGER) AS n_gold FROM preds p "
          "LEFT JOIN (SELECT example_id, gold_tokens FROM preds WHERE has_gold) g USING (example_id)")
def q_attach_gold(spark, sf_dir):
    p = predictions(spark, sf_dir)
    gold = p.where("has_gold").select("example_id", "gold_tokens")
    out = EV.attach_gold(p.select("example_id", "predicted_tokens"), gold)
    return out.select("example_id", F.size("predicted_tokens").alias("n_pred"),
                      F.when(F.col("gold_tokens").isNotNull(), F.size("gold_tokens")).alias("n_gold"))


@register("prediction_records", Q.with_programs(PREDICTIONS_SQL) +
          " SELECT p.example_id, p.source, array_to_string(g.gold_tokens, ' ') AS target, "
          "array_to_string(p.predicted_tokens, ' ') AS predicted FROM preds p "
          "LEFT JOIN (SELECT example_id, gold_tokens FROM preds WHERE has_gold) g USING (example_id)")
def q_prediction_records(spark, sf_dir):
    """One record per example: source, gold when present, prediction; heavy
    fields (ids, logits) dropped before writing."""
    p = predictions(spark, sf_dir)
    gold = p.where("has_gold").select("example_id", "gold_tokens")
    out = EV.attach_gold(p.select("example_id", "source", "predicted_tokens"), gold)
    return out.select("example_id", "source", F.array_join("gold_tokens", " ").alias("target"),
                      F.array_join("predicted_tokens", " ").alias("predicted"))


@register("sequence_accuracy", Q.with_programs(PREDICTIONS_SQL) +
          " SELECT coalesce(avg(CASE WHEN list_bool_and(list_transform(gold_ids[2:], lambda g, i: "
          "coalesce(pred_ids[i], 0) = g)) OR len(gold_ids) < 2 THEN 1.0 ELSE 0.0 END), 0.0) AS id_seq_acc FROM preds")
def q_sequence_accuracy(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return EV.sequence_accuracy(p, "gold_ids", "pred_ids", pad=0)


@register("sequence_accuracy_masked", Q.with_programs(PREDICTIONS_SQL) +
          " SELECT coalesce(avg(CASE WHEN list_bool_and(list_transform(gold_ids[2:], lambda g, i: "
          "i % 3 = 0 OR coalesce(pred_ids[i], 0) = g)) THEN 1.0 ELSE 0.0 END), 0.0) AS id_seq_acc FROM preds WHERE len(gold_ids) >= 2")
def q_sequence_accuracy_masked(spark, sf_dir):
    """Every third gold position is masked out."""
    p = predictions(spark, sf_dir)
    p = p.withColumn("mask", F.transform("gold_ids", lambda _x, i: F.when(i % 3 == 0, 0).otherwise(1)))
    return EV.sequence_accuracy(p, "gold_ids", "pred_ids", "mask", pad=0)


@register("best_candidate", Q.with_programs(PREDICTIONS_SQL, CANDIDATES_SQL) +
          " SELECT example_id, rank, log_prob FROM (SELECT *, row_number() OVER (PARTITION BY example_id "
          "ORDER BY log_prob DESC, rank) AS rn FROM cands) WHERE rn = 1")
def q_best_candidate(spark, sf_dir):
    return EV.best_candidate(candidates(spark, sf_dir)).select("example_id", "rank", "log_prob")


@register("truncate_at_eos", Q.with_programs(PREDICTIONS_SQL, CANDIDATES_SQL) +
          " SELECT example_id, rank, array_to_string(CASE WHEN list_position(token_ids, 2) IS NOT NULL "
          "THEN token_ids[1:list_position(token_ids, 2)] ELSE token_ids END, ' ') AS ids FROM cands")
def q_truncate_at_eos(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.select("example_id", "rank", F.array_join(EV.truncate_at_eos("token_ids").cast("array<string>"), " ")
                    .alias("ids"))


EXCLUDE_IDS = (0, 1, 2)


def _ngr(c, n):
    return (f"CASE WHEN len({c}) >= {n} THEN list_transform(range(1, len({c}) - {n} + 2), "
            f"lambda i: array_to_string({c}[i:i + {n} - 1], ' ')) ELSE []::VARCHAR[] END")


def _bleu_sql():
    strip = "list_filter({}, lambda x: x NOT IN (0, 1, 2))"
    ctes = [PREDICTIONS_SQL,
            f"b AS (SELECT example_id, {strip.format('gold_ids')} AS g, {strip.format('pred_ids')} AS p FROM preds)"]
    parts = []
    for n in range(1, 5):
        ctes.append(f"pg{n} AS (SELECT example_id, gram, count(*) AS pc FROM (SELECT example_id, unnest({_ngr('p', n)}) AS gram FROM b) GROUP BY ALL)")
        ctes.append(f"gg{n} AS (SELECT example_id, gram, count(*) AS gc FROM (SELECT example_id, unnest({_ngr('g', n)}) AS gram FROM b) GROUP BY ALL)")
        ctes.append(f"s{n} AS (SELECT sum(least(pc, coalesce(gc, 0))) AS m, sum(pc) AS t FROM pg{n} LEFT JOIN gg{n} USING (example_id, gram))")
        parts.append(f"0.25 * (ln(coalesce(s{n}.m, 0) + 1e-13) - ln(coalesce(s{n}.t, 0) + 1e-13))")
    ctes.append("l AS (SELECT sum(len(p)) AS plen, sum(len(g)) AS rlen FROM b)")
    bp = ("CASE WHEN plen > rlen THEN 1.0 WHEN rlen = 0 OR plen = 0 THEN 0.0 ELSE exp(1.0 - rlen / plen) END")
    return Q.with_programs(*ctes) + f" SELECT round({bp} * exp({' + '.join(parts)}), 9) AS bleu FROM l, s1, s2, s3, s4"


@register("bleu", _bleu_sql())
def q_bleu(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return EV.bleu(p, "gold_ids", "pred_ids", "example_id", exclude=EXCLUDE_IDS)


def _rouge_sql():
    strip = "list_filter({}, lambda x: x NOT IN (0, 1, 2))"

    def f1(m, tp, tr):
        prec = f"(CASE WHEN {tp} > 0 THEN {m} / {tp} ELSE 0.0 END)"
        rec = f"(CASE WHEN {tr} > 0 THEN {m} / {tr} ELSE 0.0 END)"
        return f"(CASE WHEN {prec} + {rec} > 0 THEN 2 * {prec} * {rec} / ({prec} + {rec}) ELSE 0.0 END)"

    def nf1(n):
        pg, gg = _ngr("p", n), _ngr("g", n)
        m = (f"CAST(coalesce(list_sum(list_transform(list_distinct({pg}), lambda x: least("
             f"len(list_filter({pg}, lambda y: y = x)), len(list_filter({gg}, lambda y: y = x))))), 0) AS DOUBLE)")
        return f1(m, f"CAST(len({pg}) AS DOUBLE)", f"CAST(len({gg}) AS DOUBLE)")

    lcs = ("list_reduce(p, lambda rw, x: list_reduce(range(1, len(g) + 1), lambda acc, j: list_append(acc, "
           "CASE WHEN g[j] = x THEN rw[j] + 1 ELSE greatest(acc[j], rw[j + 1]) END), [0]), "
           "list_resize([0], len(g) + 1, 0))[len(g) + 1]")
    return Q.with_programs(
        PREDICTIONS_SQL,
        f"b AS (SELECT {strip.format('gold_ids')} AS g, {strip.format('pred_ids')} AS p FROM preds)",
        f"c AS (SELECT *, CAST({lcs} AS DOUBLE) AS lcs FROM b)") + (
        f" SELECT round(coalesce(avg({nf1(1)}), 0.0), 9) AS rouge_1, round(coalesce(avg({nf1(2)}), 0.0), 9) AS rouge_2, "
        f"round(coalesce(avg(CASE WHEN lcs > 0 THEN {f1('lcs', 'CAST(len(p) AS DOUBLE)', 'CAST(len(g) AS DOUBLE)')} "
        "ELSE 0.0 END), 0.0), 9) AS rouge_l FROM c")


@register("rouge", _rouge_sql())
def q_rouge(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return EV.rouge(p, "gold_ids", "pred_ids", "example_id", exclude=EXCLUDE_IDS)


# ---------------------------------------------------------------------------
# 2.1 sources: shards, raw-pair dedup, stage counts
# ---------------------------------------------------------------------------
from ..sources import shards as SHD  # noqa: E402

SHARDS = 4
SHARD_SQL = ("s AS (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS INTEGER) AS shard, "
             "(row_number() OVER (ORDER BY doc_id) - 1) // 4 AS shard_pos, text FROM documents)")


@register("shard_round_robin", "WITH " + SHARD_SQL + " SELECT doc_id, shard, shard_pos, text FROM s")
def q_shard_round_robin(spark, sf_dir):
    """Documents in doc_id order dealt round-robin to 4 shards."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return SHD.shard_round_robin(d, ["doc_id"], SHARDS).select("doc_id", "shard", "shard_pos", "text")


@register("merge_shards", "WITH " + SHARD_SQL +
          " SELECT doc_id, row_number() OVER (ORDER BY shard_pos // 2, shard, shard_pos) - 1 AS merged_pos, text FROM s")
def q_merge_shards(spark, sf_dir):
    """The 4 shards interleaved back two lines at a time."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    sh = SHD.shard_round_robin(d, ["doc_id"], SHARDS)
    return SHD.merge_shards(sh, 2).select("doc_id", "merged_pos", "text")


@register("shard_files", "WITH " + SHARD_SQL +
          " SELECT doc_id, text, shard, shard_pos, row_number() OVER (ORDER BY shard_pos // 2, shard, shard_pos) - 1 AS merged_pos FROM s")
def q_shard_files(spark, sf_dir):
    """Documents as lines of JSON, dealt in doc_id order to the files of 4 named
    shards, read back and interleaved two lines at a time."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    lines = _round_trip(spark, lambda path: SHD.write_shard_files(d, ["doc_id"], "value", path, SHARDS),
                        lambda path: SHD.read_shard_files(spark, path, SHARDS, 2))
    return lines.select(F.from_json("value", "doc_id long, text string").alias("d"), "shard", "shard_pos", "merged_pos").select(
        "d.*", "shard", "shard_pos", "merged_pos")


@register("read_raw_pairs",
          "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) "
          "AS rn FROM conversations WHERE role = 'user') WHERE rn = 1")
def q_read_raw_pairs(spark, sf_dir):
    """First-wins dedup of user turns on their whole text (first by conv_id, turn)."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    return SHD.first_wins(c, ["text"], ["conv_id", "turn"]).select("conv_id", "turn")


def _round_trip(spark, write, read):
    """A written file set in the shared folder, read back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    write(path)
    return read(path)


def _headerless(df):
    """An input file as the reader gets it: tab-separated, no header."""
    return lambda path: df.write.option("sep", "	").option("quote", '"').option("escape", '"').option("header", False).csv(path)


@register("read_pairs", Q.with_programs() + " SELECT example_id, question, query FROM programs")
def q_read_pairs(spark, sf_dir):
    """A headerless pair file in the shared folder, read by position."""
    p = programs(spark, sf_dir).select("example_id", "question", "query")
    return _round_trip(spark, _headerless(p), lambda path: TSV.read_pairs(spark, path))


@register("read_eval_templates", Q.with_programs(Q.TEMPLATED) +
          f" SELECT DISTINCT abstract_template FROM templated WHERE {EVAL_FILTER_SQL}")
def q_read_eval_templates(spark, sf_dir):
    """The sixth column of a held-out evaluation file."""
    t = templated_programs(spark, sf_dir).where(eval_program_filter())
    t = t.select("example_id", "question", "query", F.lit("a"), F.lit("b"), "abstract_template")
    return _round_trip(spark, _headerless(t), lambda path: TSV.read_eval_templates(spark, path))


@register("write_pool", Q.with_programs() + " SELECT example_id, question, query FROM programs")
def q_write_pool(spark, sf_dir):
    """The pool as TSV with a header, read back."""
    p = programs(spark, sf_dir).select("example_id", "question", "query")
    return _round_trip(spark, lambda path: TSV.write_pool(p, path, "tsv"), lambda path: TSV.read_splits(spark, path))


@register("write_splits", Q.with_programs() + " SELECT example_id, CASE WHEN shape < 4 THEN CASE WHEN shape < 2 THEN '1' ELSE '2' END END AS s FROM programs")
def q_write_splits(spark, sf_dir):
    """The wide split table as TSV (an empty cell for rows without a label),
    read back by read_splits."""
    p = programs(spark, sf_dir)
    labels = p.where("shape < 4").select(F.lit("s").alias("split_name"), "example_id", F.when(F.col("shape") < 2, 1).otherwise(2).alias("label"))
    back = _round_trip(spark, lambda path: TSV.write_splits(labels, path, p.select("example_id", "question", "query"), split_names=["s"], fmt="tsv"),
                       lambda path: TSV.read_splits(spark, path))
    return back.select("example_id", "s")


@register("read_predictions", Q.with_programs() + " SELECT example_id, len(string_split(query, ' ')) AS n_tokens, shape < 3 AS correct FROM programs")
def q_read_predictions(spark, sf_dir):
    """Prediction records as JSON lines, heavy fields dropped, read back with
    the fixed schema."""
    p = programs(spark, sf_dir).select("example_id", F.split("query", " ").alias("predicted_tokens"), (F.col("shape") < 3).alias("correct"),
                                       F.array(F.lit(0.5)).alias("decoder_logits"))
    back = _round_trip(spark, lambda path: TSV.write_predictions(p, path), lambda path: TSV.read_predictions(spark, path))
    return back.select("example_id", F.size("predicted_tokens").cast("long").alias("n_tokens"), "correct")


@register("read_raw_pairs_file", Q.with_programs() + " SELECT line_no, c0, c1 FROM (SELECT CAST(row_number() OVER (ORDER BY example_id) - 1 AS BIGINT) AS line_no, "
          "question AS c0, query AS c1, row_number() OVER (PARTITION BY question ORDER BY example_id) AS rn FROM programs) WHERE rn = 1")
def q_read_raw_pairs_file(spark, sf_dir):
    """Raw files of three tab-separated fields, written in id order; of each
    question the first line of all files stays, with its number."""
    lines = programs(spark, sf_dir).orderBy("example_id").select(F.concat_ws("\t", "example_id", "question", "query").alias("value"))
    return _round_trip(spark, lambda path: lines.write.text(path), lambda path: SHD.read_raw_pairs(spark, path)).select("line_no", "c0", "c1")


@register("read_pairs_by_place", Q.with_programs() + " SELECT CAST(row_number() OVER (ORDER BY example_id) - 1 AS VARCHAR) AS example_id, question, query FROM programs")
def q_read_pairs_by_place(spark, sf_dir):
    """Pair files without ids, written in id order: a row's place over all files
    is its id."""
    p = programs(spark, sf_dir).orderBy("example_id").select("question", "query")
    return _round_trip(spark, _headerless(p), lambda path: TSV.read_pairs(spark, path, 0, 1, None))


@register("stage_counts", Q.with_programs(*CLI_CTES) +
          " SELECT 'input' AS stage, count(*) AS rows FROM programs UNION ALL SELECT 'pool', count(*) FROM pool "
          "UNION ALL SELECT 'train', count(*) FROM final WHERE label = 1 "
          "UNION ALL SELECT 'dev', count(*) FROM final WHERE label = 2")
def q_stage_counts(spark, sf_dir):
    pool, a = _cli_assignments(spark, sf_dir)
    return SHD.stage_counts({"input": programs(spark, sf_dir), "pool": pool,
                             "train": a.where("label = 1"), "dev": a.where("label = 2")})


# ---------------------------------------------------------------------------
# template distances
# ---------------------------------------------------------------------------
from ..operators import neighbours as NB  # noqa: E402


def _enc_sql(src_cols: list[str]):
    toks = " UNION ".join(f"SELECT DISTINCT unnest({_sql_tokens(c)}) AS tok FROM leveled" for c in src_cols)
    vals = " UNION ".join(f"SELECT DISTINCT {c} AS t FROM leveled" for c in src_cols)
    return [f"codes AS (SELECT tok, chr(CAST(33 + row_number() OVER (ORDER BY tok) - 1 AS INTEGER)) AS code FROM ({toks}))",
            f"enc AS (SELECT d.t, string_agg(c.code, '' ORDER BY u.i) AS enc, count(*) AS n FROM ({vals}) d, "
            f"unnest({_sql_tokens('d.t')}) WITH ORDINALITY AS u(tok, i) JOIN codes c USING (tok) GROUP BY d.t)"]


PAIR_GAP = 2
NEAREST_K = 4
DIST_SQL = "CAST(CASE WHEN levenshtein(a.enc, b.enc) = 0 THEN 100000 ELSE levenshtein(a.enc, b.enc) END AS INTEGER)"


@register("template_pairs", Q.with_programs(*POOL_CTES, Q.LEVELED, *_enc_sql(["template"])) +
          f" SELECT a.t AS t1, b.t AS t2, {DIST_SQL} AS dist FROM enc a JOIN enc b "
          f"ON a.t <> b.t WHERE levenshtein(a.enc, b.enc) <= {PAIR_GAP}")
def q_template_pairs(spark, sf_dir):
    """Distinct typed templates within token edit distance 2 of each other,
    with their distance (threshold join, no all-pairs comparison)."""
    return NB.template_pairs(leveled_pool(spark, sf_dir, ["template"]), "template", PAIR_GAP)


@register("template_pairs_kept", Q.with_programs(*POOL_CTES, Q.LEVELED, *_enc_sql(["template"])) +
          f" SELECT a.t AS t1, b.t AS t2, {DIST_SQL} AS dist FROM enc a JOIN enc b "
          f"ON a.t <> b.t WHERE levenshtein(a.enc, b.enc) <= {PAIR_GAP}")
def q_template_pairs_kept(spark, sf_dir):
    """The same pairs from a kept table: a first run over the templates of some
    shapes, then one over all, which computes only what is new."""
    pool = leveled_pool(spark, sf_dir)

    def runs(path):
        NB.update_template_pairs(pool.where("shape < 3"), "template", PAIR_GAP, path)
        NB.update_template_pairs(pool, "template", PAIR_GAP, path)

    return _round_trip(spark, runs, lambda path: NB.kept_template_pairs(spark, path))


@register("nearest_templates", Q.with_programs(*POOL_CTES, Q.LEVELED, *_enc_sql(["template"])) +
          f" SELECT t1, t2, dist, rank FROM (SELECT a.t AS t1, b.t AS t2, {DIST_SQL} AS dist, "
          f"CAST(row_number() OVER (PARTITION BY a.t ORDER BY {DIST_SQL}, b.t) AS INTEGER) AS rank "
          f"FROM enc a JOIN enc b ON a.t <> b.t) WHERE rank <= {NEAREST_K}")
def q_nearest_templates(spark, sf_dir):
    """Exact 4 nearest other typed templates of every typed template."""
    return NB.nearest_templates(leveled_pool(spark, sf_dir, ["template"]), "template", NEAREST_K).select(
        "t1", "t2", "dist", F.col("rank").cast("int").alias("rank"))


@register("token_edit_distance", Q.with_programs(*POOL_CTES, Q.LEVELED, *_enc_sql(["template", "abstract_template"])) +
          " SELECT DISTINCT l.template, l.abstract_template, CAST(levenshtein(a.enc, b.enc) AS INTEGER) AS dist "
          "FROM leveled l "
          "JOIN enc a ON a.t = l.template JOIN enc b ON b.t = l.abstract_template")
def q_token_edit_distance(spark, sf_dir):
    """Token-level edit distance between each typed template and its abstract template."""
    lv = leveled_pool(spark, sf_dir)
    codes = NB.token_codes(lv, ["template", "abstract_template"])
    ea = NB.encode(lv, "template", codes).select("template", F.col("enc").alias("ea"))
    eb = NB.encode(lv, "abstract_template", codes).select("abstract_template", F.col("enc").alias("eb"))
    pairs = lv.select("template", "abstract_template").distinct().join(ea, "template").join(eb, "abstract_template")
    return pairs.select("template", "abstract_template",
                        NB.token_edit_distance(F.col("ea"), F.col("eb"), allow_zero=True).alias("dist"))


# ---------------------------------------------------------------------------
# neighbourhood sets
# ---------------------------------------------------------------------------
NBR_SIZE, NBR_K = 1000, 4
NBR_COLUMNS = ["example_id", "abstract_template", "template"]


def _neighbour_sets(spark, sf_dir):
    lv = leveled_pool(spark, sf_dir, NBR_COLUMNS).select(*NBR_COLUMNS)
    return NB.neighbour_sets(lv, "example_id", "abstract_template", "template", NBR_SIZE, NBR_K)


def _neighbour_sql(tail: str) -> str:
    """The sets served one after another by a recursive query: its state is the
    list of ids taken so far."""
    from ..functions.hashing import uniform_sql
    from ..functions.vocab import program_vocab_sql
    k, n_dev = NBR_K, int(NBR_SIZE * 0.05 // 1)
    order = uniform_sql("l.example_id", "0", "'nbr'", "'order'")
    offset = uniform_sql("w.set_id", "0", "w.t2", "'offset'")
    gap = uniform_sql("w.set_id", "0", "w.t2", "i")
    u_dev = uniform_sql("r.example_id", "0", "'dev'", "'draw'")
    ctes = [
        *_neighbour_ctes(),
        f"rest AS MATERIALIZED (SELECT l.example_id, l.template, l.abstract_template, row_number() OVER (PARTITION BY l.template ORDER BY {order}, l.example_id) - 1 AS pos "
        "FROM leveled l WHERE l.example_id NOT IN (SELECT example_id FROM anchors))",
        "wanted AS MATERIALIZED (SELECT a.set_id, n.t2, n.rank, n.c, coalesce(sum(n.c) OVER (PARTITION BY a.set_id ORDER BY n.rank "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_all FROM anchors a JOIN counted n ON n.t1 = a.template)",
        f"arcs AS (SELECT set_id, t2, c, CAST(floor({offset} * c) AS BIGINT) AS o, unnest(range(0, c)) AS i FROM wanted w "
        # all sets together take m * k rows, so a set never gets to templates beyond these
        f"WHERE c > 0 AND (rank <= {k} OR before_all < {int(NBR_SIZE * 0.95 // 1 // (k + 1)) * k + k}))",
        f"raced AS (SELECT set_id, t2, (o + i) % c AS pos, sum(-ln({gap}) / (c - i)) "
        "OVER (PARTITION BY set_id, t2 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key FROM arcs w)",
        "cand AS MATERIALIZED (SELECT d.set_id, d.t2, r.example_id, d.key FROM raced d JOIN rest r ON r.template = d.t2 AND r.pos = d.pos)",
        "served(j, taken, mine) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL "
        "SELECT j + 1, list_concat(any_value(taken), coalesce(list(example_id) FILTER (WHERE rn IS NOT NULL), [])), "
        "coalesce(list(example_id) FILTER (WHERE rn IS NOT NULL), []) FROM ("
        " SELECT s.j, s.taken, p.example_id, p.rn FROM served s LEFT JOIN ("
        "  SELECT set_id, example_id, row_number() OVER (ORDER BY key, example_id) AS rn FROM ("
        "   SELECT c.set_id, c.example_id, c.key FROM cand c JOIN ("
        "    SELECT set_id, t2, rank, coalesce(sum(c - coalesce(gone, 0)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
        "    FROM wanted JOIN served ON wanted.set_id = served.j LEFT JOIN ("
        "     SELECT template AS t2, count(*) AS gone FROM (SELECT unnest(taken) AS example_id FROM served) JOIN rest USING (example_id) GROUP BY 1) USING (t2)) e "
        f"   ON c.set_id = e.set_id AND c.t2 = e.t2 AND (e.rank <= {k} OR e.before < {k})"
        "   WHERE c.example_id NOT IN (SELECT unnest(taken) FROM served)) "
        f"  QUALIFY rn <= {k}) p ON p.set_id = s.j WHERE s.j < (SELECT count(*) FROM anchors)) GROUP BY j)",
        "members AS (SELECT j - 1 AS set_id, unnest(mine) AS example_id FROM served UNION ALL SELECT set_id, example_id FROM anchors)",
        f"lab AS (SELECT m.set_id, m.example_id, l.abstract_template AS p, 1 AS label FROM members m JOIN leveled l USING (example_id) UNION ALL "
        f"SELECT -1, example_id, abstract_template, 2 FROM (SELECT r.example_id, r.abstract_template, "
        f"row_number() OVER (ORDER BY -ln({u_dev}), r.example_id) AS rn FROM rest r WHERE r.example_id NOT IN (SELECT example_id FROM members)) WHERE rn <= {n_dev})",
        f"voc AS (SELECT label, unnest({program_vocab_sql('p')}) AS tok FROM lab)",
        "missing AS (SELECT tok FROM voc WHERE label = 2 EXCEPT SELECT tok FROM voc WHERE label = 1)",
        "kept AS (SELECT * FROM lab WHERE label = 1 OR NOT EXISTS (SELECT 1 FROM missing m "
        "WHERE strpos(lab.p, ' ' || regexp_replace(m.tok, '^\\s+|\\s+$', '', 'g') || ' ') > 0))",
    ]
    return Q.with_programs(*ctes).replace("WITH ", "WITH RECURSIVE ", 1) + tail


def _neighbour_ctes() -> list[str]:
    """Anchors, and all templates by distance with their row counts."""
    from ..functions.hashing import uniform_sql
    m = int(NBR_SIZE * 0.95 // 1 // (NBR_K + 1))
    u = uniform_sql("l.example_id", "0", "'anchors'", "'draw'")
    return [
        *POOL_CTES, Q.LEVELED.replace("leveled AS (", "leveled AS MATERIALIZED ("), *_enc_sql(["template"]),
        "fr AS (SELECT abstract_template, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS freq FROM leveled "
        "WHERE abstract_template IS NOT NULL GROUP BY 1)",
        f"drawn AS (SELECT l.example_id, l.template, row_number() OVER (ORDER BY -ln({u}) / (1.0 / f.freq), l.example_id) - 1 AS set_id "
        "FROM leveled l JOIN fr f USING (abstract_template))",
        f"anchors AS (SELECT * FROM drawn WHERE set_id < {m})",
        "cnt AS (SELECT template AS t2, count(*) AS c FROM leveled WHERE example_id NOT IN (SELECT example_id FROM anchors) GROUP BY 1)",
        f"near AS (SELECT a.t AS t1, b.t AS t2, {DIST_SQL} AS dist, CAST(row_number() OVER (PARTITION BY a.t ORDER BY {DIST_SQL}, b.t) AS INTEGER) AS rank "
        "FROM enc a JOIN enc b ON a.t <> b.t WHERE a.t IN (SELECT template FROM anchors) "
        f"UNION ALL SELECT t, t, {NB.SELF_DISTANCE}, 1000000000 FROM enc WHERE t IN (SELECT template FROM anchors))",
        "counted AS (SELECT n.*, coalesce(cnt.c, 0) AS c FROM near n LEFT JOIN cnt USING (t2))",
    ]


@register("neighbour_sets", _neighbour_sql(
    f" SELECT '{NBR_K}_{NBR_SIZE}_0_false' AS split_name, CAST(set_id AS BIGINT) AS set_id, example_id, CAST(label AS INTEGER) AS label FROM kept"))
def q_neighbour_sets(spark, sf_dir):
    """190 sets of an anchor (weight 1/p(abstract template)) plus 4 rows of
    its nearest typed templates, and 50 dev rows (set_id -1)."""
    return _neighbour_sets(spark, sf_dir)


def _expand_sql():
    """All-pair distances, the draw and running sums in plain SQL."""
    from ..functions.hashing import uniform_sql
    m = int(NBR_SIZE * 0.95 // 1 // (NBR_K + 1))
    u = uniform_sql("l.example_id", "0", "'anchors'", "'draw'")
    far = NB.SELF_DISTANCE
    ctes = [
        *POOL_CTES, Q.LEVELED, *_enc_sql(["template"]),
        "fr AS (SELECT abstract_template, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS freq FROM leveled "
        "WHERE abstract_template IS NOT NULL GROUP BY 1)",
        f"drawn AS (SELECT l.example_id, l.template, row_number() OVER (ORDER BY -ln({u}) / (1.0 / f.freq), l.example_id) - 1 AS set_id "
        "FROM leveled l JOIN fr f USING (abstract_template))",
        f"anchors AS (SELECT * FROM drawn WHERE set_id < {m})",
        "cnt AS (SELECT template AS t2, count(*) AS c FROM leveled WHERE example_id NOT IN (SELECT example_id FROM anchors) GROUP BY 1)",
        f"near AS (SELECT a.t AS t1, b.t AS t2, {DIST_SQL} AS dist, CAST(row_number() OVER (PARTITION BY a.t ORDER BY {DIST_SQL}, b.t) AS INTEGER) AS rank "
        "FROM enc a JOIN enc b ON a.t <> b.t WHERE a.t IN (SELECT template FROM anchors) "
        f"UNION ALL SELECT t, t, {far}, 1000000000 FROM enc WHERE t IN (SELECT template FROM anchors))",
        "counted AS (SELECT n.*, coalesce(cnt.c, 0) AS c FROM near n LEFT JOIN cnt USING (t2))",
        "summed AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY t1 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counted)",
    ]
    return Q.with_programs(*ctes) + (
        " SELECT a.set_id, s.t2 AS template, s.dist, s.rank, s.c FROM anchors a JOIN summed s ON s.t1 = a.template "
        f"WHERE s.rank <= {NBR_K} OR s.before < {NBR_K}")


@register("expand_neighbourhood", _expand_sql())
def q_expand_neighbourhood(spark, sf_dir):
    """Templates each anchor may draw from (nearest first, grown until they
    hold 4 rows)."""
    lv = leveled_pool(spark, sf_dir, NBR_COLUMNS).select(*NBR_COLUMNS)
    m = int(NBR_SIZE * 0.95 // 1 // (NBR_K + 1))
    a = materialize(NB.draw_anchors(lv, "example_id", "abstract_template", m))
    return NB.expand_neighbourhood(lv, a, "template", NBR_K, "example_id")


@register("set_quality", _neighbour_sql(
    " SELECT CAST(set_id AS BIGINT) AS set_id, count(*) AS rows, count(DISTINCT example_id) AS distinct_ids, "
    f"count(*) <= {NBR_K + 1} AND count(*) = count(DISTINCT example_id) AS ok FROM kept WHERE set_id >= 0 GROUP BY set_id"))
def q_set_quality(spark, sf_dir):
    """Per neighbourhood set: rows, distinct ids, ok (<= k + 1 rows, unique ids)."""
    return NB.set_quality(_neighbour_sets(spark, sf_dir), "example_id", NBR_K)
