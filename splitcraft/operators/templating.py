"""Template columns and template-level relational operators."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import templates as T
from .joins import template_join
from .sampling import spread, template_counts


def with_abstract_template(df: DataFrame, program_col: str = "query", id_col: str | None = None,
                           out_col: str = "abstract_template", compat: bool = True) -> DataFrame:
    """Add the CLI's abstract template (noops of untyped).  The regex chain
    is the CPU cost of the whole flow, so the input is spread over all cores
    first when the scan is narrower than the cluster."""
    if id_col:
        df = spread(df, id_col)
    return df.withColumn(out_col, T.template_abstract(F.col(program_col), compat))


def with_template_levels(df: DataFrame, program_col: str = "query", id_col: str | None = None,
                         compat: bool = True) -> DataFrame:
    """Add all template levels (typed ``template``, ``template_kbfree``,
    ``template_kbfree_untyped``, ``template_kbfree_untyped_noops``)."""
    if id_col:
        df = spread(df, id_col)
    return T.with_template_levels(df, program_col, compat)


def exclude_eval_templates(pool: DataFrame, eval_templates: DataFrame,
                           template_col: str = "abstract_template") -> DataFrame:
    """Pool rows whose template is not among the held-out evaluation
    templates (anti join; the pool is not shuffled on the template)."""
    return template_join(pool, eval_templates.select(template_col).distinct(), template_col, "left_anti")


def rows_with_templates(df: DataFrame, templates: DataFrame, template_col: str) -> DataFrame:
    """Rows whose template is in ``templates`` (semi join)."""
    return template_join(df, templates.select(template_col).distinct(), template_col, "left_semi")


def distinct_templates(df: DataFrame, template_col: str) -> DataFrame:
    return df.select(template_col).where(F.col(template_col).isNotNull()).distinct()


def template_difference(df: DataFrame, remove: DataFrame, template_col: str) -> DataFrame:
    """Distinct templates of ``df`` minus those in ``remove``."""
    return distinct_templates(df, template_col).join(remove.select(template_col), template_col, "left_anti")


def attach_template_freq(df: DataFrame, template_col: str, out_col: str = "freq") -> DataFrame:
    """Each row gets p(template) = rows of its template / rows with a template
    (rows with a null template get null)."""
    counts = template_counts(df, template_col).select(template_col, F.col("freq").alias(out_col))
    return template_join(df, counts, template_col, "left")


def skew_weight(freq, alpha: float):
    """freq ** alpha (alpha in [-1, 0]: -1 equal mass per template, 0 uniform)."""
    c = F.col(freq) if isinstance(freq, str) else freq
    return F.pow(c, F.lit(float(alpha)))


def distinct_children(df: DataFrame, parent: str, child: str, out_col: str = "children") -> DataFrame:
    """(parent, number of distinct non-null child templates)."""
    return df.groupBy(parent).agg(F.count_distinct(child).alias(out_col))


def examples_per_template(df: DataFrame, template_col: str, query_col: str = "query") -> DataFrame:
    """(template, count of non-null programs) - the cap's threshold count."""
    return df.where(F.col(template_col).isNotNull()).groupBy(template_col).agg(F.count(query_col).alias("examples"))
