"""Command line, same flags as the reference's split script, run on Spark.

  python -m splitcraft.plans.cli splits --augmented_path pool.tsv \\
      --compositional_test_path test.tsv --compositional_dev_path dev.tsv \\
      --training_size 20 --create_training_pool --save_training_pool --save_uat_samples

  python -m splitcraft.plans.cli instances --split_table small_uat_splits.tsv \\
      --condition_name -1_20_0_false --condition_value 1 --out train_instances

  python -m splitcraft.plans.cli score --predictions preds.jsonl --out scores

Outputs go next to the input (``em_preprocessed.tsv``, ``small_uat_splits.tsv``)
as Spark output folders.  ``spark.checkpoint.dir`` is taken from the session
configuration; only when it is unset (a laptop) a local scratch folder is used.
"""
from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import templates as T
from ..operators import evaluate as EV
from ..operators import shaping as SH
from ..operators import splits as S
from ..operators import templating as TP
from ..operators.templating import exclude_eval_templates, with_abstract_template
from ..session import get_session, materialize
from ..sources import tsv as TSV

log = logging.getLogger("splitcraft")


def run_splits(spark, args) -> dict:
    pool = TSV.read_pairs(spark, args.augmented_path, args.question_col_index, args.query_col_index)
    pool = materialize(with_abstract_template(pool, "query", id_col="example_id"))
    evalt = TSV.read_eval_templates(spark, [args.compositional_test_path, args.compositional_dev_path])
    if args.create_training_pool:
        pool = exclude_eval_templates(pool, evalt, "abstract_template")
    pool = pool.withColumn("template", T.template_typed(F.col("query")))
    out = {}
    parent = Path(args.augmented_path).parent
    if args.save_training_pool:
        if not args.create_training_pool:
            log.warning("training pool is identical to the input data file")
        out["pool"] = str(parent / "em_preprocessed.tsv")
        TSV.write_pool(pool, out["pool"], "tsv")
    if args.save_uat_samples:
        specs = S.uat_specs([-1], [args.training_size], 5)
        a = S.uat_splits(pool, "example_id", "abstract_template", "query", [-1], [args.training_size],
                         replicates=5, dev_share=0.20, seed=args.seed, on_short="error").persist()
        S.check_split_sizes(a)
        pool_f = TP.attach_template_freq(pool, "abstract_template")
        out["splits"] = str(parent / "small_uat_splits.tsv")
        TSV.write_splits(a, out["splits"], pool=pool_f, split_names=[s["split_name"] for s in specs], fmt="tsv")
    return out


def run_instances(spark, args) -> str:
    table = TSV.read_splits(spark, args.split_table, header=True)
    rows = (SH.select_split_wide(table, args.example_id_col, args.condition_name, args.condition_value,
                                 (args.utterance_col, args.program_col))
            if args.condition_name else table.select(args.example_id_col, args.utterance_col, args.program_col))
    if args.debug:   # the first 1,001 rows, counted before empty sources are skipped
        rows = SH.debug_limit(rows, args.example_id_col)
    rows = SH.drop_empty_source(rows, args.utterance_col)
    inst = SH.instances(rows, args.example_id_col, args.utterance_col, args.program_col,
                        args.source_max_tokens, args.target_max_tokens, args.lower_case_output,
                        args.add_domain_token).persist()
    counts = SH.truncation_counts(inst).first()
    if args.source_max_tokens and counts["source_exceeded"]:
        log.info("In %d instances the source exceeded %d tokens and was truncated",
                 counts["source_exceeded"], args.source_max_tokens)
    inst.write.mode("overwrite").parquet(args.out)
    return args.out


def run_score(spark, args) -> str:
    preds = TSV.read_predictions(spark, args.predictions)
    flags = preds.select("example_id", EV.exact_match("target_tokens", "predicted_tokens").alias("correct"))
    TSV.write_predictions(flags, args.out + "/correct", filter_mode=True)
    markers = (SH.START_SYMBOL, SH.END_SYMBOL)
    parts = [flags.agg(F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("exact_match")),
             EV.sequence_accuracy(preds, "target_tokens", "predicted_tokens"),
             EV.bleu(preds, "target_tokens", "predicted_tokens", exclude=markers),
             EV.rouge(preds, "target_tokens", "predicted_tokens", exclude=markers)]
    acc = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:   # one-row totals
        acc = acc.join(part.withColumn("_one", F.lit(1)), "_one")
    acc = acc.drop("_one")
    acc.write.mode("overwrite").json(args.out + "/summary")
    return args.out


def main(argv=None):
    p = argparse.ArgumentParser(prog="splitcraft")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("splits")
    s.add_argument("--compositional_test_path", default="data/program_test.tsv")
    s.add_argument("--compositional_dev_path", default="data/program_dev.tsv")
    s.add_argument("--augmented_path", default="data/small_synthetic_data.tsv")
    s.add_argument("--question_col_index", type=int, default=1)
    s.add_argument("--query_col_index", type=int, default=2)
    s.add_argument("--training_size", type=int, default=20)
    s.add_argument("--save_training_pool", action="store_true")
    s.add_argument("--create_training_pool", action="store_true")
    s.add_argument("--save_uat_samples", action="store_true")
    s.add_argument("--seed", type=int, default=0)
    i = sub.add_parser("instances")
    i.add_argument("--split_table", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--condition_name")
    i.add_argument("--condition_value", type=int)
    i.add_argument("--example_id_col", default="example_id")
    i.add_argument("--utterance_col", default="question")
    i.add_argument("--program_col", default="query")
    i.add_argument("--source_max_tokens", type=int)
    i.add_argument("--target_max_tokens", type=int)
    i.add_argument("--lower_case_output", action="store_true")
    i.add_argument("--add_domain_token", action="store_true")
    i.add_argument("--debug", action="store_true")
    c = sub.add_parser("score")
    c.add_argument("--predictions", required=True)
    c.add_argument("--out", required=True)
    args = p.parse_args(argv)
    spark = get_session()
    if args.cmd == "splits":
        return run_splits(spark, args)
    if args.cmd == "instances":
        return run_instances(spark, args)
    return run_score(spark, args)


if __name__ == "__main__":
    main()
