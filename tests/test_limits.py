"""Results that must not depend on caps, prefixes or estimates."""
import pytest
from pyspark.sql import functions as F

from splitcraft import session
from splitcraft.functions import templates as T
from splitcraft.functions import text as TX
from splitcraft.operators import joins, neighbours as NB, splits as S
from splitcraft.operators.templating import exclude_eval_templates


def test_more_tokens_than_one_code_block(spark):
    """Tokens past U+9FFF and past the surrogates keep their distances."""
    n = 36000
    rows = [(" ".join(f"t{i}" for i in range(a, a + 60)),) for a in range(0, n, 60)]
    rows += [("t5 t6 t35990 t35991 t35992",), ("t5 t6 t35990 t35991 zzz",), ("t5 t6 t35990 t35991",)]
    got = {(r.t1, r.t2): r.dist for r in NB.template_pairs(spark.createDataFrame(rows, "t string"), "t", 2).collect()}
    a, b, c = (r[0] for r in rows[-3:])
    assert got == {(a, b): 1, (b, a): 1, (a, c): 1, (c, a): 1, (b, c): 1, (c, b): 1}


def test_too_many_tokens_raise(spark, monkeypatch):
    monkeypatch.setattr(NB, "CODE_SIZE", 3)
    with pytest.raises(ValueError, match="distinct tokens"):
        NB.token_codes(spark.createDataFrame([("a b c d e",)], "t string"), ["t"])


def test_sets_do_not_depend_on_the_prefix_read(spark):
    """Many sets that want the rows of few templates."""
    rows = [(f"e{i}", f"a {i % 3}", f"x {i % 4} y") for i in range(240)]
    pool = spark.createDataFrame(rows, "example_id string, abstract_template string, template string")
    short, whole = (sorted(map(tuple, NB.neighbour_sets(pool, "example_id", "abstract_template", "template", 120, 5, start_prefix=p)
                               .where("label = 1").select("set_id", "example_id").collect())) for p in (2, 240))
    assert short == whole and len(short) > 60


def test_template_joins_leave_the_rows_in_place(spark):
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit("t"), F.pmod("id", F.lit(7)).cast("string")).alias("abstract_template"))
    held = spark.createDataFrame([("t3",), ("t9",), (None,)], "abstract_template string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exclude_eval_templates(rows, held)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert out.count() == rows.where("abstract_template <> 't3'").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_template_joins_beyond_the_limit(spark, monkeypatch, how):
    rows = spark.createDataFrame([(i, None if i == 5 else f"t{i % 4}") for i in range(50)], "id long, t string")
    side = spark.createDataFrame([("t1", 1), ("t2", 2), ("t8", 8)], "t string, v int")
    side = side if how in ("inner", "left") else side.select("t")
    small = sorted(map(str, joins.template_join(rows, side, "t", how).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert sorted(map(str, joins.template_join(rows, side, "t", how).collect())) == small


def test_hierarchy_weights_need_no_nesting(spark):
    """A finest template under two parents does not repeat rows."""
    rows = [(f"e{i}", "top", f"m{i % 2}", "k", "fine") for i in range(10)]
    pool = spark.createDataFrame(rows, "example_id string, template_kbfree_untyped_noops string, template_kbfree_untyped string, template_kbfree string, template string")
    hw = S.hierarchy_weights(pool)
    assert hw.count() == 2
    assert joins.template_join(pool, hw.select(*S.HIERARCHY_LEVELS, "hweight"), S.HIERARCHY_LEVELS).count() == 10


def test_curly_quotes_fold_like_straight_ones(spark):
    df = spark.createDataFrame([("now => @a.b param:name == \" joe’s bar – \" => notify",), ("now => @a.b param:name == \" joe's bar - \" => notify",)], "query string")
    a, b = (r[0] for r in df.select(T.template_typed("query")).collect())
    assert a == b and "joe" not in a
    assert spark.range(1).select(TX.ascii_fold(F.lit("“x” — y… «z» 2×3"))).first()[0] == '"x" -- y... <<z>> 2x3'


def test_no_local_checkpoint_folder_off_a_local_master(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())


def test_strict_domains_raise(spark):
    df = spark.createDataFrame([("nosuch-1", "q")], "example_id string, question string")
    assert df.select(TX.domain_prefix("example_id", "question")).first()[0] is None
    with pytest.raises(Exception, match="no marker"):
        df.select(TX.domain_prefix("example_id", "question", strict=True)).collect()


def test_too_large_samples_can_be_refused(spark):
    pool = spark.createDataFrame([(f"e{i}", "t", "now => @a.b => notify") for i in range(5)], "example_id string, t string, query string")
    with pytest.raises(ValueError, match="larger"):
        S.uat_splits(pool, "example_id", "t", "query", sizes=(6,), on_short="error")


def test_ids_by_place_and_positional_headers(spark, tmp_path):
    from splitcraft.sources import tsv as TSV

    pairs = spark.createDataFrame([(f"q{i}", f"p{i}") for i in range(30)], "a string, b string").coalesce(1)
    pairs.write.option("sep", "\t").csv(str(tmp_path / "pairs"))
    got = TSV.read_pairs(spark, str(tmp_path / "pairs"), 0, 1, id_col=None)
    assert sorted((int(r.example_id), r.question, r.query) for r in got.collect()) == [(i, f"q{i}", f"p{i}") for i in range(30)]
    TSV.write_pool(got, str(tmp_path / "pool"), "tsv", positional=True)
    assert TSV.read_splits(spark, str(tmp_path / "pool")).columns == ["0", "1", "2"]
