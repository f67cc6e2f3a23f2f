"""What the workers of one task hold beside each other."""
from splitcraft.llm import pii


def test_copied_texts_are_told_apart_without_a_python_worker(spark):
    rows = [(1, "one a"), (2, "two b"), (3, "one a"), (4, None), (5, ""), (6, "three c"), (7, "one a"), (8, "two b ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = pii._texts(docs, "doc_id", "text")
    once = pii.different_texts(texts, texts)
    # the counts that follow run in a worker of their own
    assert "EvalPython" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.text for r in once.collect()) == ["", "one a", "three c", "two b", "two b "]


def test_bits_of_many_copied_texts(spark):
    texts = spark.range(600).selectExpr("id as key", "id as doc_id", "xxhash64(id % 400) as text_key", "cast(id % 400 as string) as text")
    once = pii.different_texts(texts, texts)
    assert once.count() == 400 and once.distinct().count() == 400
    # keys of one bit that stand for different texts are kept apart
    same = spark.createDataFrame([(1, 1, 7, "x"), (2, 2, 7, "x"), (3, 3, 7 + pii.COPY_BITS, "y")], "key long, doc_id long, text_key long, text string")
    assert sorted(r.text for r in pii.different_texts(same, same).collect()) == ["x", "y"]
