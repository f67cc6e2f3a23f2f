"""What is written once of the leveled pool: only what the query reads."""
import datetime

from splitcraft.operators import neighbours as NB
from splitcraft.operators import splits as S
from splitcraft.plans import catalog


def _orders(spark, folder):
    day = datetime.datetime(2020, 1, 1)
    rows = [(k, k * 7 % 50, "FOP"[k % 3], 1.0, day, f"{k % 5}-URGENT") for k in range(300)] + [(5, 3, "F", 1.0, day, "1-URGENT"), (7, None, None, None, None, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_narrow_pool_has_the_rows_of_the_whole_one(spark, tmp_path):
    sf = _orders(spark, tmp_path)
    whole = catalog.leveled_pool(spark, sf)
    for cols in (S.HIERARCHY_LEVELS, catalog.NBR_COLUMNS, ["template"]):
        narrow = catalog.leveled_pool(spark, sf, cols)
        assert sorted(map(str, narrow.select(*cols).collect())) == sorted(map(str, whole.select(*cols).collect()))


def test_only_columns_that_are_read_are_written(spark, tmp_path, monkeypatch):
    sf = _orders(spark, tmp_path)
    written = []

    def noted(df):
        written.append(df.columns)
        return df

    monkeypatch.setattr(catalog, "materialize", noted)
    monkeypatch.setattr(NB, "neighbour_sets", lambda pool, *args: pool)
    catalog.q_neighbour_sets(spark, sf)
    catalog.q_distinct_children(spark, sf)
    for cols in written:
        assert not {"query", "question", "domain"} & set(cols)
    assert "template_kbfree" not in written[0]  # a level that the sets don't use
