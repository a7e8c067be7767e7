from pairlab.operators import models as C
from pairlab.operators.rows import canonical_pair
from pairlab.plans.training import prepare
from pairlab.session import FIT_MOST, FIT_ROWS, fit_task_count, table_by, task_count


def test_small_tables_have_few_tasks_and_large_ones_all(spark):
    assert fit_task_count(spark, 0) == fit_task_count(spark, FIT_ROWS) == 1
    assert fit_task_count(spark, FIT_ROWS + 1) == 2
    assert fit_task_count(spark, 10**9) == task_count(spark) > 2


def test_a_fit_has_no_more_tasks_than_slots_until_they_are_large(spark):
    slots, key = spark.sparkContext.defaultParallelism, "spark.sql.shuffle.partitions"
    kept = spark.conf.get(key)
    spark.conf.set(key, 25 * slots)
    try:
        assert fit_task_count(spark, 10 * slots * FIT_ROWS) == slots
        assert fit_task_count(spark, 10 * slots * FIT_ROWS, 4) == -(-slots // 4)
        assert fit_task_count(spark, 3 * slots * FIT_MOST, 4) == 3 * slots
    finally:
        spark.conf.set(key, kept)


def test_a_fit_passes_over_few_partitions(spark):
    v = spark.range(60).selectExpr("id", "array(cast(id as double), 1.0D) as v")
    pairs = spark.range(0, 60, 2).selectExpr("id as pair_id", "id as id_1", "id + 1 as id_2")
    data = prepare(pairs, v)
    assert canonical_pair(data.positives, "id_1", "id_2").count() == 30
    assert data.rows.rdd.getNumPartitions() == 1


def test_a_bag_is_fitted_on_partitions_of_its_own_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "fit_forest", lambda rows, **_: seen.append((rows.rdd.getNumPartitions(), rows.count())))
    rows = spark.range(400).selectExpr("id as id_a", "id as id_b", "cast(id % 4 as int) as bag", "id as features")
    table = table_by(rows.repartition(40), "bag", 4, "id_a", "id_b")
    C.fit_bags(spark.range(30).selectExpr("id as features").repartition(9), table, 4)
    assert seen == [(1, 130)] * 4


def test_a_table_by_key_keeps_rows_and_types_and_reads_one_folder(spark):
    rows = spark.range(50).selectExpr("id as id_a", "concat('0', id % 3) as fold", "cast(id as double) as x")
    table = table_by(rows, "fold", 3, "id_a")
    assert table.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    one = table.filter("fold = '01'")
    assert one.count() == 17 and all("fold=01" in f for (f,) in one.selectExpr("input_file_name()").distinct().collect())
