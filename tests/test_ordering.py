import random

from pyspark.sql import functions as F

from quillstream.operators.ordering import with_position


def test_positions_are_the_sorted_order(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 1, 2, 3])) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = with_position(df, [F.col("v").desc_nulls_last(), F.col("id")]).orderBy("position").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.v) for r in got] == want and [r.position for r in got] == list(range(1, 501))
    assert with_position(df.limit(0), [F.col("id")]).collect() == []
