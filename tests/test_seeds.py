"""Seeds change the sample, and samples spread over the whole id range."""

from spate.operators import classify


def test_split_depends_on_the_seed_and_spreads(spark):
    df = spark.range(2000).withColumnRenamed("id", "id")
    held = {s: {r["id"] for r in classify.split(df, seed=s).filter("split <> 'train'").collect()} for s in (0, 12345)}
    assert all(len(h) == 200 for h in held.values())
    assert 2 <= len(held[0] & held[12345]) <= 50  # 20 expected
    for h in held.values():
        assert all(10 <= sum(a <= i < a + 500 for i in h) for a in range(0, 2000, 500))


def test_split_takes_string_ids(spark):
    df = spark.createDataFrame([(f"x{k}",) for k in range(50)], "id string")
    assert classify.split(df).filter("split = 'test'").count() == 3
