"""Registered queries work on whole tables."""

from tidewater.queries import engine, queries

SF = "/root/testdata/sf0.001"


def test_customers_with_missing_keys_are_all_there(spark):
    e = engine(spark, SF)
    rows = [tuple(r) for r in e.dataframe("customer_n { .c_custkey, .k }").collect()]
    assert len(rows) == spark.read.parquet(f"{SF}/customer.parquet").count() > 40
    pairs = [(a, b) for a in rows for b in rows if a[1] == b[1]]
    got = e.dataframe("customer_n as a join customer_n as b on a.k = b.k { a: a.c_custkey, b: b.c_custkey }")
    assert sorted(map(tuple, got.collect())) == sorted((a[0], b[0]) for a, b in pairs)
    got = e.dataframe("customer_n as a join customer_n as b on a.k < b.k { a: a.c_custkey, b: b.c_custkey }")
    less = [(a[0], b[0]) for a in rows for b in rows if b[1] is not None and (a[1] is None or a[1] < b[1])]
    assert sorted(map(tuple, got.collect())) == sorted(less)


def made_by_joins(spark, name):
    """The most rows that a join of a registered query makes, and the rows of its result."""
    from tests.llm.test_texts import join_rows

    since = join_rows(spark)[1]
    found = queries()[name](spark, SF).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return max(join_rows(spark, since)[0]), found


def test_a_key_of_few_values_makes_no_square_of_its_rows(spark):
    """Equal keys: a join makes a row for each key, though the result counts all pairs."""
    made, found = made_by_joins(spark, "null_key_join")
    assert made <= len(found) == 5 and sum(r["n"] for r in found) > 400


def test_an_inequality_of_few_values_makes_no_square_of_its_rows(spark):
    """Smaller keys: a join makes a row for each pair of keys, of ten that match."""
    made, found = made_by_joins(spark, "theta_join")
    assert made <= 10 and len(found) == 4 and sum(r["n"] for r in found) > 800
