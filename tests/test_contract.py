import __spark_entry__ as contract


def test_entry_and_registry(spark):
    assert contract.entry(spark).count() == 800
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 95


def test_listed_operators_have_a_query():
    ids = {name.split("_")[0] for name in contract.queries()}
    wanted = {f"{family}{i}" for family, last in (("a", 16), ("b", 22), ("c", 17), ("d", 11), ("e", 13), ("f", 8), ("g", 4), ("h", 7)) for i in range(1, last + 1)}
    # Writers (a9, a11, a14) have round-trip tests; b7_b8 is one query.
    assert wanted - ids <= {"a9", "a11", "a14", "b8"}
