import __spark_entry__ as driver


def test_names_and_sql_agree():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80 and len(sql) > 70
    assert all(text.strip() for text in sql.values())


def test_entry_runs(spark):
    df = driver.entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"] and df.limit(5).count() == 5


def test_core_stands_alone():
    import pathlib
    import re

    root = pathlib.Path(driver.__file__).parent / "annales"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+annales\.llm", path.read_text(encoding="utf-8")), path
