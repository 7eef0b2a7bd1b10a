import __spark_entry__ as e


def test_every_sql_has_its_query_and_names_are_plain():
    known = e.queries()
    assert set(e.oracle_sql()) <= set(known)
    assert all(n.replace("_", "").isalnum() for n in known)


def test_entry_runs(spark):
    assert len(e.entry(spark).collect()) == 20


def test_engine_stands_without_the_llm_folder():
    import subprocess
    import sys

    code = "import sys; sys.modules['surfacelab.llm'] = None\nimport __spark_entry__ as e\nassert 'q_nms' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()), list(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=e.__file__.rsplit("/", 1)[0])
