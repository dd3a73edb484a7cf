import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


def test_a_library_that_is_missing_costs_only_what_needs_it(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ImportError")
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.PAGE_QUERIES) and set(e.oracle_sql()) == set(e.PAGE_SQL)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{REPO}"})


def test_imports_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "quirelake"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quirelake" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'page_metric' in q and not any(x.startswith('op') for x in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
