"""The registry: every query has a stable schema; SQL and Spark agree on a few of them; the optional part is optional."""

import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kinetrail.plans.catalogue import ORACLES, QUERIES  # with the rows that the registry's other modules add

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["src", "dst", "n_ij", "jump_lag"] and df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.fixture(scope="module")
def rows(spark):
    """The queries' rows, several at a time: small ones mostly wait for their planning."""
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(lambda f=QUERIES[name]: f(spark, str(DATA)).toPandas()) for name in sorted(ORACLES)}


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_spark_equals_sql(rows, duck, name):
    want = duck.sql(ORACLES[name]).df()
    key = sorted(want.columns)
    got = rows[name].result()
    assert sorted(got.columns) == key and len(want) == len(got)

    def plain(df):
        rounded = {c: df[c].astype("float64").round(5) + 0.0 if df[c].dtype.kind in "fiu" else df[c] for c in key}
        return df.assign(**rounded).sort_values(key).reset_index(drop=True)

    want, got = plain(want), plain(got)
    for c in key:
        assert want[c].tolist() == (pytest.approx(got[c].tolist(), nan_ok=True, abs=2e-5) if want[c].dtype.kind == "f" else got[c].tolist())


def test_only_missing_optional_parts_are_passed_over(tmp_path):
    """Without the optional folders the rest works; an error inside them is raised."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "kinetrail", tmp_path / "kinetrail", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    if (tmp_path / "kinetrail" / "llm").exists():
        (tmp_path / "kinetrail" / "llm" / "queries.py").write_text("import no_such_module\n")
        assert "no_such_module" in run().stderr
        shutil.rmtree(tmp_path / "kinetrail" / "llm")
        (tmp_path / "corpus_pipeline.py").unlink()
    (tmp_path / "kinetrail" / "llm").mkdir()  # what is left of a deleted folder
    done = run()
    assert done.returncode == 0 and done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


def test_workers_can_import_every_module_without_a_session():
    root = Path(__file__).resolve().parent.parent
    modules = [".".join(p.relative_to(root).with_suffix("").parts) for p in (root / "kinetrail").rglob("*.py") if p.name != "__init__.py" and p.parent.name != "llm"]
    subprocess.run([sys.executable, "-c", "import " + ", ".join(modules)], cwd=root, check=True)
