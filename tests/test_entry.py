"""Every query with a SQL counterpart gives the same rows; the training-data part may be absent."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from trawlframe.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
TABLES = "pages events documents"


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(str([plain(v) for v in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def entry_in(folder: Path, code: str) -> subprocess.CompletedProcess:
    (folder / "run.py").write_text(f"import sys; sys.path.insert(0, {str(folder)!r})\n" + code)
    (folder / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    return subprocess.run([sys.executable, "run.py"], cwd=folder, check=True, capture_output=True, text=True)


CRAWL_ONLY = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'page_links' in q and 'pipeline' not in q"


def test_imports_without_the_training_data_part(tmp_path):
    (tmp_path / "trawlframe").mkdir()
    for p in (ROOT / "trawlframe").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "trawlframe" / p.name).symlink_to(p)
    assert "UserWarning" not in entry_in(tmp_path, CRAWL_ONLY).stderr


@pytest.mark.skipif(not (ROOT / "corpus_pipeline.py").exists(), reason="the training-data part is not there")
@pytest.mark.parametrize("library", ["xxhash", "numpy"])
def test_imports_without_a_library_of_that_part(tmp_path, library):
    (tmp_path / "trawlframe").symlink_to(ROOT / "trawlframe")
    (tmp_path / "corpus_pipeline.py").symlink_to(ROOT / "corpus_pipeline.py")
    told = entry_in(tmp_path, f"sys.modules[{library!r}] = None\n" + CRAWL_ONLY)
    assert "without the training-data operators" in told.stderr
