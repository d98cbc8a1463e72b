"""Every query of the engine against its SQL in DuckDB, on the smallest tables; and imports without the extra subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tesserae.plans import catalog

SMALL = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return float(v) if isinstance(v, float) else int(v) if isinstance(v, bool) or hasattr(v, "__index__") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SMALL))
    have = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in SQL:
        assert have
        return
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    place = [columns.index(c) for c in sorted(columns)]
    want = [tuple(plain(r[k]) for k in place) for r in cursor.fetchall()]
    assert sorted(map(repr, have)) == sorted(map(repr, want))


def test_nothing_else_needs_the_extra_subpackage():
    root = Path(__file__).resolve().parents[1]
    block = "import sys\nclass No:\n  def find_spec(self, name, *_):\n    if name == 'corpus_pipeline' or name.startswith('tesserae.llm'): raise ImportError(name)\nsys.meta_path.insert(0, No())\n"
    code = block + "import re, __spark_entry__ as e\nassert e.queries() and not any(re.match('op[0-9]', n) or n == 'pipeline' for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
