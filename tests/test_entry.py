import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from paperloom import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_flagship(spark):
    assert entry.entry(spark).count() == 25


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(rows):
    return sorted(repr(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(queries.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert shown(df.select(*cols).collect()) == shown([tuple(r[k] for k in at) for r in found.fetchall()])


def test_imports_without_the_llm_part():
    code = "import sys\nfor m in ('corpus_pipeline', 'paperloom.llm'):\n    sys.modules.pop(m, None)\nclass F:\n    def find_spec(self, n, p=None, t=None):\n        if n in ('corpus_pipeline', 'paperloom.llm'):\n            raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, F())\nimport __spark_entry__ as e\nassert not any(k.startswith('op') or k == 'pipeline' for k in e.queries()) and len(e.queries()) > 30\n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
