import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert entry.entry(spark).limit(1).count() == 1


def test_the_rest_stands_where_a_library_is_missing():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'peth' in q and 'op1_license_scan' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
