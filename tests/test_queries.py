"""Every query against its SQL, or for rows, at the smallest scale."""

import pytest
from conftest import SF, shown

from palmleaf.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in catalogue.ORACLE_SQL:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert shown(rows) == shown(duck.execute(f"SELECT {quoted} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
    else:
        assert rows


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
