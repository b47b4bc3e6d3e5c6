import re
from pathlib import Path

import pytest
from compare import duck_rows, spark_rows

from corvane.llm import queries

ROOT = Path(__file__).resolve().parents[2]
COLUMNS = {"p1_found": ["seq_a", "seq_b"], "p2_found": ["seq", "line_no"], "p3_found": ["pair_id", "defect"], "p5_found": ["seq_a", "seq_b"], "p6_found": ["seq", "kind"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_without_repeats(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        rows = df.collect()
        assert rows and len({repr(r) for r in rows}) == len(rows)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    columns, rows = spark_rows(queries.queries()[name](spark, data))
    assert (columns, rows) == duck_rows(queries.oracle_sql()[name], data)


def test_nothing_outside_imports_the_subpackage():
    for p in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"corvane\.llm|from \.+llm|import llm", p.read_text()), p
