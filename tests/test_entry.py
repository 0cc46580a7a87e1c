"""Driver contract: entry() runs, every query has a callable, oracles name real queries."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_registry(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert df.columns == ["doc_id", "fp_hex", "is_duplicate", "action"]
    rows = df.collect()
    assert len(rows) == 200 and {r.action for r in rows} <= {"store_unique", "skip_duplicate", "store_with_error"}
    qs, oracles = m.queries(), m.oracle_sql()
    assert set(oracles) <= set(qs) and len(qs) >= 50
    for name, sql in oracles.items():
        assert "LIMIT" not in sql or name.startswith("top"), name  # limits only where they are the feature
