"""The library stands without the training-data subpackage, and the entry registers what is there."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "strandlake").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_is_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_query_cuts_its_tables():
    """No limits, samples or remainders of ids as filters in the driver's queries (the query set of vectors is one that is stated)."""
    for p in (ROOT / "strandlake" / "plans").glob("*_queries.py"):
        text = p.read_text()
        assert not re.search(r"(?<!haplotypes)\.(limit|sample|head|take)\(", text), p
        assert set(re.findall(r"where\(\"(\w+ % \d+ = \d+)", text)) <= {"vec_id % 100 = 0"}, p
