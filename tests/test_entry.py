import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.core.queries) > 120


def test_core_does_not_import_the_subpackage():
    for p in (ROOT / "weftline").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "weftline").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("weftline.llm" in n for n in names), p


def test_entry(spark):
    assert entry.entry(spark).count() > 100
