"""The registered queries: names, SQL and the smoke query; the core works without the text subpackage."""

from pathlib import Path

import __spark_entry__ as entry
import weftline
from weftline.plans import registry


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and "p1_found" in registry.queries()
    assert set(entry.queries()) >= set(registry.queries()) and set(entry.oracle_sql()) >= set(registry.oracle_sql())


def test_core_never_imports_text_operators():
    root = Path(weftline.__file__).parent
    sources = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert len(sources) > 20 and not any("llm" in line for p in sources for line in p.read_text().splitlines() if line.lstrip().startswith(("import ", "from ")))


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "context_status", "n"] and df.count() > 0
