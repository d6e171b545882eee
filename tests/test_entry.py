"""The rest of the library works without the subpackage llm."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_without_llm():
    code = (
        "import sys; sys.modules['folioscan.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')] and len(q) > 50; assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for p in (ROOT / "folioscan").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "folioscan").parts:
            assert "folioscan.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
