import re
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_names_and_sql_go_together():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 140
    for n in range(1, 8):
        assert f"p{n}_found" in names


def test_everything_imports_without_the_llm_package(tmp_path):
    code = "import sys; sys.modules['stridewell.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries(); assert not any(n.startswith(('p8', 'p9', 'p10')) for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_else_imports_the_llm_package():
    for p in (REPO / "stridewell").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text())
