import importlib.util
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_needs_no_session_and_llm_is_apart():
    code = "import __spark_entry__ as e, sys; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 60; print('ok')"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.stdout.strip().endswith("ok"), done.stderr
    for f in (ROOT / "termforge").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "termforge.llm" not in f.read_text(), f


def test_all_problems_are_registered():
    import __spark_entry__ as e

    wanted = {"p2_found", "p3_found", "p7_found"}
    if importlib.util.find_spec("termforge.llm") is not None:
        wanted |= {f"p{n}_found" for n in (1, 4, 5, 6, 8, 9, 10)}
    assert wanted <= set(e.queries())
