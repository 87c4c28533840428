"""The entry module, whole and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(root):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    q, o = out.stdout.strip().split("\n")[-2:]
    return set(q.split()), set(o.split())


def test_every_oracle_belongs_to_a_query():
    q, o = names(ROOT)
    assert o <= q and len(q) > 150
    if (ROOT / "tessera/llm").is_dir():
        assert "pipeline" in q and {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in q if x.startswith("op")}


def test_the_rest_stands_without_the_subpackage(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    q, o = names(tmp_path)
    assert o <= q and not any(x.startswith("op1") or x == "pipeline" for x in q) and len(q) > 150


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessera.llm" not in path.read_text() and "from .llm" not in path.read_text()
