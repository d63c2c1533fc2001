"""Nothing outside of the training-data package imports it."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_does_not_import_llm():
    for p in (ROOT / "loomline").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "loomline").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
