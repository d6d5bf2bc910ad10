"""No module defines a name twice: the later one would hide the first."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_no_function_hides_another():
    for path in (ROOT / "tracklake").rglob("*.py"):
        for scope in ast.walk(ast.parse(path.read_text())):
            if isinstance(scope, (ast.Module, ast.ClassDef)):
                names = [n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
                assert len(names) == len(set(names)), path
