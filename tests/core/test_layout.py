"""What the repository promises about its own layout."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def imported(path: Path) -> set[str]:
    found = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            found.add("." * node.level + (node.module or ""))
    return found


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "quire").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any("llm" in name or "corpus_pipeline" in name for name in imported(path)), path


def test_no_local_checkpoints_and_no_cross_joins():
    for path in [*(ROOT / "quire").rglob("*.py"), *ROOT.glob("*.py")]:
        source = path.read_text()
        assert "localCheckpoint(" not in source and "crossJoin(" not in source, path
