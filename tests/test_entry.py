"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


def test_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tarnlight"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "tarnlight"
    package.mkdir()
    for path in (ROOT / "tarnlight").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (package / path.name).symlink_to(path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'nation_revenue' in names and not any(n.startswith('op') or n == 'pipeline' for n in names); print(len(e.oracle_sql()))"
    for leftover in (False, True):
        if leftover:
            (package / "llm").mkdir()
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr
