"""The engine without the training-data subpackage and its tests."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SAID = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in [*q, *o]))"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", SAID], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()


def test_entry_points_without_the_subpackage(tmp_path):
    """With both folders deleted, the corpus pipeline left in place or not, the engine's queries are listed and nothing else."""
    from marlspar.plans import catalog, roundtrips  # noqa: F401

    kept = shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse")
    shutil.copytree(REPO, tmp_path / "repo", ignore=kept)
    for _ in range(2):
        assert listed(tmp_path / "repo") == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"]
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry_points_without_optional_libraries(tmp_path):
    """A library that only the subpackage needs takes only its queries with it."""
    (tmp_path / "regex.py").write_text("raise ImportError('not here')")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); " + SAID
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split()[2] == "False", out.stderr[-2000:]
