import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_part(tmp_path, pipeline):
    """With or without the pipeline's module, which imports the part that is gone."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'manifest' in q and set(o) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_errors_of_the_part_itself_are_raised(tmp_path):
    (tmp_path / "salvora/llm").mkdir(parents=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for name in ("salvora/__init__.py", "salvora/llm/__init__.py"):
        (tmp_path / name).touch()
    (tmp_path / "salvora/llm/queries.py").write_text("import no_such_module")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e._llm()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.returncode and "no_such_module" in got.stderr
