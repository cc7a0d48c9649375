"""The driver contract, whole and without the optional folders."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
OPTIONAL = ("riskloom/llm", "tests/llm", "corpus_pipeline.py")
SAYS = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(root):
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=root, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.splitlines()[-1])


def copied(tmp_path, left_out):
    for name in ("riskloom", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = ROOT / name, tmp_path / name
        if name in left_out or not source.exists():
            continue
        if source.is_dir():
            gone = [Path(x).name for x in left_out if x.startswith(f"{name}/")]
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("__pycache__", *gone))
        else:
            shutil.copy(source, target)
    return tmp_path


@pytest.mark.parametrize("left_out", [OPTIONAL, OPTIONAL[:2]], ids=["all", "folders"])
def test_the_other_queries_stay(tmp_path, left_out):
    """Without the optional folders, whether or not the pipeline's file is still there."""
    found, sql = names(copied(tmp_path, left_out))
    from riskloom.plans.catalog import catalog
    from riskloom.plans.oracle import oracle

    assert found == sorted(catalog()) and sql == sorted(oracle())


def test_errors_inside_an_optional_module_are_not_hidden(tmp_path):
    root = copied(tmp_path, OPTIONAL)
    (root / "riskloom/llm").mkdir()
    (root / "riskloom/llm/__init__.py").write_text("")
    (root / "riskloom/llm/queries.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=root, capture_output=True, text=True, check=False)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
