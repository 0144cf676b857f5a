"""The entry file in a copy of the library, with and without the optional corpus folders."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
PROBE = """
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(len([n for n in names if not n.startswith("op") and n != "pipeline"]), sum(n.startswith("op") for n in names))
"""


@pytest.mark.parametrize("left_out", [["llm"], ["llm", "corpus_pipeline.py"], []])
def test_import_without_corpus_folders(tmp_path, left_out):
    from tablekeep.plans import QUERIES

    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copytree(ROOT / "tablekeep", copy / "tablekeep", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and (ROOT / name).exists():
            shutil.copy(ROOT / name, copy / name)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    governed, corpus = map(int, done.stdout.split())
    assert governed == len(QUERIES)
    assert (corpus > 0) == (not left_out and (ROOT / "tablekeep" / "llm").exists())
