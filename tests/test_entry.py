"""The entry module imports whatever of the training-data side was left out."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import tomllib

import pytest
from helpers import ROOT

LLM, PIPELINE = os.path.join("transitlens", "llm"), "corpus_pipeline.py"
WHOLE = os.path.isdir(os.path.join(ROOT, LLM)) and os.path.isfile(os.path.join(ROOT, PIPELINE))


@pytest.mark.parametrize("left_out", [(), (LLM, PIPELINE), (PIPELINE,), (LLM,)])
def test_entry_imports(tmp_path, left_out):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    skip = shutil.ignore_patterns("__pycache__", *(["llm"] if LLM in left_out else []))
    shutil.copytree(os.path.join(ROOT, "transitlens"), tmp_path / "transitlens", ignore=skip)
    if WHOLE and PIPELINE not in left_out:
        shutil.copy(os.path.join(ROOT, PIPELINE), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.ping_queries()), *[n for n in e.queries() if n not in e.ping_queries()])"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert said[0] == "35"
    others = said[1:]
    if not WHOLE or LLM in left_out:
        assert others == []
    else:
        assert sum(n.startswith("op") for n in others) == 13
        assert ("pipeline" in others) == (PIPELINE not in left_out)


def test_an_installed_copy_has_every_module():
    with open(os.path.join(ROOT, "pyproject.toml"), "rb") as f:
        built = tomllib.load(f)["tool"]["setuptools"]
    assert built["py-modules"] == ["corpus_pipeline"] and built["packages"]["find"]["include"] == ["transitlens*"]
