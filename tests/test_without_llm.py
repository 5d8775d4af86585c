"""The library and its registry work where the training-data operators are absent."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder, before: str = "") -> str:
    code = before + "import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') for q in e.queries()), 'pipeline' in e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout


def test_registry_without_the_subpackage(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/plaintscope", tmp_path / "plaintscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    count, operators, pipeline = names(tmp_path).split()
    assert (operators, pipeline) == ("0", "False") and int(count) > 100


def test_registry_without_a_library_of_the_subpackage(tmp_path):
    if not os.path.isdir(f"{ROOT}/plaintscope/llm"):
        return
    count, operators, pipeline = names(ROOT, "import sys; sys.modules['sentencepiece'] = None; ").split()
    assert (operators, pipeline) == ("0", "False") and int(count) > 100


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/plaintscope"):
        if "llm" in folder.split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "plaintscope.llm" not in open(os.path.join(folder, f)).read(), f
