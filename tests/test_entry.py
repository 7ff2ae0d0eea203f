"""The entry module, in processes of its own: without a session, and without the optional modules."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len([n for n in q if not n.startswith(('op', 'pipeline'))]), len([n for n in o if not n.startswith('op')]))"


def run(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


def copied(to, *left_out):
    shutil.copytree(HERE, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *left_out))
    return to


def test_imports_without_a_session():
    got = run(HERE, LIST)
    assert got.returncode == 0 and len(set(got.stdout.split())) == 1, got.stderr


def test_imports_without_the_optional_modules(tmp_path):
    whole = run(HERE, LIST).stdout
    assert run(copied(tmp_path / "a", "llm", "corpus_pipeline.py"), LIST).stdout == whole
    assert run(copied(tmp_path / "b", "llm"), LIST).stdout == whole


def test_what_the_optional_modules_need_may_not_be_missing(tmp_path):
    folder = copied(tmp_path / "a")
    if os.path.exists(folder / "corpus_pipeline.py"):
        with open(folder / "corpus_pipeline.py", "a") as f:
            f.write("import no_such_module\n")
        assert "no_such_module" in run(folder, LIST).stderr
