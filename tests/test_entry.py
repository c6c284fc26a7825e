import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_part(tmp_path):
    for name in ("samplewell", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "samplewell/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) == 99 and set(q) - set(o) == {'validation_metrics'} and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_a_missing_library_leaves_the_engine(tmp_path):
    code = """
import sys
sys.modules["xxhash"] = None
import __spark_entry__ as e
assert len(e.queries()) == 99 and len(e.oracle_sql()) == 98
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_rest_passes_without_the_corpus_part(tmp_path):
    for name in ("samplewell", "tests", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "samplewell/llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "tests/llm", ignore_errors=True)
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=tmp_path, capture_output=True, text=True)
    collected = run("tests", "--collect-only")
    assert collected.returncode == 0, collected.stdout[-2000:]
    found = run("tests/test_engine.py", "tests/test_entry.py", "-k", "wire or flagship")  # the others don't touch what was deleted: all are collected
    assert found.returncode == 0, found.stdout[-2000:]


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
