"""The entry points stand with and without the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["dataset", "detected", "positives", "tpr", "threshold"]


def test_import_without_the_subpackage():
    program = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", program], check=True, cwd=entry.__file__.rpartition("/")[0])


def test_another_missing_module_is_an_error():
    program = "import sys, types; made = types.ModuleType('marlstone.llm'); made.__path__ = []; sys.modules |= {'corpus_pipeline': types.ModuleType('corpus_pipeline'), 'marlstone.llm': made}; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", program], capture_output=True, cwd=entry.__file__.rpartition("/")[0]).returncode


def test_nothing_else_imports_the_subpackage():
    found = subprocess.run(["grep", "-rln", "--include=*.py", "marlstone.llm", "marlstone"], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0]).stdout.split()
    assert all(x.startswith("marlstone/llm/") for x in found)
