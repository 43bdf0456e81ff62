"""The entry module without the training-data operators, or without a library
that they import."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("absent", ["statline.llm", "corpus_pipeline", "numpy"])
def test_library_queries_remain(absent):
    code = (f"import sys; sys.modules[{absent!r}] = None\n"
            "import __spark_entry__ as e\n"
            "own = set(e._registry.queries())\n"
            "assert own and own <= set(e.queries()) and own <= set(e.oracle_sql())\n"
            f"assert {absent!r} == 'corpus_pipeline' or own == set(e.queries())\n"
            "assert 'pipeline' not in e.queries()\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
