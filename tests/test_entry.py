"""The entry point without the optional parts."""

import os
import subprocess
import sys

import pytest

from tickloom.plans.catalogue import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys, warnings
for name in sys.argv[1:]:
    sys.modules[name] = None
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum("left out" in str(w.message) for w in told))
"""


@pytest.mark.parametrize("hidden", [["zstandard"], ["sentencepiece", "tokenizers"], ["tickloom.llm", "corpus_pipeline"]])
def test_catalogue_stays_without_optional_packages(hidden):
    made = subprocess.run([sys.executable, "-c", SCRIPT, *hidden], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    queries, oracles, warned = map(int, made.stdout.split())
    assert queries >= len(QUERIES) and oracles >= len(QUERIES)
    if hidden == ["zstandard"] and os.path.isdir(f"{ROOT}/tickloom/llm"):
        assert warned and queries == len(QUERIES)
