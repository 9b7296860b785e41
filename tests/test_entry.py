import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_entry_works_without_what_the_corpus_part_needs():
    for missing in ("tracelattice.llm", "public_tokenizers", "corpus_pipeline"):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
        assert int(out[0]) > 80 and int(out[1]) > 80 and int(out[0]) <= len(entry.queries())
