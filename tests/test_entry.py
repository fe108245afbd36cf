import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_names_and_sql_agree():
    names = entry.queries()
    assert len(names) > 50 and set(entry.oracle_sql()) <= set(names)


def test_catalogue_needs_no_other_subpackage():
    for path in (REPO / "shelfmark").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"shelfmark\.llm|corpus_pipeline", path.read_text()), path


def test_import_needs_no_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_sql(spark, small, name):
    frame = entry.queries()[name](spark, small.folder)
    columns = sorted(frame.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    got = sorted((tuple(map(tidy, r)) for r in frame.select(*columns).collect()), key=str)
    result = small.con.execute(entry.oracle_sql()[name])
    place = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(tidy(r[i]) for i in place) for r in result.fetchall()), key=str)
    assert len(place) == len(result.description) and got == want


def test_entry_runs(spark, small, monkeypatch):
    assert entry.queries()["search_mask"](spark, small.folder).columns == ["item_id", "name"]
