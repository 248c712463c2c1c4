import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and lists its queries where the llm folders and the pipeline are gone."""
    for item in ROOT.iterdir():
        if item.name not in ("docloom", "tests", "corpus_pipeline.py", ".git"):
            (tmp_path / item.name).symlink_to(item)
    (tmp_path / "docloom").mkdir()
    for item in (ROOT / "docloom").iterdir():
        if item.name not in ("llm", "__pycache__"):
            (tmp_path / "docloom" / item.name).symlink_to(item)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
