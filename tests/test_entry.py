import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_the_operators_of_training_data(tmp_path):
    """Without that subpackage the entry module has the other queries and their check SQL."""
    for part in ("shelfrank", "oracle"):
        shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / file).exists():
            shutil.copy(ROOT / file, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
