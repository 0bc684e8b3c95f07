import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from corpusloom.operators.definitions import code_chunks
from corpusloom.ship import ship
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
ship(spark)
files = spark.createDataFrame([("a.py", "python", "def f():\\n    pass\\n")], "path string, language string, content string")
print("FOUND", [r.symbol_name for r in code_chunks(files).collect()])
"""


def test_workers_import_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_PYTHON")}
    env["PYSPARK_PYTHON"] = sys.executable
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    run = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert "FOUND ['f']" in run.stdout, run.stderr[-2000:]
