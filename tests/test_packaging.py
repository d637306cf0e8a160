"""The package reaches workers as an archive, from any working directory."""

import os
import shutil
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_archive_from_a_foreign_folder(tmp_path):
    shutil.copytree(f"{ROOT}/alphaloom", tmp_path / "src/alphaloom", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    archive = shutil.make_archive(str(tmp_path / "alphaloom"), "zip", tmp_path / "src")
    job = textwrap.dedent("""
        import sys
        from pyspark.sql import SparkSession
        s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        s.sparkContext.addPyFile(sys.argv[1])
        from alphaloom.streaming import io, stateful, windows
        e = windows.ticks(io.file_stream(s, "/root/testdata/sf0.001/events.parquet"))
        print("ROWS", io.drain(stateful.position_exits(e)).count())
    """)
    (tmp_path / "job.py").write_text(job)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "job.py", archive], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
