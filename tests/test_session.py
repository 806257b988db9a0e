"""The library starts on a plain machine, without any Spark configuration."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_empty_configuration(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from foldwise.session import cut_lineage, ensure_checkpoint_dir, get_session
        spark = get_session(1)
        first = ensure_checkpoint_dir(spark)
        assert first == ensure_checkpoint_dir(spark)
        assert cut_lineage(spark.range(3)).count() == 3
        spark.stop()
    """)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_CONF", "PYSPARK_SUBMIT"))}
    env["SPARK_CONF_DIR"] = str(tmp_path)
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
