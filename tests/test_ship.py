import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {root!r})
from spanwise.common import session
from spanwise.functions import text as T
s = session("local[1]", **{{"spark.ui.enabled": "false"}})
print(len(s.createDataFrame([("One. Two",)], "a string").select(T.split_claims("a")).head()[0]))
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip() == "2", done.stderr[-800:]
