"""Python workers get the package from the shared folder, wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import numpy as np
from cohortcast.session import get_spark, shared_dir
from cohortcast.operators import comps
spark = get_spark("packaging", "local[2]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {shared!r}}})
assert shared_dir(spark) == {shared!r}

def with_inverse(parts):
    for p in parts:
        yield p.assign(at=[float(comps._inverse(np.eye(2) * (i + 1))[0, 0]) for i in p["id"]])

print("ROWS", sorted(r["at"] for r in spark.range(4).mapInPandas(with_inverse, "id bigint, at double").collect()))
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    script = SCRIPT.format(root=ROOT, shared=f"file://{tmp_path}/shared")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS [0.25, 0.3333333333333333, 0.5, 1.0]" in done.stdout, done.stderr[-2000:]
