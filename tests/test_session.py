"""Settings of the submit command win over the defaults of the session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from quire.session import get_session
s = get_session({args})
print("GOT", s.conf.get("spark.sql.shuffle.partitions"), s.sparkContext.master, s.conf.get("spark.sql.session.timeZone"))
s.stop()
"""


def got(args, submit):
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": f"{submit} pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", CODE.format(args=args)], env=env, capture_output=True, text=True, timeout=120)
    lines = [x for x in out.stdout.splitlines() if x.startswith("GOT")]
    assert lines, out.stderr[-2000:]
    return lines[0].split()[1:]


def test_submit_settings_win():
    assert got("", "--master local[2] --conf spark.sql.shuffle.partitions=77 --conf spark.sql.session.timeZone=CET") == ["77", "local[2]", "CET"]
    assert got("", "--master local[2]") == ["200", "local[2]", "UTC"]


def test_defaults_of_this_machine():
    assert got("cpus=3", "") == ["8", "local[3]", "UTC"]
