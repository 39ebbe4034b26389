"""The command line takes its launcher's master and settings."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, {root!r})
from possum.session import job_session
s = job_session()
print(s.sparkContext.master, s.conf.get("spark.sql.session.timeZone"), s.conf.get("spark.sql.adaptive.enabled"), s.sparkContext.getConf().get("spark.driver.memory", "unset"))
"""


def test_master_and_settings_of_the_launcher():
    args = "--master local[3] --conf spark.ui.enabled=false --conf spark.sql.adaptive.enabled=false pyspark-shell"
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], env=os.environ | {"PYSPARK_SUBMIT_ARGS": args}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["local[3]", "UTC", "false", "unset"], done.stderr[-2000:]
