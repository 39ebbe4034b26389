"""Write PLANS.md: the physical plan tree and shuffle keys of every registered
query (``explain("formatted")`` before execution, so adaptive execution may
still switch joins to broadcast and coalesce partitions at run time).

Usage: python tools/dump_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from possum.registry import QUERIES  # noqa: E402
from possum.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    print(f"# Physical plans of the registered queries\n\nTables: `{sf_dir}`, Spark {spark.version}, "
          "`explain(\"formatted\")` before execution. Streaming queries run their micro-batches while the "
          "DataFrame is built; their plan is the read of the published state.\n")
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0].replace("== Physical Plan ==\n", "")
        keys = [re.sub(r"#\d+L?", "", k).rsplit(",", 1)[0]
                for k in re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", text)]
        pushed = sorted({ln.split(": ", 1)[1] for ln in text.splitlines() if ln.startswith("PushedFilters")
                         and "EqualTo" in ln})
        print(f"## {name}\n")
        print(f"Shuffle keys: {', '.join('(' + k + ')' for k in keys) or 'none'}  ")
        if pushed:
            print(f"Pushed equality filters: {'; '.join(pushed)}  ")
        print(f"\n```\n{tree}\n```\n")


if __name__ == "__main__":
    main()
