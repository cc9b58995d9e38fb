"""Print the formatted physical plan of registered queries.

    python tools/plans.py [sf_dir] key [key ...]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairsignals.plans.catalog import QUERIES  # noqa: E402
from pairsignals.session import build_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    spark = build_session()
    for k in args:
        print(f"## {k}\n\n```")
        plan = QUERIES[k](spark, sf)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        print(plan.split("\n\n(1)")[0].strip())
        print("```\n")


if __name__ == "__main__":
    main()
