"""Print the formatted physical plan of registered queries (the plan AQE starts from; it
may re-plan joins and partition counts at run time from measured sizes).
Usage: python scripts/explain_queries.py [sf_dir] [query ...]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from qualityframe.plans.catalog import QUERIES  # noqa: E402
from qualityframe.session import get_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)] or sorted(QUERIES)
    spark = get_session("local[8]", shuffle_partitions=8)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
