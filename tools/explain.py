"""Print the formatted physical plan of catalogue queries (plan review aid).

Usage: python tools/explain.py [--sf-dir DIR] name [name ...]
"""
from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from statuta.plans.catalog import REGISTRY  # noqa: E402
from statuta.session import build_session  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    spark = build_session()
    for name in args.names:
        df = REGISTRY[name](spark, args.sf_dir)
        print(f"===== {name} =====")
        df.explain(mode="formatted")
        sys.stdout.flush()


if __name__ == "__main__":
    main()
