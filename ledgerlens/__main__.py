"""Run one registry key: ``python -m ledgerlens <key> [sf_dir] [--explain] [--rows N]``.

Without a key it lists the keys. Output goes to stdout; ``--explain`` prints
the formatted physical plan instead of rows.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from .registry import QUERIES

    args = [a for a in argv if not a.startswith("--")]
    if not args:
        print("\n".join(QUERIES))
        return 0
    key = args[0]
    sf_dir = args[1] if len(args) > 1 else "/root/testdata/sf0.01"
    if key not in QUERIES:
        print(f"unknown key {key!r}; run without arguments for the list", file=sys.stderr)
        return 2
    from .plans.inspect import explain
    from .session import local_session, scratch_tables

    spark = local_session()
    with scratch_tables(spark):
        df = QUERIES[key](spark, sf_dir)
        if "--explain" in argv:
            print(explain(df))
        else:
            n = int(argv[argv.index("--rows") + 1]) if "--rows" in argv else 50
            df.show(n, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
