"""Run registered queries against their DuckDB oracle and print one line per query.

usage: python scripts/oracle_check.py [sf_dir] [key-prefix ...]
"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle import compare, duck  # noqa: E402

from procmon.plans import registry  # noqa: E402
from procmon.session import local_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    registry.load_all()
    spark = local_session(cores=8, shuffle_partitions=8)
    bad = 0
    for key in sorted(registry.QUERIES):
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            s = registry.QUERIES[key](spark, sf).toArrow()
        except Exception as exc:  # noqa: BLE001
            print(f"{key:40s} SPARK ERROR {str(exc)[:300]}")
            bad += 1
            continue
        ts = time.time() - t
        if key not in registry.ORACLE:
            print(f"{key:40s} rows={s.num_rows:7d} (no oracle) {ts:5.1f}s")
            continue
        try:
            d = duck(sf, registry.ORACLE[key])
        except Exception as exc:  # noqa: BLE001
            print(f"{key:40s} DUCK ERROR {str(exc)[:300]}")
            bad += 1
            continue
        r = compare(s, d)
        status = "EXACT" if r.get("exact") else ("close" if r.get("close") else "DIFF")
        if status == "DIFF" or r["rows_spark"] != r["rows_oracle"]:
            bad += 1
        extra = r.get("detail", "")
        print(f"{key:40s} {status:5s} rows={r['rows_spark']}/{r['rows_oracle']} {ts:5.1f}s types={r.get('types', {})} {extra[:400]}")
    print("bad:", bad)


if __name__ == "__main__":
    main()
