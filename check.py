"""Run queries against their SQL: ``python check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import tempfile
import time

from fundlens.plans.registry import load_all
from fundlens.session import build_session
from tests.oracle import compare, connect


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, q in load_all().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if q.sql is None:
                result = f"rows only: {len(q.run(spark, sf_dir).collect())}"
            else:
                diff = compare(spark, con, q.run, q.sql, sf_dir)
                result = "ok" if diff is None else f"FAIL {diff}"
        except Exception as e:  # noqa: BLE001
            result = f"FAIL {type(e).__name__} {str(e)[:600]}"
        failed += result.startswith("FAIL")
        print(f"{name}: {result} ({time.time() - start:.1f}s)", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
