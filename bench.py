"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import keyloom.plans  # noqa: E402, F401
from keyloom.registry import REGISTRY  # noqa: E402
from keyloom.session import session  # noqa: E402

HEADLINE = ["zrevrange", "set", "getset", "incrby", "append", "lrange", "linsert", "sinter", "sdiff", "scard", "zadd", "zunion", "zinter", "zrank", "xadd", "xread", "xpending", "bitop_xor", "pfcount", "georadius", "georadiusbymember", "ttl", "publish", "exec", "evict_lru"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    REGISTRY["zrevrange"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            t = time.perf_counter()
            REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
