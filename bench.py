"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line of seconds per query."""

from __future__ import annotations

import json
import os
import time

from foliospark.plans import registry
from foliospark.session import local_session

QUERIES = ("TXT8", "TXT4", "TXT14", "TXT3", "FLT5", "VEC4", "AGG5", "AGG15", "WIN2", "WIN7", "JN2", "JN10", "DED13", "EXT10", "CLS15", "QRY7", "STM5", "SNK8")


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cpus, "bench")
    found = dict(registry.queries())
    try:
        from foliospark.llm import queries as llm

        found |= llm.queries()
    except ModuleNotFoundError as error:
        if error.name not in ("foliospark.llm", "foliospark.llm.queries"):
            raise
    names = [*QUERIES, *sorted((k for k in found if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))]
    seconds = {}
    found["AGG1"](spark, root).write.format("noop").mode("overwrite").save()  # the session's own start
    for name in names:
        began = time.perf_counter()
        found[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
