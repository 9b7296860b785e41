"""Median seconds of the four headline patterns over stored spans; one JSON line.

``value`` is their sum.  ``more``: a window, indexes, structural classes, and a table that is not bucketed.
"""

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from tracelattice import scratch
from tracelattice.model import IndexKind
from tracelattice.operators import structure
from tracelattice.operators.indices import upkeep
from tracelattice.operators.indices.catalog import Catalog
from tracelattice.plans.catalogue import ATTR, DURATION, FANOUT, HEIGHT, ONE_CALL, SLOW_LINE, SLOW_ROOT, YEAR
from tracelattice.plans.planner import search
from tracelattice.session import configure
from tracelattice.sources.derived import order_spans, read_spans, save_spans, write_spans

RUNS = 10


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    began = time.time()
    spans = save_spans(order_spans(spark, sf), "spans", int(cpus))
    load = time.time() - began
    queries, rows = {}, {}
    for name, pattern, conditions in (("one_call", ONE_CALL, []), ("fanout", FANOUT, []), ("height", HEIGHT, []), ("duration", DURATION, [SLOW_ROOT])):
        taken = []
        for _ in range(RUNS + 1):
            began = time.time()
            rows[name] = search(spans, pattern, conditions=conditions).count()
            taken.append(time.time() - began)
        queries[name] = round(statistics.median(taken[1:]), 4)  # the first run warms up
    more = {}
    catalog = Catalog(spark)
    for prop, kind in ((ATTR.prop, IndexKind.INVERTED), ("latency", IndexKind.RANGE)):
        upkeep.update(spans, catalog, prop, kind, 4_000_000_000)
    hashes = scratch.materialise(structure.structure_hashes(spans, 4), "classes")
    write_spans(spans, path := scratch.new_path(spark, "spans"))
    cases = {
        "pattern_in_window": lambda: search(spans, ONE_CALL, YEAR), "conditions": lambda: search(spans, ONE_CALL, conditions=[ATTR, SLOW_LINE]),
        "conditions_indexed": lambda: search(spans, ONE_CALL, conditions=[ATTR, SLOW_LINE], catalog=catalog), "classes": lambda: search(spans, HEIGHT, hashes=hashes), "height_by_folder": lambda: search(read_spans(spark, path), HEIGHT),
    }
    for name, run in cases.items():
        taken = []
        for _ in range(4):
            began = time.time()
            rows[name] = run().count()
            taken.append(time.time() - began)
        more[name] = round(statistics.median(taken[1:]), 4)
    print(json.dumps({"metric": "median_total", "value": round(sum(queries.values()), 4), "unit": "sec", "queries": queries, "more": more, "sf": sf, "rows": rows, "load_s": round(load, 2), "cpus": int(cpus), "runs": RUNS}))


if __name__ == "__main__":
    main()
