"""Wall time of the headline jobs. Prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (default 8).
Every job runs to the end (all rows are produced). The log is built and written
once, as its own entry; the other entries read that written log.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from catalog import causes, conformity, kpis, profiling
    from catalog.data import order_log
    from tracewright.operators import dfg, filters, model
    from tracewright.operators.kpi import tower
    from tracewright.operators.rca.analysis import analyse

    def produce(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def log():
        return order_log(spark, folder)

    def graph():
        produce(dfg.edges(dfg.passages(log(), log().links_of("Order", "Item"))))

    def variants(with_types=()):
        log().__dict__.pop("_memo", None)
        produce(model.type_variants(log(), "Order", list(with_types)).with_median())

    def case_filter():
        out = filters.apply(log(), [{"kind": "object", "type": "Order", "attribute": "o_orderpriority", "values": ["1-URGENT"]}])
        produce(out.e2o)

    def profile():
        p = profiling.star_profile(spark, folder)
        produce(p.relationships)

    jobs = {
        "build_log": lambda: log(),
        "edges_with_durations": graph,
        "variants_own": variants,
        "variants_case": lambda: variants(["Item"]),
        "case_filter": case_filter,
        "kpi_dashboard": lambda: produce(tower.compute(log(), kpis.ALL, "12")),
        "profile_keys_and_links": profile,
        "conformance": lambda: produce(conformity.compared(spark, folder).flows),
        "root_cause_duration": lambda: analyse(log(), causes.K_SHIP),
    }
    times = {}
    for name, job in jobs.items():
        start = time.time()
        job()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "process_analytics_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
