"""Headline analyses at BENCH_SF_DIR; prints one JSON line.

Every query is run to completion on all of its input (noop sink). The panel is derived from the raw
tables inside each query, so each time includes scan, panel and analysis.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from evalpanel.operators import paired as Q  # noqa: E402
from evalpanel.operators import resample as B  # noqa: E402
from evalpanel.operators import topset as TS  # noqa: E402
from evalpanel.operators.bootstrap import bootstrap  # noqa: E402
from evalpanel.plans import catalog, panels as P  # noqa: E402
from evalpanel.plans.queries_paired import config_pairs  # noqa: E402
from evalpanel.plans.queries_resample import BALANCED  # noqa: E402
from evalpanel.session import cut_lineage, local_session  # noqa: E402


def balanced_bootstrap(reps: int, method: str):
    return lambda spark, sf_dir: bootstrap(P.base_panel(spark, sf_dir), ["config"], BALANCED, reps, 1, method)


def all_contrasts(spark, sf_dir):
    return Q.contrast_table(config_pairs(spark, sf_dir), ["a", "b"])


def top_set(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    stats = cut_lineage(B.unit_stats(panel, ["config"], BALANCED))
    reps = B.replicates(stats, ["config"], BALANCED, 500, 2, "poisson")
    return TS.top_set(reps, B.point(stats, ["config"], BALANCED))


HEADLINE = {
    "balanced_slice": catalog.QUERIES["balanced_ranking"],
    "metrics_by_axis": catalog.QUERIES["metrics_by_axis"],
    "bootstrap_200_multinomial": balanced_bootstrap(200, "multinomial"),
    "bootstrap_200_poisson": balanced_bootstrap(200, "poisson"),
    "bootstrap_2000_poisson": balanced_bootstrap(2000, "poisson"),
    "all_pair_contrasts": all_contrasts,
    "top_set_500": top_set,
    "signed_rank_config_pairs": catalog.QUERIES["config_pair_signed_rank"],
    "trend_over_bins": catalog.QUERIES["trend_over_bins"],
    "spearman_by_config": catalog.QUERIES["spearman_by_config"],
    "cutoff_sweep": catalog.QUERIES["cutoff_sweep_drop_missing"],
    "ensembles": catalog.QUERIES["ensemble_over_repeats"],
    "path_agreement": catalog.QUERIES["path_agreement"],
    "covariate_model": catalog.QUERIES["covariate_model"],
    "parsed_responses": catalog.QUERIES["parsed_responses"],
    "pixel_cover": catalog.QUERIES["pixel_cover"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    wanted = sys.argv[1:] or list(HEADLINE)
    catalog.QUERIES["balanced_ranking"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        query = HEADLINE.get(name) or catalog.QUERIES[name]
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
