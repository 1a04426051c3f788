"""Growth check: the people table replicated k times, key jobs timed.

Usage: python tools/scaling.py [sf_dir] [k ...]
Each copy shifts weight by copy/1000 kg, so distinct BMI values grow with k
as well as rows.  Prints one JSON line per k with seconds per job and
whether the ECDF plan has a single-partition exchange over distinct values.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from cohortlens import schema as S  # noqa: E402
from cohortlens.operators import aggregate as A  # noqa: E402
from cohortlens.operators import distribution as Q  # noqa: E402
from cohortlens.operators import hypothesis as T  # noqa: E402
from cohortlens.operators.clean import valid  # noqa: E402
from cohortlens.operators.enrich import enrich  # noqa: E402
from cohortlens.plans import views  # noqa: E402
from cohortlens.session import get_session  # noqa: E402


def replicated(spark, sf, k):
    m = views.people(spark, sf)
    r = m.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("copy"))
    return r.select((F.col("person_id") * k + F.col("copy")).alias("person_id"), "gender", "age",
                    "height", (F.col("weight") + F.col("copy") / F.lit(1000.0)).alias("weight"))


def timed(make):
    """Seconds to build the plan (jobs run while building count) and run it."""
    t0 = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 3)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    ks = [int(k) for k in sys.argv[2:]] or [1, 10, 100]
    spark = get_session("local[8]", spark__driver__memory="16g")
    for k in ks:
        x = enrich(valid(replicated(spark, sf, k)))
        xg = x.filter(F.col("gender").isin(list(S.GENDER_LEVELS)))
        probes = views.submissions(spark, sf).select(
            "event_id", (F.col("weight") / ((F.col("height") / 100) * (F.col("height") / 100))).alias("bmi"))
        jobs = {
            "gender_pivot": lambda: A.gender_pivot(x),
            "chisq_gender_band": lambda: T.chi_square(xg, "gender", "BMI_Index"),
            "ecdf": lambda: Q.ecdf(x, "BMI"),
            "quantiles": lambda: Q.quantiles(x, "BMI", [0.1, 0.9]),
            "percentile_many": lambda: Q.percentile_many(x, "BMI", probes, "bmi"),
            "box_by_gender": lambda: Q.box_stats(xg, "height", ["gender"]),
        }
        out = {}
        for name, make in jobs.items():
            timed(make)
            spark.catalog.clearCache()  # the timed run starts from the raw rows
            out[name] = timed(make)
            spark.catalog.clearCache()
        vc = Q.value_counts(x, "BMI")
        nb = Q.default_buckets(spark)
        plan = Q.ecdf(x, "BMI")._jdf.queryExecution().executedPlan().toString()
        print(json.dumps({"copies": k, "rows": x.count(), "buckets": nb, "sec": out,
                          "single_partition_exchanges_in_ecdf": plan.count("SinglePartition")}),
              flush=True)
        spark.catalog.clearCache()
    spark.stop()


if __name__ == "__main__":
    main()
