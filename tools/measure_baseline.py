
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from riskflow.operators import models as mo  # noqa: E402
from riskflow.operators.density import log_density_points  # noqa: E402
from riskflow.operators.iforest import IsolationForest  # noqa: E402
from riskflow.operators.prep import Prep  # noqa: E402
from riskflow.params import Params  # noqa: E402
from riskflow.plans import jobs  # noqa: E402
from riskflow.plans.fixtures import frame  # noqa: E402
from riskflow.session import cut_lineage, get_spark  # noqa: E402


def timed(fn):
    t = time.perf_counter()
    out = fn()
    return out, time.perf_counter() - t


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    parts = sys.argv[2].split(",") if len(sys.argv) > 2 else ["prep", "density", "forest", "composite", "models"]
    spark = get_spark("local[8]", 8)
    spark.range(1000).count()
    res = {"sf_dir": sf_dir}
    if "prep" in parts:
        line = frame(spark, sf_dir, "line_risk")
        n = line.count()
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        model, t_fit = timed(lambda: Prep(Params()).fit(line, "label", keys))
        _, t_tr = timed(lambda: model.transform(line).write.format("noop").mode("overwrite").save())
        res["prep"] = {"rows": n, "fit_s": round(t_fit, 2), "fit_rows_per_s": round(n / t_fit),
                       "transform_s": round(t_tr, 2), "transform_rows_per_s": round(n / t_tr),
                       "features": model.feature_names}
    if "density" in parts:
        geo = frame(spark, sf_dir, "geo_events")
        def run():
            d, n = log_density_points(geo, "latitude", "longitude", Params())
            return cut_lineage(d), n
        (_, n), t = timed(run)
        out = {"s": round(t, 2), "points": n}
        res["density"] = out
    if "forest" in parts or "models" in parts:
        geo = frame(spark, sf_dir, "geo_events")
        prep_model, fr = jobs.prepare(geo, "label", ["event_id"], Params())
        train = cut_lineage(fr.where("split = 'train'"))
        n_train, n_all = train.count(), fr.count()
    if "forest" in parts:
        p = Params()
        model, t_fit = timed(lambda: IsolationForest(p).fit(train, prep_model.feature_names, ["event_id"]))
        _, t_off = timed(lambda: model.fit_offset(train, p.if_contamination))
        _, t_sc = timed(lambda: model.score(fr).write.format("noop").mode("overwrite").save())
        res["isolation_forest"] = {"trees": p.if_trees, "train_rows": n_train, "fit_s": round(t_fit, 2),
                                   "offset_s": round(t_off, 2), "score_rows": n_all, "score_s": round(t_sc, 2),
                                   "score_rows_per_s": round(n_all / t_sc)}
    if "composite" in parts:
        from riskflow.plans.registry import load_all
        fn = load_all()["composite_risk"][0]
        _, t = timed(lambda: fn(spark, sf_dir).write.format("noop").mode("overwrite").save())
        res["composite_risk_s"] = round(t, 2)
    if "models" in parts:
        tw = cut_lineage(mo.ev.with_class_weight(train, "label").withColumn("label", F.col("label").cast("double")))
        fits = {}
        for label, p in (("defaults", Params()),):
            for name, pipe in mo.build_models(p, prep_model.feature_names, n_train).items():
                _, t = timed(lambda: pipe.fit(tw))
                fits[name] = round(t, 2)
        res["model_fit_s"] = {"params": "defaults: RF 200 trees depth 15, GBT 300 rounds depth 6, LR 1000 iter",
                              "train_rows": n_train, **fits}
    print(json.dumps(res))


if __name__ == "__main__":
    main()
