"""How many passes a fit of the text model takes."""

import numpy as np
from pyspark.sql import functions as F

from labelmill.operators import learning as T


def test_text_model_takes_few_jobs(spark):
    rnd = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(3000)])
    rows = []
    for i in range(1500):
        at = np.minimum(rnd.zipf(1.3, 60), len(words)) - 1
        rows.append((i, " ".join(words[at]), float((at[:40] % 7 == 0).sum() + rnd.normal() > 6)))
    d = T.balanced(T.with_plain_text(spark.createDataFrame(rows, "doc_id long, text string, label double"))).persist()
    sc = spark.sparkContext
    sc.setJobGroup("text-fit", "")
    model = T.text_pipeline().fit(d)
    jobs = len(sc.statusTracker().getJobIdsForGroup("text-fit"))
    sc.setJobGroup("after", "")
    assert jobs < 100
    # at the least value the weights are what the losses pull for
    rows = model.transform(d).select(F.unwrap_udt("with_constant").alias("v"), (F.col("weight") * (F.col("label") - T.vector_to_array("probability")[1])).alias("r")).collect()
    w = model.stages[-1].coefficients.toArray()
    pull = np.zeros(len(w))
    for v, r in rows:
        pull[v["indices"] if v["indices"] is not None else np.arange(len(w))] += r * np.array(v["values"])
    assert np.linalg.norm(w - pull) < 1e-3
    d.unpersist()
