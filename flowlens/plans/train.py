"""E2 — training run: prepare, train, evaluate, time, persist.

Writes under ``out_dir``: the processed train/test tables (S2), the
transformer state and selected-feature list (S4), the model (S5) and the
evaluation report with timings (S10, A13).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import scalar as S
from flowlens.operators import metrics as ME
from flowlens.operators import model as MO
from flowlens.plans import prepare as PP
from flowlens.session import write_scratch
from flowlens.sources import records as RC


def run_training(spark: SparkSession, records: DataFrame, out_dir: str, key=None,
                 params: MO.TrainParams | None = None) -> dict:
    prep = PP.prepare(records, RC.ROW_KEY if set(RC.ROW_KEY) <= set(records.columns) else [], key=key)
    cols = prep.selected + ["label"]
    RC.write_processed(prep.train_rows.select(*cols), f"{out_dir}/processed/train")
    RC.write_processed(prep.test_rows.select(*cols), f"{out_dir}/processed/test")
    train = RC.read_processed(spark, f"{out_dir}/processed/train", prep.selected)   # S3
    test = RC.read_processed(spark, f"{out_dir}/processed/test", prep.selected)

    t0 = time.perf_counter()
    clf = MO.train_classifier(train, prep.selected, params=params)
    train_sec = time.perf_counter() - t0

    t0 = time.perf_counter()
    seen = Observation("scored")  # counted by the pass that scores and writes
    scored = clf.predict(test).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(S.is_threat("prediction")).alias("threats"))
    scored = write_scratch(scored.drop(*prep.selected, MO.PROBABILITY), "scored")  # the features lie in the processed table
    infer_sec = time.perf_counter() - t0
    n_test = seen.get["n"]

    clf.save(f"{out_dir}/model")
    MO.save_transformer(spark, prep.transformer, prep.selected, f"{out_dir}/model")
    conf = ME.confusion_long(scored)
    extra = {"train_sec": round(train_sec, 4),
             "infer_ms_per_row": round(1000.0 * infer_sec / max(1, n_test), 6),
             "unknown_dropped": clf.n_unknown_dropped, "scored_rows": n_test, "scored_threats": seen.get["threats"]}
    ME.write_report(spark, ME.class_report(conf), ME.summary(conf), f"{out_dir}/report", extra)
    summary = ME.summary(conf).first().asDict()
    summary.update(extra)
    return summary


def run_training_on_records(spark: SparkSession, sf_dir: str, out_dir: str, **kw) -> dict:
    return run_training(spark, RC.read_records(spark, sf_dir), out_dir, key=PP.record_split_key(), **kw)
