"""The chain to the relative risk keeps its cases as Parquet tables and deletes the model's rows."""

import os

from riskframe.lineage import checkpoint_dir
from riskframe.plans import boosted_q, models_q
from riskframe.plans.catalog import QUERIES


def test_cases_are_not_checkpointed(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    kept, cut, bootstrap = [], models_q.cut, boosted_q.resample.bootstrap_rr

    def noted(df):
        out = cut(df)
        kept.append(out.count())
        return out
    for module in (models_q, boosted_q):
        monkeypatch.setattr(module, "cut", noted)
    monkeypatch.setattr(boosted_q.resample, "bootstrap_rr", lambda cases, reps: bootstrap(cases, reps=20))
    assert QUERIES["chain_relative_risk"](spark, folder).count() == 1
    entities = spark.read.parquet(f"{folder}/supplier.parquet").count()
    assert kept and max(kept) <= entities
    left = checkpoint_dir(spark).removeprefix("file:")
    assert not [x for x in os.listdir(left) if x.startswith("rows-")]
