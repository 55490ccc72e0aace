"""Components of chains in any order of their numbers, in few rounds."""

import random
import time

import pytest
from pyspark.sql import functions as F

from riskframe import lineage
from riskframe.llm import components

NODES = 10_000


@pytest.mark.parametrize("order", ["rising", "falling", "shuffled"])
def test_long_chain(spark, monkeypatch, order):
    name = list(range(NODES))
    if order == "shuffled":
        random.Random(5).shuffle(name)
    links = [(name[i], name[i + 1]) for i in range(NODES - 1)]
    if order == "falling":
        links = [(b, a) for a, b in reversed(links)]
    dropped = []
    drop = lineage.Tables.drop
    monkeypatch.setattr(lineage.Tables, "drop", lambda self, last=None: (dropped.append(last), drop(self, last))[1])
    start = time.time()
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    found = got.agg(F.count("*"), F.min("component"), F.max("component")).first()
    assert tuple(found) == (NODES, 0, 0)
    assert dropped.count(2) <= 16 and time.time() - start < 180


def test_hub_and_apart(spark):
    links = [(0, i) for i in range(1, 3000)] + [(5000, 5001), (5002, 5001), (7000, 7000), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3000)}, 5000: 5000, 5001: 5000, 5002: 5000}
