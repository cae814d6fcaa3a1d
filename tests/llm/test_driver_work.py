"""What small tables ask of the driver: one job for a step of small joins, bitmaps no larger than their texts need."""

import random
import uuid

import pytest

from lodestone.llm import common, jaccard
from lodestone.llm.graph import connected_components

EDGES = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (202, 202), (203, None)]


def smallest(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = start
                todo += near[x]
    return out


@pytest.mark.parametrize("most", [common.PLANNED_ROWS, 0])
def test_components_of_either_plan(spark, monkeypatch, most):
    monkeypatch.setattr(common, "PLANNED_ROWS", most)
    keys = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before, r = [spark.conf.get(k) for k in keys], random.Random(3)
    edges = EDGES + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == smallest(edges)
    assert [spark.conf.get(k) for k in keys] == before


def test_jobs_of_small_components(spark, monkeypatch):
    def jobs() -> int:
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "components")
        try:
            connected_components(spark.createDataFrame([(100, i) for i in range(101, 140)], "a long, b long"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    once = jobs()
    monkeypatch.setattr(common, "PLANNED_ROWS", 0)
    assert 3 * once <= 2 * jobs()


def test_bitmaps_follow_the_texts(spark):
    docs = spark.createDataFrame([(i, f"one two three four five {i}") for i in range(50)], "doc_id long, text string")
    levels = jaccard.shingle_levels(docs, 1 << 27)
    assert levels.bits == 1 << 20 and sum(m.nbytes for m in levels.maps) < 1 << 20
