"""Connected components against union-find, in one task and dealt out."""

from __future__ import annotations

import random

import pytest

from civicspark.llm import components


@pytest.mark.parametrize("per_task", [200_000, 10])
def test_components(spark, per_task):
    rng = random.Random(1)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(5, 5), (7, 8), (7, 8)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    rows = components.connected_components(spark.createDataFrame(links, "u long, v long").repartition(3), links_per_task=per_task).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert len(rows) == len(linked) and {r.node: r.component for r in rows} == {x: root(x) for x in linked}


def test_no_links(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
