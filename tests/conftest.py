"""A local session and the small fixtures that tests share."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
os.environ["PYTHONPATH"] = f"{HERE.parent}:{HERE}:{os.environ.get('PYTHONPATH', '')}"  # for the workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    out = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


@pytest.fixture(scope="session")
def seeded(spark):
    """Two persons, two organisations and a project: pA works at oA and leads prj, pB works at oB, oB runs prj."""
    from lattice.schemas import TABLES, Graph

    rows = lambda table, data: spark.createDataFrame(data, TABLES[table])
    graph = Graph.empty(spark)
    text = "Ana Ruiz works at Orbit Corp and leads Project Sol.", "Ben Okoye works at Nadir Group, which runs Project Sol."
    return graph.with_(
        documents=rows("documents", [(1, "team.md", "h", 104, 0.0, "t", None)]),
        chunks=rows("chunks", [(1, 1, 0, text[0], 0, 51, 12), (2, 1, 1, text[1], 52, 107, 13)]),
        entities=rows(
            "entities",
            [
                (1, "Ana Ruiz", "Person", '{"role": "lead"}', "t", "t"),
                (2, "Ben Okoye", "Person", '{"role": "it\'s ops"}', "t", "t"),
                (3, "Orbit Corp", "Organization", '{"industry": "space", "listed": true}', "t", "t"),
                (4, "Nadir Group", "Organization", "{}", "t", "t"),
                (5, "Project Sol", "Project", "{}", "t", "t"),
            ],
        ),
        mentions=rows("mentions", [(1, 1, "Ana Ruiz", 1, 0, 8, 1, 0.95), (2, 3, "Orbit Corp", 1, 18, 28, 1, 0.9), (3, 2, "Ben Okoye", 2, 0, 9, 1, 0.95), (4, 4, "Nadir Group", 2, 19, 30, 1, 0.9)]),
        relations=rows(
            "relations",
            [
                (1, 1, "works_at", 3, 1, 1, 0.9, "{}", "t"),
                (2, 2, "works_at", 4, 2, 1, 0.9, "{}", "t"),
                (3, 1, "leads", 5, 1, 1, 0.9, "{}", "t"),
                (4, 4, "runs", 5, 2, 1, None, "{}", "t"),
            ],
        ),
    )
