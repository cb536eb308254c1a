import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from graphloom.model import PropertyGraph, conform_nodes  # noqa: E402
from graphloom.session import build_session  # noqa: E402

NODE_INPUT = (
    "id string, label string, name string, fqn string, file string, start_line bigint, end_line bigint, is_test boolean,"
    " is_volatile boolean, risk_score double, change_frequency bigint, atomic_features array<string>,"
    " embedding array<float>, description string, content string"
)
FIELDS = [part.split()[0] for part in NODE_INPUT.split(", ")]


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "graphloom-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A graph from ``{id: {property: value}}`` (or label strings) and edge triples."""

    def build(nodes, edges=()):
        rows = []
        for node_id, props in nodes.items():
            props = {"label": props} if isinstance(props, str) else props
            row = {"id": node_id, "label": "Function", "name": node_id, **props}
            rows.append(tuple(row.get(f) for f in FIELDS))
        frame = conform_nodes(spark.createDataFrame(rows, NODE_INPUT))
        return PropertyGraph(frame, spark.createDataFrame(list(edges), "src string, dst string, type string"))

    return build
