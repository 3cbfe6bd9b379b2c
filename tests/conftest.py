import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from braidvec.plans.tables import Tables  # noqa: E402
from braidvec.session import get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def sample(tables):
    """A few hundred order graphs: (nodes, edges), small enough for brute force."""
    nodes = tables.nodes.filter("graph_id < 200").persist()
    edges = tables.bonds.filter("graph_id < 200").persist()
    return nodes, edges


def graph_tables(spark, graphs):
    """Tables from {graph_id: (feats, undirected pairs)}."""
    nodes = [(g, i, list(f)) for g, (feats, _) in graphs.items() for i, f in enumerate(feats)]
    edges = [(g, a, b, 1) for g, (_, pairs) in graphs.items() for u, v in pairs for a, b in ((u, v), (v, u))]
    n = spark.createDataFrame(nodes, "graph_id long, node_id int, feat array<int>")
    return n, spark.createDataFrame(edges, "graph_id long, src int, dst int, bond int")
