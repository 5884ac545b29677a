import sys
import warnings
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
warnings.filterwarnings("ignore", category=FutureWarning)

from grovekeep.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, 4)


@pytest.fixture(scope="session")
def sf():
    return SF


NODE = "id long, owner_id string, parent_id long, name string, content string, sort_order double, is_deleted boolean"


@pytest.fixture(scope="session")
def forest(spark):
    """Nodes from (id, parent) pairs or (id, parent, overrides) triples."""

    def build(*rows, owner="o"):
        out = []
        for i, row in enumerate(rows):
            extra = row[2] if len(row) > 2 else {}
            node = dict(id=row[0], owner_id=owner, parent_id=row[1], name=f"n{row[0]}", content="", sort_order=float(i), is_deleted=False)
            node.update(extra)
            out.append(tuple(node[c.split()[0]] for c in NODE.split(", ")))
        return spark.createDataFrame(out, NODE).coalesce(1)

    return build
