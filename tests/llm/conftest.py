import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from llm_helpers import SF001  # noqa: E402
from rxlake.session import get_session  # noqa: E402



@pytest.fixture(scope="session")
def spark():
    return get_session(master="local[4]", shuffle_partitions=4, app="rxlake-llm-tests")


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con
