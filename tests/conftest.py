from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tideline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, app_name="tideline-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # Small frames would shrink to one partition; the carries between blocks need several.
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    # Compiling code costs more than it saves on frames this small.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()
