from __future__ import annotations

from collections.abc import Iterator

import pytest
from pyspark.sql import SparkSession

from tests.support import local_session


@pytest.fixture(scope="session")
def spark() -> Iterator[SparkSession]:
    session = local_session()
    yield session
    session.stop()
