from __future__ import annotations

import pytest


@pytest.fixture(autouse=True)
def package_path(spark):
    from seatpool.llm.common import workers_find_package

    workers_find_package(spark)
