from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from starlane.session import get_session  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="starlane-warehouse-")
    return get_session("local[*]", app="starlane-tests", shuffle_partitions=8,
                       extra={"spark.sql.warehouse.dir": warehouse})


@pytest.fixture(scope="session")
def fixture_star(spark):
    from fixtures import flat_frame

    from starlane.operators.clean import clean_flat
    from starlane.operators.star import build_star

    return build_star(clean_flat(flat_frame(spark))).written()
