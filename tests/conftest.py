import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from findlake import get_session
    s = get_session("local[4]", app="findlake-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_catalog(spark):
    from findlake.operators.catalog import build_catalog, with_tokens
    from findlake.sources.fixtures import fixture_listing
    return with_tokens(build_catalog(fixture_listing(spark, SF_SMALL))).cache()


def catalog_from_paths(spark, rows):
    """Catalog from ``(path, is_dir)`` rows; arrival order is the list order."""
    from findlake.operators.catalog import build_catalog, with_tokens
    listing = spark.createDataFrame([(i, p, d) for i, (p, d) in enumerate(rows)],
                                    "ordinal bigint, path string, is_dir boolean")
    return with_tokens(build_catalog(listing))
