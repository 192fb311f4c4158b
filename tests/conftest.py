import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from webtables.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session()
    yield s


@pytest.fixture(scope="session")
def fixture_pages(spark):
    from tests import fixtures as fx

    return spark.createDataFrame(fx.PAGES, "page_id long, url string, html string")


@pytest.fixture(scope="session")
def parsed(fixture_pages):
    from webtables.operators.parse import parse_pages

    return parse_pages(fixture_pages).cache()
