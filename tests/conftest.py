import pytest

from shelf.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return build(8, "shelf-tests", str(tmp_path_factory.mktemp("scratch")))
