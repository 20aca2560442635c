import pytest

from claimlens.session import shared_dir


@pytest.fixture(scope="session", autouse=True)
def _scratch(spark):
    """The operators cut lineage by checkpoints."""
    shared_dir(spark)
