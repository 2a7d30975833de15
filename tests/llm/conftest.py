import pytest


@pytest.fixture(scope="session", autouse=True)
def tables_go(spark):
    yield
    from gridloom.llm.common import close_all

    close_all()
