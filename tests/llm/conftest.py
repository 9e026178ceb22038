import pytest


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    from listwright.llm.registry import send_package

    send_package(spark)


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, n, [1]) for n, (i, t) in enumerate(rows)],
            "doc_id bigint, text string, mark string, row int, n_chars bigint, spans array<int>",
        )

    return make
