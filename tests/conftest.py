import numpy as np
import pytest

from stratalens.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.fixture
def matrix_frame(spark):
    """Rows of named matrices as ``(arm, row_id, embedding)``, spread over several partitions."""

    def build(**arms):
        rows = [
            (arm, i, [float(v) for v in vector])
            for arm, matrix in arms.items()
            for i, vector in enumerate(matrix)
        ]
        frame = spark.createDataFrame(rows, "arm string, row_id long, embedding array<double>")
        return frame.repartition(5, "row_id")

    return build
