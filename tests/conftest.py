import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "3", "spark.sql.codegen.wholeStage": "true"})
    from loomspark.session import open_table  # noqa: F401  the workers' path is set with the first table

    session.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent)
    yield session
    from loomspark.scratch import release

    release(session)
