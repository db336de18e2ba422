import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from basketry.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    yield session
    session.stop()
import sys; from pathlib import Path; sys.path.insert(0, str(Path(__file__).resolve().parent))
