import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def cases(spark):
    from common_cases import table

    return table(spark).cache()
