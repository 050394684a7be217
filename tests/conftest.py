import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    import compare

    session = compare.session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def small_chunks(monkeypatch):
    """Chunks so short that every carry and halo crosses borders."""
    from tidemark.operators import series

    monkeypatch.setattr(series, "CHUNK_BARS", 16)
