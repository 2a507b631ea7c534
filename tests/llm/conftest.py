import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = SCHEMA + ", h long, key string, df int, words string, `__gone` int, position int, curve string, cluster int"


@pytest.fixture(scope="session")
def documents(spark):
    """A DataFrame of (doc_id, text) pairs, with other columns whose names clash."""

    def make(rows, wide=True):
        full = [(d, t, "en" if d is None or d % 2 else None, f"src{(d or 0) % 3}", None if t is None else len(t)) + ((1, "k", 2, "w", 3, 4, "c", 5) if wide else ()) for d, t in rows]
        return spark.createDataFrame(full, WIDE if wide else SCHEMA)

    return make
