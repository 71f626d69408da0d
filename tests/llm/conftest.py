import random

import pytest

#: Columns named like those that operators make for themselves.
CLASHING = ["_id", "row", "all", "id", "_row", "_order", "_nth", "_spans", "_hash", "spans", "_i", "_s", "_t", "_made", "made", "key", "same", "dealt", "copies", "n", "every", "_score", "text_hash", "_print", "digest"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="etaoinshr"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, lang, source]) as documents, with columns whose names clash with those that operators make."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 0.5, 3, *"x" * len(CLASHING)) for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", score double, size int, " + ", ".join(f"{c} string" for c in CLASHING))

    return build


@pytest.fixture
def rng():
    return random.Random(5)
