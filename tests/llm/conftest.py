import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp string, node long"


def rows(seed=1):
    """Nulls in every column, empty and blank texts, a very long text, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = make(300), make(60)
    texts = [None, "", " \n\t ", "one", "Two words", make(40_000), base, base, base.replace(base.split()[150], "changed"), base.upper(), make(80) + " " + passage + " " + make(20), passage + "\n" + make(90), "ab " * 200]
    texts += [make(rng.randint(1, 200)) for _ in range(20)]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, 0.5, "k", "f", 1) for i, t in enumerate(texts)]
    return [*out, out[6], out[6]]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd table, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
