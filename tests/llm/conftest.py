import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names could clash."""
    def build(rows, extra="score double, fp long, bucket int, v string, rep long, place long"):
        names = [x.split()[0] for x in extra.split(",")]
        schema = DOCS + (", " + extra if extra else "")
        full = [(i, t, "en", s[0] if s else "src0", len(t) if t is not None else None, *([None] * len(names) if extra else []))
                for i, t, *s in rows]
        return spark.createDataFrame(full, schema)
    return build


ODD = [(5, None), (3, ""), (4, "   \n\t "), (1, "a"), (2, "alpha beta gamma delta epsilon"), (7, "alpha beta gamma delta epsilon"),
       (None, "no id here at all"), (9, "word " * 30_000), (9, "word " * 30_000), (11, "é漢字\u0000\x1c ñandú\n\nthree   spaces ")]
