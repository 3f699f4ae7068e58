"""One document of each class where ids are missing or stand on different texts."""

import random
from collections import Counter

from skein.llm import simhash


def test_rows_without_id_and_ids_on_different_texts(spark):
    rng = random.Random(11)
    a, b, c, d, e, f, g = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(7))
    rows = [
        (1, a), (5, a.upper()), (5, b),  # id 5 is a copy of 1 and a text of its own
        (7, c), (7, d),  # one id on two classes
        (None, e), (None, e), (None, f), (None, g), (None, g.upper()),  # three texts without an id
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, class_row string").repartition(4)
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, r.text.lower()) for r in got.collect())
    assert kept == Counter([(1, a), (5, b), (7, c), (7, d), (None, e), (None, f), (None, g)])
