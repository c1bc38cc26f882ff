"""drop() removes rows, not ids: repeated rows, null ids, and one id with two texts."""

from collections import Counter

from tidewire.llm import neardup

ROWS = [
    (1, "a b c d e", 0),
    (2, "a b c d e", 0),
    (2, "p q r s t", 0),
    (3, "f g h i j", 0),
    (3, "f g h i j", 0),
    (4, "k l m n o", 0),
    (4, "u v w x y", 0),
    (5, "", 0),
    (5, "", 0),
    (6, None, 0),
    (None, "a b c d e", 0),
    (None, "z z1 z2 z3", 0),
    (None, "z z1 z2 z3", 0),
    (None, "", 0),
    (None, None, 0),
]


def test_drop_by_row(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, extra int")
    got = neardup.drop(df)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    four = [(4, t) for t in ("k l m n o", "u v w x y") if (4, t) in kept]
    assert len(four) == 1
    assert kept == Counter([(1, "a b c d e"), (2, "p q r s t"), (3, "f g h i j"), *four, (5, ""), (6, None), (None, "z z1 z2 z3"), (None, ""), (None, None)])


def test_without_repeats(spark):
    df = spark.createDataFrame([r[:2] for r in ROWS[:3]], "doc_id long, text string")
    assert Counter(map(tuple, neardup.drop(df).collect())) == Counter([(1, "a b c d e"), (2, "p q r s t")])
