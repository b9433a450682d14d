import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def hostile(spark, tmp_path_factory):
    """Documents with every kind of odd row, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(150), text(90)
    near = base.split()
    near[70] = "changed"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n "), (6, "one two three"), (7, "One  two\nTHREE"), (8, text(40) + " " + passage + " " + text(40)),
        (9, text(20) + "\n" + passage), (10, passage + "\n" + passage), (11, "x" * 300_000), (12, text(30_000)), (13, "ab " * 900), (13, "ab " * 900), (14, "日本語 текст ÉCOLE ß"), (15, "1234 5678 !!! ???"),
        (16, "\n\n\n"), (17, base.upper()), (18, "é" * 700), (19, "z" * 399), (20, "z" * 401), (None, text(60)), (None, None), (21, text(19)), (22, "a\x0bb\x0cc\x1cd e f g h i j k l m n o p q r s t u v w x y z " * 3),
    ]
    rows += [(100 + i, base + f" tail{i}") for i in range(45)]
    langs = ["en", "fr", None]
    data = [(d, t, langs[i % 3], "src", len(t) if t is not None else None, "k", 1, "p", "r", 0.5, True, "i", "t", "w", "b") for i, (d, t) in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, pos string, row string, score double, held_out boolean, _id string, _text string, _windows string, kept string"
    path = str(tmp_path_factory.mktemp("hostile") / "documents.parquet")
    spark.createDataFrame(data, names).repartition(3).write.parquet(path)
    return spark.read.parquet(path), rows


@pytest.fixture(scope="session")
def documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
