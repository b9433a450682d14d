from cairnflow.llm import minhash
from tests.llm import brute


def rows_of_texts(spark):
    words = [f"w{i}" for i in range(300)]
    text = lambda a, b, *more: " ".join([*words[a:b], *more])
    middle, near, far = text(0, 120), text(0, 120, "x", "y"), text(0, 120, "x", "y", "p", "q", "r", "s", "t", "u", "v", "w", "z1", "z2", "z3")
    alone = text(150, 250)
    rows = [(5, far), (None, near), (2, middle), (9, alone), (None, alone), (None, text(260, 300)), (9, "another text of this id that is its own"), (7, None), (None, ""), (7, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def test_rows_without_ids_link_their_neighbours(spark):
    df, rows = rows_of_texts(spark)
    want = brute.near(list(enumerate(t for _, t in rows)))
    groups: dict = {}
    for i, (_, component, _) in want.items():
        groups.setdefault(component, []).append(i)
    assert sorted(map(sorted, groups.values()))[0] == [0, 1, 2]  # only through the row without an id
    expected = []
    for i, (d, t) in enumerate(rows):
        ids = [rows[j][0] for j in groups[want[i][1]] if rows[j][0] is not None]
        component = (min(ids) if ids else None) if t and t.split() else d
        expected.append((str(d), want[i][0], str(component), component == d))
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got) == sorted(expected)


def test_one_row_of_each_group_is_kept(spark):
    df, _ = rows_of_texts(spark)
    got = sorted((str(r.doc_id), len((r.text or "").split())) for r in minhash.keep_one(df, 85).collect())
    assert got == sorted([("2", 120), ("9", 100), ("None", 40), ("9", 9), ("7", 0), ("None", 0)])


def test_rows_without_words_stay_but_repeated_ones(spark):
    rows = [(7, None, "x"), (7, None, "x"), (7, None, "y"), (7, "", "x"), (8, None, "x"), (None, None, "x"), (None, None, "x"), (None, None, None), (None, " \n", "x"), (None, " \n", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert sorted(map(str, minhash.keep_one(df).collect())) == sorted(str(r) for r in df.distinct().collect())
