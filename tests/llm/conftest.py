import random

import pytest

#: Names that operators use within, as columns of the input.
EXTRA = "n int, s string, sig long, _sig long, gkey int, bands string, words int, toxic int, place int, window int, key int, row int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def row(i, text, lang="en"):
    return (i, text, lang, "src", 1, *[None] * 12)


def sentence(rng, n=60):
    return " ".join(rng.choice(["the", "of", "and", "rain", "stone", "river", "hill", "light", "cloud", "grass", "wind"]) + rng.choice(["", "", "s", "ed", "er"]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    texts = [sentence(rng) for _ in range(30)]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(3, texts[3]), row(3, texts[3]), row(40, texts[3]), row(41, texts[4] + " Extra words."), row(42, ""), row(43, None), row(None, texts[5]), row(44, texts[6], None), row(45, "one"), row(46, "one two"), row(47, "..."), row(48, "é" * 5), row(49, sentence(rng, 30000)), (None,) * 17, row(7, "another text of the same id")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(30)] + [(0, 1, 1), (None, 1, 1), (5, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def same_as_sql(frame, sql, **tables):
    """Whether a query's rows are those that the SQL gives over the tables; floats to 5 digits."""
    import duckdb

    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t.toArrow())
    norm = lambda x: round(x, 5) if isinstance(x, float) else tuple(map(norm, x)) if isinstance(x, (list, tuple)) else x
    columns = sorted(frame.columns)
    got = sorted((tuple(norm(r[k]) for k in columns) for r in frame.collect()), key=str)
    q = c.execute(sql)
    names = [x[0] for x in q.description]
    want = sorted((tuple(norm(dict(zip(names, r))[k]) for k in columns) for r in q.fetchall()), key=str)
    assert sorted(names) == columns and len(got) == len(want)
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
    return True
