"""Small documents with every odd case: NULLs in any column, empty, blank and
very long texts, ties, repeated rows, ids that repeat, extra columns with the
names that the operators use themselves."""

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, doc string, size long, score double, "
          "component string, id string, chunk int, target double, fold int, label int, bucket long, rank int, key string, fp long, spans string")


def prose(i, n=40):
    return " ".join(f"w{(i * 7919 + k * 104729) % 997}" for k in range(n))


def odd_rows():
    base = [(i, prose(i), "en", f"s{i % 3}") for i in range(24)]
    base += [(100, prose(1), "en", "s1"), (101, prose(1) + " tail", None, None)]          # a copy and a near copy
    base += [(102, None, None, "s0"), (103, "", "en", None), (104, " \t\n ", "en", "s2"), (None, prose(50), None, "s1"),
             (None, None, None, None), (105, "x", "en", "s0"), (105, "x", "en", "s0"), (7, prose(60), "de", "s2")]
    base += [(106, "long " * 20_000 + "a@b.example 4111 1111 1111 1111", "en", "s1"), (107, "z" * 50_000, "en", "s1")]
    base += [(-5, "\U0001f600 é ñ. 10.0.0.1 x@y.zz +1 (202) 555-0143", "en", "s2")]
    return base


def frame(spark, rows):
    full = [(*r[:4], len(r[1]) if r[1] is not None else None, "d", 1, 0.5, None, "i", 3, 1.0, 2, 1, 9, 1, "k", 5, "s") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(r[0], int(r[0] is not None and r[0] % 4 != 0), int(r[0] == 3)) for r in odd_rows()] + [(None, 1, 1), (3, None, None), (999, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def same_rows(a, b):
    cols = sorted(a.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, a.select(*cols).collect()), key=key) == sorted(map(tuple, b.select(*cols).collect()), key=key)

