import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, start string, _n string, ids string"
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from the noisy village near the old river bank "


def rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows and ids."""
    texts = [
        (0, PLAIN * 3, "en"), (1, PLAIN * 3, "en"), (1, PLAIN * 3, "en"), (2, None, None), (3, "", "en"), (4, " \t\n ", "de"),
        (5, "Schöne Grüße an alle, die heute nicht kommen können, weil das Wetter so schlecht ist", "de"), (6, "a b", "en"),
        (7, "x" * 50_000 + " " + "wörter und noch mehr " * 5_000, "de"), (8, "1234 5678", None), (None, "ohne Kennung, aber mit Text", "de"),
        (None, None, None), (9, "Mail a@b.co and c@d.org, call +1 (234) 567-8901, 4111 1111 1111 1111 or 10.0.0.300 10.0.0.1", "en"),
        (9, "another text under the same id", "en"), (10, PLAIN.upper() * 3, "en"), (11, "All rights reserved. CC BY 4.0", "en"),
    ]
    return [(i, t, lang, "s", None if t is None else len(t), "yes", "now", "many", "none") for i, t, lang in texts]


@pytest.fixture(scope="session")
def rough(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, None if langs is None else langs[i], "s", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
