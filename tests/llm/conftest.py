import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))


#: Nulls, empty, blank, very long, repeated and tied rows; the last columns clash with names the operators use.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, n long, shard int, score double, "
    "rank int, key string, words array<string>, component_id long, label int, target double, part int"
)


@pytest.fixture(scope="session")
def awkward(spark):
    def row(i, text, source="a", lang="en"):
        return (i, text, lang, source, len(text) if text else None, -1, -1, -1, -1.0, -1, "k", ["w"], -1, -1, -1.0, -1)

    long_text = prose(7, 60_000)
    rows = [
        row(1, None), row(2, ""), row(3, " \t\r\n\x0b\x0c "), row(4, prose(1, 120) + ".", "b"), row(5, prose(1, 120) + ".", "b"),
        row(6, prose(1, 120).upper() + ".", None), row(7, long_text, "hot"), row(8, long_text + " tail", "hot"),
        row(9, "one"), row(10, "ONE"), row(11, "one two"), row(12, None, None, None), row(13, "x" * 50_000),
        row(13, "x" * 50_000), row(14, prose(2, 80), "hot"), row(None, prose(3, 80), "hot"),
    ]
    return spark.createDataFrame(rows, SCHEMA)
