import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out int, part string, size string"


def rows_of(seed=5, n=60):
    """Documents with nulls, empty and very long texts, copies, and columns whose names the operators use themselves."""
    rng = random.Random(seed)
    words = {"en": "the of and water house never green would light about".split(), "de": "der und nicht wasser haus grün würde licht über schön".split()}
    out = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 60)))
        out.append([i, text, lang, f"s{i % 3}" if i % 7 else None, len(text), i, "x", None])
    out[3][1], out[4][1], out[5][1] = None, "", " \t\n "
    out[6][1] = out[8][1] = out[10][1]  # copies
    out[9][2] = None
    out[11][1] = "x" * 30_000
    out[12][1] = "Wörter 12 !! ... 日本語 ▁ a  b\n\n" * 300
    out[13][1] = "123 456 ... !!"
    out += [list(out[0]), list(out[0])]  # repeated rows
    out.append([None, "no id here but words of the house", "en", "s1", 5, 0, "x", None])
    out.append([None, None, None, None, None, None, None, None])
    return [tuple(r) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocab():
    from vistra.llm.queries import piece_vocabulary

    return piece_vocabulary()
