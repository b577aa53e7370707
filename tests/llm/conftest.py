import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, _row string"
SYLLABLES = "ka lo mi ter an du ri se po na vel tor en qui sha".split()


def prose(seed: int, n: int, end: str = ". ") -> str:
    """Words made of syllables, in short sentences; some sentences end a line."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        out.append(word + ("." if i % 9 == 8 else ""))
    return " ".join(out).replace(". ", end)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with extra columns whose names operators use."""
    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, "clash", "clash", "clash") for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, prose(2, 80)), (5, prose(2, 80)), (6, prose(2, 80)), (None, "no id here"),
            (None, None), (7, "é ß ñ İ ſ <|endoftext|> #$%"), (8, "x" * 5000), (9, prose(3, 120, ".\n"))]


@pytest.fixture(scope="session")
def folder(tmp_path_factory, spark):
    """Writes tables as parquet folders and returns the path."""
    def write(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return path

    return write
