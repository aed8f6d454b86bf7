import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, blanks, letters outside ASCII, control strings, ties.
ODD = [
    None, "", " ", " \n\t ", "a", "A.", "é", "漢字 かな", "a  b\n\nc", " lead", "trail ", "don't we'll 'S", "<|endoftext|> x <|startoftext|>y", "123 456 7",
    "\x0b\x0c\x1c\x85 　x", "🙂🙂 x🙂", "All  rights\nRESERVED. all rights reserved", "</s>[INST] ok [/INST] <|turn|>user\n<|end|> &amp; &lt;", "K by", "z" * 3000,
]


@pytest.fixture(scope="session")
def texts():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    out = list(ODD)
    for _ in range(60):
        out.append(" ".join(r.choice(words) for _ in range(r.randint(1, 120))) + r.choice(["", ".", "!\n"]))
    out.append(" ".join(r.choice(words) for _ in range(30_000)))  # a very long one
    out += [out[25], out[25], out[26] + " ", out[26].replace(" ", "  ", 1), None]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """One row a text, a null id, a repeated row, and columns whose names operators might use themselves."""
    rows = [(k, t, "en" if k % 2 else None, "s", 1) for k, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, None), rows[30], rows[30]]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("digest", "fp", "key", "word", "ids", "media", "host", "file", "row", "n"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
