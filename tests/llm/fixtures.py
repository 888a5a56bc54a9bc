"""Small tables with the awkward cases: nulls, empties, long texts, ties, repeats, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars int, id int, label string, shard int, score double, `__key` int"


def documents(spark, texts, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "src0", None, 7, "x", 3, 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [
    None,
    "",
    " ",
    "\n\n\t",
    "a",
    "same words here again and again",
    "same words here again and again",
    "Ünïcödé — 漢字 عربى ​  x y \x1c z ½ Ⅷ ٣",
    "don't DON'T we'll I've  double  spaces\r\n\r\nlines \t tabs ",
    "<|endoftext|> in a text",
    "\x00\x01 control",
    "x" * 3000,
    "word " * 4000,
    "😀😀 emoji 👩‍👩‍👧",
    "1234567890 " * 50,
]


def words(draw: random.Random, n: int, letters="abcdefgh") -> str:
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(n))
