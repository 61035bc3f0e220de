"""Small tables for the tests of this folder."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, n int, kept boolean, score double, label int, row int, h int"


def make(spark, texts, **columns):
    """Documents of texts, with columns whose names the operators use for their own."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((columns.get("ids", range(len(texts)))[i], t, columns.get("langs", ["en"] * len(texts))[i], columns.get("sources", ["s"] * len(texts))[i], len(t or ""), -1, "k", 0, False, 0.5, 1, 2, 3))
    return spark.createDataFrame(rows, SCHEMA)


WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
EDGES = [None, "", " \n\t ", "one", "one", "cc by All Rights reserved", " ".join(WORDS), " ".join(WORDS), "  " + "\n".join(WORDS) + "\x0b", LONG, "é ñ 日本 𝔘 ▁ \x00", "a" * 5000]

