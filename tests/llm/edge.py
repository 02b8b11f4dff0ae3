"""Small tables with every awkward case."""

import random

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, score double, fp long, __qm_rules int"


def texts(seed=5, n=40):
    rng = random.Random(seed)
    vocabulary = ["th", "Inth", "of", "onston", "die&&&", "été", "the", "a,", "|", "IT!!", "日本", "x" * 30]
    made = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(n)]
    made += [None, "", " \n\t ", "one", "two words", "A\x0bB\x0cC\rD\tE\nF", "line here\nline here\n\nline here\n", "é" * 50, "a b c d e f g h " * 40]
    made += [made[3], made[3], made[3] + " tail"]
    made.append(" ".join(rng.choices(vocabulary, k=60_000)))  # very long
    return made


def documents(spark, rows=None, clash=True):
    rows = texts() if rows is None else rows
    langs = ["en", "fr", "de", "es", None]
    data = [(i, t, langs[i % 5], None if i % 7 == 6 else f"src{i % 3}", len(t or ""), 1, True, 0.5, 7, 3) for i, t in enumerate(rows)]
    data += [data[1], (None, "a null id", "en", "src0", 9, 1, True, 0.5, 7, 3), (None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, CLASHING).repartition(3)
    return df if clash else df.select("doc_id", "text", "lang", "source", "n_chars")


def labels(spark, n=60):
    rows = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(n)] + [(None, 1, 0), (3, None, None), (4, 0, 0), (4, 0, 0), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
