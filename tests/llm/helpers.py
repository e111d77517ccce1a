"""Rows that any operator must survive."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, words int, label string, component string"

EDGES = [
    (1, None, None, None, None, None, None, None, None, None),
    (2, "", "en", "s", 0, 1.0, 5, 1, "x", "y"),
    (3, "   \n\t ", "en", "s", 0, 1.0, 5, 1, "x", "y"),
    (4, "The same words here for all of the copies to have", "en", "s", 1, 1.0, 5, 1, "x", "y"),
    (5, "the SAME words here for all of the copies to have", "en", None, 1, 1.0, 5, 1, "x", "y"),
    (5, "the SAME words here for all of the copies to have", "en", None, 1, 1.0, 5, 1, "x", "y"),
    (6, "word " * 60_000, "en", "s", 1, None, None, 1, "x", "y"),
    (7, "x" * 50_000, "fr", "s", 1, None, None, 1, "x", "y"),
    (8, "12345 !!! 😀 <|endoftext|> İstanbul É é", "de", "s", 1, None, None, 1, "x", "y"),
    (None, "a text without an id", None, "s", 1, None, None, 1, "x", "y"),
    (9, "Licensed under CC BY-NC 4.0. Released under the MIT License.", "en", "s", 1, None, None, 1, "x", "y"),
]


def edge_docs(spark, rows=EDGES):
    return spark.createDataFrame(rows, SCHEMA)


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
