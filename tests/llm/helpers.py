"""Small document tables with awkward rows, stored as Parquet like the tables that the operators read."""

import uuid

SCHEMA = "doc_id long, text string, lang string, source string, _row long, kept string, name string, key int, component string, score string"

WORDS = "the of and a river stone makes long small water under green field house over light paper train clock every".split()


def prose(n, seed=0):
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


def stored(spark, tmp_path, rows):
    """Rows (doc_id, text, lang, source), with columns whose names clash with those that operators use inside."""
    folder = str(tmp_path / uuid.uuid4().hex)
    full = [(*r, 7, "x", "y", 1, "z", "s") for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(2).write.parquet(folder)
    return spark.read.parquet(folder)


LONG = prose(30_000, 5)
AWKWARD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (None, "no id here at all", "en", None),
    (None, None, None, None),
    (4, prose(60, 1), "en", "a"),
    (4, prose(60, 1), "en", "a"),
    (4, prose(60, 2), "de", "b"),
    (5, prose(60, 1), "en", "b"),
    (6, prose(60, 1).replace(" ", "\n"), "en", "b"),
    (7, LONG, "en", "a"),
    (8, LONG + " end", None, "a"),
    (9, "12345 !!! 0x", "en", "a"),
    (10, "é ü 日本語 'quoted' don't\x00\x1c x", "fr", "c"),
]
