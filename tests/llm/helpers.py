import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, part int, fp long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, g, s, len(t) if t is not None else None, 7, 1, 2) for d, t, g, s in rows], DOCS)


EN = "the quick brown fox jumps over the lazy dog and then the other dog thinks about this thing with them "
DE = "der schnelle braune fuchs springt über den faulen hund und dann denkt der andere hund noch einmal nach "
FR = "le renard brun rapide saute par dessus le chien paresseux et puis l'autre chien réfléchit à cette chose "


def odd_documents():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    return [
        (1, EN * 4, "en", "a"), (2, EN * 4, "en", "a"), (2, EN * 4, "en", "a"), (3, DE * 3, "de", "b"), (4, FR * 3, "fr", None),
        (5, None, None, "b"), (6, "", "en", "b"), (7, " \n\t ", "de", None), (None, EN * 2, "en", "a"), (None, None, None, None),
        (8, long, "en", "hot"), (9, long + " end", "en", "hot"), (10, "123 456 !!!", "fr", "hot"), (11, "Ünï ☃   x", None, "hot"), (12, "one two", "en", "hot"),
    ]
