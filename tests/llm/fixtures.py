"""Small tables with every awkward case, and helpers."""

from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog again and again. " * 4000
PASSAGE = "A passage of more than a hundred bytes that stands in several documents, word for word, so that it must go from the later ones."


def awkward():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows and ids."""
    rows = [
        (1, "Alpha beta gamma delta. " + PASSAGE + " Epsilon zeta.", "en", "web", 10),
        (2, "Other words first, " + PASSAGE + " and others last.", "en", "web", 10),
        (2, "Other words first, " + PASSAGE + " and others last.", "en", "web", 10),
        (3, None, None, None, None),
        (4, "", "de", "", 0),
        (5, " \n\t ", "fr", "books", 3),
        (6, "ünïcödé 漢字 \U0001f600 text", "fr", "books", 3),
        (7, LONG, "en", "hot", len(LONG)),
        (8, LONG, "en", "hot", len(LONG)),
        (None, "a row without an id", "en", "web", 19),
        (None, None, "en", "web", None),
        (9, "x" * 5000, "en", "hot", 5000),
        (10, "same", "en", "hot", 4),
        (11, "same", "en", "hot", 4),
    ]
    return rows


def docs_df(spark, rows=None, extra=False):
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if extra:
        for name in ("id", "score", "fp", "size", "src", "rid", "span", "word", "hits", "part"):
            df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def by_id(rows, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows}


def auc(score, truth):
    pairs = sorted(zip(score, truth))
    rank, pos = 0.0, 0
    i = 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        for k in range(i, j):
            if pairs[k][1]:
                rank += (i + j + 1) / 2
                pos += 1
        i = j
    return (rank - pos * (pos + 1) / 2) / (pos * (len(pairs) - pos))


__all__ = ["DOCS", "LONG", "PASSAGE", "Row", "auc", "awkward", "by_id", "docs_df"]
