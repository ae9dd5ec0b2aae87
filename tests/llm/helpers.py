"""Plain versions of what the operators compute, and documents that are awkward."""

import re

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table from (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """Nulls, blanks, repeated rows, a long text, odd characters."""
    return documents(
        spark,
        [
            (1, None, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "a" * 200_000), (6, "w " * 60_000),
            (7, "İstanbul ſtraße Kelvin K   nbsp\x00zero"), (8, "tie tie tie tie tie tie"), (9, "tie tie tie tie tie tie"), (10, "\r\n.\r\n"),
        ],
    )


def with_clashes(docs):
    """The same rows with more columns, some named as results are."""
    return docs.withColumns({c: F.lit("x") for c in ("n_words", "kept", "component_id", "spans", "row", "node", "start", "weight", "copies", "key", "hit", "items", "block")})


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
