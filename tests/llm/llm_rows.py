"""Small document tables for the tests."""

#: Names that operators use inside.
CLASHES = ["_row", "_size", "_key", "_class", "_text", "_score", "_shard", "size"]


def make(spark, rows):
    """Documents from (doc_id, text, source), with extra columns whose names clash."""
    full = [(i, t, "en", s, len(t) if t is not None else None, *["x"] * len(CLASHES)) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
