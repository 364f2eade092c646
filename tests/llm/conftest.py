import pytest

# Columns with names that operators use for themselves or for their results.
CLASHING = ("kept", "size", "score", "id", "digest", "fp", "_document", "host", "target",
            "n_words", "ids", "label")
DDL = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
       + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture
def docs(spark):
    """Build a table of documents from ``(doc_id, text[, lang[, source]])``."""
    def build(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *(None,) * (4 - len(row)))
            full.append((doc_id, text, lang, source, len(text or ""),
                         *[f"{c}-{doc_id}" for c in CLASHING]))
        return spark.createDataFrame(full, DDL)
    return build
