from __future__ import annotations

import pytest
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own, and one with a dot.
EXTRA = "row string, fp long, `key` int, id string, row_key string, `a.b` int, kept_text string, `group` int"


def odd_documents() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows and ids."""
    passage = " ".join(f"word{i} and" for i in range(40))
    long_text = "\n".join(f"A long line number {i} with several words in it, like {i * 7919 % 1009} others" for i in range(9000))
    rows = [
        (1, "", "en", "s"),
        (2, None, "en", "s"),
        (3, " \n\t ", None, None),
        (None, "a text without an id, of some words", "en", None),
        (None, None, None, None),
        (4, passage, "en", "s"),
        (5, "Before it. " + passage + "\nand after it.", "de", "s"),
        (6, long_text, "en", "t"),
        (7, "same same same same", "en", "t"),
        (8, "same same same same", "en", "t"),
        (8, "same same same same", "en", "t"),
        (9, "one line of text that is here\none line of text that is here\nOne line of text that is here", "en", "t"),
        (10, "Ünïcödé ǅ 漢字 text with Σ signs <|endoftext|> don't I'LL 12 345\x85x", "fr", "t"),
        (8, "another text under an id that is used twice", "en", "t"),
        (11, "x" * 300_000, "en", "u"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, clashing=False):
        schema = T._parse_datatype_string(DOCS + (", " + EXTRA if clashing else ""))
        return spark.createDataFrame([tuple(r) + (("x", 7, 1, "id", "k", 2, "kept", 3) if clashing else ()) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(odd_documents(), clashing=True).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
