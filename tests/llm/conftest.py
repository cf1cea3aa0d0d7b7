
import pytest
from pyspark.sql import Row

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, special tokens and other columns of clashing names."""
    texts = [None, "", "  a", "a  b", "a   b \n c", "x<|endoftext|>y <|endoftext|>", " ", "\n\n a", "日本語 テキスト", "é́a 🙂🙂",
             "a" * 3000, "word and more words " * 3000, "don't I'll. 12a, 3.", "same text", "same text", "tab\t\t b\r\n c"]
    rows = [Row(doc_id=i, text=t, lang=None, source="s", n_chars=None, ids=1, part=2, rank=3, block=4, component_id=5, rows="x")
            for i, t in enumerate(texts)]
    rows += [rows[-1], Row(**{**rows[3].asDict(), "doc_id": None})]
    schema = ("doc_id long, text string, lang string, source string, n_chars int, ids int, part int, rank int, block int, "
              "component_id int, rows string")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
