import pytest

from keyloom.llm.common import ship

SF = "/root/testdata/sf0.001"

ODD = [
    (900001, "src0", None), (900002, None, ""), (900003, "src0", " \n\t "), (None, "src1", "no id here at all"), (900004, "src1", "one"),
    (900005, "src1", "a b c d"), (900006, "src1", "A B c  d"), (900007, "src2", "same words again " * 40), (900007, "src2", "same words again " * 40),
    (900008, "src2", "x" * 50_000), (900009, None, "word " * 30_000), (900010, "src3", "Zoë's café — naïve\u00a0text 'll 12345 ½ \u3000 日本語 🙂 it's\r\n\r\n end  "),
    (900011, "src3", "mail a.b@c.d.e, x@y, p@q.r@s.t +1 (555) 123-4567 1.2.3.4 999.1.1.1 01.02.003.0004 4111 1111 1111 1111 4111-1111-1111-1112"),
    (900012, "src3", "tie"), (900013, "src3", "tie"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The small documents with odd rows and columns of clashing names."""
    ship(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    odd = spark.createDataFrame(ODD, "doc_id bigint, source string, text string")
    return base.unionByName(odd).selectExpr("*", "'extra' AS ids", "1 AS n", "2 AS root", "'k' AS kept", "0 AS size").coalesce(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]


@pytest.fixture
def empty(docs):
    return docs.where("false")
