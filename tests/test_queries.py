"""Every registered query against its SQL on the smallest tables."""

from itertools import product

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from lumenpair.plans import catalog
from lumenpair.sources.benchmarks import load_bivlc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    sql = catalog.ORACLES.get(name)
    if sql is None:
        assert df.collect()
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_embedded_images_of_odd_documents(spark, tmp_path):
    """An empty or null text, language or source is a value, as in the SQL; a null id comes last."""
    values = list(product(["a \n b ", "", " ", "+", None], ["en", "es", "", None], ["web", "", None]))
    fields = {"doc_id": [*range(-3, len(values) - 4), None], "text": [v[0] for v in values], "lang": [v[1] for v in values], "source": [v[2] for v in values]}
    types = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])
    pq.write_table(pa.table(fields, schema=types), tmp_path / "documents.parquet")
    name = "src13_embedded_image_pairs"
    assert compare(catalog.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), catalog.ORACLES[name]) is None


def test_embedded_images_without_caption_or_bytes(spark):
    """The loader itself sets empty captions and empty bytes aside."""
    data = [(0, "a", "b", b"p"), (1, "", "b", b"p"), (2, "a", None, b"p"), (3, "a", "b", b""), (4, "a", "b", None)]
    rows = spark.createDataFrame(data, "record_index long, caption string, negative_caption string, b binary")
    rows = rows.withColumn("image", F.struct(F.col("b").alias("bytes")))
    good, bad = load_bivlc(rows.withColumns({"negative_image": F.lit(b"n"), "source_file": F.lit("/d/t.parquet")}))
    assert [r.sample_id for r in good.collect()] == ["t_0"]
    assert {r.sample_id: r.reason.split()[1] for r in bad.collect()} == {"t_1": "caption", "t_2": "caption", "t_3": "image", "t_4": "image"}
