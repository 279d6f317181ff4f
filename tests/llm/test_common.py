from helpers import prose, stored
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, keep_rows, numbered


def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    folder = str(tmp_path / "docs")
    rows = [(i, prose(60, i), "en", "a") for i in range(3000)]
    stored(spark, tmp_path, rows).repartition(3).write.option("parquet.block.size", 20_000).option("parquet.block.size.row.check.min", 10).parquet(folder)
    name, wide = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        first = numbered(spark.read.parquet(folder), "doc_id")
        one = {r.doc_id: r[ROW] for r in first.collect()}
        spark.conf.set(name, "20000")
        docs = spark.read.parquet(folder)
        assert docs.rdd.getNumPartitions() > 3
        assert {r.doc_id: r[ROW] for r in numbered(docs, "doc_id").collect()} == one and len(set(one.values())) == 3000
        wanted = spark.createDataFrame([(n,) for i, n in one.items() if i % 7 == 0], f"{ROW} long")
        kept = keep_rows(docs, wanted)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(0, 3000, 7))
        assert kept.filter(F.col(ROW) != 7).isEmpty()
    finally:
        spark.conf.set(name, wide)
