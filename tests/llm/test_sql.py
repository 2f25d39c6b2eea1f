"""Views of operators that SQL can follow, held against it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, registry

VIEWS = ["url_rules", "shard_laws", "mix_targets", "edited_texts"]


@pytest.mark.parametrize("name", VIEWS)
def test_agrees_with_sql(spark, small, duck, same_rows, name):
    same_rows(registry.queries()[name](spark, small), duck, registry.oracle_sql()[name])


def test_targets_where_sources_are_full(spark, tmp_path, same_rows):
    """Small sources beside a large one stop at three times their size, one after another; a null source is the last, an empty one gets nothing."""
    sizes = [("a", 4), ("b", 900), ("c", 30), ("d", 8), ("e", 2), (None, 5), ("f", 0)]
    rows = [(i, " ".join(["w"] * n) if n else None, s) for i, (s, n) in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = mixing.mix_targets(spark, str(tmp_path))
    assert found.where(F.col("target") == 3 * F.col("source_size")).count() >= 5
    same_rows(found, con, mixing.MIX_TARGETS_SQL)


def test_rules_of_urls(spark, tmp_path, same_rows):
    urls = [None, "", "no scheme", "http://Example.com/en/x", "http://www.example.com/en/x?q#f", "https://a.b.net/es/", "https://net/fr/a", "https://net/frx", "http://xnet/es/", "http://com", "http://com/?a", "x://y://z.com/p", "http://a.com/", "http://a.com/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(registry.queries()["url_rules"](spark, str(tmp_path)), con, registry.oracle_sql()["url_rules"])
