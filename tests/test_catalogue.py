import math
from pathlib import Path

import duckdb
import pytest

from siftwire import catalogue

SF = Path("/root/testdata/sf0.001")


def test_names():
    assert catalogue.oracle_sql().keys() <= catalogue.queries().keys()


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = catalogue.queries()[name](spark, str(SF))
    want = con.execute(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns

    def plain(value):
        return round(value, 9) + 0.0 if isinstance(value, float) and math.isfinite(value) else value

    left = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    right = sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in want.fetchall())
    assert left == right


def test_normalize_takes_whole_texts(spark, tmp_path):
    tail = "word, " * 2000 + "The END"
    spark.createDataFrame([(1, "The  " + tail)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"{tail}\nsecond line {tail}", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = catalogue.queries()
    assert queries["name_normalize_whole"](spark, str(tmp_path)).first()["name"] == "word " * 2000 + "the end"
    item = queries["items_normalize_whole"](spark, str(tmp_path)).first()
    assert (item["title"], item["body"]) == (tail, f"{tail}\nsecond line {tail}")
