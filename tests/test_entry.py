"""The driver's contract: queries against their SQL on the smallest tables, and the sources."""

import duckdb
import pytest

import __spark_entry__ as entry
from lakesieve.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cur = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sources(spark, tmp_path):
    import zipfile

    from lakesieve.sources import readers as S

    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "a.txt").write_text("x\ny")
    with zipfile.ZipFile(tmp_path / "d" / "z.zip", "w") as z:
        z.writestr("k/b.txt", "hello")
    (tmp_path / "d" / "bad.zip").write_bytes(b"no archive")
    assert S.text_files(spark, str(tmp_path / "d" / "e")).first().content == "x\ny"
    got = {(r.path, bytes(r.content) if r.content else None) for r in S.zip_entries(S.binary_files(spark, str(tmp_path / "d"), "*.zip")).collect()}
    assert got == {("k/b.txt", b"hello"), (None, None)}
    packed = S.zip_parts(spark.createDataFrame([("a", "1"), ("b", None)], "path string, content string"))
    assert packed.count() == 1
    assert S.manifest(spark.createDataFrame([("a", "1")], "path string, content string")).first().files == 1
