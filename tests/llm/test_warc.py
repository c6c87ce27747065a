import gzip
import io

import pytest

from gridloom.llm import warc
from gridloom.llm.common import work_dir
from gridloom.llm.queries import oracle_sql, queries


def archive(*recs):
    return b"".join(map(warc.gzip_member, recs))


def test_members_are_gzip_and_read_in_small_steps(monkeypatch):
    recs = [warc.page_record(i, f"http://x/{i}", b"<p>" + b"ab" * (i * 700) + b"</p>", None) for i in range(6)]
    data = archive(*recs)
    assert gzip.decompress(data) == b"".join(recs)
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "_READ", step)
        got = list(warc.records(io.BytesIO(data)))
        assert [r.http[1] for r in got] == [b"<p>" + b"ab" * (i * 700) + b"</p>" for i in range(6)]
        assert [r.headers["warc-target-uri"] for r in got] == [f"http://x/{i}" for i in range(6)]


def test_damage_is_found():
    good = warc.page_record(1, None, b"payload", None)
    list(warc.records(io.BytesIO(archive(good))))
    for bad in (good.replace(b"payload", b"paYload"), good.replace(b"\r\n\r\n", b"\n", 1), good[:-1]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(archive(bad))))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(archive(good)[:-9])))


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    rows = [(1, "http://a\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (5, "u", "<p>é</p>"), (5, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (7, "u", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(df).collect())
    assert got == [(0, 9, "revisit", 5), (1, 9, "revisit", 5), (2, 0, "revisit", 3), (3, 0, "response", None), (5, 9, "response", None), (5, 9, "response", None), (7, 100_000, "response", None)]
    assert warc.archived(df.limit(0)).count() == 0


def test_payloads_come_back(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = work_dir(spark)
    back = warc.read_archives(warc.write_archives(warc.with_revisits(pages), root), root, with_payload=True)
    html = {r.page_id: r.html for r in pages.collect()}
    url = {r.page_id: r.url for r in pages.collect()}
    rows = back.collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.url == url[r.page_id]
        assert (bytes(r.payload).decode() if r.record_type == "response" else html[r.refers_to]) == html[r.page_id]


def test_query_matches_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(oracle_sql()["op10_warc"]).df()
    got = queries()["op10_warc"](spark, sf_dir).toPandas()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False)))
    assert key(got) == key(want.astype(got.dtypes.to_dict()))


def test_large_ids(spark):
    ids = [2**60 + 1, 2**60 + 3, 5, None]
    df = spark.createDataFrame([(i, "u", "<p>a" if i != 5 else "b") for i in ids], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.refers_to for r in warc.archived(df).collect()}
    assert got == {2**60 + 1: 2**60 + 3, 2**60 + 3: None, 5: None, None: 2**60 + 3}
