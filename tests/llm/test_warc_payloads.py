import hashlib

from quern.llm import warc


def test_query_assembles_payloads(spark, tmp_path, monkeypatch):
    pages = [(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000), (3, "http://c", "small"), (4, "http://d", None), (5, "http://e", "x" * 2000), (6, "http://f", "\u00e9" * 600)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    seen = []
    whole = warc.assemble
    monkeypatch.setattr(warc, "assemble", lambda records: (seen.append(records.where("type = 'response' and payload is null").count()), whole(records))[1])
    got = {r.page_id: tuple(r)[1:] for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    assert seen == [0]
    for i, _, html in pages:
        data = (html or "").encode()
        again = i in (1, 2)
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None)


def test_larger_pages_come_fewer_to_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PAGES_A_FILE", 4)
    monkeypatch.setattr(warc, "SMALL_BYTES", 100)
    monkeypatch.setattr(warc, "BATCH_BYTES", 500)
    pages = [(i, f"http://h/{i}", f"{i:04d}" * n) for i, n in enumerate([5, 25, 26, 50, 51, 100, 101, 400] * 5)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.metadata.page_id: bytes(r.capture.payload).decode() for r in warc.archive_pages(rows, f"file://{tmp_path}/w").collect()}
    assert got == {i: html for i, _, html in pages}
    for file in tmp_path.glob("w/*/*.gz"):
        sizes = [r[-3] for r in warc.parse_archive(file.read_bytes(), True) if r[0] == "response"]
        assert len(sizes) <= max(1, 400 // max(sizes, default=1)) or max(sizes) <= 100 and len(sizes) <= 4
