import io

import pytest

from themeflow.llm import warc
from themeflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def pages(spark):
    rows = [(i, f"http://h/{i} x\r\n", f"body {i % 4}" * i, "zz") for i in range(12)]
    rows += [(20, None, None, "zz"), (21, "u", None, None), (22, "u", "", "zz"), (23, "u", "é日\r\n\r\n" * 9, "zz")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_round_trip_equals_brute_force(spark):
    df = pages(spark)
    got = warc.read_archives(warc.write_archives(df)).collect()
    assert key(got) == key(warc.brute_force([(r.page_id, r.html) for r in df.collect()]))


def test_payloads_come_back(spark):
    df = pages(spark)
    back = {r.page_id: r.payload for r in warc.read_archives(warc.write_archives(df), keep_payload=True).collect()
            if r.record_type == "response"}
    html = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert back and all(html[k] == bytes(v) for k, v in back.items())


def test_min_bytes_leaves_small_copies_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                               "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(df, min_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "u", "same"), (5, "u", "same"), (5, "u", "same"), (None, "u", "other")],
                               "page_id long, url string, html string")
    got = key((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect())
    assert got == key([(None, "revisit", 5), (5, "response", None), (5, "response", None), (None, "response", None)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).count() == 0


@pytest.mark.parametrize("harm", ["cut", "byte", "length"])
def test_damage_is_found(harm):
    data = warc.record(1, "u", b"payload " * 500, False, None)
    if harm == "cut":
        data = data[:-20]
    else:
        import gzip
        raw = gzip.decompress(data)
        raw = raw.replace(b"payload payload", b"payload Payload", 1) if harm == "byte" else raw.replace(
            b"Content-Length: 4", b"Content-Length: 3", 1)
        data = gzip.compress(raw)
    with pytest.raises(warc.WarcError):
        for pieces in warc.members(io.BytesIO(data)):
            warc.read_record(pieces)


def test_members_split_anywhere():
    data = b"".join(warc.record(i, "u", bytes([i]) * 70000, False, None) for i in range(4))

    class Trickle(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 37) if n and n > 0 else n)
    got = [warc.read_record(p, True)["payload"] for p in warc.members(Trickle(data))]
    assert got == [bytes([i]) * 70000 for i in range(4)]


def test_query(spark):
    got = QUERIES["op1_warc"](spark, SF).collect()
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert key(got) == key(warc.brute_force(rows))
