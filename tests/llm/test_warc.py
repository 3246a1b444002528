import hashlib

import pytest
from pestle.llm.common import shared_dir
from pestle.llm.warc import archive_pages, read_archive, record_bytes, write_archive
from pyspark.sql import functions as F

LONG = "<p>é</p>" * 40
ROWS = [(3, "http://a/3", LONG), (1, "http://a/1\r\nX: y", LONG), (2, None, LONG), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""), (8, "u8", "x" * 100), (9, "u9", "x" * 100), (10, "u10", "y" * 99), (11, "u11", "y" * 99), (12, "u12", "z" * 200_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "q", 1) for r in ROWS], "page_id long, url string, html string, digest string, row int")
    path = f"{shared_dir(spark)}/w"
    write_archive(df, path)
    got = {r.record_id: r for r in read_archive(spark, path).withColumn("bytes", record_bytes(F.col("header"), F.col("payload"), F.col("record_type"))).collect()}
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    for i, url, html in ROWS:
        r, body = got[i], (html or "").encode()
        first = min(k for k, _, h in ROWS if (h or "") == (html or ""))
        revisit = len(body) >= 100 and i != first
        assert (bytes(r.payload), r.digest, r.record_type, r.refers_to) == (body, hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
        head, _, rest = bytes(r.bytes).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == r.record_type
        assert fields.get("WARC-Target-URI") == (url.replace("\r\n", " ") if url else None)
        assert rest == (b"" if revisit else body) + b"\r\n\r\n" and int(fields["Content-Length"]) == len(rest) - 4
        if revisit:
            assert f"WARC-Record-ID: {fields['WARC-Refers-To']}\r\n" in bytes(got[first].header).decode()


def test_repeated_null_and_damaged(spark):
    df = spark.createDataFrame([(1, "u", LONG), (1, "u", LONG), (None, "n", LONG), (None, None, None)], "page_id long, url string, html string")
    got = archive_pages(df).collect()
    assert len(got) == 4 and sum(r.record_type == "revisit" for r in got) == 2
    assert archive_pages(df.limit(0)).count() == 0
    path = f"{shared_dir(spark)}/w"
    write_archive(df, path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary"))).write.parquet(f"{path}/bad")
    from pestle.llm.common import remove

    remove(spark, f"{path}/payloads")
    spark.read.parquet(f"{path}/bad").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        read_archive(spark, path).collect()
