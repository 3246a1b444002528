"""Content-addressed web archive: payload bytes once by verified digest, exact record headers apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pestle.llm.common import shared_dir, text_of, written

#: Payloads of fewer bytes are never replaced by a revisit.
MIN_REVISIT = 100
EOL = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uuid(*parts):
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def field(name: str, value):
    """A header line; none where the value is null. Line ends inside a value become spaces."""
    return F.coalesce(F.concat(F.lit(name + ": "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit(EOL)), F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> None:
    """Write ``path/headers`` (one row per record) and ``path/payloads`` (one row per digest).

    Of records whose payloads of at least ``MIN_REVISIT`` bytes are equal, the one with the smallest
    (id, url, read order) is a response and the others revisit it; smaller ones are all responses, yet
    their bytes too are stored once. Null html is an empty payload; null ids and urls stay null; repeated
    rows are records of their own; an empty table gives an empty archive; further columns are ignored.

    Digests, ids and urls are shuffled by digest, and payloads once, by (digest, id), where a hot
    payload is spread over its copies' ids.
    """
    payload = text_of(html_col).cast("binary")
    light = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )
    light = written(light, "light")
    spark = pages.sparkSession
    first = light.groupBy("digest").agg(F.min(F.struct("id", "url", "row")).alias("first"))
    first = first.select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.row").alias("first_row"))

    rows = light.join(first.hint("merge"), "digest")
    response = (F.col("n_bytes") < MIN_REVISIT) | (F.col("row") == F.col("first_row"))
    rid = lambda i, u, r: record_uuid(F.coalesce(F.col(i).cast("string"), F.lit("")), F.coalesce(F.col(u), F.lit("")), F.col(r).cast("string"), F.col("digest"))
    header = F.concat(
        F.lit("WARC/1.1" + EOL),
        F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit"), F.lit(EOL),
        field("WARC-Record-ID", rid("id", "url", "row")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(EOL),
        F.when(response, "").otherwise(F.concat(
            field("WARC-Refers-To", rid("first_id", "first_url", "first_row")),
            field("WARC-Refers-To-Target-URI", F.col("first_url")),
            field("WARC-Profile", F.lit(PROFILE)),
        )),
        F.lit("Content-Type: text/html; charset=utf-8" + EOL),
        F.lit("Content-Length: "), F.when(response, F.col("n_bytes")).otherwise(0).cast("string"), F.lit(EOL + EOL),
    )
    headers = rows.select(
        F.col("id").alias("record_id"),
        header.cast("binary").alias("header"),
        "digest",
        F.when(~response, F.col("first_id")).alias("refers_to"),
    )
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")

    stored = pages.select(F.xxhash64(id_col).alias("key"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    holders = first.select("digest", F.xxhash64("first_id").alias("key"))
    kept = stored.join(holders.hint("merge"), ["digest", "key"], "left_semi")
    kept = kept.dropDuplicates(["digest", "key"])  # a repeated row; dealt as the join is
    kept.select("digest", F.octet_length("payload").cast("long").alias("n_bytes"), "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records, whole: ``record_id, record_type, refers_to, digest, header, payload``.

    Each stored payload is verified against its digest once, before headers are joined to it; a payload
    that is missing or differs fails the query.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    intact = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes"))
    payloads = payloads.select("digest", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.lit("archive: a payload differs from its digest")).cast("binary")).alias("payload"))
    joined = headers.join(payloads.hint("merge"), "digest", "left")
    kind = F.regexp_extract(F.col("header").cast("string"), "WARC-Type: (\\w+)", 1)
    payload = F.coalesce("payload", F.raise_error(F.lit("archive: a payload is missing")).cast("binary"))
    return joined.select("record_id", kind.alias("record_type"), "refers_to", "digest", "header", payload.alias("payload"))


def record_bytes(header, payload, record_type):
    """A record as it stands in a WARC file: a revisit has headers only."""
    end = F.lit(EOL + EOL).cast("binary")
    return F.when(record_type == "response", F.concat(header, payload, end)).otherwise(F.concat(header, end))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write an archive of ``pages`` (below the shared folder unless ``path`` is given) and read it back."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc"
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
