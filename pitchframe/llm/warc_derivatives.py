"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Every response yields one metadata record (title, language, number of links, and the source's own headers) and one
conversion record (its plain text). Both refer to the response by its identifier, target and date, name each other as
concurrent, and carry digests of their blocks and of the payload they come from. Identifiers derive from the page's id,
target and content, so that a task that runs again makes the same records, and two captures of one page have two.

Defined results: a null page is an empty payload with an empty text; a null target is ''; rows that repeat give equal
records; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
# Elements that aren't shown, those that end a line, and the named characters that are turned back.
HIDDEN = ["script", "style", "template"]
BREAKS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|article|section|header|footer|figure|blockquote|pre"
NAMED = [("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def region(tag: str, inside: str = "{}") -> str:
    """From the last start of an element before its end to that end. Each part is read once, however many starts there are."""
    return rf"<{tag}\b[^<>]*+>" + inside.format(rf"[^<]*+(?:<(?!/?{tag}\b)[^<]*+)*+") + f"</{tag}>"


# in one pass; what isn't closed goes to the end of the page, so that no start is tried twice
UNSEEN = [r"<!--.*?(?:-->|\z)", *[rf"<{tag}\b.*?(?:</{tag}>|\z)" for tag in HIDDEN]]
TAG = rf"(?i)</?(?:{BREAKS})\b[^<>]*>"
#: Patterns in their order, each with what it leaves. A tag ends before the next one, so that pages of < only stay cheap.
TO_TEXT = [
    ("(?is)" + "|".join([*UNSEEN, region("head")]), ""),
    ("(?is)" + region("nav"), "\n"),
    (TAG, "\n"),
    (r"<[^<>]*>", ""),
    (r"[ \t\r]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"\A\s++|(?<!\s)\s++\z", ""),
]
TITLE = "(?is)" + region("title", "({})")
LANGUAGE = r"(?is)<html\b[^<>]*\blang=\"([^\"<>]*)\""
LINK = r"(?i)<a\s[^<>]*href="
#: The same for SQL, whose patterns know neither possession nor what stands around; they differ where starts are nested.
SQL_TEXT = [
    ("(?is)" + "|".join([*UNSEEN, r"<head\b[^<>]*>.*?</head>"]), ""),
    (r"(?is)<nav\b[^<>]*>.*?</nav>", "\n"),
    *TO_TEXT[2:6],
    (r"^\s+|\s+$", ""),
]
SQL_TITLE = r"(?is)<title\b[^<>]*>(.*?)</title>"


def plain_text(html: Column) -> Column:
    out = html
    for pattern, left in TO_TEXT:
        out = F.regexp_replace(out, pattern, left)
    for name, char in NAMED:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def identifier(*parts: Column) -> Column:
    """A urn:uuid that the parts decide."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records: identifier, target, date, headers of the source, payload and its digest."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    target = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    digest = F.concat(F.lit("sha256:"), F.sha2(payload, 256))
    return pages.select(F.col(id_col).alias("page_id"), target.alias("target_uri"), payload.alias("payload"), digest.alias("payload_digest")).select(
        "page_id",
        identifier(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest")).alias("record_id"),
        "target_uri",
        F.lit(DATE).alias("date"),
        F.create_map(
            F.lit("status"), F.lit("200"),
            F.lit("content-type"), F.lit("text/html; charset=utf-8"),
            F.lit("content-length"), F.octet_length("payload").cast("string"),
        ).alias("headers"),
        "payload",
        "payload_digest",
    )


def derivatives(found: DataFrame) -> DataFrame:
    """Response records to their metadata and conversion records, two rows each."""
    page = found.select(
        "*",
        plain_text(F.col("payload")).alias("text"),
        F.trim(F.regexp_extract("payload", TITLE, 1)).alias("title"),
        F.regexp_extract("payload", LANGUAGE, 1).alias("language"),
        F.regexp_count("payload", F.lit(LINK)).alias("links"),
        identifier(F.lit("metadata"), F.col("record_id")).alias("metadata_id"),
        identifier(F.lit("conversion"), F.col("record_id")).alias("conversion_id"),
    )
    headers = F.array_join(
        F.transform(F.map_entries("headers"), lambda x: F.concat(F.lit("source-"), x["key"], F.lit(": "), x["value"], F.lit(CRLF))), ""
    )
    fields = F.concat(
        F.lit("title: "), F.col("title"), F.lit(CRLF + "language: "), F.col("language"),
        F.lit(CRLF + "links: "), F.col("links").cast("string"), F.lit(CRLF), headers,
    )
    record = lambda kind, own, other, media, block: F.struct(
        F.lit(kind).alias("record_type"),
        F.col(own).alias("record_id"),
        F.col(other).alias("concurrent_to"),
        F.lit(media).alias("content_type"),
        block.alias("block"),
    )
    both = F.array(
        record("metadata", "metadata_id", "conversion_id", "application/warc-fields", fields),
        record("conversion", "conversion_id", "metadata_id", "text/plain; charset=utf-8", F.col("text")),
    )
    rows = page.select(
        "page_id", F.col("record_id").alias("refers_to"), F.col("target_uri"), F.col("date").alias("refers_to_date"), "headers", "payload_digest",
        F.explode(both).alias("x"),
    )
    return rows.select(
        "page_id", "x.record_type", "x.record_id", "refers_to", "x.concurrent_to", "target_uri", "refers_to_date", "headers", "payload_digest",
        "x.content_type", "x.block",
        F.concat(F.lit("sha256:"), F.sha2("x.block", 256)).alias("block_digest"),
        F.octet_length("x.block").cast("long").alias("content_length"),
    )


def serialised(records: DataFrame, out: str = "warc") -> DataFrame:
    """Derivative records with the bytes of their WARC form."""
    lines = [
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        ("WARC-Date", F.col("refers_to_date")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("refers_to_date")),
        ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("concurrent_to"), F.lit(">"))),
        ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Payload-Digest", F.col("payload_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    ]
    head = F.concat(F.lit("WARC/1.1" + CRLF), *[x for name, value in lines for x in (F.lit(f"{name}: "), value, F.lit(CRLF))], F.lit(CRLF))
    return records.withColumn(out, F.concat(head, F.col("block"), F.lit(CRLF * 2)).cast("binary"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every page, blocks by their digests."""
    found = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select(
        "page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "refers_to_date", "payload_digest",
        "content_type", "block_digest", "content_length",
    )


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = "payload"
    for pattern, left in SQL_TEXT:
        text = f"regexp_replace({text}, {quoted(pattern)}, {'chr(10)' if left == chr(10) else quoted(left)}, 'g')"
    for name, char in NAMED:
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"

    def urn(*parts: str) -> str:
        h = f"sha256(concat_ws('|', {', '.join(parts)}))"
        cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'urn:uuid:' || {cuts}"

    end = "chr(13) || chr(10)"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, 'sha256:' || sha256(payload) AS payload_digest FROM p),
q AS (SELECT *, {urn("'response'", "coalesce(page_id::VARCHAR, '')", "target_uri", "payload_digest")} AS refers_to FROM r),
s AS (SELECT *, {urn("'metadata'", "refers_to")} AS m, {urn("'conversion'", "refers_to")} AS c, {text} AS text,
      'title: ' || trim(regexp_extract(payload, {quoted(SQL_TITLE)}, 1)) || {end} || 'language: '
      || regexp_extract(payload, {quoted(LANGUAGE)}, 1) || {end} || 'links: '
      || len(regexp_extract_all(payload, {quoted(LINK)})) || {end} || 'source-status: 200' || {end}
      || 'source-content-type: text/html; charset=utf-8' || {end} || 'source-content-length: ' || strlen(payload) || {end} AS fields FROM q),
u AS (SELECT *, 'metadata' AS record_type, m AS record_id, c AS concurrent_to, 'application/warc-fields' AS content_type, fields AS block FROM s
      UNION ALL
      SELECT *, 'conversion', c, m, 'text/plain; charset=utf-8', text FROM s)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{DATE}' AS refers_to_date, payload_digest, content_type,
       'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM u
"""


OP8_SQL = _sql()
