"""Resolution of not-modified revisit records in web captures.

A revisit (status 304) stands for the latest earlier full response of the same
canonical URL.  The as-of join goes by time buckets, so that a URL with very
many captures is spread over tasks: the latest response of each bucket is
gathered first and carried forward, and inside a bucket a window finds it.
Validators then tell whether the response is the one that was not modified, and
the headers that a 304 may update are merged over the response's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response carries to update a stored response, in lower case.
PERMITTED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Width of a time bucket.
BUCKET_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """URL without scheme, "www.", user, default port, fragment, tracking parameters and final slash; host in lower case, parameters sorted.

    A null or blank URL has no canonical form.
    """
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^(?i:https?)://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    made = F.concat(host, path, tail)
    return F.when(made != "", made)


def _same_tag(a: Column, b: Column) -> Column:
    """Weak comparison of entity tags."""
    return F.regexp_replace(a, "^W/", "") == F.regexp_replace(b, "^W/", "")


def _lower_names(headers: Column) -> Column:
    """Header fields by lower-case name; of names that differ in case only the one that sorts last counts, and null has no fields."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    beaten = lambda e: F.exists(entries, lambda x: (F.lower(x["key"]) == F.lower(e["key"])) & (x["key"] > e["key"]))
    return F.map_from_entries(F.transform(F.filter(entries, lambda e: ~beaten(e)), lambda e: F.struct(F.lower(e["key"]), e["value"])))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit of ``records``.

    records: record_id long, warc_type ("response" or "revisit"), url, captured_at
    long (seconds), status int, etag, last_modified, headers map of strings,
    n_bytes long.  Full responses are those with a status from 200 to 299.

    Result: record_id, canonical_url, captured_at, response_id, outcome, headers,
    n_bytes.  outcome is "resolved" if the entity tags agree, or, where one is
    missing, the modification dates; "mismatch" if they differ; "unverified" if
    there is nothing to compare; "no_response" if there is no earlier response.
    Only resolved revisits have merged headers and the response's size.  Earlier
    is strictly before; of responses at one time the greatest record_id counts.
    Revisits without URL or time have no response; repeated rows are kept; long
    values are kept whole; other columns are not read, whatever their names; an
    empty table gives no rows.
    """
    info = F.struct("record_id", "etag", "last_modified", "headers", "n_bytes")
    full = (F.col("warc_type") == "response") & F.col("status").between(200, 299) & F.col("captured_at").isNotNull() & F.col("canonical_url").isNotNull()
    every = records.withColumn("canonical_url", canonical_url(F.col("url"))).withColumn("bucket", F.floor(F.col("captured_at") / bucket_seconds))
    every = every.select("record_id", "warc_type", "canonical_url", "captured_at", "bucket", "etag", "last_modified", "headers", "n_bytes", F.when(full, info).alias("full"))
    order = F.struct("captured_at", "record_id")
    # The latest response of each bucket, then of all buckets before.
    by_bucket = every.where("full is not null").groupBy("canonical_url", "bucket").agg(F.max_by("full", order).alias("latest"))
    asked = every.where("warc_type = 'revisit' and canonical_url is not null and bucket is not null").select("canonical_url", "bucket").distinct()
    buckets = by_bucket.join(asked, ["canonical_url", "bucket"], "full_outer")
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("canonical_url", "bucket", F.last("latest", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    placed = every.where("warc_type = 'revisit' or full is not null").withColumn("recent", F.max_by("full", F.when(F.col("full").isNotNull(), order)).over(inside)).where("warc_type = 'revisit'")
    found = placed.join(carried, ["canonical_url", "bucket"], "left").withColumn("hit", F.coalesce("recent", "carried"))
    hit = F.col("hit")
    tags, dates = hit["etag"].isNotNull() & F.col("etag").isNotNull(), hit["last_modified"].isNotNull() & F.col("last_modified").isNotNull()
    same = F.when(tags, _same_tag(hit["etag"], F.col("etag"))).when(dates, hit["last_modified"] == F.col("last_modified"))
    outcome = F.when(hit.isNull(), "no_response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    news = F.map_filter(_lower_names(F.col("headers")), lambda k, v: k.isin(*PERMITTED_HEADERS))
    merged = F.map_concat(F.map_filter(_lower_names(hit["headers"]), lambda k, v: ~F.array_contains(F.map_keys(news), k)), news)
    done = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "captured_at", hit["record_id"].alias("response_id"), "outcome", F.when(done, merged).alias("headers"), F.when(done, hit["n_bytes"]).alias("n_bytes")
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Capture records of a pages table (page_id, url, html): each page once in full, then up to two revisits at other spellings of its URL.

    Some revisits carry a changed or no entity tag, so every outcome occurs.
    """
    p = F.col("page_id")
    visit = pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod(p, F.lit(3)))).alias("k"))
    k, first = F.col("k"), F.col("k") == 0
    spelled = F.when(first, F.col("url")).when(k == 1, F.concat(F.regexp_replace("url", "^http://", "https://"), F.lit("#seen"))).otherwise(F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&utm_source=again").otherwise("?utm_source=again")))
    tag = F.when(first, F.md5("html")).when(F.pmod(p + k, F.lit(5)) == 0, F.md5("url")).when(F.pmod(p + k, F.lit(7)) == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), F.md5("html")))
    day = F.when(F.pmod(p, F.lit(2)) == 0, F.concat(F.lit("day "), F.pmod(p, F.lit(365)).cast("string")))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.concat(F.lit("t"), (p + 37 * k).cast("string")), F.lit("Content-Length"), F.when(first, F.octet_length("html").cast("string")).otherwise("0"), F.lit("Server"), F.concat(F.lit("s"), k.cast("string")))
    return visit.select(
        (p * 10 + k).alias("record_id"), F.when(first, "response").otherwise("revisit").alias("warc_type"), spelled.alias("url"), ((p + 37 * k) * 1000).alias("captured_at"),
        F.when(first, 200).otherwise(304).alias("status"), tag.alias("etag"), day.alias("last_modified"), headers.alias("headers"), F.octet_length("html").cast("long").alias("n_bytes"),
    )
