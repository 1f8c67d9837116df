"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

The join is two levels of windows. Time is cut at sampled quantiles, so that a URL's captures, however many, fall
into many windows; each (URL, time range) finds the latest response within it and the ranges' last responses, one
row each, are carried on along the URL. Payloads aren't moved: the join sees ids, times and validators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Records in a time range, about.
RANGE = 50_000
# Fields of a 304 that don't update the stored response (they describe its payload or one connection),
# and query parameters that don't tell pages apart.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without closing slashes, sorted query without tracking
    parameters; no scheme, no fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^(?i)(?:https?:)?//", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(?:80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(F.lower(p), F.lit(TRACKING)))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.lit("/"), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def lowered(headers: Column) -> Column:
    """A header map with lower-case names; of names that differ in case only, the first in the map's order."""
    entries = F.map_entries(headers)
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: F.lower(x["key"]) == F.lower(e["key"])))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]), e["value"])))


def merged(stored: Column, revisit: Column) -> Column:
    """The stored response's headers with those that the revisit may update; both with lower-case names."""
    new = F.map_filter(revisit, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame, per_range: int = RANGE) -> DataFrame:
    """Each revisit with the response it repeats.

    records: record_id, url, ts, record_type ('response' or 'revisit'), status, headers (a map). Rows that agree in all
    of these are one record; ids may repeat or be null. Full responses are those of status 200; captures order by ts,
    record_id, url and headers, and a response at the revisit's own time counts if it comes first in that order.
    Returns record_id, canonical_url, refers_to, outcome, headers. outcome: 'resolved' (an entity tag, else a
    modification time, that both give is equal; tags compare weakly), 'unchecked' (there is no validator that both give), 'mismatch' or 'missing'
    (no earlier response, or no URL or time). headers are merged for the first two, else the revisit's own. Null
    headers count as none; further columns are ignored; without revisits there are no rows.
    """
    none = F.create_map().cast("map<string,string>")
    head = lowered(F.coalesce("headers", none))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(head), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    rows = records.select("record_id", "url", canonical_url(F.col("url")).alias("canonical_url"), "ts", "record_type", "status", head.alias("headers"), text.alias("text"))
    rows = rows.dropDuplicates(["record_id", "url", "ts", "record_type", "status", "text"])
    lost = rows.where("record_type = 'revisit' AND (canonical_url IS NULL OR ts IS NULL)")
    lost = lost.select("record_id", "canonical_url", F.lit(None).cast("long").alias("refers_to"), F.lit("missing").alias("outcome"), "headers")
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    rows = rows.where((full | (F.col("record_type") == "revisit")) & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull())
    # rid tells records apart whose ids repeat; with ts and record_id before it, it orders them by url and headers
    rid = F.struct("ts", "record_id", "url", "text")
    rows = cut(rows.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("rid", F.xxhash64(rid, "record_type", "status")))
    n = rows.count()
    ranges = max(1, -(-n // per_range))
    split = rows.agg(F.percentile_approx("ts", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(split)))).cast("array<long>"), lambda s: s < F.col("ts"))) if split else F.lit(0)
    # the headers stay behind: what is carried along is the response's id and validators
    key = F.struct("ts", "record_id", "url", "text")
    narrow = rows.select("rid", "canonical_url", "ts", "full", bucket.alias("bucket"), key.alias("k"))
    response = F.when(F.col("full"), F.col("rid"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    found = narrow.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("NOT full")
    tails = narrow.where("full").groupBy("canonical_url", "bucket").agg(F.max_by("rid", "k").alias("tail"))
    steps = tails.unionByName(narrow.where("NOT full").select("canonical_url", "bucket", F.lit(None).cast("long").alias("tail")).distinct())
    steps = steps.groupBy("canonical_url", "bucket").agg(F.max("tail").alias("tail"))
    along = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("canonical_url", "bucket", F.last("tail", ignorenulls=True).over(along).alias("far"))
    asof = found.join(carried, ["canonical_url", "bucket"], "left").select("rid", F.coalesce("near", "far").alias("to"))
    asof = cut(asof)
    own = rows.where("NOT full").select("rid", "record_id", "canonical_url", F.col("headers").alias("h")).join(asof, "rid")
    stored = rows.where("full").select(F.col("rid").alias("s_rid"), F.col("record_id").alias("refers_to"), F.col("headers").alias("s"))
    both = own.join(stored, F.col("to") == F.col("s_rid"), "left")
    tag, since = F.col("h")["etag"], F.col("h")["last-modified"]
    s_tag, s_since = F.col("s")["etag"], F.col("s")["last-modified"]
    same = F.when(tag.isNotNull() & s_tag.isNotNull(), _weak(tag) == _weak(s_tag)).when(since.isNotNull() & s_since.isNotNull(), F.trim(since) == F.trim(s_since))
    outcome = F.when(F.col("s_rid").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    both = both.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome").isin("resolved", "unchecked"), merged(F.col("s"), F.col("h"))).otherwise(F.col("h"))
    return both.select("record_id", "canonical_url", "refers_to", "outcome", headers.alias("headers")).unionByName(lost)


def crawl(pages: DataFrame) -> DataFrame:
    """pages as a crawl: each page is a full response at its id's time, visited again a million later.

    The second visit is told that nothing changed. It spells the URL another way; every fifth page gives no entity
    tag, every seventh a tag of another version, and every eleventh page's first visit failed. A page without an id
    makes records without id and time, one without a URL records without URL, null html counts as empty; pages that
    repeat make records that repeat.
    """
    tag = F.concat(F.lit('"'), F.substr(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256), F.lit(1), F.lit(16)), F.lit('"'))
    since = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))
    is_ = lambda n: F.col("page_id") % n == n - 1
    some = lambda *kv: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in kv)), lambda e: e["value"].isNotNull()))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("record_type"), F.when(is_(11), 503).otherwise(200).alias("status"),
        some(("ETag", F.when(~is_(5), tag)), ("Last-Modified", since), ("Content-Type", F.lit("text/html")), ("Cache-Control", F.lit("max-age=60"))).alias("headers"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), (F.col("page_id") + 1_000_000).alias("ts"), F.lit("revisit").alias("record_type"), F.lit(304).alias("status"),
        some(("etag", F.when(~is_(5), F.when(is_(7), F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)))), ("last-modified", since), ("cache-control", F.lit("max-age=600")), ("content-length", F.lit("0"))).alias("headers"),
    )
    return first.unionByName(again)


def op10_warc_revisits(pages: DataFrame) -> DataFrame:
    """Every second visit with the response it repeats and the headers as text; pages that repeat count once, those without
    id or URL are 'missing' (see crawl and resolve_revisits), and an empty table gives no rows."""
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return resolve_revisits(crawl(pages)).select("record_id", "canonical_url", "refers_to", "outcome", F.array_join(entries, ";").alias("headers"))


SQL = r"""
WITH p AS (SELECT DISTINCT page_id, url, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id % 1000) AS since,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)(?:https?:)?//', '') AS bare FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), ':(?:80|443)$', ''), '^www[0-9]*\.', '') AS host,
  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
    lambda q: q != '' AND NOT regexp_matches(lower(q), '^(?:utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sid)(?:=|$)'))), '&') AS q FROM p),
u AS (SELECT *, host || path || '/' || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url,
  CASE WHEN page_id % 5 = 4 THEN NULL ELSE tag END AS own_tag FROM c),
w AS (SELECT DISTINCT page_id, regexp_replace(url, '#.*$', '') AS url, canonical_url, since,
  CASE WHEN page_id IS NULL OR page_id % 5 = 4 THEN NULL WHEN page_id % 7 = 6 THEN '"other"' ELSE tag END AS h_tag FROM u),
f AS (SELECT canonical_url, page_id AS ts, arg_max(struct_pack(page_id := page_id, tag := own_tag, since := since), struct_pack(url := url, tag := coalesce(own_tag, ''))) AS b
  FROM u WHERE page_id % 11 != 10 GROUP BY canonical_url, page_id),
r AS (SELECT w.*, f.b.page_id AS ref, f.b.tag AS s_tag, f.b.since AS b_since
  FROM w ASOF LEFT JOIN f ON w.canonical_url = f.canonical_url AND f.ts < w.page_id + 1000000),
o AS (SELECT *, CASE WHEN ref IS NULL THEN 'missing' WHEN h_tag IS NOT NULL AND s_tag IS NOT NULL THEN CASE WHEN h_tag = s_tag THEN 'resolved' ELSE 'mismatch' END
  WHEN since = b_since THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN h_tag IS NULL THEN NULL WHEN page_id % 7 = 6 THEN h_tag ELSE 'W/' || h_tag END AS sent FROM r)
SELECT 2 * page_id + 1 AS record_id, canonical_url, 2 * ref AS refers_to, outcome, CASE WHEN outcome IN ('resolved', 'unchecked')
  THEN 'cache-control=max-age=600;content-type=text/html' || coalesce(';etag=' || coalesce(sent, s_tag), '') || coalesce(';last-modified=' || since, '')
  ELSE 'cache-control=max-age=600;content-length=0' || coalesce(';etag=' || sent, '') || coalesce(';last-modified=' || since, '') END AS headers FROM o
"""
