"""Derived attributes and hubs, reference feeds, money totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ip_scope, iso_hour, parse_amount, registrable_domain, url_host
from .components import cut, numbered
from .graph import STRINGS, dedup_key, ends, entity_id

#: Rows of a feed that may be broadcast.
FEED_ROWS = 200_000
#: Hashes that are compared at once with so many of a feed, and tasks that such blocks are dealt to at most.
OWN_ROWS, BLOCK_ROWS, TASKS = 4_096, 16_384, 10_000


def derived_attributes(entities: DataFrame) -> DataFrame:
    """attributes with host, registrable_domain, ip_scope and activity_hour where they're missing, and the tag enriched
    on entities that gained any."""
    a, label = F.col("attributes"), F.col("label")
    host = F.when(F.col("kind") == "url", url_host(label))
    stamp = F.coalesce(*(F.try_element_at(a, F.lit(k)) for k in ("timestamp", "created_at", "received_at", "observed_at")))
    own = F.when(F.col("kind") == "domain", registrable_domain(label)).when(F.col("kind") == "url", registrable_domain(host))
    values = {"host": host, "registrable_domain": F.nullif(own, F.lit("")), "ip_scope": F.when(F.col("kind") == "ip", ip_scope(label)), "activity_hour": iso_hour(stamp)}
    new = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))
    keys = F.map_keys(a)
    gained = F.map_from_entries(F.filter(new, lambda e: e["value"].isNotNull() & ~F.array_contains(keys, e["key"])))
    out = entities.withColumn("__g", gained)
    tags = F.when(F.size("__g") > 0, F.array_union("tags", F.array(F.lit("enriched")))).otherwise(F.col("tags"))
    return out.withColumns({"attributes": F.map_concat("attributes", "__g"), "tags": tags}).drop("__g")


def domain_hubs(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Domains that URLs and sub-domains belong to: new entity rows (kind, label, dedup_key, id, sources, tags) and
    belongs_to_domain edges."""
    host = F.when(F.col("kind") == "url", url_host(F.col("label"))).when(F.col("kind") == "domain", F.lower("label"))
    rows = entities.where("kind IN ('url', 'domain')").select("id", "ord", "label", "kind", registrable_domain(host).alias("parent")).where("parent != '' AND NOT (kind = 'domain' AND lower(label) = parent)")
    key = dedup_key(F.lit("domain"), F.col("parent"))
    edges = rows.select(F.col("id").alias("source_id"), F.lit("belongs_to_domain").alias("rel_type"), entity_id(key).alias("target_id"), F.lit(0.9).alias("confidence"), F.lit("derived:enrich").alias("source_reference"), "ord")
    new = rows.select(F.lit("domain").alias("kind"), F.col("parent").alias("label"), key.alias("dedup_key")).distinct().join(entities.select("dedup_key"), "dedup_key", "left_anti")
    return new.select("kind", "label", "dedup_key", entity_id(F.col("dedup_key")).alias("id"), F.array(F.lit("derived:enrich")).alias("sources"), F.array(F.lit("enriched")).cast(STRINGS).alias("tags")), edges


def load_refs(groups: DataFrame) -> DataFrame:
    """(value, kind, source, category, severity, ord) of feed groups (source, category, severity, kind, values, ord): values
    trimmed in lower case, kind hash and severity high by default; of exact repeats the last stays."""
    rows = groups.select(F.explode("values").alias("value"), F.coalesce("kind", F.lit("hash")).alias("kind"), "source", "category", F.coalesce("severity", F.lit("high")).alias("severity"), "ord")
    rows = rows.withColumn("value", F.lower(F.trim("value"))).where("value != ''")
    return rows.groupBy("value", "kind").agg(F.max_by(F.struct("source", "category", "severity"), "ord").alias("r"), F.max("ord").alias("ord")).select("value", "kind", "r.*", "ord")


def _feed(refs: DataFrame) -> DataFrame:
    return F.broadcast(refs) if refs.limit(FEED_ROWS + 1).count() <= FEED_ROWS else refs


def match_exact(items: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, source, category, severity) of items (id, hash) whose hash a feed holds."""
    known = _feed(refs.where("kind = 'hash'").select(F.col("value").alias("h"), "source", "category", "severity"))
    return items.select("id", F.lower(F.trim("hash")).alias("h")).join(known, "h").select("id", "source", "category", "severity")


def match_perceptual(items: DataFrame, refs: DataFrame, most: int = 10, own_rows: int = OWN_ROWS, feed_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, source, category, severity, distance, similarity): the nearest feed value of each item (id, hash) within `most`
    bits, of equals the first.

    Pieces of so few bits as two hashes within `most` agree on hold for nearly all pairs, so distinct hashes of one length are
    compared with the feed in blocks, each two blocks in a task of their own.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^0x", "").alias("h")
    hexa = lambda df: df.where(F.regexp_like("h", F.lit("^([0-9a-f]{2})+$"))).withColumn("n", F.length("h") * 4)
    rows = cut(hexa(items.select("id", clean("hash"))))
    feed = cut(hexa(refs.where("kind = 'perceptual'").select(clean("value"), "source", "category", "severity", "ord")).distinct())
    known = cut(numbered(feed, ["ord", "h", "source", "category", "severity"], "pos"))
    texts = cut(rows.select("n", "h").distinct())
    parts = max(1, -(-texts.count() // own_rows))
    own = cut(texts.groupBy("n", F.pmod(F.xxhash64("h"), F.lit(parts)).alias("part")).agg(F.collect_list(F.unhex("h")).alias("own")))
    first = known.groupBy("n", "h").agg(F.min("pos").alias("pos"))
    blocks = first.groupBy("n", F.floor(F.col("pos") / feed_rows).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", F.unhex("h").alias("bits")))).alias("f"))
    blocks = cut(blocks.select("n", "block", F.col("f.pos").alias("pos"), F.col("f.bits").alias("feed")))
    met = cut(own.select("n", "part").join(blocks.select("n", "block"), "n"))
    both = met.join(own, ["n", "part"]).join(blocks, ["n", "block"]).select("part", "block", "own", "pos", "feed")
    near = both.repartition(max(1, min(met.count(), TASKS)), "part", "block").select("own", "pos", "feed").mapInArrow(_nearest(most), "h binary, distance int, pos long")
    best = near.groupBy("h").agg(F.min(F.struct("distance", "pos")).alias("m")).select(F.lower(F.hex("h")).alias("h"), "m")
    found = rows.join(best, "h").groupBy("id").agg(F.min(F.struct("m", "n")).alias("b")).select("id", "b.m.distance", "b.m.pos", "b.n")
    return found.join(known.drop("n"), "pos").select("id", "source", "category", "severity", "distance", (1 - F.col("distance") / F.col("n")).alias("similarity"))


def _words(column: pa.Array) -> np.ndarray:
    """Equally long binaries as rows of 64-bit words."""
    raw = [x.as_buffer() for x in column]
    bits = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def _nearest(most: int, cells: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of each block of the feed, of equals the first, for those that have one within `most` bits."""
        for batch in batches:
            for i in range(batch.num_rows):
                mine, pos, feed = (batch.column(c)[i].values for c in range(3))
                x, y, pos = _words(mine), _words(feed), pos.to_numpy()
                step = max(1, cells // len(y))
                for lo in range(0, len(x), step):
                    part = x[lo : lo + step]
                    far = np.bitwise_count(part[:, :1] ^ y[:, 0])
                    if x.shape[1] > 1:
                        far = far.astype(np.int32)
                        for w in range(1, x.shape[1]):
                            far += np.bitwise_count(part[:, w : w + 1] ^ y[:, w])
                    at = far.argmin(axis=1)
                    least = far[np.arange(len(part)), at].astype(np.int32)
                    hit = np.flatnonzero(least <= most)
                    yield pa.RecordBatch.from_arrays([mine.slice(lo, len(part)).take(pa.array(hit)), pa.array(least[hit]), pa.array(pos[at[hit]])], ["h", "distance", "pos"])

    return run


def nearest_perceptual(items: DataFrame, refs: DataFrame, at_once: int = 100_000) -> DataFrame:
    """(id, distance): the fewest bits in which each item (id, hash) differs from a perceptual feed value of its length, however
    many; what calibration reads. A feed is compared in blocks of at_once values, one aggregate a block."""
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^0x", "")
    hexa = lambda df: df.where(F.regexp_like("h", F.lit("^([0-9a-f]{2})+$")))
    known = hexa(refs.where("kind = 'perceptual'").select(clean("value").alias("h"))).distinct()
    blocks = max(1, -(-known.count() // at_once))
    rows, out = hexa(items.select("id", clean("hash").alias("h"))), None
    for i in range(blocks):
        feed = [r["h"] for r in known.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == i).collect()]
        part = rows.mapInPandas(_closest(feed), "id string, distance long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.min("distance").alias("distance"))


def _closest(feed: list[str]):
    bits = lambda hexes: np.frombuffer(bytes.fromhex("".join(hexes)), np.uint8).reshape(len(hexes), -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length: dict[int, list[str]] = {}
        for x in feed:
            by_length.setdefault(len(x), []).append(x)
        known = {n: bits(v) for n, v in by_length.items()}
        for pdf in batches:
            for n, own in pdf.groupby(pdf["h"].str.len()):
                if n in known:
                    least = [int(np.bitwise_count(known[n] ^ row).sum(axis=1).min()) for row in bits(own["h"].tolist())]
                    yield pd.DataFrame({"id": own["id"].astype(str).to_numpy(), "distance": least})

    return run


def match_refs(entities: DataFrame, refs: DataFrame, most: int = 10) -> DataFrame:
    """(id, source, category, severity, match, similarity): an exact match wins over a perceptual one."""
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    exact = match_exact(entities.select("id", at("file_hash").alias("hash")).where("hash IS NOT NULL"), refs)
    rest = entities.select("id", at("perceptual_hash").alias("hash")).where("hash IS NOT NULL").join(exact.select("id"), "id", "left_anti")
    near = match_perceptual(rest, refs, most)
    return exact.select("*", F.lit("exact").alias("match"), F.lit(1.0).alias("similarity")).unionByName(near.select("id", "source", "category", "severity", F.lit("perceptual").alias("match"), "similarity"))


def mark_refs(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """entities with ref_* attributes, tags for the match and its severity, and the feed as a source."""
    m = matches.select(F.col("id").alias("m_id"), "source", "category", "severity", "match", "similarity")
    j = entities.join(m, F.col("id") == F.col("m_id"), "left")
    hit = F.col("m_id").isNotNull()
    similar = F.when(F.col("match") == "perceptual", F.round("similarity", 2).cast("string"))
    new = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in {"ref_source": F.col("source"), "ref_category": F.col("category"), "ref_severity": F.col("severity"), "ref_match": F.col("match"), "ref_similarity": similar}.items())), lambda e: e["value"].isNotNull())
    fresh = F.map_from_entries(new)
    attributes = F.when(hit, F.map_concat(F.map_filter("attributes", lambda k, _: ~F.startswith(k, F.lit("ref_"))), fresh)).otherwise(F.col("attributes"))
    tag = F.when(F.col("match") == "perceptual", "perceptual-match").otherwise("known-file-hash")
    tags = F.when(hit, F.array_union("tags", F.array(tag, F.col("severity")))).otherwise(F.col("tags"))
    sources = F.when(hit, F.array_union("sources", F.array(F.concat(F.lit("ref:"), "source")))).otherwise(F.col("sources"))
    return j.withColumns({"attributes": attributes, "tags": tags, "sources": sources}).select(*entities.columns)


def money_rollup(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, total_value): amounts of payments summed over the edges of wallets and accounts; parallel edges count each."""
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    amount = parse_amount(F.coalesce(at("amount"), at("value"), at("transaction_amount")))
    paid = entities.where("kind = 'payment'").select(F.col("id").alias("node"), amount.alias("amount")).where("amount IS NOT NULL")
    sums = ends(edges).join(paid, "node").groupBy(F.col("other").alias("id")).agg(F.sum("amount").alias("total_value"))
    return sums.join(entities.where("kind IN ('wallet', 'account')").select("id"), "id", "left_semi")
