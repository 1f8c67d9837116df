"""Text predicates, keys, fingerprints and similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fingerprint's start and multiplier (2**40 + 435), and letters without their accents.
BASIS, MULTIPLIER = 1469598103934665603, 435
ACCENTED = "áàâãäÁÀÂÃÄéèêëÉÈÊËíìîïÍÌÎÏóòôõöÓÒÔÕÖúùûüÚÙÛÜçÇñÑ"
PLAIN = "aaaaaaaaaaeeeeeeeeiiiiiiiioooooooooouuuuuuuuccnn"


def rlike(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def count_of(c: Column, pattern: str) -> Column:
    """Characters of c that match a one-character pattern's class."""
    return F.length(F.regexp_replace(c, f"[^{pattern}]", ""))


def normalize_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


# -- indicators --------------------------------------------------------------------------------------------


def is_url(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://") | c.startswith("www.")


def is_email(c: Column) -> Column:
    return rlike(c, r"^[^@]+@[^@]*\.[^@]*$")


def is_ipv4(c: Column) -> Column:
    octet = lambda p: F.coalesce(p.try_cast("long"), F.lit(999)) <= 255
    return rlike(c, r"^[0-9]+(\.[0-9]+){3}$") & F.forall(F.split(c, r"\."), octet)


def is_hash(c: Column) -> Column:
    return rlike(c, "^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")


def is_wallet(c: Column) -> Column:
    return rlike(c, "^0x[0-9a-fA-F]{40}$")


def is_domain(c: Column) -> Column:
    return rlike(c, r"^([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")


#: What every indicator has somewhere: most tokens are left out by this one test.
_LIKELY = r"@|\.[0-9A-Za-z]|[0-9a-fA-F]{32}|://|www\."


def tokens(c: Column) -> Column:
    """Tokens between white space and , ; | that may be indicators, without outer punctuation."""
    bare = F.transform(F.filter(F.split(c, r"[\s,;|]+"), lambda t: rlike(t, _LIKELY)), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}.:/@_-]+|[^\p{L}\p{N}.:/@_-]+$", ""))
    return F.filter(bare, lambda t: t != "")


def indicator_kind(t: Column) -> Column:
    """The entity kind that a token looks like, else null."""
    return F.when(is_url(t), "url").when(is_email(t), "account").when(is_ipv4(t), "ip").when(is_hash(t), "media").when(is_wallet(t), "wallet").when(is_domain(t), "domain")


def indicators(c: Column) -> Column:
    found = F.transform(tokens(c), lambda t: F.struct(indicator_kind(t).alias("kind"), t.alias("raw")))
    return F.filter(found, lambda x: x["kind"].isNotNull())


def hash_type(c: Column) -> Column:
    return F.when(is_hash(c), F.when(F.length(c) == 32, "md5").when(F.length(c) == 40, "sha1").otherwise("sha256"))


# -- fingerprints ------------------------------------------------------------------------------------------


def _bytes(c: Column) -> Column:
    h = F.hex(F.encode(c, "UTF-8"))
    at = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("long"))


def fingerprint48(c: Column) -> Column:
    """The low 48 bits of the multiply-and-xor hash, as a number; 2**48 arithmetic never overflows a long."""
    mask = (1 << 48) - 1

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        return (F.shiftleft(x.bitwiseAND(F.lit(255)), 40) + x * MULTIPLIER).bitwiseAND(F.lit(mask))

    return F.aggregate(_bytes(c), F.lit(BASIS & mask).cast("long"), step)


def short_ref(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint48(c))), 12, "0")


def short_token(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint48(F.lower(F.trim(c))).bitwiseAND(F.lit(0xFFFFFF)))), 6, "0")


def chain_hash(previous: Column, content: Column) -> Column:
    """All 64 bits of the same hash over both texts, in two limbs of 32 bits."""
    mask = 0xFFFFFFFF

    def step(h: Column, b: Column) -> Column:
        low = h["lo"].bitwiseXOR(b)
        product = low * MULTIPLIER
        high = (h["hi"] * MULTIPLIER + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(mask))
        return F.struct(high.alias("hi"), product.bitwiseAND(F.lit(mask)).alias("lo"))

    start = F.struct(F.lit(BASIS >> 32).cast("long").alias("hi"), F.lit(BASIS & mask).cast("long").alias("lo"))
    out = F.aggregate(_bytes(F.concat(previous, content)), start, step)
    return F.concat(F.lpad(F.lower(F.hex(out["hi"])), 8, "0"), F.lpad(F.lower(F.hex(out["lo"])), 8, "0"))


#: Kinds whose labels are replaced by a fingerprint.
SENSITIVE = ("victim", "media", "evidence", "communication")


def safe_label(kind: Column, raw: Column) -> Column:
    bare = F.trim(raw)
    cut = F.when(F.length(bare) > 80, F.concat(F.substr(bare, F.lit(1), F.lit(79)), F.lit("…"))).otherwise(bare)
    return F.when(kind.isin(*SENSITIVE), F.concat(kind, F.lit(":"), short_ref(raw))).otherwise(cut)


# -- similarity --------------------------------------------------------------------------------------------


def plain(c: Column) -> Column:
    """Without accents, lower case, letters, digits and single spaces only."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), r"[^a-z0-9\s]", ""), r"\s+", " ")
    return F.trim(kept)


def jaccard(a: Column, b: Column) -> Column:
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda t: t != "")
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def edit_sim(a: Column, b: Column) -> Column:
    n, m = F.length(a), F.length(b)
    longest = F.greatest(n, m)
    none = (n == 0) | (m == 0) | (F.abs(n - m) > F.floor(longest / 2))
    return F.when(none, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def str_sim(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def email_local(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.lower(F.trim(F.substring_index(c, "@", 1))))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def is_numeric_id_like(c: Column) -> Column:
    """More than half of the characters that aren't white space are digits."""
    whole = F.length(F.regexp_replace(c, r"\s", ""))
    return (whole > 0) & (F.length(digits_only(c)) * 2 > whole)


# -- masking -----------------------------------------------------------------------------------------------


def looks_like_name(c: Column) -> Column:
    return rlike(c, r"^\s*\p{Lu}\S+(\s+\p{Lu}\S+){1,3}\s*$") & ~rlike(c, "[@0-9]")


def _mask_token(t: Column) -> Column:
    bare = F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    digits = F.length(digits_only(t))
    email = rlike(bare, r"^[^@]*@[^@]*\.[^@]*$")
    phone = rlike(t, r"^[0-9+() -]+$") & digits.between(10, 15)
    ident = rlike(t, "^[0-9.-]+$") & digits.isin(9, 11) & rlike(t, "[.-]")
    return F.when(email, F.concat(F.lit("[email:"), short_token(t), F.lit("]"))).when(phone, "[phone]").when(ident, "[id]").otherwise(t)


def redact_patterns(c: Column) -> Column:
    """Tokens that look personal masked, white space kept."""
    parts = F.regexp_extract_all(c, F.lit(r"\s|\S+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(rlike(t, "[@0-9]"), _mask_token(t)).otherwise(t)), "")


def mask_value(c: Column) -> Column:
    out = redact_patterns(c)
    return F.when(looks_like_name(out), F.concat(F.lit("PERSON-"), short_token(c))).otherwise(out)


# -- network names, time, money ------------------------------------------------------------------------------


def url_host(c: Column) -> Column:
    host = F.trim(F.regexp_extract(F.lower(F.trim(c)), r"^(?:https?://|www\.)*([^/:?#]*)", 1))
    return F.when(F.contains(host, F.lit(".")), host)


def registrable_domain(host: Column) -> Column:
    labels = F.filter(F.split(F.lower(F.trim(host)), r"\."), lambda x: x != "")
    return F.when(F.size(labels) < 2, "").otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def ip_scope(c: Column) -> Column:
    o = F.filter(F.transform(F.split(c, r"\."), lambda p: p.try_cast("int")), lambda x: x.isNotNull())
    a, b = F.get(o, 0), F.get(o, 1)
    private = (a == 10) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31))
    return F.when(F.size(o) != 4, "unknown").when(a == 127, "loopback").when(private, "private").when((a == 169) & (b == 254), "link-local").otherwise("public")


def iso_hour(c: Column) -> Column:
    h = F.regexp_extract(F.trim(c), "^[^T ]*[T ]([0-9]{2})", 1)
    return F.when((h != "") & (h < "24"), h)


def time_bucket(c: Column, window_min: int = 60) -> Column:
    """Coarse minutes since 2000 over the window, from the text's runs of digits; null without a plausible date."""
    n = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    y, later = F.get(n, 0), lambda i: F.coalesce(F.get(n, i), F.lit(0))
    minutes = (((y - 2000) * 365 + F.get(n, 1) * 31 + F.get(n, 2)) * 24 + later(3)) * 60 + later(4)
    # dates before 2000 are negative; the quotient is cut towards zero
    return F.when((F.size(n) >= 3) & y.between(1900, 2100), F.when(minutes < 0, -F.floor(-minutes / max(window_min, 1))).otherwise(F.floor(minutes / max(window_min, 1))).cast("long"))


def parse_amount(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9.-]", "").try_cast("double")


def hex_distance(a: Column, b: Column) -> Column:
    """Bits that differ between hex texts of one length; null for other texts. Taken 8 digits at a time."""
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^0x", "")
    x, y = bare(a), bare(b)
    ok = (F.length(x) == F.length(y)) & (F.length(x) > 0) & (F.length(x) % 2 == 0) & rlike(x, "^[0-9a-f]+$") & rlike(y, "^[0-9a-f]+$")
    part = lambda s, i: F.conv(F.substr(s, i, F.lit(8)), 16, 10).cast("long")
    bits = F.aggregate(F.sequence(F.lit(1), F.length(x), F.lit(8)), F.lit(0), lambda n, i: n + F.bit_count(part(x, i).bitwiseXOR(part(y, i))))
    return F.when(ok, bits)


# -- geography and vectors -------------------------------------------------------------------------------------

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = lambda x: F.pow(F.sin(x / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), half(b - a) + F.cos(a) * F.cos(b) * half(F.radians(lon2) - F.radians(lon1)))))


def geo_of(attributes: Column) -> Column:
    """(lat, lon) from an attribute map, else null: named keys first, else a packed "lat,lon" value."""
    entries = F.transform(F.map_entries(attributes), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[^a-z]", "").alias("k"), e["value"].alias("v")))
    first = lambda v: F.trim(F.get(F.split(v, ","), 0)).try_cast("double")
    named = lambda *names: F.get(F.transform(F.filter(entries, lambda e: e["k"].isin(*names) & first(e["v"]).isNotNull()), lambda e: first(e["v"])), 0)
    lat, lon = named("lat", "latitude", "latitudeapprox", "gpslatitude"), named("lon", "lng", "longitude", "longitudeapprox", "gpslongitude")
    pair = lambda v: F.transform(F.split(v, ","), lambda p: F.trim(p).try_cast("double"))
    in_range = lambda p: (F.size(p) == 2) & (F.abs(F.get(p, 0)) <= 90) & (F.abs(F.get(p, 1)) <= 180)
    packed = F.get(F.filter(F.transform(entries, lambda e: pair(e["v"])), in_range), 0)
    x = F.coalesce(lat, F.get(packed, 0))
    y = F.when(lat.isNotNull(), lon).otherwise(F.coalesce(F.get(packed, 1), lon))
    return F.when((F.abs(x) <= 90) & (F.abs(y) <= 180), F.struct(x.alias("lat"), y.alias("lon")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length or without direction."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0)))
