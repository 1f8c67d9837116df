"""Personal data by weak supervision, in DataFrame functions only.

Every row is read twice and never moved. The first pass collects candidate spans: matches of the strict patterns and
of looser forms (spelled-out at and dot signs, telephone numbers without a plus sign, numbers that fail their check).
Five labelers vote on each candidate; the counts of vote patterns, a table of at most a few hundred rows whatever the
input, go through expectation-maximisation for the labelers' reliabilities. Its posteriors are the soft labels
from which the span classifier (naive Bayes over votes, lengths and hashed neighbouring words, a fixed number of
features) is counted in one aggregate. The second pass finds the candidates again and scores them with the weights
as literals: strict matches that pass their check always stay, others are added where the classifier says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# Possessive where nothing could be given back, so that neither long runs nor many labels cost more than their length.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\((?i:at)\)|\[(?i:at)\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\((?i:dot)\)|\[(?i:dot)\]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.()-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])(?![ .-][0-9])",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": "+"}
LOOSE_NEEDS = {"email": r"(?i)[(\[]at[)\]]", "phone": r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"}

# Gazetteers of top-level domains, card issuers' prefixes and calling codes.
DOMAINS = r"(?i)(?:com|org|net|edu|gov|mil|int|info|io|biz|name|app|dev|ai|co|me|tv|us|uk|ca|au|nz|ie|de|fr|es|it|pt|br|mx|ar|cl|nl|be|ch|at|se|no|dk|fi|pl|cz|ru|ua|tr|gr|in|cn|jp|kr|sg|hk|za|eu|test|example)"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0245])"
CODES = r"^(?:1|7|2[07]|21[1-8]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|3[0-469]|35[0-9]|37[0-9]|38[0-9]|4[013-9]|42[013]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|67[0-9]|68[0-9]|8[1246]|85[0-6]|88[06]|9[0-58]|96[0-8]|97[0-7]|99[2-8])"
CUES = {
    "email": (r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b", r"(?i)\b(?:commit|git|ssh|user)\b"),
    "ip": (r"(?i)\b(?:ip|host|server|address|client|from|login|adresse|direcci[oó]n)\b", r"(?i)\b(?:version|release|section|v)\b"),
    "card": (r"(?i)\b(?:card|visa|credit|payment|mastercard|amex|tarjeta|carte|karte)\b", r"(?i)\b(?:order|tracking|serial|isbn|token|hash|sha)\b"),
    "phone": (r"(?i)\b(?:tel|phone|call|mobile|cell|fax|t[eé]l[eé]fono|telefon)\b", r"(?i)\b(?:order|serial|version|id|ref)\b"),
}
NEAR, BUCKETS, ROUNDS = 32, 64, 12
VOTES = ("regex", "check", "gazetteer", "context", "edge")


def _found(text: Column, pattern: str, needs: Column) -> tuple[Column, Column]:
    none = F.array().cast("array<string>")
    return F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(needs, F.split(text, pattern, -1)).otherwise(none)


def _spans(hits: str, gaps: str) -> str:
    """Offsets of the matches from the lengths of what lies between them; both count code points."""
    total = "aggregate(slice({}, 1, {}), 0, (a, y) -> a + char_length(y))"
    start = f"{total.format(gaps, 'i + 1')} + {total.format(hits, 'i')}"
    return f"transform({hits}, (x, i) -> named_struct('s', {start}, 'x', x))"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substr(back, i, F.lit(1)).cast("int")
        twice = v * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _octets(x: Column) -> Column:
    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(x, r"\."), small)


def _passes(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(x)
    if kind == "card":
        return _luhn(_digits(x))
    return F.length(_digits(x)).between(9, 15)


def _vote(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


def _labelers(kind: str, strict: bool, x: Column, before: Column, after: Column) -> list[Column]:
    digits = _digits(x)
    check = F.regexp_like(x, F.lit(r"[.\])][ ]?[A-Za-z]{2,24}$")) if kind == "email" else F.length(digits) == 10 if kind == "phone" and not strict else _passes(kind, x)
    gazetteer = {
        "email": F.regexp_like(x, F.lit(rf"[.\])] ?{DOMAINS}$")),
        "ip": F.regexp_like(x, F.lit(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.")),
        "card": F.regexp_like(digits, F.lit(ISSUERS)),
        "phone": F.regexp_like(digits, F.lit(CODES if strict else "^[2-9]")),
    }[kind]
    yes, no = CUES[kind]
    context = F.when(F.regexp_like(before, F.lit(yes)), 1).when(F.regexp_like(before, F.lit(no)), -1).otherwise(0)
    edge = F.when(F.regexp_like(before, F.lit("[A-Za-z0-9=/]$")) | F.regexp_like(after, F.lit("^[A-Za-z0-9=/]")), -1).otherwise(1)
    return [F.lit(1 if strict else -1), _vote(check), _vote(gazetteer), context, edge]


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and c: the candidates of each row, by kind and start, with votes and features."""
    t = F.coalesce("text", F.lit(""))
    out = documents.select("doc_id", t.alias("t"))
    needs = {("strict", k): F.contains("t", F.lit(v)) if len(v) == 1 else F.regexp_like("t", F.lit(v)) for k, v in NEEDS.items()}
    needs |= {("loose", k): F.regexp_like("t", F.lit(v)) for k, v in LOOSE_NEEDS.items()}
    # telling the rows that need a pattern first keeps the costly ones to those rows
    out = out.select("*", *(v.alias(f"n_{a}_{k}") for (a, k), v in needs.items()))
    patterns = {("strict", k): v for k, v in STRICT.items()} | {("loose", k): v for k, v in LOOSE.items()}
    for (a, k), p in patterns.items():
        hits, gaps = _found(F.col("t"), p, F.col(f"n_{a}_{k}"))
        out = out.withColumns({f"h_{a}_{k}": hits, f"g_{a}_{k}": gaps})
    out = out.select("doc_id", "t", *(F.expr(_spans(f"h_{a}_{k}", f"g_{a}_{k}")).alias(f"s_{a}_{k}") for a, k in patterns))

    def one(a: str, k: str) -> Column:
        strict = a == "strict"

        def build(m: Column) -> Column:
            x, s = m["x"], m["s"]
            e = s + F.length(x)
            before = F.substr("t", F.greatest(s - NEAR, F.lit(0)) + 1, F.least(s, F.lit(NEAR)))
            after = F.substr("t", e + 1, F.lit(8))
            votes = _labelers(k, strict, x, before, after)
            word = F.regexp_extract(F.lower(before), r"(\S+)\s*\S*$", 1)
            return F.struct(
                F.lit(KINDS.index(k)).alias("kind"), s.cast("long").alias("s"), e.cast("long").alias("e"),
                (F.lit(strict) & _passes(k, x)).alias("base"), *(v.cast("int").alias(f"v_{n}") for n, v in zip(VOTES, votes)),
                F.least(F.length(x), F.lit(40)).alias("f_length"), F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int").alias("f_word"),
            )

        return F.transform(f"s_{a}_{k}", build)

    out = out.select("doc_id", F.concat(*(one(a, k) for a, k in patterns)).alias("c"))
    apart = lambda x, y: (x["kind"] != y["kind"]) | (x["e"] <= y["s"]) | (x["s"] >= y["e"])
    # a loose candidate that overlaps a strict match of its kind says nothing new
    strict = F.filter("c", lambda y: y["v_regex"] == 1)
    return out.select("doc_id", F.array_sort(F.filter("c", lambda x: (x["v_regex"] == 1) | F.forall(strict, lambda y: apart(x, y)))).alias("c"))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """The vote patterns (kind, votes, n) with the posterior p that their candidates are personal data.

    Expectation-maximisation with labelers independent given the truth; each step is one aggregate of the bounded
    pattern table. Counts are smoothed by one. The start is the share of votes in favour.
    """
    votes = [f"v_{n}" for n in VOTES]
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.05), 0.5 + 0.15 * sum((F.col(v) for v in votes), F.lit(0))))
    for _ in range(ROUNDS):
        at = patterns.withColumn("p", p)
        sums = [F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")]
        sums += [F.sum(F.when((F.col("kind") == k), F.col("n") * F.col("p")).otherwise(0.0)).alias(f"k{k}") for k in range(len(KINDS))]
        sums += [F.sum(F.when((F.col("kind") == k), F.col("n")).otherwise(0)).alias(f"t{k}") for k in range(len(KINDS))]
        for i, v in enumerate(votes):
            for x in (-1, 0, 1):
                sums += [F.sum(F.when(F.col(v) == x, F.col("n") * F.col("p")).otherwise(0.0)).alias(f"y{i}_{x + 1}"), F.sum(F.when(F.col(v) == x, F.col("n") * (1 - F.col("p"))).otherwise(0.0)).alias(f"n{i}_{x + 1}")]
        got = at.agg(*sums).first()
        odds = F.element_at(F.array(*(F.lit(math.log((got[f"k{k}"] + 1) / (got[f"t{k}"] - got[f"k{k}"] + 1))) for k in range(len(KINDS)))), F.col("kind") + 1)
        for i, v in enumerate(votes):
            weight = [math.log((got[f"y{i}_{x}"] + 1) / (got["yes"] + 3)) - math.log((got[f"n{i}_{x}"] + 1) / (got["no"] + 3)) for x in range(3)]
            odds = odds + F.element_at(F.array(*map(F.lit, weight)), F.col(v) + 2)
        p = 1 / (1 + F.exp(-odds))
    return patterns.withColumn("p", p)


def _features(x: Column) -> list[Column]:
    kind = x["kind"].cast("string")
    names = [f"v_{n}" for n in VOTES] + ["f_length", "f_word"]
    return [F.concat_ws(":", kind, F.lit(n), x[n].cast("string")) for n in names]


def train(found: DataFrame) -> dict[str, float]:
    """The span classifier's weights by feature, and the kinds' prior odds; at most a few hundred entries."""
    spans = found.select(F.explode("c").alias("x")).select("x.*")
    votes = [f"v_{n}" for n in VOTES]
    counts = cut(spans.groupBy("kind", *votes, "f_length", "f_word").agg(F.count(F.lit(1)).alias("n")))
    patterns = cut(counts.groupBy("kind", *votes).agg(F.sum("n").alias("n")))
    if patterns.isEmpty():
        return {}
    soft = F.broadcast(reliabilities(patterns).drop("n"))  # as many rows as there are vote patterns
    labelled = counts.join(soft, ["kind", *votes])
    x = F.struct("kind", *votes, "f_length", "f_word")
    rows = labelled.select(F.explode(F.array(*_features(x), F.concat_ws(":", F.col("kind").cast("string"), F.lit("all")))).alias("f"), "n", "p")
    sums = rows.groupBy("f").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
    total = {r["f"]: (r["yes"], r["no"]) for r in sums if r["f"].endswith(":all")}
    values = {"v": 3, "f_length": 40, "f_word": BUCKETS}
    weights = {}
    for r in sums:
        kind, name, *_ = r["f"].split(":")
        yes, no = total[f"{kind}:all"]
        if name == "all":
            weights[r["f"]] = math.log((yes + 1) / (no + 1))
        else:
            m = values.get(name, 3)
            # lengths and words count half: many values, each seen seldom
            weights[r["f"]] = (0.5 if name[0] == "f" else 1) * (math.log((r["yes"] + 1) / (yes + m)) - math.log((r["no"] + 1) / (no + m)))
    return weights


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, found: an array of (kind, s, e, base) by kind and start, one row for each row of documents.

    Offsets count code points, the end is exclusive. A null text has no span; ids may repeat or be null; other
    columns are ignored; an empty table gives no rows. Without candidates nothing is trained or added.
    """
    found = candidates(documents)
    weights = train(found)
    if weights:
        table = F.create_map(*(F.lit(v) for kv in sorted(weights.items()) for v in kv))
        score = lambda x: sum((F.coalesce(F.try_element_at(table, f), F.lit(0.0)) for f in [*_features(x), F.concat_ws(":", x["kind"].cast("string"), F.lit("all"))]), F.lit(0.0))
        keep = F.filter("c", lambda x: x["base"] | ((x["v_check"] == 1) & (score(x) > 0)))
    else:
        keep = F.filter("c", lambda x: x["base"])
    return found.select("doc_id", F.transform(keep, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))).alias("found"))


def op1_pii(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans of every row of documents."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["base"])
    of = lambda i: F.filter("found", lambda x: x["base"] & (x["kind"] == i))
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find_pii(documents).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: ~x["base"])).cast("long").alias("n_added"))
