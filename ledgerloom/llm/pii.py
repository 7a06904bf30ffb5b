"""Personal data by weak supervision, in DataFrame expressions only.

Strict patterns give base spans, wider ones give further candidates. Labelers vote on every candidate (1 yes,
0 no, -1 abstain); expectation-maximisation over the counts of vote patterns estimates how reliable each is; a
naive Bayes classifier of the span's features is trained on the resulting posteriors and decides which further
candidates are spans, too. Base spans always stay.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, named

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns. Where a run of characters decides a match, a look-behind (or the end of the match before)
#: fixes its start and possessive repeats its end, so that no text takes quadratic time; the matches are the same.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further candidates: written-out or spaced addresses, colon-separated addresses, shorter cards, national numbers.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]++(?: ?(?:[(\[{]dot[)\]}]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<!\) )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: Words shortly before a span that speak for its kind, and words that speak for none.
GAZETTEER = {
    "email": r"\b(e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
    "ip": r"\b(ip|host|server|client|login|peer|address)\b",
    "card": r"\b(card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte)\b",
    "phone": r"\b(tel|telephone|phone|call|mobile|cell|fax|telefon|telefono)\b",
}
#: Values that lists know: domains in common use, first numbers of routed addresses, issuers' card numbers, country codes.
LISTED = {
    "email": r"(?i)(\.|dot[)\]}] ?)(com|org|net|edu|gov|info|example|io|ai|dev|eu|uk|de|fr|es|it|nl|pt|pl|ch|at|be|ru|cn|jp|in|br|us|ca|au)$",
    "ip": r"(?i)^(([1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.|(2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]|0*):)",
    "card": r"^(4|5[ -]?[1-5]|2[ -]?[2-7]|3[ -]?[47068]|6[ -]?(0[ -]?1[ -]?1|5|2|4[ -]?[4-9]))",
    "phone": r"^\+ ?\(?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[058][0-9]|9[679][0-9])|^\(?[2-9][0-9]{2}",
}
#: What shortly follows a span and speaks for or against a person's data.
FOLLOWS_FOR, FOLLOWS_AGAINST = r"^[^a-z0-9]{0,3}(or|and|for|to|any|ext|asap|today|please|if|when)?\b", r"^ ?(%|percent|kg|km|cm|mm|mb|gb|px|usd|eur|dollars|euros|pages|items|units)\b"
AGAINST = r"\b(version|release|build|section|chapter|isbn|issn|order|invoice|serial|part|figure|table|page|doi|id)\b[^a-z]*$"
CONTEXT = 32  # code points before a span that labelers see
LABELERS = ("listed", "shape", "gazetteer", "context", "following", "edges")
FEATURES = ("form", "before", "after", "size", "marks", "word")
THRESHOLD = 0.9

SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"


def located(text: Column, pattern: str, kind: str, only_if: Column) -> Column:
    """Spans of the leftmost matches, from the pieces between them."""
    pieces = F.when(only_if, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    found = F.when(F.size(pieces) > 1, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["found"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), found, lambda p, m: F.struct(p.alias("piece"), m.alias("found")))
    return F.when(F.size(pieces) > 1, F.aggregate(pairs, zero, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        trimmed = F.transform(F.split(found, r"\."), lambda p: F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")))
        return ~F.exists(trimmed, lambda p: (F.length(p) > 4) | (F.substring(p, -4, 4).cast("int") > 255))
    if kind == "card":
        return luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _only_valid(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["found"]))


def _voted(text: Column, span: Column, base: Column) -> Column:
    """A candidate with its votes and features."""
    kind, found = span["kind"], span["found"]
    before = ascii_lower(F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), span["start"])))
    previous = F.substring(text, span["start"], F.when(span["start"] > 0, 1).otherwise(0))
    next_ = F.substring(text, span["end"] + 1, F.lit(1))
    n = F.length(_digits(found))
    shape = (
        F.when(kind == "email", found.rlike(r"[A-Za-z]{2,}$"))
        .when(kind == "ip", ~found.rlike(r"(^|\.)0[0-9]"))
        .when(kind == "card", found.rlike(r"^[3-6]") & luhn(_digits(found)))
        .otherwise(n.between(10, 13))
    )
    listed = F.lit(False)
    for k in KINDS:
        listed = listed | ((kind == k) & before.rlike(GAZETTEER[k]))
    known = F.lit(False)
    for k in KINDS:
        known = known | ((kind == k) & found.rlike(LISTED[k]))
    behind = ascii_lower(F.substring(text, span["end"] + 1, F.lit(CONTEXT)))
    following = F.when(behind.rlike(FOLLOWS_AGAINST), 0).when((behind == "") | behind.rlike(FOLLOWS_FOR), 1).otherwise(-1)
    edges = ~previous.rlike(r"[\p{L}\p{N}]") & ~next_.rlike(r"[\p{L}\p{N}]")
    votes = F.array(known.cast("int"), shape.cast("int"), F.when(listed, 1).otherwise(-1), F.when(before.rlike(AGAINST), 0).otherwise(-1), following, edges.cast("int"))

    def sort_of(c: Column) -> Column:
        return F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\p{N}"), "number").when(c.rlike(r"[(\[{<\"']"), "open").otherwise("sign")

    form = F.substring(F.regexp_replace(F.regexp_replace(found, "[0-9]+", "9"), "[A-Za-z]+", "a"), 1, 12)
    marks = F.concat(*(F.instr(found, m).cast("boolean").cast("int").cast("string") for m in (" ", "-", "(", ".")))
    values = F.array(F.concat(F.lit("f"), F.pmod(F.xxhash64(form), F.lit(64)).cast("string")), sort_of(previous), sort_of(next_), F.least(n, F.lit(20)).cast("string"), marks, F.concat(F.lit("w"), F.pmod(F.xxhash64(F.regexp_extract(before, r"([a-z]+)[^a-z]*$", 1)), F.lit(256)).cast("string")))
    return F.struct(kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), base.alias("base"), votes.alias("votes"), values.alias("values"))


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (doc_id, text) -> (columns to keep, doc_id, text_hash, spans): the strict and the wider matches of each text with votes and features."""
    rows = docs.select(*keep, "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    has = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), "phone": F.contains(text, F.lit("+"))}
    wide_has = {"email": ascii_lower(text).rlike(r"[(\[{]at[)\]}]"), "ip": text.rlike(r"[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"), "card": has["card"], "phone": text.rlike(r"[0-9]{3}[.-][0-9]{4}")}
    spans = rows.select(*keep, "doc_id", "text_hash", "text", *(located(text, STRICT[k], k, has[k]).alias(k) for k in KINDS), *(located(text, WIDE[k], k, wide_has[k]).alias(f"wide_{k}") for k in KINDS))
    valid = spans.select(*keep, "doc_id", "text_hash", "text", *(_only_valid(k).alias(k) for k in KINDS), *(f"wide_{k}" for k in KINDS))
    # A wider match counts only beside the base spans of all kinds.
    base = valid.withColumn("base", F.concat(*KINDS))
    more = F.filter(F.concat(*(f"wide_{k}" for k in KINDS)), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    both = base.select(*keep, "doc_id", "text_hash", "text", "base", more.alias("more"))
    voted = F.concat(F.transform("base", lambda s: _voted(text, s, F.lit(True))), F.transform("more", lambda s: _voted(text, s, F.lit(False))))
    return both.select(*keep, "doc_id", "text_hash", F.when(F.size("base") + F.size("more") > 0, voted).alias("spans"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """(kind, votes, count) -> the posterior that such a candidate is personal data, by expectation-maximisation.

    Each labeler has, for each kind, a distribution of its votes on true and on false candidates (smoothed);
    the start is the share of yes among the votes cast. There are 3 ** labelers patterns of a kind at most.
    """
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        cast = [[x for x in v if x >= 0] for v, _ in own]
        p = [(sum(x) + 1) / (len(x) + 2) for x in cast]
        for _ in range(rounds):
            total = sum(n for _, n in own)
            prior = min(0.999, max(0.001, (sum(q * n for q, (_, n) in zip(p, own)) + 1) / (total + 2)))
            table = []
            for i in range(len(own[0][0])):
                sums = {(x, t): 1.0 + (1.0 if (x, t) in ((1, 1), (0, 0)) else 0.0) for x in (-1, 0, 1) for t in (0, 1)}
                for q, (v, n) in zip(p, own):
                    sums[v[i], 1] += q * n
                    sums[v[i], 0] += (1 - q) * n
                table.append({(x, t): s / sum(sums[y, t] for y in (-1, 0, 1)) for (x, t), s in sums.items()})
            odds = [math.log(prior / (1 - prior)) + sum(math.log(table[i][x, 1] / table[i][x, 0]) for i, x in enumerate(v)) for v, _ in own]
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
        out |= {(kind, v): q for q, (v, _) in zip(p, own)}
    return out


def _literal_map(d: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,double>")


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_hash, spans array<struct<kind, start, end, base, score>>), one row for each input row.

    start and end are code points, end exclusive; spans are ordered by kind as in KINDS, then start. base marks
    what the strict patterns find; the others have a classifier score of ``threshold`` at least. A null or
    empty text has no spans. Repeated rows get equal spans; an empty table gives no rows. Only counts of vote
    patterns and of feature values, both of bounded number, come to the driver.
    """
    return _judged(candidates(docs), threshold)


def _judged(found: DataFrame, threshold: float) -> DataFrame:
    """Candidates with the spans that stay, in order."""
    found = materialise(found, "candidates")
    each = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.values")
    counted = each.groupBy("kind", "votes").count().collect()
    truth = reliabilities([(r.kind, tuple(r.votes), r["count"]) for r in counted])
    sums: dict = defaultdict(lambda: [0.5, 0.5])
    if truth:
        posterior = _literal_map({f"{k}:{','.join(map(str, v))}": q for (k, v), q in truth.items()})
        key = F.concat("kind", F.lit(":"), F.array_join(F.col("votes").cast("array<string>"), ","))
        weighed = each.select("kind", F.element_at(posterior, key).alias("p"), F.posexplode("values").alias("feature", "value"))
        for r in weighed.groupBy("kind", "feature", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect():
            sums[r.kind, r.feature, r.value][0] += r.yes
            sums[r.kind, r.feature, r.value][1] += r.no
    totals: dict = defaultdict(lambda: [1.0, 1.0])
    for (k, f, _), (yes, no) in sums.items():
        if f == 0:
            totals[k][0] += yes
            totals[k][1] += no
    prior = {k: math.log(yes / no) for k, (yes, no) in totals.items()}
    odds = {f"{k}:{f}:{v}": math.log((yes / totals[k][0]) / (no / totals[k][1])) for (k, f, v), (yes, no) in sums.items()}

    def scored(s: Column) -> Column:
        log_odds = F.coalesce(F.element_at(_literal_map(prior), s["kind"]), F.lit(0.0))
        for i in range(len(FEATURES)):
            log_odds = log_odds + F.coalesce(F.element_at(_literal_map(odds), F.concat(s["kind"], F.lit(f":{i}:"), s["values"][i])), F.lit(0.0))
        return F.struct(F.array_position(F.lit(list(KINDS)), s["kind"]).cast("int").alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), (1 / (1 + F.exp(-log_odds))).alias("score"))

    kept = F.filter(F.transform("spans", scored), lambda s: s["base"] | (s["score"] >= threshold))
    final = F.transform(F.array_sort(kept), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    return found.withColumn("spans", F.when(F.col("spans").isNotNull(), final).otherwise(none))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all columns, each span of text replaced by [KIND]. Overlapping spans are replaced together.

    A row's spans go with the row itself, so rows of null or repeated ids are redacted like any other, whatever columns
    there are; null texts stay null, and an empty table stays empty. Nothing is shuffled but counts.
    """
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), "doc_id", "text")
    found = _judged(candidates(rows, "row"), threshold)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        tag = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["parts"], tag).alias("parts"))

    done = found.select("row", F.when(F.size("spans") > 0, F.aggregate(ordered, zero, step)).alias("done"))
    clean = F.concat(F.array_join(F.col("done.parts"), ""), F.substring(text, F.col("done.at") + 1, F.length(text)))
    return done.select(*(F.when(F.col("done").isNotNull(), clean).otherwise(text).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
