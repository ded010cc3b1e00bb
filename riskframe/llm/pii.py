"""PII by weak supervision, in DataFrame and SQL expressions only.

Base patterns give certain spans.  Wider patterns propose candidates, on which labelers
vote: a strict regular expression, a gazetteer of domains and dialling codes, and the
words and marks around the span.  Expectation-maximisation over the table of vote
patterns estimates how reliable each labeler is, and the posteriors train a naive Bayes
span classifier on the spans' own features, which accepts the candidates that are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, texts

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Repeats are possessive where giving back cannot help,
# so that Java matches them without recursion; a run of name characters is tried at its
# start, or where the last match ended, because a later start in the run ends the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

# Wider patterns of the candidates: spelt-out addresses, numbers with group marks and without a plus.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[(\[{]at[)\]}] ?[a-z0-9-]{1,63}+(?: ?(?:\.|[(\[{]dot[)\]}]| dot ) ?[a-z0-9-]{2,63}+){1,4}"
             r"| at [a-z0-9-]{1,63}+(?: dot [a-z0-9-]{2,63}+){1,4})",
    "ip": r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}+:){7}[0-9a-f]{1,4}+(?![0-9a-f:.])",
    "card": r"(?<![0-9.-])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-]|\.[0-9])",
}
WIDE_SIGN = {"email": r"(?i)[(\[{]at[)\]}]| at [a-z0-9-]+ dot ", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]"}
# Labelers: strict form, gazetteer, and the 40 characters before the span (plus what touches it).
STRICT = {
    "email": r"(?i)^[a-z0-9][a-z0-9._%+-]*+ ?[(\[{].*(?:[)\]}]|\.) ?[a-z]{2,24}$",
    "ip": r"^[0-9A-Fa-f:]+$", "card": r"^[3-6][0-9]{3}", "phone": r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}$",
}
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|de|fr|es|uk|io)$", "ip": r"(?i)^(?:20|2a|fe8|fd)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\(?(?:201|202|212|213|305|310|312|404|415|503|510|512|555|602|617|646|702|713|718|800|818|877|888|917|949)",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|reach)\W*(?:\w+\W+){0,3}$", "ip": r"(?i)(?:ip|ipv6|host|server|address)\W*(?:\w+\W+){0,3}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|account|iban|pan)\W*(?:\w+\W+){0,3}$", "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|contact)\W*(?:\w+\W+){0,3}$",
}
LABELERS = ("strict", "gazetteer", "context")
ROUNDS = 25
#: Posterior odds a candidate needs, and how far before a span its context reaches.
ACCEPT, BEFORE = 0.5, 40

#: Fixed value: parts of an address that are 255 at most.
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the Luhn sum of a string of digits is a multiple of ten."""
    def add(total, i):
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - F.lit(48)
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return span.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "phone":
        return F.length(_digits(span)).between(8, 15)
    if kind == "card":
        return F.when(F.length(_digits(span)).between(16, 19), luhn(_digits(span))).otherwise(False)
    return F.lit(True)


_SPAN = "array<struct<start:bigint,end:bigint,span:string>>"


def spans(text: Column, pattern: str, sign: Column, valid=lambda span: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (code points, end exclusive) and span.

    Matches and the text between them alternate, so their lengths add up to places in one
    walk, which keeps the valid ones.  ``sign`` is false where no match can be; the
    pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(_SPAN)

    def step(acc, i):
        span = F.get(found_, i)
        at = acc["at"] + F.length(F.get(gaps_, i)).cast("bigint")
        end = at + F.length(span).cast("bigint")
        one = F.struct(at.alias("start"), end.alias("end"), span.alias("span"))
        return F.struct(end.alias("at"), F.when(valid(span), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    # The two arrays are bound once, as the single element that the outer transform visits.
    def walk(pair):
        nonlocal found_, gaps_
        found_, gaps_ = pair["found"], pair["gaps"]
        return F.aggregate(F.sequence(F.lit(0), F.size(found_) - 1), F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")),
                           step, lambda acc: acc["out"])
    found_ = gaps_ = None
    bound = F.transform(F.filter(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), lambda p: F.size(p["found"]) > 0), walk)
    return F.when(sign, F.coalesce(F.get(bound, F.lit(0)), none)).otherwise(none)


def _overlaps(x: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (x["start"] < o["end"]) & (o["start"] < x["end"]))


def _share(part: Column, whole: Column) -> Column:
    return F.floor(4 * part / F.greatest(whole, F.lit(1))).cast("string")


def _described(text: Column, found: Column, kind: str, base: bool) -> Column:
    """Each span with the labelers' votes and the classifier's features."""
    def one(x):
        span = x["span"]
        before = F.substring(text, F.greatest(x["start"] - F.lit(BEFORE - 1), F.lit(1)).cast("int"), F.least(F.lit(BEFORE), x["start"]).cast("int"))
        after = F.substring(text, (x["end"] + 1).cast("int"), F.lit(1))
        strict = F.lit(None).cast("boolean") if base else span.rlike(STRICT[kind])      # a base span says nothing about the wider form
        n = F.length(span)
        features = [F.least(F.floor(F.log2(n + F.lit(1))), F.lit(8)).cast("string"), _share(F.length(_digits(span)), n),
                    _share(F.length(F.regexp_replace(span, "[A-Za-z0-9]", "")), n),
                    F.when(before.rlike(r"[A-Za-z0-9]$"), "w").when(before.rlike(r"\s$") | (before == ""), "s").otherwise("m"),
                    F.when(after.rlike(r"^[A-Za-z0-9]"), "w").when(after.rlike(r"^\s") | (after == ""), "s").otherwise("m"),
                    F.least(F.size(F.split(span, r"[^A-Za-z0-9]+")), F.lit(9)).cast("string")]
        votes = [strict, span.rlike(GAZETTEER[kind]), before.rlike(CONTEXT[kind])]
        features += [F.coalesce(v.cast("string"), F.lit("none")) for v in votes]
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), F.array(*votes).alias("votes"),
                        F.array(*[F.concat(F.lit(f"{kind}/{i}/"), f) for i, f in enumerate(features)]).alias("features"))
    return F.transform(found, one)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): base spans of all kinds and the candidates that touch none of them, one row per row of ``docs``."""
    text = F.col("text")
    rows = texts(docs).withColumn("digit", text.rlike("[0-9]"))
    sign = {"email": F.contains(text, F.lit("@")), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.contains(text, F.lit("+"))}
    rows = rows.withColumns({f"b_{k}": spans(text, BASE[k], sign[k], lambda s, k=k: _valid(k, s)) for k in KINDS})
    wide_sign = {k: F.col("digit") if k in ("card", "phone") else text.rlike(WIDE_SIGN[k]) for k in KINDS}
    rows = rows.withColumns({f"w_{k}": spans(text, WIDE[k], wide_sign[k]) for k in KINDS})
    rows = rows.withColumn("all_base", F.concat(*[f"b_{k}" for k in KINDS]))
    rows = rows.withColumns({f"w_{k}": F.filter(f"w_{k}", lambda x: ~_overlaps(x, F.col("all_base"))) for k in KINDS})
    parts = [_described(text, F.col(f"b_{k}"), k, True) for k in KINDS] + [_described(text, F.col(f"w_{k}"), k, False) for k in KINDS]
    return rows.select("doc_id", F.concat(*parts).alias("found"))


def _posterior(votes, state: Column) -> Column:
    """Probability that a candidate with these votes is real; a labeler that abstains (null) says nothing."""
    yes, no = state["p"], 1 - state["p"]
    for i in range(len(LABELERS)):
        yes = yes * F.when(votes(i).isNull(), 1.0).when(votes(i), state[f"a{i}"]).otherwise(1 - state[f"a{i}"])
        no = no * F.when(votes(i).isNull(), 1.0).when(votes(i), state[f"b{i}"]).otherwise(1 - state[f"b{i}"])
    return yes / (yes + no)


def reliabilities(found: DataFrame) -> DataFrame:
    """(kind, state): per kind, the share p of real candidates and each labeler's rates of votes for real (a) and other (b) spans.

    Expectation-maximisation over the counted vote patterns, at most twelve a kind, all
    rounds in one expression.  Base spans are real in every round, so that the classes
    can't change places; they count for the rates and not for the share.
    """
    patterns = found.select(F.explode("found").alias("x")).groupBy(F.col("x.kind").alias("kind"), F.col("x.base").alias("base"), F.col("x.votes").alias("votes")) \
        .agg(F.count(F.lit(1)).cast("double").alias("n")) \
        .groupBy("kind").agg(F.collect_list(F.struct("base", "votes", "n")).alias("patterns"))

    def fields(p, a, b):
        return F.struct(p.alias("p"), *[c.alias(f"a{i}") for i, c in enumerate(a)], *[c.alias(f"b{i}") for i, c in enumerate(b)])

    def step(state, _):
        real = lambda x: F.when(x["base"], x["n"]).otherwise(x["n"] * _posterior(lambda i: x["votes"][i], state))
        total = lambda f: F.aggregate("patterns", F.lit(0.0), lambda s, x: s + f(x))
        n, n1 = total(lambda x: F.when(x["base"], 0.0).otherwise(x["n"])), total(lambda x: F.when(x["base"], 0.0).otherwise(real(x)))
        voted = []
        for i in range(len(LABELERS)):
            given = lambda f, i=i: total(lambda x: F.when(x["votes"][i].isNull(), 0.0).otherwise(f(x)))
            says = lambda f, i=i: total(lambda x: F.when(x["votes"][i], f(x)).otherwise(0.0))
            other = lambda x: x["n"] - real(x)
            voted.append(((says(real) + 1) / (given(real) + 2), (says(other) + 1) / (given(other) + 2)))
        return fields((n1 + 1) / (n + 2), [a for a, _ in voted], [b for _, b in voted])
    start = fields(F.lit(0.5), [F.lit(0.8)] * len(LABELERS), [F.lit(0.2)] * len(LABELERS))
    return patterns.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("state"))


def classifier(found: DataFrame, states: DataFrame) -> Column:
    """Soft counts of real and other spans by feature value, as a scalar map of bounded size.

    The posteriors are the soft labels of a naive Bayes model over the candidates' features
    and votes.  Base spans look different from any candidate, so they teach the labelers'
    rates only.
    """
    state = states.agg(F.map_from_entries(F.collect_list(F.struct("kind", "state")))).scalar()
    soft = found.select(F.explode(F.filter("found", lambda x: ~x["base"])).alias("x")).select("x.*").withColumn("states", state).withColumn("s", F.element_at("states", F.col("kind"))) \
        .withColumn("real", _posterior(lambda i: F.col("votes")[i], F.col("s")))
    per = soft.select(F.explode(F.concat(F.array(F.concat(F.col("kind"), F.lit("/"))), "features")).alias("value"), "real") \
        .groupBy("value").agg(F.sum("real").alias("yes"), F.sum(1 - F.col("real")).alias("no"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("yes", "no"))))).scalar()


def _accepted(x: Column, odds: Column) -> Column:
    """A candidate's log odds under the classifier, over its features and its kind, reach the threshold."""
    prior = F.element_at(odds, F.concat(x["kind"], F.lit("/")))
    log = F.log((prior["yes"] + 1) / (prior["no"] + 1))
    given = F.aggregate(x["features"], F.lit(0.0), lambda s, f: s + F.log(
        (F.element_at(odds, f)["yes"] + 1) / (prior["yes"] + 2) / ((F.element_at(odds, f)["no"] + 1) / (prior["no"] + 2))))
    return log + given >= math.log(ACCEPT / (1 - ACCEPT))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>), kinds as listed, then by start; one row per row of ``docs``.

    Base spans always stay; a candidate is added if the classifier accepts it.  Null and
    empty texts have no spans; repeated rows each get a row; null doc_ids stay; other
    columns are ignored; an empty table gives no rows.
    """
    found = cut(candidates(docs), "pii")
    odds = F.col("odds")
    with_odds = found.withColumn("odds", classifier(found, reliabilities(found)))
    kept = F.filter("found", lambda x: x["base"] | F.when(x["base"], True).otherwise(_accepted(x, odds)))
    order = F.transform(kept, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("n"), x["start"].alias("start"),
                                                 x["end"].alias("end"), x["base"].alias("base"), x["kind"].alias("kind")))
    return with_odds.select("doc_id", F.transform(F.array_sort(order), lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))).alias("spans"))


def digest(detected: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    n_of = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k)))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return detected.select("doc_id", *[n_of(k).cast("long").alias(f"n_{k}") for k in KINDS],
                           F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
