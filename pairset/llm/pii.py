"""Personal data in whole texts, by weak supervision in DataFrame functions alone.

1. *Candidates.* Base kinds (email, ip, card, phone) by fixed patterns, leftmost and non-overlapping per kind; matches
   that fail their test are dropped. Further kinds: spelled-out emails, local phone numbers, social security
   numbers and IBANs. Positions are code points, end exclusive.
2. *Labelers* vote for (1), against (-1) or abstain (0) on every candidate: format and checksum, gazetteers of
   domains, address blocks and card issuers, words before it, words against it, and its borders.
3. *Aggregation.* Expectation-maximisation over the counted vote patterns estimates how reliable each labeler
   is, and with it a probability for every pattern.
4. *Classifier.* A logistic regression over kinds, votes and shape, fitted to those probabilities, weighs the
   candidates of further kinds; base spans stay whatever it says.

A text is read once; its candidates with their votes are one array, written to the shared folder. Patterns are
bounded by kinds, votes and shapes, not by the corpus: only their counts reach the driver.

NULL and empty texts have no spans. Rows are independent, so repeated ids keep a row each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.llm.common import stored, whole_text

# The base kinds in their order, and the further ones after them.
BASE = ("email", "ip", "card", "phone")
FURTHER = ("email_spelled", "phone_local", "ssn", "iban")
KINDS = BASE + FURTHER

# Characters of an IBAN by country, after the registry.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
# A country's own length ends an IBAN before any word that follows; other starts give words back until a border fits.
_IBAN = "|".join([f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()] + ["[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"])

# The fixed patterns, written so that no run of characters is tried from each of its places and no group
# recurses: possessive repeats, and starts only where a run begins or the last match ended.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_spelled": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,40}+ (?:\(at\)|\[at\]|at) [a-z0-9-]{2,40}+ (?:\(dot\)|\[dot\]|dot) [a-z]{2,12}(?![a-z0-9])",
    "phone_local": r"(?<![0-9+(-])(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": rf"(?<![A-Za-z0-9])(?:(?:{_IBAN})(?![A-Za-z0-9]))",
}
#: What a text must hold for a pattern to be tried at all.
_HINTS = {"email": "@", "ip": ".", "phone": "+", "phone_local": "-. ", "ssn": "-"}

VOTES = ("format", "gazetteer", "context", "against", "border")
_CUES = {
    "email": "mail|contact|write|reach|@", "ip": r"\bip\b|address|host|server|client", "card": "card|visa|master|credit|payment|iban",
    "phone": "phone|tel|call|mobile|fax|contact", "email_spelled": "mail|contact|write|reach", "phone_local": "phone|tel|call|mobile|fax|contact",
    "ssn": r"ssn|social|security|tax", "iban": "iban|account|bank|transfer",
}
_AGAINST = r"version|\bv\.? ?$|release|isbn|issn|order|invoice|serial|build|section|example|figure"
_DOMAINS = r"(?i)(?:\.|dot )(?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|us|ca|eu|ch|at|be|se|pl|jp|cn|in|br|au)$"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))"
_BLOCKS = r"^(?:0|127|22[4-9]|2[3-5][0-9])\."


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda sum_, i: sum_ + F.when(i % 2 == 1, _digit(digits, n - i + 1)).otherwise(
            2 * _digit(digits, n - i + 1) - F.when(_digit(digits, n - i + 1) > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _digit(digits: Column, at: Column) -> Column:
    return F.ascii(F.substr(digits, at, F.lit(1))) - 48


def _iban(match: Column) -> Column:
    """Whether an IBAN leaves 1 modulo 97; letters count as two digits."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda rest, i: F.when(F.ascii(F.substr(turned, i, F.lit(1))) >= 65, (rest * 100 + F.ascii(F.substr(turned, i, F.lit(1))) - 55) % 97)
        .otherwise((rest * 10 + F.ascii(F.substr(turned, i, F.lit(1))) - 48) % 97),
    ) == 1


def _passes(kind: str, match: Column) -> Column | None:
    """The test that a match of a base kind must pass; its failure drops the match."""
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return None


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind with their places and what stands before and after them.

    A text is cut at the matches; the lengths of cuts and matches add up to their places.
    """
    pattern = _PATTERNS[kind]
    cuts = F.split(text, pattern, -1)
    found = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m, i: F.struct(m.alias("match"), F.get(cuts, i).alias("before"), F.get(cuts, i + 1).alias("after")),
    )
    kept = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    placed = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), F.array().cast(kept).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["before"]) + F.length(x["match"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["before"])).alias("start"), (acc["at"] + F.length(x["before"]) + F.length(x["match"])).alias("end"),
                x["match"].alias("match"), F.right(x["before"], F.lit(40)).alias("before"), F.left(x["after"], F.lit(20)).alias("after"),
            )).cast(kept)).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    hint = _HINTS.get(kind)
    tried = text.rlike("[0-9]") if hint is None or kind in ("ssn", "phone_local") else F.contains(text, F.lit(hint))
    if kind == "email_spelled":
        tried = text.rlike(r"(?i)\bdot\b")
    return F.when(tried, placed).otherwise(F.array().cast(kept))


def _votes(kind: str, m: Column) -> dict[str, Column]:
    """What each labeler says of a candidate."""
    match, before, after = m["match"], F.lower(m["before"]), m["after"]
    d = _digits(match)
    yes, no, abstain = F.lit(1), F.lit(-1), F.lit(0)
    form = {
        "email": F.when(F.length(match).between(6, 80) & ~match.rlike(r"\.\.|^[.-]|[.-]@"), yes).otherwise(no),
        "ip": F.when(match.rlike(r"(?:^|\.)0[0-9]"), no).otherwise(yes),
        "card": yes,
        "phone": F.when(F.length(d) >= 10, yes).otherwise(abstain),
        "email_spelled": F.when(match.rlike(r"(?i)[(\[]at|[(\[]dot"), yes).otherwise(abstain),
        "phone_local": F.when(match.rlike(r"^\([0-9]{3}\) |^[0-9]{3}-[0-9]{3}-"), yes).otherwise(abstain),
        "ssn": F.when(match.rlike("^(?:000|666|9)|-00-|-0000$"), no).otherwise(yes),
        "iban": F.when(_iban(match), yes).otherwise(no),
    }[kind]
    known = {
        "email": F.when(match.rlike(_DOMAINS), yes).otherwise(abstain),
        "ip": F.when(match.rlike(_BLOCKS), no).otherwise(yes),
        "card": F.when(d.rlike(_ISSUERS), yes).otherwise(no),
        "phone": F.when(d.rlike("^0"), no).otherwise(yes),
        "email_spelled": F.when(match.rlike(_DOMAINS), yes).otherwise(no),
        "phone_local": F.when(d.rlike("^[2-9]"), yes).otherwise(no),
        "ssn": abstain,
        "iban": F.when(match.rlike("^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"), yes).otherwise(no),
    }[kind]
    return {
        "format": form, "gazetteer": known,
        "context": F.when(before.rlike(_CUES[kind]), yes).otherwise(abstain),
        "against": F.when(before.rlike(_AGAINST), no).otherwise(abstain),
        "border": F.when(before.rlike(r"[A-Za-z0-9_/=]$") | after.rlike(r"^[A-Za-z0-9_/=]"), no).otherwise(yes),
    }


def _spans(text: Column, kind: str) -> Column:
    """The candidates of one kind: place, votes and shape."""
    found = _matches(text, kind)
    if _passes(kind, F.lit("")) is not None:
        found = F.filter(found, lambda m: _passes(kind, m["match"]))

    def span(m: Column) -> Column:
        votes = _votes(kind, m)
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].cast("long").alias("start"), m["end"].cast("long").alias("end"),
            *[votes[v].alias(v) for v in VOTES],
            F.least(F.floor(F.length(m["match"]) / 8), F.lit(3)).cast("int").alias("long"),
        )

    return F.transform(found, span)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``spans`` of every text: kind, place, votes and shape, by kind and place."""
    text = whole_text()
    arrays = [_spans(text, kind) for kind in KINDS]
    return docs.select("doc_id", F.concat(*arrays).alias("spans"))


@dataclass
class Weights:
    """Weights of the span classifier, and what expectation-maximisation found out about the labelers."""

    kinds: dict[str, float]
    votes: dict[tuple[str, int], float]
    long: float
    reliability: dict[str, float]

    def probability(self, span: Column) -> Column:
        total = F.coalesce(*[F.when(span["kind"] == k, F.lit(w)) for k, w in self.kinds.items()], F.lit(0.0))
        for (vote, value), w in self.votes.items():
            total = total + F.when(span[vote] == value, F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-(total + span["long"] * self.long)))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over counted vote patterns: the share of true candidates, and for every labeler
    how often it says each value of a true and of a false one."""
    n = len(VOTES)
    prior = 0.7
    says = [{1: (0.7, 0.3), 0: (0.2, 0.3), -1: (0.1, 0.4)} for _ in range(n)]
    for _ in range(rounds):
        true = [{v: 1.0 for v in (1, 0, -1)} for _ in range(n)]
        false = [{v: 1.0 for v in (1, 0, -1)} for _ in range(n)]
        total = positive = 0.0
        for votes, count in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for labeler, v in zip(says, votes, strict=True):
                a, b = a + math.log(labeler[v][0]), b + math.log(labeler[v][1])
            p = 1 / (1 + math.exp(min(700, max(-700, b - a))))
            total, positive = total + count, positive + count * p
            for k, v in enumerate(votes):
                true[k][v] += count * p
                false[k][v] += count * (1 - p)
        prior = min(0.99, max(0.01, (positive + 1) / (total + 2)))
        says = [{v: (t[v] / sum(t.values()), f[v] / sum(f.values())) for v in t} for t, f in zip(true, false, strict=True)]
    return prior, says


def fit(found: DataFrame) -> Weights:
    """Estimate the labelers and train the span classifier on all counted patterns of ``candidates``."""
    patterns = stored(
        found.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{v}" for v in VOTES], "s.long").agg(F.count("*").alias("n")), "patterns",
    )
    counts = [(tuple(r[v] for v in VOTES), r.n) for r in patterns.groupBy(*VOTES).agg(F.sum("n").alias("n")).orderBy(*VOTES).collect()]
    if not counts:
        return Weights({}, {}, 0.0, {})
    prior, says = reliabilities(counts)
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, labeler in zip(VOTES, says, strict=True):
        odds = odds + F.coalesce(*[F.when(F.col(name) == v, F.lit(math.log(t / f))) for v, (t, f) in labeler.items()])
    p = 1 / (1 + F.exp(-odds))
    pairs = [(v, x) for v in VOTES for x in (1, -1)]
    inputs = [(F.col("kind") == k).cast("double").alias(f"kind_{k}") for k in KINDS]
    inputs += [(F.col(v) == x).cast("double").alias(f"{v}_{x + 1}") for v, x in pairs] + [F.col("long").cast("double").alias("shape")]
    names = [f"kind_{k}" for k in KINDS] + [f"{v}_{x + 1}" for v, x in pairs] + ["shape"]
    both = patterns.select(*inputs, F.col("n"), p.alias("p")).withColumn(
        "y", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))),
    ).select(*names, F.col("y.label").alias("label"), (F.col("n") * F.col("y.w")).alias("weight")).where("weight > 0")
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(both)
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50, standardization=False).fit(rows)
    weights = [float(w) for w in model.coefficients.toArray()]
    kinds = {k: w + float(model.intercept) for k, w in zip(KINDS, weights, strict=False)}
    return Weights(
        kinds, dict(zip(pairs, weights[len(KINDS):-1], strict=True)), weights[-1],
        {v: labeler[1][0] / max(labeler[1][0] + labeler[1][1], 1e-9) for v, labeler in zip(VOTES, says, strict=True)},
    )


def detect(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """``doc_id``, the ``base`` spans and all accepted ``spans``, with kind, start, end and probability."""
    found = stored(candidates(docs), "candidates")
    weights = fit(found)
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), weights.probability(s).alias("p")))
    rows = found.select("doc_id", scored.alias("spans"))
    return rows.select(
        "doc_id", F.filter("spans", lambda s: s["kind"].isin(*BASE)).alias("base"),
        F.filter("spans", lambda s: s["kind"].isin(*BASE) | (s["p"] >= accept)).alias("spans"),
    )


def joined(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
