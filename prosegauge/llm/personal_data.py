"""Personal data by weak supervision, in Spark expressions only.

Candidate spans come from patterns: four base kinds (email, ip, card, phone), which always
stay, and wider ones that need a decision. Labelers (a strict form, a gazetteer, words of
context for and against, a checksum or mixture test) vote 1, -1 or 0 on each candidate. Votes and
classes of the span's statistics (length, shares of digits and of capitals) are counted over the
whole corpus in Spark, at most KINDS x 3^5 x 18 rows; expectation-maximisation over the votes
estimates how reliable each labeler is, and a logistic span classifier is trained on the resulting
probabilities, from kind, votes and statistics. Its weights become a Column, which decides on the
wider candidates of each text; of accepted ones that overlap the likeliest stays, then the first,
then by kind as listed.

Null texts count as empty; offsets are code points, ends exclusive. Repeated rows and rows with a
null id each get their spans. An empty table yields no rows. Wider spans that overlap a base span
are dropped. Other columns stay as they are, but for those that have the names of the new ones.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: Candidate patterns by kind. The base forms start at the first character of
#: a run (or after a match), so that they find the leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?",
}
#: A text without a match of this can't hold the kind (cheaper to test).
GATES = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){13}",
    "phone": r"\+[0-9]",
    "secret": r"[A-Za-z0-9_/+-]{20}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"[0-9]{3}[ .-][0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "person": r"\b(?:M[rs]|Mrs|Dr|Prof|Herr|Frau|Se|Mons|Mad)",
}
#: What a strict form of each kind looks like.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .(-]",
    "secret": r"^(?:[0-9a-f]{32,}|(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_/+-]{20,}={0,2})$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,40}$",
    "person": r"^(?:Mr|Mrs|Ms|Dr|Prof)\. |^(?:Herr|Frau|Señora?|Monsieur|Madame) ",
}
#: Known beginnings and ends.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk-|sk_live_|eyJ|AIza)",
    "national_id": r"^(?!9)",
    "local_phone": r"^\(?(?:201|202|212|213|305|310|312|404|415|416|503|512|602|617|646|702|713|718|800|888|917)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "person": r"(?i) (?:smith|jones|brown|taylor|miller|davis|garcia|martin|müller|schmidt|meyer|bernard|dubois|lópez|fernández)$",
}
#: Words just before a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|correo|kontakt|courriel)\W*\w*\W*$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from|client)\W*\w*\W*$",
    "card": r"(?i)(?:card|visa|credit|debit|tarjeta|karte|carte|payment)\W*\w*\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|whatsapp|tél|teléfono)\W*\w*\W*$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|key|auth|bearer)[\s\"'=:]*$",
    "national_id": r"(?i)(?:ssn|social|security|id)\W*\w*\W*$",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|fax)\W*\w*\W*$",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte|bank)\W*\w*\W*$",
    "person": r"(?i)(?:dear|by|from|contact|name|author)\W*$",
}
#: Words just before a span that speak against any kind.
AGAINST = r"(?i)(?:version|release|isbn|issn|figure|table|section|rfc|part|https?:/|www\.|[/=?&])\W?$"
LABELERS = ("strict", "gazetteer", "context", "against", "mixture")
#: Statistics of a span and the greatest class of each.
CLASSES = (("length", 2), ("digits", 2), ("capitals", 1))
KINDS = tuple(PATTERNS)
LEFT = 24
SPAN = "array<struct<kind:string,start:int,end:int,value:string,left:string>>"


def _matches(text: Column, kind: str) -> Column:
    """Spans of the kind's pattern: the texts between matches give their offsets."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        lo = state["at"] + F.length(pair["gap"])
        hi = lo + F.length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), lo.alias("start"), hi.alias("end"), pair["value"].alias("value"), F.right(pair["gap"], F.lit(LEFT)).alias("left"))
        return F.struct(hi.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(text.rlike(GATES[kind]), F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _stands(span: Column, kind: str) -> Column:
    """The base kinds' own tests; a match that fails is dropped."""
    value = span["value"]
    if kind == "ip":
        return value.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _standing(text: Column, kind: str) -> Column:
    return F.filter(_matches(text, kind), lambda s: _stands(s, kind))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind)


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def base_spans(text: Column) -> Column:
    return _in_order(F.concat(*(_standing(text, k) for k in BASE)))


def wider_spans(text: Column, base: Column) -> Column:
    """Candidates of the other kinds that don't touch a base span; they may overlap each other."""
    every = _in_order(F.concat(*(_matches(text, k) for k in KINDS if k not in BASE)))
    return F.filter(every, lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))


def accepted(spans: Column, weights: list[float], least: float = 0.5) -> Column:
    """The candidates that the classifier takes; of overlapping ones the likeliest, then the first, then by kind."""
    rated = F.transform(spans, lambda s: F.struct((-chance(s, weights)).alias("p"), s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s.alias("span")))
    best = F.transform(F.array_sort(F.filter(rated, lambda r: r["p"] <= -least)), lambda r: r["span"])
    apart = lambda out, s: ~F.exists(out, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))
    return F.aggregate(best, F.array().cast(SPAN), lambda out, s: F.when(apart(out, s), F.concat(out, F.array(s))).otherwise(out))


def votes(span: Column) -> Column:
    """The labelers' votes on a span, as a struct of 1, -1 and 0."""
    value, left, kind = span["value"], span["left"], span["kind"]

    def by_kind(patterns: dict, subject: Column, other: int) -> Column:
        tests = [F.when(kind == k, F.when(subject.rlike(p), 1).otherwise(other)) for k, p in patterns.items()]
        return F.coalesce(*tests, F.lit(0))

    mixed = (
        F.when(kind == "card", F.when(F.call_function("luhn_check", _digits(value)), 1).otherwise(-1))
        .when(kind == "secret", F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.regexp_count(value, F.lit("[0-9]")) >= 4), 1).otherwise(-1))
        .when(kind == "phone", F.when(F.length(_digits(value)).between(11, 13), 1).otherwise(0))
        .when(kind == "iban", F.when(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & (F.length(_digits(value)) >= 8), 1).otherwise(-1))
        .otherwise(0)
    )
    return F.struct(
        by_kind(STRICT, value, -1).alias("strict"),
        by_kind(GAZETTEER, value, 0).alias("gazetteer"),
        by_kind(CONTEXT, left, 0).alias("context"),
        F.when(left.rlike(AGAINST), -1).otherwise(0).alias("against"),
        mixed.alias("mixture"),
    )


def classes(span: Column) -> Column:
    """Classes of a span's statistics: length, share of digits, share of capitals."""
    n = F.length(span["value"])
    share = lambda pattern: F.regexp_count(span["value"], F.lit(pattern)) / n
    graded = lambda x, *cuts: sum((F.when(x >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return F.struct(
        graded(n, 16, 32).alias("length"), graded(share("[0-9]"), 0.2, 0.6).alias("digits"), graded(share(r"\p{Lu}"), 0.1).alias("capitals")
    )


def em(counts: dict[tuple, float], rounds: int = 50) -> dict[tuple, float]:
    """Probability that a candidate is real, by (kind, votes), from counts of such patterns.

    Each labeler, when it votes, says 1 with one chance for a real and another for a false
    candidate, shared by the kinds; a 0 tells nothing. Each kind has its own share of real
    ones. Pseudo-votes lean towards honest labelers; the start trusts the majority.
    """
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:]))) for p in counts}
    for _ in range(rounds):
        share: dict[str, list[float]] = {}
        table = [[{1: 4.0 if real else 1.0, -1: 1.0 if real else 4.0} for real in (0, 1)] for _ in LABELERS]
        for p, n in counts.items():
            has = share.setdefault(p[0], [1.0, 1.0])
            for real, weight in ((0, n * (1 - post[p])), (1, n * post[p])):
                has[real] += weight
                for j, v in enumerate(p[1:]):
                    if v:
                        table[j][real][v] += weight
        fresh = {}
        for p in counts:
            odds = math.log(share[p[0]][1] / share[p[0]][0])
            for j, v in enumerate(p[1:]):
                real, false = table[j][1], table[j][0]
                if v:
                    odds += math.log(real[v] / sum(real.values())) - math.log(false[v] / sum(false.values()))
            fresh[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(fresh[p] - post[p]) for p in counts), default=0)
        post = fresh
        if moved < 1e-6:
            break
    return post


def _inputs(pattern: tuple) -> list[float]:
    """What the classifier sees of a (kind, votes, classes) pattern."""
    kind, said, graded = pattern[0], pattern[1 : 1 + len(LABELERS)], pattern[1 + len(LABELERS) :]
    marks = [float(g >= k) for g, (_, most) in zip(graded, CLASSES, strict=True) for k in range(1, most + 1)]
    return [1.0, *(float(kind == k) for k in KINDS), *(float(v == 1) for v in said), *(float(v == -1) for v in said), *marks]


def train(counts: dict[tuple, float], rounds: int = 800, ridge: float = 1e-4) -> list[float]:
    """Logistic weights of the span classifier from counts of (kind, votes, classes), fitted to the probabilities of em(); each kind weighs the same, however rare."""
    voted: dict[tuple, float] = {}
    total: dict[str, float] = {}
    for p, n in counts.items():
        key = p[: 1 + len(LABELERS)]
        voted[key] = voted.get(key, 0.0) + n
        total[p[0]] = total.get(p[0], 0.0) + n
    post, rows = em(voted), sorted(counts)
    weights = np.zeros(len(_inputs((KINDS[0], *([0] * (len(LABELERS) + len(CLASSES)))))))
    x = np.array([_inputs(p) for p in rows], float).reshape(-1, len(weights))
    share = np.array([counts[p] / total[p[0]] / len(total) for p in rows])
    y = np.array([post[p[: 1 + len(LABELERS)]] for p in rows])
    for _ in range(rounds if len(rows) else 0):
        off = share * (1 / (1 + np.exp(-(x @ weights))) - y)
        weights = weights - 1.5 * (x.T @ off + ridge * weights)
    return weights.tolist()


def chance(span: Column, weights: list[float]) -> Column:
    """The span classifier as a Column."""
    said, graded, kind = votes(span), classes(span), span["kind"]
    rest = iter(weights)
    terms = [F.lit(next(rest)), F.coalesce(*(F.when(kind == k, F.lit(next(rest))) for k in KINDS), F.lit(0.0))]
    for vote in (1, -1):
        terms += [F.when(said[name] == vote, F.lit(next(rest))).otherwise(F.lit(0.0)) for name in LABELERS]
    for name, most in CLASSES:
        terms += [F.when(graded[name] >= k, F.lit(next(rest))).otherwise(F.lit(0.0)) for k in range(1, most + 1)]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def vote_counts(docs: DataFrame, text_column: str = "text") -> dict[tuple, float]:
    """How often each (kind, votes, classes) occurs over all candidates of all texts; the group count has a fixed bound."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = (
        docs.select(text.alias("t"))
        .select("t", base_spans(F.col("t")).alias("b"))
        .select(F.explode(F.concat("b", wider_spans(F.col("t"), F.col("b")))).alias("s"))
        .select(F.col("s.kind").alias("kind"), votes(F.col("s")).alias("v"), classes(F.col("s")).alias("c"))
        .groupBy("kind", *(F.col(f"v.{n}").alias(n) for n in LABELERS), *(F.col(f"c.{n}").alias(n) for n, _ in CLASSES))
        .count()
    )
    return {tuple(r[:-1]): float(r[-1]) for r in found.collect()}


def with_spans(docs: DataFrame, weights: list[float], text_column: str = "text", least: float = 0.5, names: tuple[str, str] = ("pii_base", "pii_spans")) -> DataFrame:
    """Adds the base spans and all spans (base and accepted wider ones, in order) under these names."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    base, spans = names
    return (
        docs.withColumn(base, base_spans(text))
        .withColumn(spans, accepted(wider_spans(text, F.col(base)), weights, least))
        .withColumn(spans, _in_order(F.concat(base, spans)))
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span as [KIND]; of overlapping spans the first names the whole."""
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(state["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return (
            F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), mark.alias("out")))
            .otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out")))
        )

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    )
