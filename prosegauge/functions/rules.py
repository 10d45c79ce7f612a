"""Rule scores, the judge's labels and the final score as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import fixed as X
from prosegauge.functions import text as T


def per_100(n: Column, n_words: Column) -> Column:
    return n / F.greatest(n_words, F.lit(1)) * 100


def to_10(rate: Column, ceiling: float) -> Column:
    """10 at rate 0 down to 0 at the ceiling (unrounded)."""
    return F.greatest(F.lit(0.0), 10.0 * (1 - F.least(F.lit(1.0), rate / ceiling)))


def coverage(facts: Column, required: Column) -> Column:
    return F.when(facts <= 0, 0.0).when(F.coalesce(required, F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), facts / required))


def economy(n_words: Column, facts: Column, required: Column, budget: Column) -> Column:
    """R2: halves with each 1.5 budgets beyond the budget, times coverage (unrounded)."""
    b = F.coalesce(F.nullif(budget, F.lit(0)), F.lit(X.ECONOMY_BUDGET))
    over = F.greatest(F.lit(0.0), (n_words - b) / b)
    return F.when(facts <= 0, 0.0).otherwise(10.0 * F.pow(F.lit(0.5), over / 1.5) * coverage(facts, required))


def is_expert(audience: Column) -> Column:
    return F.coalesce(audience, F.lit("")).rlike(X.EXPERTS)


def economy_detail(n_words: Column, facts: Column, required: Column, budget: Column) -> Column:
    """R2: what the score rests on; without facts there is no budget in it."""
    b = F.coalesce(F.nullif(budget, F.lit(0)), F.lit(X.ECONOMY_BUDGET))
    some = lambda c: F.when(facts > 0, c)
    return F.struct(
        n_words.alias("words"), some(b).alias("budget"), F.greatest(facts, F.lit(0)).alias("facts"), required.alias("required"),
        F.round(coverage(facts, required), 2).alias("coverage"), some(F.round(n_words / b, 2)).alias("over_budget"),
    )


def undefined_acronyms(text: Column, assumed: Column, audience: Column, dictionary: list[str] | None = None, bare: Column | None = None) -> Column:
    """Distinct acronyms that are neither assumed, common, an English word in capitals nor spelt out; bare is the text without quotes."""
    shouted = F.array(*map(F.lit, [*X.SHOUTED, *(w.upper() for w in dictionary or ())]))
    known = F.concat(F.transform(assumed, F.upper), F.array(*map(F.lit, X.COMMON_ACRONYMS)))
    quoted = lambda a: F.concat(F.lit("\\Q"), a, F.lit("\\E"))

    def unknown(a: Column) -> Column:
        up = F.upper(a)
        base = F.when(up.endswith("S") & (F.length(up) > 2), F.substring(up, F.lit(1), F.length(up) - 1)).otherwise(up)
        defined = F.rlike(text, F.concat(quoted(a), F.lit(r"(?U:\s)*\([^)]{4,}\)"))) | F.rlike(text, F.concat(F.lit(r"\([^)]*"), quoted(a), F.lit(r"[^)]*\)")))
        return ~F.array_contains(known, F.regexp_replace(a, "s+$", "")) & ~F.array_contains(shouted, up) & ~F.array_contains(shouted, base) & ~defined

    found = F.array_distinct(F.regexp_extract_all(T.stripped_of_quotes(text) if bare is None else bare, F.lit("(?U)" + X.ACRONYM_LETTER_FIRST), F.lit(0)))
    return F.when(is_expert(audience), F.array().cast("array<string>")).otherwise(F.filter(found, unknown))


def undefined_terms(text: Column, assumed: Column, audience: Column, bare: Column | None = None, places: Column | None = None) -> Column:
    """Jargon that is neither assumed nor explained on the spot; repeats stay. A text with none of it among its all_places() is ruled out first."""
    some = "|".join(X.escaped(t) for t in sorted(X.JARGON, key=lambda t: (-len(t), t)))
    found = F.regexp_extract_all(T.stripped_of_quotes(text) if bare is None else bare, F.lit(rf"(?iu)(?U)\b(?:{some})\b(?!{X.GLOSS})"), F.lit(0))
    lowered = F.filter(F.transform(found, F.lower), lambda t: ~F.array_contains(F.transform(assumed, F.lower), t))
    none = is_expert(audience)
    if places is not None:
        none = none | ~(T.starts_at(places, [X.escaped(t) for t in X.JARGON]) | T.odd_case(F.lower(text)))
    return F.when(none, F.array().cast("array<string>")).otherwise(lowered)


def swaps(lowered: Column, places: Column | None = None) -> Column:
    """Occurrences of long phrases that have a short form; places as of all_places() save a pass."""
    return T.term_hits(lowered, list(X.SHORT_FORMS)) if places is None else T.hits_at(places, lowered, list(X.SHORT_FORMS))


def swap_map(lowered: Column) -> Column:
    """The long phrases that occur, with their short forms."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in X.SHORT_FORMS.items()))
    edge = lambda k: F.concat(F.lit(r"(?U)\b\Q"), k, F.lit(r"\E\b"))
    return F.map_from_entries(F.when(lowered.rlike(X.any_of(list(X.SHORT_FORMS))), F.filter(pairs, lambda p: F.rlike(lowered, edge(p["key"])))).otherwise(F.array().cast("array<struct<key:string,value:string>>")))


def filler_parts(bare: Column, low: Column | None = None, places: Column | None = None) -> dict[str, Column]:
    """Padding, pretentious words, euphemisms and filler grammar, given the text without quotes; that in lower case and its all_places() save passes."""
    low = F.lower(bare) if low is None else low
    at = T.term_places(low, [*X.PADDING, *X.PRETENTIOUS, *X.EUPHEMISMS], X.rule_starts()) if places is None else places
    hits = lambda terms: T.let(at, lambda p: T.hits_at(p, low, terms)) if places is None else T.hits_at(at, low, terms)
    return {
        "padding": hits(X.PADDING),
        "pretentious": hits(X.PRETENTIOUS),
        "euphemism": hits(X.EUPHEMISMS),
        "grammar": T.let(at, lambda p: T.filler_grammar(bare, low, p)) if places is None else T.filler_grammar(bare, low, at),
    }


def filler_weight(parts: dict[str, Column]) -> Column:
    return parts["padding"] + parts["pretentious"] + parts["grammar"] + 3 * parts["euphemism"]


def judge_object(raw: Column) -> Column:
    """The JSON object in a judge's answer; of an answer that goes on after it, the first balanced one. Null if there is none."""
    blob = F.regexp_extract(F.regexp_replace(raw, "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        done = (s["end"] == 0) & (ch == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(done, s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(blob, ""), start, step, lambda s: s["end"])
    whole = F.try_parse_json(blob)
    return F.when(blob == "", None).otherwise(F.coalesce(whole, F.try_parse_json(F.substring(blob, F.lit(1), end))))


def judge_error(raw: Column, parsed: Column) -> Column:
    """Why a judge's answer gives no scores; null if it does."""
    return F.when(parsed.isNull() | (F.try_variant_get(parsed, "$", "map<string,variant>")).isNull(), F.concat(F.lit("judge parse: no object in "), F.coalesce(F.substring(raw, 1, 200), F.lit("nothing"))))


def facts_delivered(parsed: Column) -> Column:
    """Entries that aren't false, zero, null or empty."""
    facts = F.coalesce(F.try_variant_get(parsed, "$.facts_delivered", "array<variant>"), F.array().cast("array<variant>"))
    return F.size(F.filter(facts, lambda v: v.isNotNull() & ~F.coalesce(F.to_json(v), F.lit("null")).isin("false", "0", "0.0", "null", '""', "[]", "{}")))


def _said(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "string")


def enough_words(quote: Column, n: int) -> Column:
    """J4."""
    return F.regexp_count(F.coalesce(quote, F.lit("")), F.lit(X.QUOTE_WORD)) >= n


def judged_scores(parsed: Column) -> dict[str, Column]:
    """Label scores; a complaint without evidence counts as 10 (7 for imagery); null where the judge left out one of the last four."""
    out = {}
    for name, labels in X.JUDGE_LABELS.items():
        said = _said(parsed, name)
        score = F.coalesce(*(F.when(said == k, v) for k, v in labels.items()), F.lit(X.JUDGE_DEFAULTS.get(name)).cast("double"))
        if name == "imagery":
            out[name] = F.when((score < 7) & (T.trimmed(F.coalesce(_said(parsed, "imagery_suggestion"), F.lit(""))) == ""), 7.0).otherwise(score)
        else:
            out[name] = F.when((score < 10) & ~enough_words(_said(parsed, f"{name}_quote"), X.QUOTE_WORDS[name]), 10.0).otherwise(score)
    return out


def merged(counted: Column, judged: Column) -> Column:
    """The worse of the two, or the counted one alone."""
    return F.least(counted, judged)


def clarity(rules: dict[str, Column], covered: Column) -> Column:
    """Weighted mean of the seven rules, capped where a rule that matters fails or little is covered."""
    weights = {k: X.ECONOMY_WEIGHT if k == "rule2" else 1.0 for k in rules}
    mean = reduce(lambda a, b: a + b, (rules[k] * w for k, w in weights.items())) / sum(weights.values())
    worst = F.least(*(rules[k] for k in ("rule1", "rule3", "rule5", "rule6", "rule7")))
    return F.when((worst < X.FLOOR) | (covered < X.LEAST_COVERAGE), F.least(mean, F.lit(X.FLOOR_CAP))).otherwise(mean)


def band(score: Column) -> Column:
    return F.when(score < X.BANDS[0][0], X.BANDS[0][1]).when(score < X.BANDS[1][0], X.BANDS[1][1]).otherwise("high")


def cost(model: Column, tokens_in: Column, tokens_out: Column, cache_made: Column | None = None, cache_read: Column | None = None) -> Column:
    """Dollars of a call; tokens that go to or come from a cache cost as much as read ones, unknown models and missing counts 0."""
    some = lambda c: F.lit(0) if c is None else F.coalesce(c, F.lit(0))
    read, dollars = some(tokens_in) + some(cache_made) + some(cache_read), F.lit(0.0)
    for name, (a, b) in reversed(X.TOKEN_RATES.items()):
        dollars = F.when(model.contains(name), F.round(read / 1e6 * a + some(tokens_out) / 1e6 * b, 6)).otherwise(dollars)
    return dollars


def contaminated(reply: Column) -> Column:
    """Names tools in the first answer without denying them, or says that it is an agent."""
    first, whole = F.lower(T.first_answer(reply)), F.lower(reply)
    tools = reduce(lambda a, b: a | b, (first.contains(t) for t in X.TOOL_NAMES))
    return (tools & ~first.rlike(X.DENIAL)) | (whole.rlike(X.IS_AGENT) & ~whole.rlike(X.IS_NO_AGENT))


def contamination_message(reply: Column) -> Column:
    """Why a probe's reply stops a run; null if it doesn't."""
    return F.when(contaminated(reply), F.concat(F.lit("the backend seems to be an agent: "), F.substring(reply, 1, 200)))
