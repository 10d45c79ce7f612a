"""From responses, items and judgements to scores, summaries and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.functions import fixed as X
from prosegauge.functions import rules as R
from prosegauge.functions import text as T

RULES = tuple(f"rule{k}" for k in range(1, 8))


def with_slop(docs: DataFrame, text_column: str = "text", keep: bool = False) -> DataFrame:
    """Adds n_words, the struct of counts, slop (per 1,000 words, unrounded) and slop_tax; keep leaves the text without quotes (_bare), that in lower case (_low) and its all_places() (_places)."""
    text = F.col(text_column)
    ready = docs.withColumn("_bare", T.stripped_of_quotes(text)).withColumn("_low", F.lower("_bare")).withColumn("_places", (T.all_places if keep else T.sign_places)(F.col("_low")))
    made = T.slop_counts(F.col("_bare"), F.col("_low"), F.col("_places"))
    counted = ready.withColumn("counts", F.struct(*(c.cast("int").alias(k) for k, c in made.items()))).withColumn("n_words", T.words(text))
    names = [f.name for f in counted.schema["counts"].dataType.fields]
    rate = T.slop_rate({k: F.col(f"counts.{k}") for k in names}, F.col("n_words"))
    rated = counted.withColumn("slop", rate).withColumn("slop_tax", T.slop_tax(F.col("slop")))
    return rated if keep else rated.drop("_bare", "_low", "_places")


def breakdown(counts: Column, names: list[str]) -> Column:
    """The counts that aren't 0, as a map."""
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), counts[k].alias("value")) for k in names)), lambda p: p["value"] > 0))


def counted_rules(text: Column, bare: Column, low: Column, n: Column, facts: Column, required: Column, budget: Column, assumed: Column, audience: Column, places: Column | None = None) -> dict[str, Column]:
    """R*: the rules that need no judge (unrounded), given the text without quotes, that in lower case, and the number of words; its all_places() save passes."""
    odd = F.size(R.undefined_acronyms(text, assumed, audience, bare=bare)) + F.size(R.undefined_terms(text, assumed, audience, bare=bare, places=places))
    return {
        "rule2": R.economy(n, facts, required, budget),
        "rule3": R.to_10(R.per_100(odd, n), X.JARGON_CEILING),
        "rule5": R.to_10(R.per_100(R.swaps(low, places), n), X.SIMPLE_CEILING),
        "rule6": R.to_10(R.per_100(R.filler_weight(R.filler_parts(bare, low, places)), n), X.FILLER_CEILING),
    }


def score_all(docs: DataFrame, rounded: bool = True) -> DataFrame:
    """R* on its own: adds rule2, rule3, rule5, rule6 and detail to rows (text, facts, budget, required, assumed, audience)."""
    text, given = F.col("text"), [F.col(c) for c in ("facts", "required", "budget")]
    ready = docs.withColumn("_bare", T.stripped_of_quotes(text)).withColumn("_low", F.lower("_bare")).withColumn("_n", T.words(text))
    who = (F.col("assumed"), F.col("audience"))
    made = counted_rules(text, F.col("_bare"), F.col("_low"), F.col("_n"), *given, *who)
    jargon = F.array_sort(F.array_distinct(F.concat(R.undefined_acronyms(text, *who, bare=F.col("_bare")), R.undefined_terms(text, *who, bare=F.col("_bare")))))
    detail = F.struct(R.economy_detail(F.col("_n"), *given).alias("economy"), jargon.alias("jargon"), R.swap_map(F.col("_low")).alias("swaps"), F.struct(*(c.alias(k) for k, c in R.filler_parts(F.col("_bare")).items())).alias("filler"))
    return ready.withColumns({k: F.round(c, 1) if rounded else c for k, c in made.items()} | {"detail": detail}).drop("_bare", "_low", "_n")


def with_scores(docs: DataFrame, judged: bool = True, rounded: bool = False) -> DataFrame:
    """The final score of rows (text, budget, required, assumed, audience, raw judge answer).

    Adds judge_error, the seven rules, coverage, clarity, slop, slop_tax and score = 10 * clarity
    * (1 - tax). An answer of the judge without an object is an error, and the row has no scores.
    judged = False needs no judge column: all facts count as delivered, rules 1, 4 and 7 start at
    10 and only the scaffolding lowers the last. rounded = True rounds where reports do: rules,
    slop and score to one digit, clarity to two, the tax to three; what follows uses the rounded
    rules and slop, and the clarity and tax before rounding.
    """
    text, digit = F.col("text"), lambda c, n=1: F.round(c, n) if rounded else c
    df = with_slop(docs, keep=True)
    if rounded:
        df = df.withColumn("slop", F.round("slop", 1)).withColumn("slop_tax", T.slop_tax(F.col("slop")))
    if judged:
        df = df.withColumn("parsed", R.judge_object(F.col("judge"))).withColumn("judge_error", R.judge_error(F.col("judge"), F.col("parsed")))
        df = df.withColumn("facts", R.facts_delivered(F.col("parsed")))
        said = R.judged_scores(F.col("parsed"))
    else:
        df = df.withColumn("judge_error", F.lit(None).cast("string")).withColumn("facts", F.col("required").cast("int"))
        said = {k: F.lit(10.0) for k in ("clarity", "imagery", "form")}
    heads, items = T.scaffold(text)
    covered = R.coverage(F.col("facts"), F.col("required"))
    found = counted_rules(text, F.col("_bare"), F.col("_low"), F.col("n_words"), F.col("facts"), F.col("required"), F.col("budget"), F.col("assumed"), F.col("audience"), F.col("_places"))
    merged = lambda rule, name: R.merged(digit(found[rule]), said[name]) if name in said else digit(found[rule])
    made = {
        "rule1": said["clarity"],
        "rule2": merged("rule2", "economy"),
        "rule3": merged("rule3", "jargon"),
        "rule4": said["imagery"],
        "rule5": merged("rule5", "simple_words"),
        "rule6": merged("rule6", "filler"),
        "rule7": R.merged(T.scaffold_score(heads, items, F.col("budget")), said["form"]),
    }
    df = df.withColumns(made).withColumn("coverage", F.round(covered, 2))
    df = df.withColumn("clarity", R.clarity({k: F.col(k) for k in RULES}, F.col("coverage")))
    df = df.withColumn("score", digit(10 * F.col("clarity") * (1 - F.col("slop_tax")))).withColumn("clarity", digit(F.col("clarity"), 2)).withColumn("slop_tax", digit(F.col("slop_tax"), 3))
    if judged:
        ok = F.col("judge_error").isNull()
        df = df.withColumns({c: F.when(ok, F.col(c)) for c in (*RULES, "coverage", "clarity", "score")}).drop("parsed")
    return df.drop("_bare", "_low", "_places")


def run_summary(scored: DataFrame, by: str = "model", rounded: bool = False, strict: bool = False) -> DataFrame:
    """A1 to A3: counts of scored and failed rows, means over the scored ones, total cost.

    rounded gives the digits of a report: score and slop one, clarity and rules two, words none,
    cost four. strict makes the job fail if a group has no scored row.
    """
    ok = F.col("error").isNull()
    digits = {"score": 1, "clarity": 2, "slop": 1, "n_words": 0} | {r: 2 for r in RULES}
    cut = lambda c, n: F.round(c, n) if rounded else c
    mean = lambda c: cut(F.avg(F.when(ok, F.col(c))), digits[c]).alias(c)
    out = scored.groupBy(by).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("errors"), mean("score"), mean("clarity"), mean("slop"), mean("n_words"), cut(F.sum(F.when(ok, F.col("cost"))), 4).alias("cost"), *(mean(r) for r in RULES)
    )
    if strict:
        out = out.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("all prompts failed: "), F.col(by).cast("string")))))
    return out


def ranked(summary: DataFrame, full: int = 30, medals: int = 3, by: str = "model") -> DataFrame:
    """Place within rows of the same sample size; the first three of full runs get a medal."""
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.col("score").desc(), F.col(by)))
    out = summary.withColumn("place", place)
    return out.withColumn("medal", F.when((F.col("n") >= full) & (F.col("place") <= medals), F.col("place")))


def first_n(scored: DataFrame, n: int, by: str = "model") -> DataFrame:
    """Means over each model's items 1 to n; models that lack one are left out."""
    rows = scored.where(F.col("error").isNull() & F.col("item").between(1, n))
    means = rows.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"), F.avg("score").alias("score"), F.avg("n_words").alias("n_words"))
    return means.where(F.col("items") >= n).drop("items")


def limited(items: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first n items by id."""
    return items.orderBy(key).limit(n)


def control_checks(scored: DataFrame) -> DataFrame:
    """Whether the band of each control case is the expected one; cases that need a judge are skipped if none was asked (judge_error and score null, or judged false)."""
    asked = F.col("judged") if "judged" in scored.columns else F.lit(False)
    rows = scored.where(asked | ~F.coalesce(F.col("needs_judge"), F.lit(False)))
    got = R.band(F.round("score", 1))
    return rows.select("name", "expect", got.alias("band"), F.col("score"), (F.col("expect") == got).alias("holds"))


def rescored(runs: DataFrame, items: DataFrame, rounded: bool = True) -> DataFrame:
    """Saved rows (model, id, response, judge, error) scored anew with their saved judgement; error rows stay as they are.

    Items give budget, required, assumed and audience by id; a saved row without an item fails the job.
    """
    known = items.select("id", "budget", "required", "assumed", "audience", F.lit(True).alias("_known"))
    rows = runs.join(known, "id", "left").withColumn("id", F.when(F.col("_known") | F.col("error").isNotNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no item for saved row "), F.col("id").cast("string"))).cast(runs.schema["id"].dataType))).drop("_known")
    again = with_scores(rows.withColumn("text", F.coalesce("response", F.lit(""))), rounded=rounded)
    fine = F.col("error").isNull()
    scores = {c: F.when(fine, F.col(c)) for c in (*RULES, "coverage", "clarity", "slop", "slop_tax", "score")}
    return again.withColumns(scores).withColumn("error", F.coalesce("error", "judge_error")).drop("text", "judge_error")


def pair_checks(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether the better of each pair scores higher; pairs with a missing side drop out."""
    # both sides look their score up in one join, so that scores are made once; a repeated pair or name gives as many rows as joins would
    each = pairs.groupBy("better", "worse").agg(F.count("*").alias("times"))
    sides = each.select("*", F.inline(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("name")) for side in ("better", "worse")))))
    found = sides.join(scores.select("name", F.struct("score").alias("found")), "name")
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("found"))).alias(f"{side}s")
    both = found.groupBy("better", "worse", "times").agg(of("better"), of("worse"))
    crossed = both.select("better", "worse", "times", F.explode("betters").alias("b"), "worses").select("better", "worse", "times", "b", F.explode("worses").alias("w"))
    return crossed.select("better", "worse", (F.col("b.score") > F.col("w.score")).alias("holds"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_n")).drop("_n")


def rejudged(rows: DataFrame, judgements: DataFrame, key: str) -> DataFrame:
    """The rows with another judge's answers. A row without one fails whatever job writes the result, which then leaves nothing."""
    fresh = rows.drop("judge").join(judgements.select(key, F.col("judge").alias("_fresh")), key, "left")
    gap = F.raise_error(F.concat(F.lit("no new judgement for row "), F.col(key).cast("string"), F.lit("; nothing is replaced")))
    return fresh.withColumn("judge", F.when(F.col("_fresh").isNotNull(), F.col("_fresh")).otherwise(gap.cast("string"))).drop("_fresh")


def unknown_acronyms(docs: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """R3 with a word list as a table: (key, acronym) of the acronyms that aren't a listed word in capitals, a plural s aside."""
    found = docs.select(key, F.explode(R.undefined_acronyms(F.col("text"), F.col("assumed"), F.col("audience"))).alias("acronym"))
    up = F.upper("acronym")
    base = F.when(up.endswith("S") & (F.length(up) > 2), F.substring(up, F.lit(1), F.length(up) - 1)).otherwise(up)
    listed = words.select(F.upper("word").alias("word")).distinct()
    rows = found.withColumns({"_up": up, "_base": base})
    for name in ("_up", "_base"):
        rows = rows.join(listed.withColumnRenamed("word", name), name, "left_anti")
    return rows.select(key, "acronym")
