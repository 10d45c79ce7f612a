"""Every query of the engine, with the SQL that gives the same rows where SQL can.

The test tables hold invented words, in which no phrase of the lexicon occurs. The queries
therefore append one of eleven passages to each text, by id, and turn accented letters into
plain ones, as the SQL engine's patterns know ASCII words only. Both sides do the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import fixed as X
from prosegauge.functions import prompts
from prosegauge.functions import rules as R
from prosegauge.functions import text as T
from prosegauge.operators import scoring, sentences, trajectory
from prosegauge.plans import sql as S
from prosegauge.sources.tables import spread

PASSAGES = (
    " We delve into the robust realm. It's not a tool. It's a partner, and the plan was approved because it is able to scale.",
    "\nGreat question! In order to win, we leverage synergies. The report was reviewed by the board while costs have been identified.",
    '\n## Summary\n- **Scope** : wide\n- item two\n1. third\nHe said "let us delve in" and left. `delve` stays out.',
    "\nShort one here. Another short one. Third short one. Fourth is this one.\nIt was careful, thoughtful, and effective. New roads, new rails, new ports.",
    " The API uses KPI (key performance index) and SLA and TLS. Improve throughput, which means speed, and bandwidth too.",
    "\n```\ndelve robust\n```\n**Overview**\nThere is a plan that works. It is worth noting that prior to launch a majority of users left; we waited.",
    " Not only fast, but also cheap. This isn't luck, it's work. Less talk, more action. From dawn to dusk, from here to there, it stands as proof, highlighting effort, no fuss.",
    "\nWe ship today, but they receive it tomorrow, so we must prepare. After the team merged the change the tests failed. I think it will probably work.",
    "\nThe same plain line appears twice in this text. The same plain line appears twice in this text. At the end of the day the future looks bright.",
    " Rightsizing and headwinds lead to challenging quarter results — observers have cited this. Here's the kicker: let that sink in.",
    "",
)
_FOLD = r"[\x{00C0}-\x{024F}]"
_SUFFIX = "[" + ", ".join(S.q(p) for p in PASSAGES) + "]"
DOCS = f"docs AS MATERIALIZED (SELECT doc_id, source, lang, regexp_replace(coalesce(text, '') || {_SUFFIX}[doc_id % 11 + 1], '{_FOLD}', 'q', 'g') AS text FROM documents)"
#: What an item asks of a document, by its id; one expression for both engines.
ITEM = {
    "budget": "100 + 50 * (doc_id % 8)",
    "required": "3 + doc_id % 3",
    "delivered": "doc_id % (4 + doc_id % 3)",
    "audience": "CASE WHEN doc_id % 3 = 0 THEN 'a software engineer' ELSE 'a school teacher' END",
}
_PICK = lambda k, *v: f"CASE doc_id % {k} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v[:-1])) + f" ELSE '{v[-1]}' END"
#: Judge answers: plain, fenced and chatty ones, with missing labels and quotes.
JUDGE = " || ".join(
    (
        _PICK(4, "", "```json ", "Sure: ", ""),
        "'{\"facts_delivered\": '",
        _PICK(5, "[true, true, true]", '[true, false, "false", 0]', "[]", '[true, null, "yes", 1]', "[false]"),
        "', \"clarity\": \"'", _PICK(3, "clear", "opaque", "needs_a_reread"),
        "'\", \"clarity_quote\": \"'", _PICK(2, "one two three four", "too short"),
        "'\", \"imagery\": \"'", _PICK(3, "needed_an_image", "concrete", "abstract_but_fine"),
        "'\", \"imagery_suggestion\": \"'", _PICK(2, " ", "a river"),
        "'\", \"form\": \"'", _PICK(4, "fits", "report_theater", "some_scaffolding", "other"),
        "'\", \"form_quote\": \"'", _PICK(3, "two words", "", "## x"),
        "'\"'",
        _PICK(5, "", ', "economy": "bloated", "economy_quote": "this goes on and on"', ', "jargon": "some_jargon", "jargon_quote": "SLA"', ', "filler": "padded"', ', "simple_words": "some_complex", "simple_words_quote": "utilize it"'),
        "'}'",
        _PICK(4, "", "``` ", " Note: see {above}", ""),
    )
)

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    passage = F.element_at(F.array(*map(F.lit, PASSAGES)), (F.col("doc_id") % 11 + 1).cast("int"))
    text = F.regexp_replace(F.concat(F.coalesce("text", F.lit("")), passage), _FOLD, "q")
    rows = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return rows.select("doc_id", "source", "lang", text.alias("text"))


def items(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.expr(e) for k, e in ITEM.items()}).withColumn("assumed", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("Throughput"), F.lit("sla"))).otherwise(F.array().cast("array<string>")))


_ITEMS = "items AS MATERIALIZED (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in ITEM.items()) + ", CASE WHEN doc_id % 4 = 0 THEN ['Throughput', 'sla'] ELSE [] END AS assumed FROM docs)"
_r = lambda c, n=6: F.round(c, n)


@query(f"WITH {DOCS} SELECT doc_id, {S.words('text')} AS n_words FROM docs")
def word_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("n_words"))


@query(f"WITH {DOCS} SELECT doc_id, length({S.without_quotes('text')}) AS n_chars FROM docs")
def strip_quoted_lengths(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length(T.stripped_of_quotes(F.col("text"))).alias("n_chars"))


_LONG = lambda names: " UNION ALL ".join(f"SELECT doc_id, '{k}' AS sign, \"{k}\" AS hits FROM slop WHERE \"{k}\" > 0" for k in names)


def _long(spark, sf_dir, names):
    counted = scoring.with_slop(docs(spark, sf_dir))
    pairs = F.array(*(F.struct(F.lit(k).alias("sign"), F.col(f"counts.{k}").alias("hits")) for k in names))
    return counted.select("doc_id", F.inline(F.filter(pairs, lambda p: p["hits"] > 0)))


@query(f"WITH {DOCS}, {S.slop_ctes('docs', 'doc_id')} {_LONG(X.category_terms())}")
def lexicon_hits_by_category(spark, sf_dir):
    return _long(spark, sf_dir, list(X.category_terms()))


@query(f"WITH {DOCS}, {S.slop_ctes('docs', 'doc_id')} {_LONG(X.PHRASING)}")
def pattern_hits(spark, sf_dir):
    return _long(spark, sf_dir, list(X.PHRASING))


@query(f"WITH {DOCS} SELECT doc_id, {S.triples('text')} AS triples FROM docs")
def rule_of_three(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.triples(F.col("text"))).alias("triples"))


@query(f"WITH {DOCS} SELECT doc_id, {S.fragments('text')} AS fragments FROM docs")
def noun_list_fragments(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.noun_fragments(F.col("text"))).alias("fragments"))


@query(f"WITH {DOCS} SELECT doc_id, {S.staccato('text')} AS runs FROM docs")
def staccato_runs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.staccato_runs(F.col("text")).alias("runs"))


@query(
    f"WITH {DOCS}, cut AS (SELECT doc_id, text, list_transform(list_filter({S.split_sentences(S.trimmed('text'))}, lambda s: s <> ''), lambda s: {S.words('s')}) AS lens, {S.words('text')} AS n FROM docs) "
    f"SELECT doc_id, round({S.count('text', '—')} / greatest(n, 1) * 100, 6) AS em_dash_per_100w, "
    "round(CASE WHEN len(lens) > 1 THEN list_aggregate(lens, 'stddev_samp') / list_avg(lens) ELSE 0 END, 6) AS sentence_cv, "
    "round(len(list_filter(lens, lambda x: x <= 4)) / greatest(len(lens), 1), 6) AS frag_ratio, "
    f"round({S.count('text', X.escaped('**') + '[^*]+' + X.escaped('**'))} / greatest(n, 1) * 100, 6) AS bold_per_100w, "
    f"round({S.count('text', ',')} / greatest(len(lens), 1), 6) AS comma_per_sent, {S.staccato('text')} AS staccato_runs FROM cut"
)
def shape_metrics(spark, sf_dir):
    made = T.shape(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", *((c if k == "staccato_runs" else _r(c)).alias(k) for k, c in made.items()))


_TAX = f"least({X.SLOP_TAX_MOST}::DOUBLE, slop / {X.SLOP_CEILING} * {X.SLOP_TAX_MOST})"


@query(f"WITH {DOCS}, {S.slop_ctes('docs', 'doc_id')} SELECT doc_id, round(slop, 6) AS slop_per_1k, round({_TAX}, 6) AS slop_tax FROM slop")
def slop_per_1k(spark, sf_dir):
    return scoring.with_slop(docs(spark, sf_dir)).select("doc_id", _r(F.col("slop")).alias("slop_per_1k"), _r(F.col("slop_tax")).alias("slop_tax"))


@query(
    f"WITH {DOCS}, {S.slop_ctes('docs', 'doc_id, source')}, means AS (SELECT source, count(*) AS n, round(avg(slop), 6) AS slop FROM slop GROUP BY source) "
    "SELECT *, row_number() OVER (ORDER BY slop, source) AS place FROM means"
)
def slop_leaderboard(spark, sf_dir):
    from pyspark.sql import Window

    means = scoring.with_slop(docs(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("n"), _r(F.avg("slop")).alias("slop"))
    return means.withColumn("place", F.row_number().over(Window.orderBy("slop", "source")))


@query(f"WITH {DOCS} SELECT doc_id, {S.scaffold('text')[0]} AS headings, {S.scaffold('text')[1]} AS list_items FROM docs")
def scaffold_counts(spark, sf_dir):
    heads, rows = T.scaffold(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", heads.alias("headings"), rows.alias("list_items"))


@query(f"WITH {DOCS}, {_ITEMS}, c AS (SELECT doc_id, 5 + budget % 30 AS budget, {S.scaffold('text')[0]} AS h, {S.scaffold('text')[1]} AS l FROM items) SELECT doc_id, {S.scaffold_score('h', 'l', 'budget')} AS score FROM c")
def scaffold_score(spark, sf_dir):
    heads, rows = T.scaffold(F.col("text"))
    counted = items(docs(spark, sf_dir)).select("doc_id", (5 + F.col("budget") % 30).alias("budget"), heads.alias("h"), rows.alias("l"))
    return counted.select("doc_id", T.scaffold_score(F.col("h"), F.col("l"), F.col("budget")).alias("score"))


_COVER = lambda facts: f"CASE WHEN {facts} <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {facts}::DOUBLE / required) END"
_ECONOMY = lambda facts, n: f"CASE WHEN {facts} <= 0 THEN 0.0::DOUBLE ELSE 10.0::DOUBLE * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, ({n} - budget)::DOUBLE / budget) / 1.5) * {_COVER(facts)} END"


@query(f"WITH {DOCS}, {_ITEMS} SELECT doc_id, round({_ECONOMY('delivered', S.words('text'))}, 6) AS score, round({_COVER('delivered')}, 6) AS coverage FROM items")
def economy(spark, sf_dir):
    n, facts, need = T.words(F.col("text")), F.col("delivered"), F.col("required")
    return items(docs(spark, sf_dir)).select("doc_id", _r(R.economy(n, facts, need, F.col("budget"))).alias("score"), _r(R.coverage(facts, need)).alias("coverage"))


_BARE = S.without_quotes("text")
_UP = "CASE WHEN ends_with(upper(a), 'S') AND length(a) > 2 THEN upper(a)[:-2] ELSE upper(a) END"
_LIST = lambda v: "[" + ", ".join(map(S.q, v)) + "]"
_EXPERT = f"regexp_matches(audience, {S.q(X.EXPERTS)})"
_ACRONYMS = (
    f"CASE WHEN {_EXPERT} THEN 0 ELSE len(list_filter(list_distinct(regexp_extract_all({_BARE}, {S.q(X.ACRONYM)})), lambda a: NOT list_contains(list_concat(list_transform(assumed, lambda z: upper(z)), {_LIST(X.COMMON_ACRONYMS)}), regexp_replace(a, 's+$', '')) "
    f"AND NOT list_contains({_LIST(X.SHOUTED)}, upper(a)) AND NOT list_contains({_LIST(X.SHOUTED)}, {_UP}) "
    f"AND NOT regexp_matches(text, a || '\\s*\\([^)]{{4,}}\\)') AND NOT regexp_matches(text, '\\([^)]*' || a || '[^)]*\\)'))) END"
)
_TERM = "(?i)\\b(?:" + "|".join(X.escaped(t) for t in sorted(X.JARGON, key=lambda t: (-len(t), t))) + ")\\b"
_NOT_ASSUMED = "lambda t: NOT list_contains(list_transform(assumed, lambda z: lower(z)), lower(regexp_extract(t, {p})))"
_TERMS = (
    f"CASE WHEN {_EXPERT} THEN 0 ELSE len(list_filter(regexp_extract_all({_BARE}, {S.q(_TERM)}), {_NOT_ASSUMED.format(p=S.q(_TERM))})) "
    f"- len(list_filter(regexp_extract_all({_BARE}, {S.q(_TERM + X.GLOSS)}), {_NOT_ASSUMED.format(p=S.q(_TERM))})) END"
)


@query(
    f"WITH {DOCS}, {_ITEMS}, f AS (SELECT doc_id, {S.words('text')} AS n, {_ACRONYMS} AS acronyms, {_TERMS} AS terms FROM items) "
    f"SELECT doc_id, acronyms, terms, round({S.to_10('(acronyms + terms)', 'n', X.JARGON_CEILING)}, 6) AS score FROM f"
)
def jargon(spark, sf_dir):
    given = (F.col("assumed"), F.col("audience"))
    found = items(docs(spark, sf_dir)).select("doc_id", T.words(F.col("text")).alias("n"), F.size(R.undefined_acronyms(F.col("text"), *given)).alias("acronyms"), F.size(R.undefined_terms(F.col("text"), *given)).alias("terms"))
    return found.select("doc_id", "acronyms", "terms", _r(R.to_10(R.per_100(F.col("acronyms") + F.col("terms"), F.col("n")), X.JARGON_CEILING)).alias("score"))


_LOWERED = f"lowered AS MATERIALIZED (SELECT *, {_BARE} AS bare, lower({_BARE}) AS low, {S.words('text')} AS n FROM docs)"


@query(f"WITH {DOCS}, {_LOWERED}, c AS (SELECT doc_id, n, {S.term_hits('low', list(X.SHORT_FORMS))} AS swaps FROM lowered) SELECT doc_id, swaps, round({S.to_10('swaps', 'n', X.SIMPLE_CEILING)}, 6) AS score FROM c")
def simple_words(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("n"), F.lower(T.stripped_of_quotes(F.col("text"))).alias("low")).select("doc_id", "n", R.swaps(F.col("low")).alias("swaps"))
    return found.select("doc_id", "swaps", _r(R.to_10(R.per_100(F.col("swaps"), F.col("n")), X.SIMPLE_CEILING)).alias("score"))


_GRAMMAR = " + ".join(S.any_case("bare", p) for p in X.FILLER_GRAMMAR)


@query(
    f"WITH {DOCS}, {_LOWERED}, c AS (SELECT doc_id, n, {S.term_hits('low', X.PADDING)} AS padding, {S.term_hits('low', X.PRETENTIOUS)} AS pretentious, {S.term_hits('low', X.EUPHEMISMS)} AS euphemism, {_GRAMMAR} AS grammar FROM lowered) "
    f"SELECT doc_id, padding, pretentious, euphemism, grammar, round({S.to_10('(padding + pretentious + grammar + 3 * euphemism)', 'n', X.FILLER_CEILING)}, 6) AS score FROM c"
)
def filler(spark, sf_dir):
    bare = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("n"), T.stripped_of_quotes(F.col("text")).alias("bare"))
    found = bare.select("doc_id", "n", *(c.alias(k) for k, c in R.filler_parts(F.col("bare")).items()))
    parts = {k: F.col(k) for k in ("padding", "pretentious", "euphemism", "grammar")}
    return found.select("doc_id", *parts, _r(R.to_10(R.per_100(R.filler_weight(parts), F.col("n")), X.FILLER_CEILING)).alias("score"))


_BLOB = "regexp_extract(regexp_replace(judge, '```(?:json)?', '', 'g'), '(?s)\\{.*\\}')"
_JUDGED = (
    f"raw AS (SELECT doc_id, {JUDGE} AS judge FROM documents), blobs AS (SELECT doc_id, {_BLOB} AS blob FROM raw), "
    "objects AS MATERIALIZED (SELECT doc_id, CASE WHEN json_valid(blob) THEN blob ELSE regexp_extract(blob, '\\{[^{}]*\\}') END AS o FROM blobs)"
)
_SAID = lambda n: f"coalesce(json_extract_string(o, '$.{n}'), '')"


def _label_sql(name: str) -> str:
    default = X.JUDGE_DEFAULTS.get(name)
    score = f"CASE {_SAID(name)} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in X.JUDGE_LABELS[name].items()) + f" ELSE {'NULL' if default is None else default}::DOUBLE END"
    if name == "imagery":
        return f"CASE WHEN {score} < 7 AND trim({_SAID('imagery_suggestion')}) = '' THEN 7.0::DOUBLE ELSE {score} END"
    return f"CASE WHEN {score} < 10 AND {S.count(_SAID(name + '_quote'), X.QUOTE_WORD)} < {X.QUOTE_WORDS[name]} THEN 10.0::DOUBLE ELSE {score} END"


_FACTS = "len(list_filter(coalesce(json_extract(o, '$.facts_delivered[*]'), []), lambda v: v::VARCHAR NOT IN ('false', '0', '0.0', 'null', '\"\"', '[]', '{}')))"
_JSCORES = f"judged AS MATERIALIZED (SELECT doc_id, {_FACTS} AS facts, " + ", ".join(f"{_label_sql(n)} AS j_{n}" for n in X.JUDGE_LABELS) + " FROM objects)"


@query(f"WITH {_JUDGED}, {_JSCORES} SELECT * FROM judged")
def judge_scores(spark, sf_dir):
    parsed = read(spark, sf_dir, "documents").select("doc_id", R.judge_object(F.expr(JUDGE)).alias("p"))
    made = R.judged_scores(F.col("p"))
    return parsed.select("doc_id", R.facts_delivered(F.col("p")).alias("facts"), *(c.alias(f"j_{k}") for k, c in made.items()))


_SCORED = (
    f"{DOCS}, {_ITEMS}, {S.slop_ctes('docs', 'doc_id')}, {_JUDGED}, {_JSCORES}, "
    f"feats AS MATERIALIZED (SELECT i.doc_id, i.source, budget, required, n_words, slop, j.*, {_ACRONYMS.replace('text', 'i.text')} AS acronyms, {_TERMS.replace('text', 'i.text')} AS terms, "
    f"{S.term_hits('low', list(X.SHORT_FORMS))} AS swaps, {S.term_hits('low', X.PADDING)} + {S.term_hits('low', X.PRETENTIOUS)} + 3 * {S.term_hits('low', X.EUPHEMISMS)} + {_GRAMMAR} AS weight, "
    f"{S.scaffold('i.text')[0]} AS h, {S.scaffold('i.text')[1]} AS l FROM items i JOIN slop s ON i.doc_id = s.doc_id JOIN judged j ON i.doc_id = j.doc_id), "
    f"ruled AS (SELECT doc_id, source, n_words, slop, j_clarity AS rule1, least({_ECONOMY('facts', 'n_words')}, j_economy) AS rule2, least({S.to_10('(acronyms + terms)', 'n_words', 6.0)}, j_jargon) AS rule3, j_imagery AS rule4, "
    f"least({S.to_10('swaps', 'n_words', 5.0)}, j_simple_words) AS rule5, least({S.to_10('weight', 'n_words', 6.0)}, j_filler) AS rule6, least({S.scaffold_score('h', 'l', 'budget')}, j_form) AS rule7, round({_COVER('facts')}, 2) AS coverage FROM feats), "
    "meant AS (SELECT *, (rule1 + rule2 * 0.75 + rule3 + rule4 + rule5 + rule6 + rule7) / 6.75 AS m FROM ruled), "
    f"clear AS (SELECT *, CASE WHEN least(rule1, rule3, rule5, rule6, rule7) < {X.FLOOR} OR coverage < {X.LEAST_COVERAGE} THEN least(m, {X.FLOOR_CAP}::DOUBLE) ELSE m END AS clarity FROM meant), "
    f"scored AS MATERIALIZED (SELECT *, 10 * clarity * (1 - {_TAX}) AS score FROM clear)"
)
_SCORED = _SCORED.replace("j.*", "facts, j_clarity, j_imagery, j_form, j_economy, j_jargon, j_simple_words, j_filler")


def scored(spark, sf_dir):
    return scoring.with_scores(items(docs(spark, sf_dir)).withColumn("judge", F.expr(JUDGE)))


@query(f"WITH {_SCORED} SELECT doc_id, " + ", ".join(f"round({r}, 6) AS {r}" for r in scoring.RULES) + ", coverage, round(clarity, 6) AS clarity, round(score, 6) AS score FROM scored")
def final_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", *(_r(F.col(r)).alias(r) for r in scoring.RULES), "coverage", _r(F.col("clarity")).alias("clarity"), _r(F.col("score")).alias("score"))


_RUNS = (
    "runs AS MATERIALIZED (SELECT s.*, source AS model, doc_id // 20 AS item, CASE WHEN doc_id % 17 = 0 THEN 'failed' END AS error, "
    "CASE doc_id % 4 WHEN 0 THEN round(n_words / 1e6 * 15.0 + 200 / 1e6 * 75.0, 6) WHEN 1 THEN round(n_words / 1e6 * 3.0 + 200 / 1e6 * 15.0, 6) WHEN 2 THEN round(n_words / 1e6 * 0.8 + 200 / 1e6 * 4.0, 6) ELSE 0.0 END AS cost FROM scored s)"
)


def runs(spark, sf_dir):
    name = F.expr(_PICK(4, "a-opus", "a-sonnet", "a-haiku", "other"))
    made = {"model": F.col("source"), "item": F.floor(F.col("doc_id") / 20), "error": F.when(F.col("doc_id") % 17 == 0, "failed"), "cost": R.cost(name, F.col("n_words"), F.lit(200))}
    return scored(spark, sf_dir).withColumns(made)


_MEANS = ", ".join(f"round(avg({c}) FILTER (error IS NULL), 6) AS {c}" for c in ("score", "clarity", "slop", "n_words", *scoring.RULES))
_SUMMARY = f"summary AS (SELECT model, count(*) FILTER (error IS NULL) AS n, count(*) FILTER (error IS NOT NULL) AS errors, {_MEANS}, round(sum(cost) FILTER (error IS NULL), 6) AS cost FROM runs GROUP BY model)"


@query(f"WITH {_SCORED}, {_RUNS}, {_SUMMARY} SELECT * FROM summary")
def run_summary(spark, sf_dir):
    made = scoring.run_summary(runs(spark, sf_dir))
    return made.select("model", "n", "errors", *(_r(F.col(c)).alias(c) for c in made.columns if c not in ("model", "n", "errors")))


@query(f"WITH {_SCORED}, {_RUNS}, {_SUMMARY}, placed AS (SELECT model, n, score, row_number() OVER (PARTITION BY n ORDER BY score DESC, model) AS place FROM summary) SELECT *, CASE WHEN n >= 30 AND place <= 3 THEN place END AS medal FROM placed")
def leaderboard_medals(spark, sf_dir):
    return scoring.ranked(run_summary(spark, sf_dir).select("model", "n", "score"))


@query(f"WITH {_SCORED}, {_RUNS}, {_SUMMARY} SELECT n, count(*) AS models, n >= 30 AS is_full, max(score) AS best, dense_rank() OVER (ORDER BY n DESC) AS block FROM summary GROUP BY n")
def by_sample_size(spark, sf_dir):
    from pyspark.sql import Window

    sizes = run_summary(spark, sf_dir).groupBy("n").agg(F.count("*").alias("models"), F.max("score").alias("best")).withColumn("is_full", F.col("n") >= 30)
    return sizes.withColumn("block", F.dense_rank().over(Window.orderBy(F.col("n").desc())))


#: Each model's rows are its items by id; failed ones leave a gap, so that some models lack an item.
_FIRST_ITEMS = 12


@query(
    f"WITH {_SCORED}, {_RUNS}, placed AS (SELECT model, error, score, n_words, row_number() OVER (PARTITION BY model ORDER BY doc_id) AS place FROM runs), "
    f"had AS (SELECT * FROM placed WHERE error IS NULL AND place <= {_FIRST_ITEMS}) "
    f"SELECT model, count(*) AS n, round(avg(score), 6) AS score, round(avg(n_words), 6) AS n_words FROM had GROUP BY model HAVING count(DISTINCT place) = {_FIRST_ITEMS}"
)
def first_n_comparable(spark, sf_dir):
    from pyspark.sql import Window

    rows = runs(spark, sf_dir).withColumn("item", F.row_number().over(Window.partitionBy("model").orderBy("doc_id")))
    return scoring.first_n(rows, _FIRST_ITEMS).select("model", "n", _r(F.col("score")).alias("score"), _r(F.col("n_words")).alias("n_words"))


@query(f"WITH {_SCORED} SELECT CASE WHEN score < 70 THEN 'low' WHEN score < 85 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM scored GROUP BY ALL")
def bands(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(R.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {_SCORED} SELECT a.doc_id::VARCHAR AS better, b.doc_id::VARCHAR AS worse, round(a.score, 6) > round(b.score, 6) AS holds FROM scored a JOIN scored b ON b.doc_id = a.doc_id + 7")
def pair_checks(spark, sf_dir):
    names = scored(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), _r(F.col("score")).alias("score"))
    pairs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("better"), (F.col("doc_id") + 7).cast("string").alias("worse"))
    return scoring.pair_checks(names, pairs)


@query(f"WITH {_SCORED}, fresh AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 5.0 ELSE 0.0 END AS fresh FROM scored) SELECT source, count(*) AS n, round(avg(fresh - rule1), 6) AS delta FROM scored JOIN fresh USING (doc_id) GROUP BY source")
def rejudge_delta(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", "source", "rule1", "judge")
    labels = _PICK(3, "clear", "needs_a_reread", "opaque")
    fresh = rows.select("doc_id", F.expr("'{\"clarity\": \"' || " + labels + " || '\", \"clarity_quote\": \"these are four words\"}'").alias("judge"))
    again = scoring.rejudged(rows, fresh, "doc_id").withColumn("new", R.judged_scores(R.judge_object(F.col("judge")))["clarity"])
    return again.groupBy("source").agg(F.count("*").alias("n"), _r(F.avg(F.col("new") - F.col("rule1"))).alias("delta"))


_SENTS = f"{DOCS}, {S.sentence_ctes('docs', 'doc_id')}"


_ROUNDED = _SCORED.replace(
    "ruled AS (", "digits AS MATERIALIZED (SELECT * REPLACE (round(slop, 1) AS slop) FROM feats), ruled AS ("
).replace(" AS coverage FROM feats)", " AS coverage FROM digits)")
for _rule, _was in (("rule2", _ECONOMY("facts", "n_words")), ("rule3", S.to_10("(acronyms + terms)", "n_words", 6.0)), ("rule5", S.to_10("swaps", "n_words", 5.0)), ("rule6", S.to_10("weight", "n_words", 6.0))):
    _ROUNDED = _ROUNDED.replace(f"least({_was}, j_", f"least(round({_was}, 1), j_")


@query(
    f"WITH {_ROUNDED} SELECT doc_id, " + ", ".join(scoring.RULES)
    + ", round(clarity, 2) AS clarity, round(slop, 1) AS slop, round(score, 1) AS score FROM scored"
)
def rounded_scores(spark, sf_dir):
    """Final scores with the digits of a report."""
    made = scoring.with_scores(items(docs(spark, sf_dir)).withColumn("judge", F.expr(JUDGE)), rounded=True)
    return made.select("doc_id", *scoring.RULES, "clarity", "slop", "score")


_FREE = (
    f"{DOCS}, {_ITEMS}, {S.slop_ctes('docs', 'doc_id')}, feats AS MATERIALIZED (SELECT i.doc_id, budget, required, n_words, slop, {_ACRONYMS.replace('text', 'i.text')} AS acronyms, {_TERMS.replace('text', 'i.text')} AS terms, "
    f"{S.term_hits('low', list(X.SHORT_FORMS))} AS swaps, {S.term_hits('low', X.PADDING)} + {S.term_hits('low', X.PRETENTIOUS)} + 3 * {S.term_hits('low', X.EUPHEMISMS)} + {_GRAMMAR} AS weight, "
    f"{S.scaffold('i.text')[0]} AS h, {S.scaffold('i.text')[1]} AS l FROM items i JOIN slop s ON i.doc_id = s.doc_id), "
    f"ruled AS (SELECT doc_id, slop, 10.0::DOUBLE AS rule1, {_ECONOMY('required', 'n_words')} AS rule2, {S.to_10('(acronyms + terms)', 'n_words', 6.0)} AS rule3, 10.0::DOUBLE AS rule4, {S.to_10('swaps', 'n_words', 5.0)} AS rule5, "
    f"{S.to_10('weight', 'n_words', 6.0)} AS rule6, least(10.0::DOUBLE, {S.scaffold_score('h', 'l', 'budget')}) AS rule7 FROM feats), "
    "meant AS (SELECT *, (rule1 + rule2 * 0.75 + rule3 + rule4 + rule5 + rule6 + rule7) / 6.75 AS m FROM ruled), "
    f"free AS (SELECT doc_id, 10 * CASE WHEN least(rule1, rule3, rule5, rule6, rule7) < {X.FLOOR} THEN least(m, {X.FLOOR_CAP}::DOUBLE) ELSE m END * (1 - {_TAX}) AS score FROM meant)"
)
_BAND = "CASE WHEN round(score, 1) < 70 THEN 'low' WHEN round(score, 1) < 85 THEN 'mid' ELSE 'high' END"
_EXPECT = _PICK(3, "low", "mid", "high")


@query(f"WITH {_FREE} SELECT doc_id::VARCHAR AS name, {_EXPECT} AS expect, {_BAND} AS band, round(score, 6) AS score, {_EXPECT} = {_BAND} AS holds FROM free WHERE doc_id % 4 <> 1")
def control_checks(spark, sf_dir):
    """Cases scored without a judge: every document is one; those that need a judge are skipped."""
    cases = items(docs(spark, sf_dir)).withColumns({"name": F.col("doc_id").cast("string"), "expect": F.expr(_EXPECT), "needs_judge": F.when(F.col("doc_id") % 4 < 2, F.col("doc_id") % 4 == 1)})
    return scoring.control_checks(scoring.with_scores(cases, judged=False)).withColumn("score", _r(F.col("score")))


#: Judge answers of which some hold no object: refusals, a list, an object that is cut off.
_ODD_JUDGE = _PICK(6, '{"clarity": "opaque", "clarity_quote": "one two three four"}', "no object at all", '[1, 2]', '{"clarity": "clear"', 'Sure: {"clarity": "needs_a_reread", "clarity_quote": "these are four words"} bye', "")


@query(f"WITH raw AS (SELECT doc_id, {_ODD_JUDGE} AS judge FROM documents) SELECT doc_id, doc_id % 6 NOT IN (0, 4) AS failed, CASE doc_id % 6 WHEN 0 THEN 0.0::DOUBLE WHEN 4 THEN 5.0::DOUBLE END AS rule1 FROM raw")
def judge_errors(spark, sf_dir):
    """Judge answers without an object are errors and give no score."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(_ODD_JUDGE).alias("judge")).withColumn("p", R.judge_object(F.col("judge")))
    rows = rows.withColumn("wrong", R.judge_error(F.col("judge"), F.col("p")))
    return rows.select("doc_id", F.col("wrong").isNotNull().alias("failed"), F.when(F.col("wrong").isNull(), R.judged_scores(F.col("p"))["clarity"]).alias("rule1"))


@query(f"WITH {_ROUNDED}, {_RUNS.replace('round(n_words', 'round(n_words')} SELECT model, count(*) FILTER (error IS NULL) AS n, count(*) FILTER (error IS NOT NULL) AS errors, round(avg(round(score, 1)) FILTER (error IS NULL), 6) AS score, round(avg(round(clarity, 2)) FILTER (error IS NULL), 6) AS clarity, round(avg(slop) FILTER (error IS NULL), 6) AS slop FROM runs GROUP BY model")
def rescore(spark, sf_dir):
    """Saved rows scored anew with their saved judgements, and the summary made again."""
    saved = items(docs(spark, sf_dir)).withColumn("judge", F.expr(JUDGE))
    rows = saved.select(F.col("source").alias("model"), F.col("doc_id").alias("id"), F.col("text").alias("response"), "judge", F.when(F.col("doc_id") % 17 == 0, "failed").alias("error"))
    known = saved.select(F.col("doc_id").alias("id"), "budget", "required", "assumed", "audience")
    made = scoring.run_summary(scoring.rescored(rows, known).withColumn("cost", F.lit(0.0)))
    return made.select("model", "n", "errors", *(_r(F.col(c)).alias(c) for c in ("score", "clarity", "slop")))


def sents(spark, sf_dir):
    return sentences.sentence_rows(docs(spark, sf_dir))


@query(f"WITH {_SENTS}, {S.mass_ctes('sents', 'doc_id')} SELECT doc_id, pos, clauses, round(mass, 6) AS mass FROM mass")
def sentence_mass(spark, sf_dir):
    return sentences.with_mass(sents(spark, sf_dir)).select("doc_id", "pos", "clauses", _r(F.col("mass")).alias("mass"))


_EROSION = f"sum(CASE WHEN clauses > {X.MANY_CLAUSES} THEN mass ELSE 0 END) / sum(mass)"


@query(f"WITH {_SENTS}, {S.mass_ctes('sents', 'doc_id')} SELECT doc_id, coalesce(round({_EROSION}, 6), 0) AS erosion, count(mass.doc_id) AS n_sentences FROM docs LEFT JOIN mass USING (doc_id) GROUP BY doc_id")
def erosion(spark, sf_dir):
    return sentences.erosion(docs(spark, sf_dir)).withColumn("erosion", _r(F.col("erosion")))


@query(f"WITH {_SENTS}, {S.clone_ctes('sents', 'doc_id')} SELECT * FROM clones")
def clones(spark, sf_dir):
    return sentences.clones_in(docs(spark, sf_dir))


_VERBOSE = f"{_SENTS}, {S.clone_ctes('sents', 'doc_id')}, each AS (SELECT doc_id, pos, sentence AS text FROM sents), {S.slop_ctes('each', 'doc_id, pos')}"


_VERBOSITY = "shares AS (SELECT s.doc_id, avg(CASE WHEN c.pos IS NOT NULL OR round(slop, 1) > 0 THEN 1 ELSE 0 END) AS verbosity FROM slop s LEFT JOIN clones c ON s.doc_id = c.doc_id AND s.pos = c.pos GROUP BY s.doc_id)"


@query(f"WITH {_VERBOSE}, {_VERBOSITY} SELECT doc_id, coalesce(round(verbosity, 6), 0) AS verbosity FROM docs LEFT JOIN shares USING (doc_id)")
def verbosity(spark, sf_dir):
    return sentences.verbosity(docs(spark, sf_dir)).withColumn("verbosity", _r(F.col("verbosity")))


@query(
    f"WITH {_VERBOSE}, {_VERBOSITY}, {S.mass_ctes('sents', 'doc_id')}, worn AS (SELECT doc_id, {_EROSION} AS erosion FROM mass GROUP BY doc_id) "
    "SELECT doc_id, coalesce(round(erosion, 3), 0) AS erosion, coalesce(round(verbosity, 3), 0) AS verbosity FROM docs LEFT JOIN worn USING (doc_id) LEFT JOIN shares USING (doc_id)"
)
def measure(spark, sf_dir):
    """Erosion and verbosity with the digits of a report."""
    return sentences.measure(docs(spark, sf_dir))


#: Assistant turns are the versions of a chain, user turns the specifications it should follow.
_CHAIN = (
    f"steps AS MATERIALIZED (SELECT conv_id, turn AS checkpoint, conv_id * 1000 + turn AS doc_id, regexp_replace(coalesce(text, '') || {_SUFFIX}[(conv_id + 3 * turn) % 11 + 1], '{_FOLD}', 'q', 'g') AS text FROM conversations WHERE role = 'assistant'), "
    "specs AS (SELECT conv_id, count(*) AS expected FROM conversations WHERE role = 'user' GROUP BY conv_id)"
)


def steps(spark, sf_dir):
    at = ((F.col("conv_id") + 3 * F.col("turn")) % 11 + 1).cast("int")
    text = F.regexp_replace(F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, PASSAGES)), at)), _FOLD, "q")
    return read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("checkpoint"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text"))


def _drifts(spark, sf_dir):
    rows = steps(spark, sf_dir)
    named = rows.withColumn("key", F.struct("conv_id", "checkpoint", T.words(F.col("text")).cast("double").alias("words")))
    valued = sentences.erosion(named, "key").select("key.*", "erosion")
    expected = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("expected"))
    return trajectory.chains(valued, "conv_id", ["erosion", "words"], expected)


_DRIFTS = (
    f"{_CHAIN}, {S.sentence_ctes('steps', 'doc_id')}, {S.mass_ctes('sents', 'doc_id')}, worn AS (SELECT doc_id, {_EROSION} AS erosion FROM mass GROUP BY doc_id), "
    f"valued AS (SELECT conv_id, checkpoint, coalesce(erosion, 0.0) AS erosion, {S.words('text')}::DOUBLE AS words FROM steps LEFT JOIN worn USING (doc_id)), "
    "per AS (SELECT conv_id, count(*) AS n, " + ", ".join(f"CASE WHEN count(*) < 2 THEN 0.0 ELSE (max_by({v}, checkpoint) - min_by({v}, checkpoint)) / (count(*) - 1) END AS {v}_drift" for v in ("erosion", "words")) + " FROM valued GROUP BY conv_id), "
    "drifts AS MATERIALIZED (SELECT * FROM per JOIN specs USING (conv_id))"
)


@query(f"WITH {_DRIFTS} SELECT conv_id, n, expected, round(erosion_drift, 6) AS erosion_drift, round(words_drift, 6) AS words_drift FROM drifts")
def trajectory_drift(spark, sf_dir):
    return _drifts(spark, sf_dir).select("conv_id", "n", "expected", _r(F.col("erosion_drift")).alias("erosion_drift"), _r(F.col("words_drift")).alias("words_drift"))


_WHOLE = "n >= expected AND n >= 2"


@query(
    f"WITH {_DRIFTS} SELECT count(*) FILTER ({_WHOLE}) AS complete, count(*) FILTER (n < expected) AS truncated, "
    + ", ".join(f"round(avg({v}_drift) FILTER ({_WHOLE}), 6) AS {v}_drift, round(100 * avg(CASE WHEN {v}_drift > 0 THEN 1 ELSE 0 END) FILTER ({_WHOLE}), 6) AS pct_{v}_rising" for v in ("erosion", "words"))
    + " FROM drifts"
)
def drift_summary(spark, sf_dir):
    made = trajectory.summary(_drifts(spark, sf_dir), ["erosion", "words"])
    return made.select("complete", "truncated", *(_r(F.col(c)).alias(c) for c in made.columns[2:]))


@query(f"WITH {_CHAIN} SELECT conv_id, count(checkpoint) AS n, expected FROM specs LEFT JOIN steps USING (conv_id) GROUP BY conv_id, expected HAVING count(checkpoint) < expected")
def truncated_chains(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    made = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n"), F.count_if(F.col("role") == "user").alias("expected"))
    return made.where((F.col("expected") > 0) & (F.col("n") < F.col("expected")))


@query(
    "SELECT conv_id, turn, count(*) OVER w AS n_specs, sum(length(coalesce(text, ''))) OVER w AS n_chars, coalesce(length(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), 0) AS prior_chars FROM conversations WHERE role = 'user' "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def cumulative_specs(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text", F.array(F.coalesce("text", F.lit(""))).alias("asks"))
    every = trajectory.cumulative(trajectory.with_prior(rows, "conv_id", "turn", "text"), "conv_id", "turn", "asks")
    return every.select("conv_id", "turn", F.size("asks").cast("long").alias("n_specs"), F.aggregate("asks", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"), F.coalesce(F.length("prior"), F.lit(0)).cast("long").alias("prior_chars"))


@query(
    "WITH said AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'), "
    "listed AS (SELECT *, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS specs, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM said), "
    "told AS (SELECT *, array_to_string(list_transform(range(1, len(specs) + 1), lambda i: i || '. ' || specs[i]), chr(10)) AS judged, array_to_string(list_transform(range(1, len(specs)), lambda i: i || '. ' || specs[i]), chr(10)) AS before FROM listed) "
    "SELECT conv_id, turn, CASE WHEN len(specs) = 1 THEN length(specs[1]) ELSE length(judged) END AS judged_chars, CASE WHEN prior IS NULL THEN length(text) ELSE length(prior) + length(before) + length(text) END AS filled_chars FROM told"
)
def chain_prompts(spark, sf_dir):
    """What a chain's model and judge are asked at each step: lengths of what is filled in."""
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("asks", F.array("text"))
    every = trajectory.cumulative(trajectory.with_prior(rows, "conv_id", "turn", "text"), "conv_id", "turn", "asks")
    # the frame around what is filled in has a fixed length
    frame = every.withColumns({"made": F.length(prompts.extend_prompt(F.col("prior"), F.col("asks"))), "bare": F.length(prompts.extend_prompt(F.when(F.col("prior").isNotNull(), ""), F.transform("asks", lambda x: F.lit(""))))})
    marks = F.aggregate(F.sequence(F.lit(1), F.size("asks")), F.lit(0), lambda n, i: n + F.when(i < F.size("asks"), F.length(i.cast("string")) + F.when(i > 1, 3).otherwise(2)).otherwise(0))
    filled = F.when(F.col("prior").isNull(), F.length("text")).otherwise(F.col("made") - F.col("bare") + marks)
    return frame.select("conv_id", "turn", F.length(prompts.judged_prompt(F.col("asks"))).cast("long").alias("judged_chars"), filled.cast("long").alias("filled_chars"))


@query(
    "WITH steps AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'failed' END AS error FROM conversations) SELECT conv_id, turn FROM (SELECT *, coalesce(max(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM steps) WHERE broken = 0"
)
def chain_break(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 3, "failed").alias("error"))
    return trajectory.until_error(rows, "conv_id", "turn").select("conv_id", "turn")


@query(
    f"WITH {DOCS}, {S.slop_ctes('docs', 'doc_id, source')} SELECT source, coalesce(quality, -1) AS quality, count(*) AS n, round(avg(slop), 6) AS slop FROM slop LEFT JOIN labels USING (doc_id) GROUP BY ALL"
)
def slop_by_label(spark, sf_dir):
    rows = scoring.with_slop(docs(spark, sf_dir)).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source", F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count("*").alias("n"), _r(F.avg("slop")).alias("slop"))


@query(
    "SELECT 'labelled' AS side, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
)
def label_join_semi_anti(spark, sf_dir):
    rows, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    part = lambda how, name: rows.join(labels, "doc_id", how).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return part("left_semi", "labelled").unionByName(part("left_anti", "unlabelled"))


_PROBES = _PICK(6, "1. NONE. 2. I am a model.", "1. I can use terminal and web_search. 2. A model.", "1. I do not have terminal access. 2. A model.", "1. none 2. I am a coding agent", "1. none 2. I am not a coding agent", "No third-party tools.") + " || CASE doc_id % 2 WHEN 0 THEN chr(10) || '2. terminal' ELSE '' END"
_FIRST = f"lower(string_split(regexp_replace(reply, {S.q(X.SECOND_ANSWER)}, chr(1)), chr(1))[1])"


@query(
    f"WITH probes AS (SELECT doc_id, {_PROBES} AS reply FROM documents) SELECT doc_id, ((" + " OR ".join(f"contains({_FIRST}, '{t}')" for t in X.TOOL_NAMES)
    + f") AND NOT regexp_matches({_FIRST}, {S.q(X.DENIAL)})) OR (regexp_matches(lower(reply), {S.q(X.IS_AGENT)}) AND NOT regexp_matches(lower(reply), {S.q(X.IS_NO_AGENT)})) AS contaminated FROM probes"
)
def contamination_gate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", R.contaminated(F.expr(_PROBES)).alias("contaminated"))
