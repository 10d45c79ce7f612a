import random

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import fixed as X
from prosegauge.functions import prompts
from prosegauge.functions import rules as R
from prosegauge.functions import text as T
from prosegauge.operators import scoring, sentences, trajectory
from tests import oracle_py as P

BITS = ["We delve into it.", "robust", " ", "\n", "Go now fast.", "Stop it here.", "Run to me.", "- item one", "## Head", "**Bold**", "`delve`", '"delve"', "```\nx\n```",
        "careful, thoughtful, and effective", "New roads, new rails, new ports.", "that the team was late again", "if", ";", "which", "load-bearing", "Ünïcode", "1. first", "a b c d e f"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = [" ".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    return ["", " ", *made, "word " * 3000]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def column(frame, made):
    return [r[0] for r in frame.orderBy("doc_id").select(made).collect()]


def test_counts_match_plain_versions(frame, texts):
    t = F.col("text")
    assert column(frame, T.words(t)) == [len(x.split()) for x in texts]
    assert column(frame, T.stripped_of_quotes(t)) == [P.bare(x) for x in texts]
    low = F.lower(T.stripped_of_quotes(t))
    for name, terms in X.category_terms().items():
        assert column(frame, T.term_hits(low, terms)) == [P.term_hits(P.bare(x).lower(), terms) for x in texts], name


def test_structure_matches_plain_versions(frame, texts):
    t = F.col("text")
    assert column(frame, T.staccato_runs(t)) == [P.staccato(x) for x in texts]
    assert column(frame, T.sentences(t)) == [P.sentences(x) for x in texts]
    found = {}
    for doc, pos in sentences.clones(sentences.sentence_rows(frame)).collect():
        found.setdefault(doc, []).append(pos)
    assert [sorted(found.get(i, [])) for i in range(len(texts))] == [P.clones(x) for x in texts]


def one(spark, made, **columns):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
    return row.select(made).collect()[0][0]


def test_subordinates(spark):
    for s in ("evict that price key now", "We said that the team was late again", "If it rains, leave", "despite rising costs", "after we had gone home"):
        assert one(spark, T.subordinates(F.col("s")), s=s) == P.subordinates(s)


@pytest.mark.parametrize("text,n", [("One two. Three four.", 0), ("One two. Three four. Five six.", 1), ("One two? Three four? Five six?", 0), ("One two.\nThree four.\nFive six.", 1), ("One two.\n- x\nThree four.\nFive six.", 0)])
def test_staccato_contract(spark, text, n):
    assert one(spark, T.staccato_runs(F.col("t")), t=text) == n


def test_clauses_contract(spark):
    clause = lambda s: one(spark, T.clauses(F.col("s")), s=s)
    assert clause("circle, triangle, square, rectangle") == 1
    assert clause("We ship today, but they receive it tomorrow, so we must prepare") == 3


def test_scaffold_contract(spark):
    heads, items = T.scaffold(F.col("t"))
    text = "# A\n**Label**\n```\n# not\n- not\n```\n- x\n2. y\nplain"
    assert (one(spark, heads, t=text), one(spark, items, t=text)) == (2, 2)
    score = lambda h, l, b: one(spark, T.scaffold_score(F.col("h"), F.col("l"), F.col("b")), h=h, l=l, b=b)  # noqa: E731, E741
    assert score(3, 8, 100) == 10.0 and score(12, 0, 100) == 0.0 and score(0, 19, 100) == 5.0


def test_economy_and_coverage(spark):
    eco = lambda n, f, r, b: one(spark, R.economy(F.col("n"), F.col("f"), F.col("r"), F.col("b")), n=n, f=f, r=r, b=b)
    assert eco(100, 0, 3, 100) == 0.0
    assert eco(90, 9, 3, 100) == 10.0
    assert eco(250, 3, 3, 100) == pytest.approx(5.0)
    assert eco(375, 1, 1, 0) == pytest.approx(5.0)


def judge(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string").select(R.judge_object(F.col("raw")).alias("p"))
    return df.select(R.facts_delivered(F.col("p")).alias("facts"), *(c.alias(k) for k, c in R.judged_scores(F.col("p")).items())).collect()[0]


def test_judge(spark):
    plain = judge(spark, '```json\n{"facts_delivered": [true, "false", 0, null, [], {"a": 1}], "clarity": "opaque", "clarity_quote": "these are four words", "economy": "bloated"}\n```')
    assert (plain.facts, plain.clarity, plain.economy, plain.imagery, plain.form, plain.jargon) == (3, 0.0, 10.0, 7.0, 10.0, None)
    chatty = judge(spark, '{"facts_delivered": [true], "imagery": "needed_an_image", "imagery_suggestion": "a river"} Note: {x}')
    assert (chatty.facts, chatty.imagery) == (1, 3.0)
    assert judge(spark, "no object at all").facts == 0


def test_jargon_contract(spark):
    found = lambda text, assumed=(), who="": one(spark, R.undefined_terms(F.col("t"), F.col("a"), F.col("w")), t=text, a=list(assumed) or [""], w=who)
    assert found("Our throughput fell.") == ["throughput"]
    assert found("Our throughput (speed) fell; throughput, which means speed.") == []
    assert found("Our throughput fell.", ["Throughput"]) == [] and found("Our throughput fell.", who="a developer") == []
    odd = lambda text: sorted(one(spark, R.undefined_acronyms(F.col("t"), F.array(F.lit("sla")), F.lit("")), t=text))
    assert odd("SLA and TLS and TLS and SHAPES and KPI (key index) and APIs") == ["TLS"]


def test_probe(spark):
    bad = lambda reply: one(spark, R.contaminated(F.col("r")), r=reply)
    assert bad("1. I use terminal") and not bad("1. I have no access to terminal") and not bad("1. NONE\n2. terminal")
    assert bad("1. none. I am a coding agent") and not bad("1. none. I am not an agent")


def test_trend_and_chains(spark):
    rows = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.3), (2, 1, 0.5), (3, 1, 1.0), (3, 2, 0.0)], "c long, checkpoint long, v double")
    expected = spark.createDataFrame([(1, 3), (2, 2), (3, 2)], "c long, expected long")
    per = trajectory.chains(rows, "c", ["v"], expected)
    assert {r.c: round(r.v_drift, 6) for r in per.collect()} == {1: 0.1, 2: 0.0, 3: -1.0}
    done = trajectory.summary(per, ["v"]).collect()[0]
    assert (done.complete, done.truncated, done.pct_v_rising) == (2, 1, 50.0)


def test_rejudge_refuses_gaps(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, judge string")
    with pytest.raises(Exception, match="no new judgement for row 2"):
        scoring.rejudged(rows, rows.where("id = 1"), "id").write.parquet(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.parquet"))
    assert sorted(map(tuple, scoring.rejudged(rows, rows.withColumn("judge", F.lit("new")), "id").collect())) == [(1, "new"), (2, "new")]


def test_first_n_drops_short_models(spark):
    rows = spark.createDataFrame([("a", 1, None, 5.0, 3), ("a", 2, None, 7.0, 3), ("b", 1, None, 9.0, 3)], "model string, item long, error string, score double, n_words int")
    assert [(r.model, r.score) for r in scoring.first_n(rows, 2).collect()] == [("a", 6.0)]
    assert [r.item for r in scoring.limited(rows.where("model = 'a'"), 1, "item").collect()] == [1]


def test_gates_let_through_texts_without_apostrophes(spark):
    said = {
        "not_x_but_y": "It was not just quick, but also cheap", "antithesis": "It's not a tool. Its a partner", "isnt_its": "This is not a tool, it is a partner",
        "less_more": "less noise, more signal", "copulative": "It serves as a base", "trailing_participle": "It grew, highlighting the need",
        "false_range": "from cats to dogs, from here", "tailing_negation": "Plain, no fuss", "inline_header_list": "- **Name**: text", "artifact": "see turn0search1",
        "agentless_passive": "It was taken",
    }
    said = [*said.items()] + [("antithesis", "Its not a bug, thats a feature here"), ("antithesis", "that not one, this's two")]
    frame = spark.createDataFrame(said, "name string, text string")
    for name, text in said:
        row = frame.where(F.col("text") == text).select(F.lower("text").rlike(X.PHRASING_NEEDS[name]).alias("gate"), F.col("text").rlike("(?i)" + X.PHRASING[name]).alias("hit")).first()
        assert row.hit and row.gate, (name, text)
    assert {n for n, _ in said} == set(X.PHRASING_NEEDS)


def test_gates_never_lose_a_match(spark):
    """Random texts of the patterns' own words: a gated count is the ungated one."""
    rng = random.Random(9)
    words = """not just only merely but also it's its it this that this's the tool isn't wasn't is less more serves stands as boasts highlighting
    ensuring from to no fuss wasted guessing has been were was are had fully taken identified by oaicite turn1search2 [cite: 3] grok_card - **A** : , . ; , , a b""".split()
    texts = ["".join(rng.choice(words) + rng.choice((" ", " ", " ", "\n", "  ", "", ", ", " \u00a0")) for _ in range(rng.randint(2, 14))) for _ in range(4000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    made = []
    for name, needs in X.PHRASING_NEEDS.items():
        pattern = X.PHRASING[name] + (rf"(?!{X.AGENT})" if name == "agentless_passive" else "")
        hit, gate = T.count_any_case(F.col("t"), pattern) > 0, F.lower("t").rlike(needs)
        made += [F.count_if(hit & ~gate).alias(f"{name}_lost"), F.count_if(hit).alias(f"{name}_hits")]
    got = frame.agg(*made).first().asDict()
    assert [n for n in X.PHRASING_NEEDS if got[f"{n}_lost"]] == [] and sum(got[f"{n}_hits"] > 0 for n in X.PHRASING_NEEDS) >= 6
    lists = {k: v for k, v in X.category_terms().items()} | {"short": list(X.SHORT_FORMS), "padding": X.PADDING, "pretentious": X.PRETENTIOUS, "euphemism": X.EUPHEMISMS}
    terms = [t for v in lists.values() for t in v]
    said = spark.createDataFrame([(rng.choice((" ", "x ", "-", "_", "9", "(")) + t + rng.choice((" ", "", "a", ".", "-b", "_")),) for t in terms for _ in range(3)], "t string")
    joints = (" ", "-", ", ", "\x01", "\u0301", "\u00e9", "_", "", "-to-end ", ". ", "\n")
    mixed = ["".join(rng.choice(terms) + rng.choice(joints) for _ in range(rng.randint(2, 12))) for _ in range(1500)]
    said = said.union(spark.createDataFrame([(t,) for t in [*mixed, "end-to-end-to-end", "an end-to-end-to-end-to-end end-to-end", ""]], "t string"))
    lost = said.agg(*(F.count_if((sum((T.count(F.col("t"), X.term_pattern(t)) for t in v), F.lit(0)) != T.term_hits(F.col("t"), v))).alias(k) for k, v in lists.items())).first()
    assert set(lost) == {0}


def test_judge_errors_and_free_scores(spark):
    rows = [(1, '{"clarity": "clear"}'), (2, "I cannot judge this."), (3, None), (4, "[1, 2]")]
    docs = spark.createDataFrame(rows, "id long, judge string").withColumns({"text": F.lit("Plain words here."), "budget": F.lit(0), "required": F.lit(1), "assumed": F.array(F.lit("x")), "audience": F.lit("")})
    got = {r.id: r for r in scoring.with_scores(docs).collect()}
    assert got[1].judge_error is None and got[1].score is not None
    assert all(got[i].judge_error and got[i].score is None and got[i].rule1 is None and got[i].clarity is None for i in (2, 3, 4))
    free = scoring.with_scores(docs.drop("judge"), judged=False).first()
    assert (free.rule1, free.rule4, free.rule7, free.coverage, free.score) == (10.0, 10.0, 10.0, 1.0, 100.0)
    heads = scoring.with_scores(docs.withColumn("text", F.lit("# a\n" * 40)).drop("judge"), judged=False).first()
    assert heads.rule7 == 0.0 and heads.clarity == 5.5


def test_rounding_follows_reports(spark):
    long = "word " * 333
    docs = spark.createDataFrame([(f"{long} delve numerous",)], "text string").withColumns({"budget": F.lit(300), "required": F.lit(3), "assumed": F.array(F.lit("x")), "audience": F.lit("")})
    exact, cut = (scoring.with_scores(docs, judged=False, rounded=r).first() for r in (False, True))
    assert (cut.slop, cut.rule2, cut.rule5) == (round(exact.slop, 1), round(exact.rule2, 1), round(exact.rule5, 1))
    assert cut.score == round(10 * sum(w * r for w, r in ((1, 10), (0.75, cut.rule2), (1, 10), (1, 10), (1, cut.rule5), (1, cut.rule6), (1, 10))) / 6.75 * (1 - 0.3 * cut.slop / 20), 1)


def test_summary_fails_without_scored_rows(spark):
    row = spark.createDataFrame([("m", "bad")], "model string, error string").withColumns({c: F.lit(None).cast("double") for c in ("score", "clarity", "slop", "n_words", "cost", *scoring.RULES)})
    assert scoring.run_summary(row).first().errors == 1
    with pytest.raises(Exception, match="all prompts failed: m"):
        scoring.run_summary(row, strict=True).collect()


def test_controls_skip_what_needs_a_judge(spark):
    rows = spark.createDataFrame([("a", "low", None, 69.94, None), ("b", "mid", False, 69.96, None), ("c", "high", True, 10.0, None)], "name string, expect string, needs_judge boolean, score double, x int")
    assert sorted((r.name, r.band, r.holds) for r in scoring.control_checks(rows).collect()) == [("a", "low", True), ("b", "mid", True)]
    assert scoring.control_checks(rows.withColumn("judged", F.lit(True))).count() == 3


def test_rule_details(spark):
    docs = spark.createDataFrame([("In order to utilize TLS we leverage throughput.", 0, 2, 5, ["x"], "")], "text string, facts int, required int, budget int, assumed array<string>, audience string")
    got = scoring.score_all(docs).first()
    assert got.detail.swaps == {"in order to": "to", "utilize": "use"} and got.detail.jargon == ["TLS", "throughput"]
    assert got.rule2 == 0.0 and got.detail.economy.coverage == 0.0 and got.detail.economy.budget is None and got.detail.filler.pretentious == 2
    some = scoring.score_all(docs.withColumn("facts", F.lit(3))).first().detail.economy
    assert (some.budget, some.coverage, some.over_budget) == (5, 1.0, 1.6)


def test_word_list_as_a_table(spark):
    docs = spark.createDataFrame([(1, "GRAVY and TLS and HOUSES and QXZ", [""], "")], "doc_id long, text string, assumed array<string>, audience string")
    words = spark.createDataFrame([("gravy",), ("house",), ("HOUSE",)], "word string")
    assert sorted(r.acronym for r in scoring.unknown_acronyms(docs, words).collect()) == ["QXZ", "TLS"]


def test_prompts(spark):
    asks = F.array(F.lit("first"), F.lit("second"))
    said = one(spark, prompts.judge_prompt(F.col("a"), F.col("p"), asks, F.col("r")), a="a cook", p="How?", r="Like this {x}.")
    assert all(x in said for x in ("a cook", "How?", "1. first\n2. second", "Like this {x}.", '"facts_delivered"', "needs_a_reread"))
    assert one(spark, prompts.extend_prompt(F.lit(None).cast("string"), F.array(F.lit("s")))) == "s"
    more = one(spark, prompts.extend_prompt(F.lit("old text"), asks))
    assert "old text" in more and "1. first" in more and "2. second" not in more and "second" in more
    assert one(spark, prompts.judged_prompt(asks)) == "1. first\n2. second" and one(spark, prompts.judged_prompt(F.array(F.lit("s")))) == "s"
    assert one(spark, prompts.with_condition(F.lit("p"), "brief")).startswith("p\n\nAnswer in 50") and one(spark, prompts.with_condition(F.lit("p"))) == "p"
    with pytest.raises(ValueError):
        prompts.with_condition(F.lit("p"), "odd")


def test_cost_counts_cached_tokens(spark):
    price = lambda *a: one(spark, R.cost(F.lit("a-sonnet"), *(F.lit(x).cast("long") for x in a)))
    assert price(1000, 100) == pytest.approx(0.0045) and price(1000, 100, 2000, None) == pytest.approx(0.0105) and price(None, None) == 0.0


def test_sentence_measures_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "We ship it today because the team that waits is late and the others are early, so we go.")], "doc_id long, text string")
    assert sorted((r.doc_id, r.erosion > 0, r.n_sentences) for r in sentences.erosion(docs).collect()) == [(1, False, 0), (2, False, 0), (3, True, 1)]
    assert sorted((r.doc_id, r.verbosity) for r in sentences.verbosity(docs).collect()) == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert sentences.measure(docs).count() == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_verbosity_and_measure_read_texts_once_and_shuffle_sums(spark, tmp_path, frame):
    frame.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for made in (sentences.verbosity(rows), sentences.measure(rows)):
        text = plan(made)
        assert text.count("FileScan") == 1 and "Join" not in text and text.count("Exchange") == 1
    assert "Exchange" not in plan(sentences.clones_in(rows))


def test_measure_is_erosion_and_verbosity(frame):
    worn = {r[0]: round(r[1], 3) for r in sentences.erosion(frame).collect()}
    said = {r[0]: round(r[1], 3) for r in sentences.verbosity(frame).collect()}
    got = {r["doc_id"]: (r["erosion"], r["verbosity"]) for r in sentences.measure(frame).collect()}
    assert got == {k: (pytest.approx(worn[k], abs=1e-9), pytest.approx(said[k], abs=1e-9)) for k in worn}


def test_clones_in_rows_equal_clones_of_sentences(frame, texts):
    got = {}
    for doc, pos in sentences.clones_in(frame).collect():
        got.setdefault(doc, []).append(pos)
    assert [sorted(got.get(i, [])) for i in range(len(texts))] == [P.clones(x) for x in texts]


def test_pair_checks_make_scores_once_and_keep_repeats(spark, tmp_path):
    spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0), ("c", None)], "name string, score double").write.parquet(str(tmp_path / "s"))
    scores = spark.read.parquet(str(tmp_path / "s"))
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", "z")], "better string, worse string")
    made = scoring.pair_checks(scores, pairs)
    assert plan(made).count("FileScan") == 1
    assert sorted(map(tuple, made.collect()), key=str) == sorted([("a", "b", True), ("a", "b", False)] * 2 + [("a", "c", None)], key=str)


def test_terms_that_meet_are_counted_apart(spark):
    for terms in ([*X.sign_terms(), *X.rule_terms()], ["let go", "let", "let", "go"]):
        made = T.layers(terms)
        assert sorted(t for some in made for t in some) == sorted(terms)
    assert all(not {"let", "let go"} <= set(x) and x.count("let") < 2 for x in made)
    assert one(spark, T.term_hits(F.col("s"), ["let go", "let", "let", "go"]), s="let go, let go on") == 8


def test_starts_hold_for_every_pattern(spark):
    import re

    said = ["There are many which", "it's worth noting", "IN ORDER TO", "due to the fact that", "for the reason of", "in the event that", "with regard to", "in spite of the fact that",
            "the fact that x is because", "at that moment in time", "in the modern era", "what that means is", "the point here is that", "last but not least", "let me begin by", "Good question",
            "I think it may perhaps", "might possibly", "usually tends to", "one of the key big factors", "x. Essentially y"]
    low = F.lower("s")
    for text, pattern in zip(said, X.FILLER_GRAMMAR, strict=True):
        assert re.search(pattern, text, re.I), text
        found = R.filler_parts(F.col("s"))["grammar"]
        shared = R.filler_parts(F.col("s"), low, T.all_places(low))["grammar"]
        want = sum(len(re.findall(p, text, re.I)) for p in X.FILLER_GRAMMAR)
        assert one(spark, F.struct(found, shared), s=text) == (want, want), text
    assert one(spark, R.filler_parts(F.col("s"))["grammar"], s="with regard to thıs; fırst and foremost") == 2


def test_words_by_the_block(frame, spark):
    for n in (0, 1, 7, 8, 9, 16, 17, 40):
        assert one(spark, T.words(F.col("s")), s=" \u00a0" + "ab\u2003c \n" * n) == 2 * n


def test_noun_fragments_after_the_gate(spark):
    for s, n in (("New roads, new rails, new ports.", 1), ("Big red car, big blue, big.", 1), ("x one. Red car, blue van, old bus. More", 1), ("Red car, blue van, old big bus.", 0), ("A, b, c, d, e!", 1), ("a b, c d, is it.", 0), ("Été a, b c, d e?", 1), ("Ete a x, b c, d e?", 0)):
        assert one(spark, F.size(T.noun_fragments(F.col("s"))), s=s) == n, s


def test_verbs_by_their_endings(spark):
    import re

    for s in ("s", "ed", "is", "Runs here", "a thing", "ing ed s", "they would", "no verb here", "walkedx", "Being", "x_s"):
        assert one(spark, T.has_verb(F.col("s")), s=s) == bool(re.search(X.VERB_LIKE, s, re.I)), s


def test_word_by_word_places_are_all_places(spark):
    """none_of() goes by no place where a term may stand: one letter tree against each term on its own."""
    import re

    terms, starts = ["delve", "the part x", "at", "end-to-end", "it's so", "no."], ["not", "the (?:fact|fun) is", "it(?:'s| is) worth", "may po(?:tenti|ssib)"]
    bits = ["delve", "the", "part", "x", "at", "end-to-end", "it's", "so", "no.", "not", "fact", "fun", "is", "worth", "may", "potential", "posit", "then", "édelve", "1at", "_not", "-", "—", "\n", ".", "'"]
    rng = random.Random(7)
    made = ["", "at", "\U0001f600delve", *("".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(300))]
    most = max(map(len, [*terms, *starts])) + 1
    plain = re.compile(rf"(?=(?<![a-z])\b(?:{'|'.join([*map(re.escape, terms), *starts])}))(?=((?s:.){{0,{most}}}))")
    want = ["".join("\x01" + m[1] for m in plain.finditer(t)) for t in made]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, low string")
    assert column(rows, T.term_places(F.col("low"), terms, starts)) == want
    assert "(?!" in X.none_of(terms, starts) and sum(map(bool, want)) > 200


def test_filler_grammar_looks_for_odd_letters_once():
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession() is not None
    plan = T.filler_grammar(F.col("bare"), F.col("low"), F.col("places"))._jc.toString().lower()
    assert plan.count("contains(low") <= 3


def test_alike_lists_pass_the_gate(frame, spark):
    """No text with a noun fragment is ruled out, however its sentences begin and end."""
    rng = random.Random(9)
    bits = ["new roads", "new rails", "ports", "old", "v1.2 ports", "it", "Ünew ways", "ten red big dogs now", "a b c d e f", "“new", "don't"]
    made = ["".join(rng.choice(bits) + rng.choice([", ", ", ", ",", ". ", ". ", ".", "! ", "\n", " "]) for _ in range(rng.randint(3, 16))) + rng.choice([".", "", "\n"]) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").union(frame)
    with_gate = column(rows, F.size(T.noun_fragments(F.col("text"))))
    gate, T._ALIKE = T._ALIKE, ""
    try:
        assert column(rows, F.size(T.noun_fragments(F.col("text")))) == with_gate
    finally:
        T._ALIKE = gate
    assert sum(map(bool, with_gate)) > 20


def test_staccato_reads_sentences_in_bulk(spark):
    rng = random.Random(11)
    bits = ["Go now fast.", "Stop.", "Run to me.", "Wait...", "v1.2 is out.", "Is it so?", "one, two.", "a b c d e f g.", "\n", "\n\n", "- item one.", "**Bold**", "No.end of it", "Ünï go.", "?!"]
    made = [rng.choice(["", " "]).join(rng.choice(bits) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert column(rows, T.staccato_runs(F.col("text"))) == [P.staccato(t) for t in made]
    assert ".*?" not in T.staccato_of(F.col("text"))._jc.toString() and "[^\\n]*?" not in T.staccato_of(F.col("text"))._jc.toString()
