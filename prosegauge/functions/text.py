"""Segmenters, counters and structural detectors as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import fixed as X

#: (?d): only \n ends a line; (?U): Unicode classes.
_U = "(?dU)"
#: Stands before each place of a term; those of the text itself become another sign that no term has.
_MARK, _NO_MARK = "\x01", "\x02"


#: All white space of Unicode.
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Words that are counted at once.
_BLOCK = 8
#: Letters that match others when case is ignored, but stay as they are (or become two) in lower case.
_ODD_CASE = ("ſ", "ı", "i̇")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_U + pattern))


def count_any_case(text: Column, pattern: str, first: str = "") -> Column:
    """Matches whatever their case; first has the lower-case letters that a match can begin with, which are cheap to look for."""
    also = {"i": r"\x{0130}\x{0131}", "s": r"\x{017F}", "k": r"\x{212A}"}
    ahead = f"(?=[{''.join(c + c.upper() + also.get(c, '') for c in sorted(set(first)))}])" if first else ""
    return F.regexp_count(text, F.lit(ahead + "(?iu)" + _U + pattern))


def stripped_of_quotes(text: Column) -> Column:
    """Code fences, code spans and short straight-quoted strings become blanks."""
    marked = F.contains(text, F.lit("`")) | F.contains(text, F.lit('"'))
    return F.when(marked, reduce(lambda t, p: F.regexp_replace(t, p, " "), X.QUOTED, text)).otherwise(text)


def without_fences(text: Column) -> Column:
    """Code fences vanish."""
    return F.regexp_replace(text, X.QUOTED[0], "")


def words(text: Column) -> Column:
    """Number of stretches without white space; found by the block, as each match makes a string."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?U)((?:\S++\s++){{{_BLOCK}}}+)|\S++"), F.lit(1))
    return let(blocks, lambda b: F.size(b) + (_BLOCK - 1) * F.size(F.array_remove(b, "")))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def split_sentences(text: Column) -> Column:
    """T5: cut after . ! or ? before white space."""
    return F.split(text, r"(?<=[.!?])(?U:\s)+", -1)


def prose_lines(text: Column, also=None) -> Column:
    """T4: trimmed lines that are running prose; also is a further test, which is made first."""
    keep = lambda x: (x != "") & ~x.endswith(":") & ~x.rlike(X.LIST_START) & ~(x.startswith("**") & x.endswith("**")) & x.rlike(r"(?d)[.!?](?:(?U:\s)|$)")
    some = lines(text) if also is None else F.filter(lines(text), also)
    return F.filter(F.transform(some, trimmed), keep)


def sentences(text: Column) -> Column:
    """Sentences of three words or more, outside headings and tables, list markers off."""
    kept = F.filter(F.transform(lines(stripped_of_quotes(text)), trimmed), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("|"))
    cut = F.flatten(F.transform(kept, lambda x: F.regexp_extract_all(F.regexp_replace(x, "(?U)" + X.LEADING_MARKER, ""), F.lit(X.SENTENCE), F.lit(0))))
    return F.filter(F.transform(cut, trimmed), lambda s: s.rlike(r"(?U)\S\s+\S+\s+\S"))


def shingles(sentence: Column, n: int = X.SHINGLE_WORDS) -> Column:
    """Distinct runs of n lower-case ASCII words; none in shorter sentences."""
    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(F.lower(sentence), F.lit("[a-z0-9]+"), F.lit(0)), runs)


def clone_places(rows: Column) -> Column:
    """M8: pos of each sentence that shares half of the smaller shingle set with an earlier one, of one document's array of (pos, sentence), by pos.

    Of sentences with the same shingle set only the first is compared with others: a later one is
    its clone already, and is like others just as the first is. Compared are only sentences with a
    shingle that another one has too, by what they have of such shingles. No list of pairs is made.
    """
    none = F.array().cast("array<int>")
    is_new = lambda sorted_, i, get=lambda x: x: (i == 0) | (get(F.get(sorted_, i - 1)) != get(F.get(sorted_, i)))

    def near(firsts: Column, shared: Column) -> Column:
        parts = F.filter(F.transform(firsts, lambda f: F.struct(f["pos"].alias("pos"), F.size(f["set"]).alias("n"), F.array_intersect(f["set"], shared).alias("part"))), lambda f: F.size(f["part"]) > 0)
        alike = lambda x, y: F.size(F.array_intersect(x["part"], y["part"])) >= X.CLONE_SHARE * F.least(x["n"], y["n"])
        return let(parts, lambda ps: F.transform(F.filter(ps, lambda x, i: F.exists(F.slice(ps, F.lit(1), i), lambda y: alike(x, y))), lambda x: x["pos"]))

    def compared(firsts: Column) -> Column:
        every = F.flatten(F.transform(firsts, lambda f: f["set"]))
        shared = lambda e: let(F.sort_array(e), lambda o: F.array_distinct(F.filter(o, lambda x, i: ~is_new(o, i))))
        return let(every, lambda e: F.when(F.size(F.array_distinct(e)) < F.size(e), let(shared(e), lambda found: near(firsts, found))).otherwise(none))

    def split(keyed: Column) -> Column:
        own = lambda first: F.filter(keyed, lambda k, i: is_new(keyed, i, lambda x: x["key"]) if first else ~is_new(keyed, i, lambda x: x["key"]))
        firsts = F.sort_array(F.transform(own(True), lambda k: F.struct(k["pos"].alias("pos"), k["set"].alias("set"))))
        return F.concat(F.transform(own(False), lambda k: k["pos"]), let(firsts, compared))

    sets = F.filter(F.transform(rows, lambda r: F.struct(r["pos"].alias("pos"), shingles(r["sentence"]).alias("set"))), lambda r: F.size(r["set"]) > 0)
    return let(F.sort_array(F.transform(sets, lambda r: F.struct(F.xxhash64(F.sort_array(r["set"])).alias("key"), r["pos"].alias("pos"), r["set"].alias("set")))), split)


def first_answer(text: Column) -> Column:
    """What stands before the second numbered answer."""
    return F.element_at(F.split(text, X.SECOND_ANSWER, 2), 1)


def term_places(lowered: Column, terms: list[str], starts: list[str] = ()) -> Column:
    """Each place where one of the terms may stand or a start matches, behind a mark and as long as the longest of them and what follows it: one pass, however many terms."""
    most = max(map(len, [*terms, *starts])) + 1
    # goes from word to word, so that most signs are passed by in tight loops; the last match is the end of the text
    skip = "(?>[a-z]*)(?>[^a-z]*)"
    others = rf"(?>[^a-z]*)(?:(?:{X.none_of(terms, starts)}|(?U:\B)[a-z]){skip})*+"
    near = F.regexp_extract_all(lowered, F.lit(rf"{others}(?:(?=((?s:.){{0,{most}}}))[a-z]{skip}|\z)"), F.lit(1))
    return F.array_join(F.transform(F.array_remove(near, ""), lambda x: F.concat(F.lit(_MARK), F.translate(x, _MARK, _NO_MARK))), "")


def starts_at(places: Column, starts: list[str]) -> Column:
    """Whether one of the starts is among the places."""
    return (places != "") & places.rlike(f"{_MARK}(?:{'|'.join(starts)})")


def layers(terms: list[str]) -> list[list[str]]:
    """The terms in few lists, so that no two terms of one list can stand at the same place."""
    edge = lambda a, b: (a.isalnum() or a == "_") != (b.isalnum() or b == "_")
    meet = lambda a, b: b.startswith(a) and (a == b or edge(a[-1], b[len(a)]))
    out: list[list[str]] = []
    for t in terms:
        free = next((some for some in out if not any(meet(t, u) or meet(u, t) for u in some)), None)
        if free is None:
            out.append([t])
        else:
            free.append(t)
    return out


def hits_at(places: Column, lowered: Column, terms: list[str]) -> Column:
    """Occurrences of all terms, each counted on its own, given the text's term_places() of these terms or more.

    Terms that can't stand at the same place are counted together. One that can overlap itself
    has fewer occurrences than places, and is counted in the text.
    """
    at = lambda some: F.regexp_count(places, F.lit(rf"(?U){_MARK}(?:{'|'.join(map(X.escaped, some))})\b"))
    own = [t for t in terms if overlaps_itself(t)]
    each = [F.when(at([t]) > 1, count(lowered, X.term_pattern(t))).otherwise(at([t])) for t in own]
    each += [at(some) for some in layers([t for t in terms if t not in own])]
    return F.when(places != "", reduce(lambda a, b: a + b, each)).otherwise(F.lit(0))


def overlaps_itself(term: str) -> bool:
    """Whether the term ends as it begins, at word boundaries: end-to-end-to-end."""
    inside = lambda k: term[k - 1].isalnum() and term[k].isalnum()
    return any(term.startswith(term[k:]) and not inside(k) for k in range(1, len(term)))


def term_hits(lowered: Column, terms: list[str]) -> Column:
    """Occurrences of all terms, each counted on its own."""
    return let(term_places(lowered, terms), lambda places: hits_at(places, lowered, terms))


def phrasing_hits(stripped: Column, lowered: Column, name: str, places: Column | None = None) -> Column:
    """Matches of a phrasing pattern; texts that lack its words are ruled out first, by their sign_places() if given."""
    pattern = X.PHRASING[name] + (rf"(?!{X.AGENT})" if name == "agentless_passive" else "")
    found = count_any_case(stripped, pattern, X.PHRASING_FIRST.get(name, ""))
    may = []
    if places is not None and name in X.PHRASING_STARTS:
        may.append(starts_at(places, X.PHRASING_STARTS[name]))
    if name in X.PHRASING_HOLDS:
        may.append(reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(k)) for k in X.PHRASING_HOLDS[name])))
    if name in X.PHRASING_NEEDS:
        may.append(lowered.rlike(X.PHRASING_NEEDS[name]))
    return F.when(reduce(lambda a, b: a & b, may), found).otherwise(F.lit(0)) if may else found


def odd_case(lowered: Column) -> Column:
    """Whether a lower-case text has letters that match others only when case is ignored."""
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(c)) for c in _ODD_CASE))


def filler_grammar(bare: Column, lowered: Column, places: Column) -> Column:
    """Matches of all patterns of filler grammar, given term_places() with their starts; texts without a pattern's start are ruled out first."""
    in_text = [count_any_case(bare, p, "".join(x[0] for x in at) if p.startswith(r"\b") else "") for p, at in zip(X.FILLER_GRAMMAR, X.FILLER_STARTS, strict=True)]
    each = [F.when(starts_at(places, at), found).otherwise(F.lit(0)) for found, at in zip(in_text, X.FILLER_STARTS, strict=True)]
    total = lambda counts: reduce(lambda a, b: a + b, counts)
    return F.when(odd_case(lowered), total(in_text)).when(starts_at(places, [p for at in X.FILLER_STARTS for p in at]), total(each)).otherwise(F.lit(0))


def triples(text: Column) -> Column:
    """`a, b, and c` of three longer adjectives, in prose."""
    may = lambda x: x.rlike(r"(?U),\s+\w+,\s+and\s")
    found = F.flatten(F.transform(prose_lines(text, may), lambda x: F.regexp_extract_all(x, F.lit("(?U)" + X.TRIPLE), F.lit(0))))

    def padded(match: Column) -> Column:
        parts = [F.regexp_extract(match, "(?U)" + X.TRIPLE, k) for k in (1, 2, 3)]
        return reduce(lambda a, b: a & b, (F.length(p).__gt__(4) & p.rlike(X.ADJECTIVE_END) for p in parts))

    none = F.array().cast("array<string>")
    return F.when(may(text), F.filter(found, padded)).otherwise(none)


def _alike() -> str:
    """Matches a lower-case text that may hold a list as noun_fragments() finds them: from the start of a sentence three items of as many words, or with one lead, then more items or the end of the sentence."""
    gap, word = r"(?>[^a-z',\n]*)", "(?>[a-z']+)"
    more = lambda n: f"(?:{gap}{word}){n}" if n != "{0}" else ""
    end = rf"(?={gap}(?:[,\n]|\z)|[^a-z',\n]*?[.!?](?U:\s))"
    sizes = "|".join(f"{word}{more(f'{{{k}}}')}(?:{gap},{gap}{word}{more(f'{{{k}}}')}){{2}}{end}" for k in range(5))
    # what follows the last lead isn't told: words of the next sentence would be taken for its own
    lead = rf"({word}){more('{0,4}+')}{gap},{gap}\1(?![a-z']){more('{0,4}+')}{gap},{gap}\1(?![a-z'])"
    item = rf"(?:{word}{gap}){{1,5}}+"
    found = rf"{gap}(?={item},{gap}{item},{gap}{word})(?:{sizes}|{lead})"
    # most sentences are told apart by what follows their first five words, which needn't be read again
    inside = r"(?>[^a-z',.!?\n]*)"
    other = rf"{inside}(?:{word}{inside}){{0,5}}+(?!,{gap}{item},{gap}{word}|[.!?]\S)"
    return rf"\A(?:(?:{other}|(?!{found}))(?>[^.!?\n]*)[.!?\n])*+(?={found})"


_ALIKE = _alike()


def noun_fragments(text: Column) -> Column:
    """Sentences that are bare lists of short verbless items, alike in lead or length."""
    may = lambda x: F.lower(x).rlike(_ALIKE)
    cores = F.filter(F.transform(F.flatten(F.transform(prose_lines(text, may), split_sentences)), trimmed), may)
    verbs = F.array(*map(F.lit, X.FRAGMENT_VERBS))

    def bare(core: Column) -> Column:
        body = trimmed(F.regexp_replace(core, r"[.!?]+\z", ""))
        split = F.transform(F.split(body, ",", -1), lambda i: F.regexp_extract_all(F.lower(i), F.lit("[a-z']+"), F.lit(0)))
        return ~core.contains("`") & ~core.contains("](") & ~body.rlike(r"(?i),(?U:\s)*(?:and|or)\b") & let(split, listed)

    def listed(items: Column) -> Column:
        alike = (F.size(F.array_distinct(F.transform(items, lambda t: F.element_at(t, 1)))) == 1) | (F.size(F.array_distinct(F.transform(items, F.size))) == 1)
        return (
            (F.size(items) >= 3)
            & F.forall(items, lambda t: F.size(t).between(1, 5) & ~F.arrays_overlap(t, verbs))
            & F.when(F.forall(items, lambda t: F.size(t) > 0), alike).otherwise(False)
        )

    return F.when(text.rlike(",[^,]*+,") & may(text), F.filter(cores, bare)).otherwise(F.array().cast("array<string>"))


def staccato_runs(text: Column, most_words: int = X.STACCATO_WORDS, least: int = X.STACCATO_RUN) -> Column:
    """D3: number of runs of three or more short declarative sentences; runs go on over prose lines.

    A fold over the sentences counts the run so far; lists, headings and blank lines end it.
    """
    return staccato_of(stripped_of_quotes(text), most_words, least)


def staccato_of(bare: Column, most_words: int = X.STACCATO_WORDS, least: int = X.STACCATO_RUN) -> Column:
    """D3 of a text without quotes: one pass makes a list with a dot for each short sentence and nothing for others, for lists, headings and blank lines."""
    # independent groups of greedy loops are faster than possessive loops
    outside = r"^(?>[^\S\n]*)(?:(?:[-*+#>|]|\d+[.)])[^\n]*+|(?=\n|\z))\n?"
    short = rf"(?:(?>[^\s,;:]+)(?<![.!?])(?>[^\S\n]+)){{1,{most_words - 1}}}+(?>[^\s,;:]*)(?<=(\.))(?!\S)"
    other = r"(?=\S)(?>[^.!?\n]*)(?:(?>[.!?]+)(?=\S)(?>[^.!?\n]*))*+[.!?]*"
    marks = F.regexp_extract_all(bare, F.lit(f"(?dmU){outside}|{short}|{other}"), F.lit(1))
    runs = F.regexp_count(F.array_join(marks, ","), F.lit(rf"\.(?:,\.){{{least - 1},}}+"))
    return F.when(bare.rlike(rf"(?:\.[^.]*+){{{least}}}"), runs).when(bare.isNotNull(), 0)


def shape(text: Column) -> dict[str, Column]:
    """Cadence figures of the raw text (unrounded)."""
    lens = F.transform(F.filter(split_sentences(trimmed(text)), lambda s: s != ""), words)
    start = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("n", "total", "squares", "short")))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["total"] + x).alias("total"), (a["squares"] + x * x).alias("squares"), (a["short"] + F.when(x <= 4, 1).otherwise(0)).alias("short"))

    def folded(end) -> Column:
        return F.aggregate(lens, start, step, end)

    n = F.size(lens)
    spread = lambda a: F.sqrt((a["squares"] - a["total"] * a["total"] / a["n"]) / (a["n"] - 1)) / (a["total"] / a["n"])
    per_100 = lambda k: k / F.greatest(words(text), F.lit(1)) * 100
    return {
        "em_dash_per_100w": per_100(F.regexp_count(text, F.lit("—"))),
        "sentence_cv": folded(lambda a: F.when(a["n"] > 1, spread(a)).otherwise(0.0)),
        "frag_ratio": folded(lambda a: a["short"] / F.greatest(a["n"], F.lit(1))),
        "bold_per_100w": per_100(F.regexp_count(text, F.lit(r"\*\*[^*]+\*\*"))),
        "comma_per_sent": F.regexp_count(text, F.lit(",")) / F.greatest(n, F.lit(1)),
        "staccato_runs": staccato_runs(text),
    }


def sign_places(low: Column) -> Column:
    """term_places() of the terms of all categories and the starts of phrasing patterns."""
    return term_places(low, X.sign_terms(), X.sign_starts())


def all_places(low: Column) -> Column:
    """sign_places() and the places that the rules need besides."""
    return term_places(low, [*X.sign_terms(), *X.rule_terms()], [*X.sign_starts(), *X.rule_starts()])


def slop_counts(bare: Column, low: Column, places: Column) -> dict[str, Column]:
    """Counts of all lexical, phrasing and structural signs.

    Given are the text without quotes, that in lower case, and sign_places() of it, which should
    be columns of an earlier projection: the counters read them often.
    """
    return (
        {k: hits_at(places, low, t) for k, t in X.category_terms().items()}
        | {k: phrasing_hits(bare, low, k, places) for k in X.PHRASING}
        | {"rule_of_three": F.size(triples(bare)), "noun_list_fragment": F.size(noun_fragments(bare)), "staccato": staccato_of(bare)}
    )


def slop_rate(counts: dict[str, Column], n_words: Column) -> Column:
    """Weighted hits per 1,000 words (unrounded); staccato runs add STACCATO_CAP at most."""
    n = F.greatest(n_words, F.lit(1))
    weighted = lambda k: counts[k] * F.lit(X.WEIGHTS.get(k, 1.0))
    rest = reduce(lambda a, b: a + b, (weighted(k) for k in counts if k != "staccato"))
    return rest / n * 1000 + F.least(weighted("staccato") / n * 1000, F.lit(X.STACCATO_CAP))


def slop_tax(rate: Column) -> Column:
    """D6."""
    return F.least(F.lit(X.SLOP_TAX_MOST), rate / X.SLOP_CEILING * X.SLOP_TAX_MOST)


def scaffold(text: Column) -> tuple[Column, Column]:
    """Headings (and bold labels on their own) and list items outside code fences."""
    rows = lines(without_fences(text))
    heads = F.size(F.filter(rows, lambda x: x.rlike("(?dU)" + X.HEADING) | x.rlike("(?dU)" + X.BOLD_LABEL)))
    return heads, F.size(F.filter(rows, lambda x: x.rlike("(?dU)" + X.BULLET)))


def scaffold_score(heads: Column, items: Column, budget: Column) -> Column:
    """10 up to the free allowance, then down to 0; the worse of the two counts. Densities have 2 digits."""
    per = F.greatest(F.coalesce(F.nullif(budget, F.lit(0)), F.lit(X.SCAFFOLD_BUDGET)), F.lit(1)) / 100.0

    def over(n: Column, free: float, most: float) -> Column:
        density = F.round(n / per, 2)
        return F.when(density <= free, 0.0).otherwise(F.least(F.lit(1.0), (density - free) / (most - free)))

    return F.round(10.0 * (1.0 - F.greatest(over(heads, X.HEAD_FREE, X.HEAD_MAX), over(items, X.LIST_FREE, X.LIST_MAX))), 1)


def subordinates(sentence: Column) -> Column:
    """M1: clear subordinators, and unsure ones that clause evidence follows."""
    return count_any_case(sentence, X.CLEAR_SUBORDINATORS, "wbatuisepg") + count_any_case(sentence, rf"\b{X.UNSURE_SUBORDINATORS}(?={X.CLAUSE_EVIDENCE})", "tabsud")


def is_flat(sentence: Column, joining: Column) -> Column:
    """M4: label lines and lists, given the sentence's subordinates."""
    label = sentence.rlike("(?dU)" + X.LABEL_LINE)
    rest = F.regexp_extract(sentence, "(?dU)" + X.LABEL_LINE, 1)
    joined = lambda s: s.rlike("(?iu)(?dU)" + X.COORDINATED)
    parts = F.size(F.filter(F.split(sentence, ",", -1), lambda p: trimmed(p) != ""))
    return F.when(label, (subordinates(rest) == 0) & ~joined(rest) & ~rest.rlike("(?U)" + X.HARD_BREAK)).otherwise((parts >= 3) & (joining == 0) & ~joined(sentence))


def has_verb(sentence: Column) -> Column:
    """Whether a sentence matches VERB_LIKE; endings are looked for at the end of a word, not from its start."""
    return sentence.rlike(rf"(?iu)(?dU)(?<=\w)(?:s|ed|ing)\b|{X.VERB_WORDS}")


def clauses(sentence: Column) -> Column:
    """M5."""

    def counted(joining: Column) -> Column:
        nested = 1 + joining + count_any_case(sentence, X.COORDINATED, "aboys") + count(sentence, X.HARD_BREAK)
        return F.when(is_flat(sentence, joining), 1).otherwise(nested)

    # most sentences without a verb need nothing else
    return F.when(~has_verb(sentence), 1).otherwise(let(subordinates(sentence), counted))
