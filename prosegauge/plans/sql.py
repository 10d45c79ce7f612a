"""SQL twins of the Column functions, for engines with RE2 patterns (no lookaround)."""

from __future__ import annotations

from prosegauge.functions import fixed as X

TRIM = r"^\s+|\s+$"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def any_case(x: str, pattern: str) -> str:
    return count(x, "(?i)" + pattern)


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {q(TRIM)}, '', 'g')"


def without_quotes(x: str) -> str:
    for p in X.QUOTED:
        x = f"regexp_replace({x}, {q(p)}, ' ', 'g')"
    return x


def words(x: str) -> str:
    return count(x, r"\S+")


def lines(x: str) -> str:
    return f"list_transform(string_split({x}, chr(10)), lambda ln: {trimmed('ln')})"


def split_sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def prose_lines(x: str) -> str:
    keep = f"pl <> '' AND NOT ends_with(pl, ':') AND NOT regexp_matches(pl, {q(X.LIST_START)}) AND NOT (starts_with(pl, '**') AND ends_with(pl, '**')) AND regexp_matches(pl, '[.!?](?:\\s|$)')"
    return f"list_filter({lines(x)}, lambda pl: {keep})"


def term_hits(low: str, terms: list[str]) -> str:
    return "(" + " + ".join(count(low, X.term_pattern(t)) for t in terms) + ")"


def phrasing_hits(bare: str, name: str) -> str:
    pattern = X.PHRASING[name]
    if name == "agentless_passive":
        return f"({any_case(bare, pattern)} - {any_case(bare, pattern + X.AGENT)})"
    return any_case(bare, pattern)


def triples(x: str) -> str:
    tests = " AND ".join(f"length(regexp_extract(m, {q(X.TRIPLE)}, {k})) > 4 AND regexp_matches(regexp_extract(m, {q(X.TRIPLE)}, {k}), {q(X.ADJECTIVE_END)})" for k in (1, 2, 3))
    return f"len(list_filter(flatten(list_transform({prose_lines(x)}, lambda t: regexp_extract_all(t, {q(X.TRIPLE)}))), lambda m: {tests}))"


def fragments(x: str) -> str:
    cores = f"list_transform(flatten(list_transform({prose_lines(x)}, lambda t: {split_sentences('t')})), lambda c: {trimmed('c')})"
    body = trimmed("regexp_replace(s, '[.!?]+$', '')")
    verbs = "[" + ", ".join(q(v) for v in X.FRAGMENT_VERBS) + "]"
    items = f"list_transform(string_split({body}, ','), lambda i: regexp_extract_all(lower(i), '[a-z'']+'))"
    good = f"len(list_filter({items}, lambda t: len(t) NOT BETWEEN 1 AND 5 OR list_has_any(t, {verbs}))) = 0"
    alike = f"(len(list_distinct(list_transform({items}, lambda t: t[1]))) = 1 OR len(list_distinct(list_transform({items}, lambda t: len(t)))) = 1)"
    tests = f"NOT contains(s, '`') AND NOT contains(s, '](') AND NOT regexp_matches({body}, '(?i),\\s*(?:and|or)\\b') AND len({items}) >= 3 AND {good} AND {alike}"
    return f"len(list_filter({cores}, lambda s: {tests}))"


def staccato(x: str) -> str:
    short = f"ends_with(s, '.') AND {words('s')} BETWEEN 2 AND {X.STACCATO_WORDS} AND NOT regexp_matches(s, '[,;:]')"
    marks = f"array_to_string(list_transform(list_filter(list_transform({split_sentences('ln')}, lambda p: {trimmed('p')}), lambda p: p <> ''), lambda s: CASE WHEN {short} THEN 'T' ELSE 'F' END), '')"
    each = f"list_transform({lines(without_quotes(x))}, lambda ln: CASE WHEN ln = '' OR regexp_matches(ln, {q(X.LIST_START)}) OR starts_with(ln, '**') THEN 'F' ELSE {marks} END)"
    return count(f"array_to_string({each}, '')", f"T{{{X.STACCATO_RUN},}}")


def slop_counts(text: str, bare: str, low: str) -> dict[str, str]:
    return (
        {k: term_hits(low, t) for k, t in X.category_terms().items()}
        | {k: phrasing_hits(bare, k) for k in X.PHRASING}
        | {"rule_of_three": triples(bare), "noun_list_fragment": fragments(bare), "staccato": staccato(text)}
    )


def slop_rate() -> str:
    """From the columns of counts and n_words."""
    names = [*X.category_terms(), *X.PHRASING, "rule_of_three", "noun_list_fragment"]
    rest = " + ".join(f'"{k}" * {X.WEIGHTS.get(k, 1.0)}::DOUBLE' for k in names)
    return f"(({rest}) / greatest(n_words, 1) * 1000 + least(staccato * {X.WEIGHTS['staccato']}::DOUBLE / greatest(n_words, 1) * 1000, {X.STACCATO_CAP}::DOUBLE))"


def slop_ctes(source: str, keys: str, out: str = "slop") -> str:
    """CTEs that add all counts, n_words and slop to (keys, text) of a source."""
    made = ", ".join(f'{e} AS "{k}"' for k, e in slop_counts("text", "bare", "low").items())
    return (
        f"{out}_b AS MATERIALIZED (SELECT {keys}, text, {without_quotes('text')} AS bare FROM {source}), "
        f"{out}_l AS MATERIALIZED (SELECT *, lower(bare) AS low FROM {out}_b), "
        f"{out}_c AS MATERIALIZED (SELECT {keys}, text, bare, low, {words('text')} AS n_words, {made} FROM {out}_l), "
        f"{out} AS MATERIALIZED (SELECT *, {slop_rate()} AS slop FROM {out}_c)"
    )


def scaffold(x: str) -> tuple[str, str]:
    rows = f"string_split(regexp_replace({x}, {q(X.QUOTED[0])}, '', 'g'), chr(10))"
    head = f"regexp_matches(r, {q(X.HEADING)}) OR regexp_matches(r, {q(X.BOLD_LABEL)})"
    return f"len(list_filter({rows}, lambda r: {head}))", f"len(list_filter({rows}, lambda r: regexp_matches(r, {q(X.BULLET)})))"


def scaffold_score(heads: str, items: str, budget: str) -> str:
    def over(n: str, free: float, most: float) -> str:
        d = f"round({n} / (greatest(coalesce(nullif({budget}, 0), {X.SCAFFOLD_BUDGET}), 1) / 100.0::DOUBLE), 2)"
        return f"CASE WHEN {d} <= {free} THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({d} - {free}::DOUBLE) / {most - free}::DOUBLE) END"

    return f"round(10.0::DOUBLE * (1.0::DOUBLE - greatest({over(heads, X.HEAD_FREE, X.HEAD_MAX)}, {over(items, X.LIST_FREE, X.LIST_MAX)})), 1)"


def to_10(n: str, n_words: str, ceiling: float) -> str:
    return f"greatest(0.0::DOUBLE, 10.0::DOUBLE * (1 - least(1.0::DOUBLE, {n}::DOUBLE / greatest({n_words}, 1) * 100 / {ceiling})))"


def sentence_ctes(source: str, key: str, out: str = "sents") -> str:
    kept = f"list_filter({lines('bare')}, lambda ln: ln <> '' AND NOT starts_with(ln, '#') AND NOT starts_with(ln, '|'))"
    cut = f"flatten(list_transform({kept}, lambda ln: regexp_extract_all(regexp_replace(ln, {q(X.LEADING_MARKER)}, ''), {q(X.SENTENCE)})))"
    good = f"list_filter(list_transform({cut}, lambda s: {trimmed('s')}), lambda s: {words('s')} >= 3)"
    return (
        f"{out}_b AS (SELECT {key}, {without_quotes('text')} AS bare FROM {source}), {out}_a AS MATERIALIZED (SELECT {key}, {good} AS s FROM {out}_b), "
        f"{out} AS MATERIALIZED (SELECT {key}, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM {out}_a)"
    )


def subordinates(x: str) -> str:
    mark = X.UNSURE_SUBORDINATORS.replace("(?:", "(").replace(r"\b", "")
    parts = f"string_split(regexp_replace({x}, '(?i)\\b{mark}\\b', chr(1) || '\\1', 'g'), chr(1))"
    tail = f"array_to_string({parts}[k:], '')"
    return f"({any_case(x, X.CLEAR_SUBORDINATORS)} + len(list_filter(range(2, len({parts}) + 1), lambda k: regexp_matches({tail}, {q('(?i)^' + X.UNSURE_SUBORDINATORS + X.CLAUSE_EVIDENCE)}))))"


def mass_ctes(source: str, key: str, out: str = "mass") -> str:
    """Clauses and mass of (key, pos, sentence) rows."""
    joined = lambda s: f"regexp_matches({s}, {q('(?i)' + X.COORDINATED)})"
    parts = f"len(list_filter(string_split(sentence, ','), lambda p: {trimmed('p')} <> ''))"
    flat = f"CASE WHEN label THEN rest_sub = 0 AND NOT {joined('rest')} AND NOT regexp_matches(rest, {q(X.HARD_BREAK)}) ELSE {parts} >= 3 AND sub = 0 AND NOT {joined('sentence')} END"
    nested = f"1 + sub + {any_case('sentence', X.COORDINATED)} + {count('sentence', X.HARD_BREAK)}"
    return (
        f"{out}_r AS (SELECT *, regexp_matches(sentence, {q(X.LABEL_LINE)}) AS label, regexp_extract(sentence, {q(X.LABEL_LINE)}, 1) AS rest FROM {source}), "
        f"{out}_s AS MATERIALIZED (SELECT *, {subordinates('sentence')} AS sub, {subordinates('rest')} AS rest_sub FROM {out}_r), "
        f"{out}_c AS (SELECT {key}, pos, sentence, CASE WHEN ({flat}) OR NOT regexp_matches(sentence, {q('(?i)' + X.VERB_LIKE)}) THEN 1 ELSE {nested} END AS clauses FROM {out}_s), "
        f"{out} AS MATERIALIZED (SELECT *, clauses * sqrt({words('sentence')}) AS mass FROM {out}_c)"
    )


def clone_ctes(source: str, key: str, out: str = "clones") -> str:
    sh = f"list_distinct(list_transform(range(1, len(w) - {X.SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {X.SHINGLE_WORDS - 1}], ' ')))"
    return (
        f"{out}_w AS (SELECT {key}, pos, regexp_extract_all(lower(sentence), '[a-z0-9]+') AS w FROM {source}), "
        f"{out}_h AS MATERIALIZED (SELECT {key}, pos, {sh} AS sh FROM {out}_w WHERE len(w) >= {X.SHINGLE_WORDS}), "
        f"{out}_f AS MATERIALIZED (SELECT {key}, list_sort(sh) AS sh, min(pos) AS pos FROM {out}_h GROUP BY {key}, list_sort(sh)), "
        f"{out}_x AS MATERIALIZED (SELECT {key}, pos, len(sh) AS n, unnest(sh) AS shingle FROM {out}_f), "
        f"{out} AS MATERIALIZED (SELECT {key}, pos FROM (SELECT a.{key}, a.pos, b.pos AS before FROM {out}_x a JOIN {out}_x b ON a.{key} = b.{key} AND a.shingle = b.shingle AND b.pos < a.pos "
        f"GROUP BY a.{key}, a.pos, b.pos, a.n, b.n HAVING count(*) >= {X.CLONE_SHARE} * least(a.n, b.n)) "
        f"UNION SELECT h.{key}, h.pos FROM {out}_h h JOIN {out}_f f ON h.{key} = f.{key} AND list_sort(h.sh) = f.sh AND h.pos > f.pos)"
    )
