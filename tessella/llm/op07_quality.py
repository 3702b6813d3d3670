"""Quality rules as a short-circuit cascade.

Every rule is a native column expression. A bounded sample gives each rule's cost and the rows it rejects; the rules are then nested
into one CASE, next always the rule with most rejections per cost among the rows that those before it leave, so that most rejected rows
stop at the first few rules. The order changes nothing in the result: a row is kept if and only if it breaks no rule.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows on which costs and rejections are estimated, and files from which they come. They bound the estimate only; every rule holds for
#: every row.
SAMPLE_ROWS, SAMPLE_FILES = 3000, 8
#: Character classes that mean the same to Java and to RE2.
SYMBOLS, CAPITALS, DIGITS = r"[$%&*#@^~<>{}=\\\[\]]", "[A-ZÀ-ÖØ-Þ]", "[0-9]"
#: Rows of a table, whose pipes are in their place; a token from its first letter on; one from its first letter or digit on; lines that list, and that break off.
TABLE_ROW, LETTERED, TOKEN = r"(?m)^[ \t]*[|].*$", r"\p{L}[^ \t\r\n]*", r"[\p{L}0-9][^ \t\r\n]*"
BULLET, ELLIPSIS = r"^[ \t]*[-*•·–‣◦][ \t]", r"([.][.][.]|…)[ \t\r]*$"
#: Shares of a text's characters (or words, or lines) above which a rule rejects; lettered and distinct_words: below which; word_length: the
#: band of mean characters a word, the space included.
LIMITS = {"symbols": 0.04, "pipes": 0.01, "exclamations": 0.04, "capitals": 0.45, "digits": 0.5, "word_length": 24.0, "short_words": 2.5, "distinct_words": 0.3, "distinct_grams": 0.4, "repeated_lines": 0.4, "repeated_chars": 0.4, "bullets": 0.9, "ellipses": 0.3, "lettered": 0.6}
#: Texts with fewer characters, words or lines than these are exempt from the rules on shares; stop_words: from the rule that asks for
#: FUNCTION_WORDS different ones.
LEAST = {"chars": 20, "words": 30, "lines": 4, "stop_words": 80}
#: Distinct words are counted within windows of so many words, and sequences of so many words over the whole text: neither share
#: falls with the length of clean prose. Within windows sequences of GRAM words are counted too.
WINDOW, SEQUENCE, GRAM = 1000, 8, 3
#: How many different function words running text must have, of any of the languages.
FUNCTION_WORDS = 2
STOP_WORDS = sorted(
    set(
        "the of and to in is that it for was on are with as be at by this have from "  # English
        "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "  # German
        "de la le et les des en un une du que est pour qui dans par sur pas au avec "  # French
        "el los las del se por con una su para es al lo como más pero sus "  # Spanish
        "il di che è per non si da sono della nel alla i gli "  # Italian
        "o a os um uma do da não com em no na dos mais "  # Portuguese
        "het een van niet dat te op zijn er aan met voor "  # Dutch
        "och att det som på av är inte til og ikke på for jeg at å "  # Scandinavian
        "w i na z się do nie to jest że jak po "  # Polish
        "a se v že je s ve bir ve bu da için ne ile "  # Czech, Turkish
        "și în cu pe nu az és hogy nem egy ja on ei että se "  # Romanian, Hungarian, Finnish
        "и в не на что с он как это по но я та що на до "  # Russian, Ukrainian
        "και το να του η της με για που από".split()  # Greek
    )
)


def _times(text: Column, char: str) -> Column:
    """How often a character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _with(value: Column, test) -> Column:
    """A test of a value that is made once."""
    return F.transform(F.array(value), test)[0]


def _grams(words: Column, k: int) -> Column:
    """A hash of every run of k words; one of all of fewer."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, k)))


def _within(items: Column) -> Column:
    """Distinct items, counted within windows and summed."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(WINDOW))
    return F.aggregate(starts, F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice(items, i, WINDOW))))


def _repetitive(words: Column, vocabulary: Column, limit: float) -> Column:
    """True for words of which, of all and then within windows or as sequences, too few are distinct. Windows and sequences cover the
    whole text; the share of all words is never above theirs by much and spares most texts the count."""
    n = F.size(words)
    return (F.size(vocabulary) < limit * n) & ((_within(words) < limit * n) | _with(_grams(words, SEQUENCE), lambda x: F.size(F.array_distinct(x)) < limit * F.size(x)))


def _regrammed(words: Column, vocabulary: Column, limit: float) -> Column:
    """True if within windows too few sequences of GRAM words are distinct. Nearly every distinct word starts a sequence of its own, so
    texts with enough of them are spared the count."""
    return (F.size(vocabulary) < limit * F.size(words) + GRAM) & _with(_grams(words, GRAM), lambda x: _within(x) < limit * F.size(x))


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))


#: The lists that rules work on, in the order in which one is made from another.
LISTS = {
    "words": lambda text, made: F.array_remove(F.split(text, " ", -1), ""),
    "vocabulary": lambda text, made: F.array_distinct(made["words"]),
    "lines": lambda text, made: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\r]")),  # blank ones part paragraphs and repeat nothing
}


def list_rules(limits: dict[str, float] = LIMITS) -> dict[str, tuple[list[str], object]]:
    """Name to (lists that the rule needs, its test of them)."""
    of_words = lambda test: lambda w, v: (F.size(w) > LEAST["words"]) & test(w, v)
    of_lines = lambda test: lambda x: (F.size(x) > LEAST["lines"]) & test(x)
    starred = lambda x, kind: F.size(F.filter(x, lambda y: y.rlike(kind)))
    words, lines = ["words", "vocabulary"], ["lines"]
    return {
        "short_words": (words, of_words(lambda w, v: _chars(w) + F.size(w) < limits["short_words"] * F.size(w))),
        "distinct_words": (words, of_words(lambda w, v: _repetitive(w, v, limits["distinct_words"]))),
        "distinct_grams": (words, of_words(lambda w, v: _regrammed(w, v, limits["distinct_grams"]))),
        "stop_words": (words, lambda w, v: (F.size(w) >= LEAST["stop_words"]) & (F.size(F.array_intersect(v, F.lit(STOP_WORDS))) < FUNCTION_WORDS)),
        "repeated_lines": (lines, of_lines(lambda x: F.size(x) - F.size(F.array_distinct(x)) > limits["repeated_lines"] * F.size(x))),
        "repeated_chars": (lines, of_lines(lambda x: _chars(x) - _chars(F.array_distinct(x)) > limits["repeated_chars"] * _chars(x))),
        "bullets": (lines, of_lines(lambda x: starred(x, BULLET) > limits["bullets"] * F.size(x))),
        "ellipses": (lines, of_lines(lambda x: starred(x, ELLIPSIS) > limits["ellipses"] * F.size(x))),
    }


def text_rules(text: Column, limits: dict[str, float] = LIMITS) -> dict[str, Column]:
    n, enough = F.length(text), F.length(text) >= LEAST["chars"]
    return {
        "blank": ~text.rlike(r"[^ \t\r\n]"),
        "symbols": enough & (F.regexp_count(text, F.lit(SYMBOLS)) > limits["symbols"] * n),
        "pipes": enough & (_times(text, "|") > limits["pipes"] * n) & (_times(F.regexp_replace(text, TABLE_ROW, ""), "|") > limits["pipes"] * n),
        "exclamations": enough & (_times(text, "!") > limits["exclamations"] * n),
        "capitals": enough & (F.regexp_count(text, F.lit(CAPITALS)) > limits["capitals"] * n),
        "digits": enough & (F.regexp_count(text, F.lit(DIGITS)) > limits["digits"] * n),
        "word_length": enough & (n > limits["word_length"] * (_times(text, " ") + _times(text, "\n") + 1)),
        "lettered": (_times(text, " ") >= LEAST["words"]) & (F.regexp_count(text, F.lit(LETTERED)) < limits["lettered"] * F.regexp_count(text, F.lit(TOKEN))),
    }


def _listed(text: Column, needed: list[str], made: dict[str, Column], then) -> Column:
    """then(made), a condition, with the needed lists made once each."""
    for name in needed:
        if name not in made:
            return _with(LISTS[name](text, made), lambda x: _listed(text, needed, made | {name: x}, then))
    return then(made)


def rules(text: Column, limits: dict[str, float] = LIMITS) -> dict[str, Column]:
    """Name to the expression that is true for a text to reject. Text must not be null."""
    of_lists = {name: _listed(text, needed, {}, lambda made: test(*(made[k] for k in needed))) for name, (needed, test) in list_rules(limits).items()}
    return text_rules(text, limits) | of_lists


def _sample(docs: DataFrame, rows: int, seed: int, files: int) -> DataFrame:
    """About so many texts, from a few files spread over the listing where docs is a scan, so that its cost doesn't grow with the table."""
    texts = common.spread(docs, files).select(common.text_of(docs).alias("t")).where("t IS NOT NULL")
    n = texts.count()
    return texts.sample(min(1.0, rows / max(n, 1)), seed)


def ordered(names: list[str], costs: list[float], hits: np.ndarray) -> list[tuple[str, float, int]]:
    """(rule, cost, rows that it rejects of those that the rules before it leave), next always the one with most of them per cost; ties by
    cost, then name. hits has a row for each text and a column for each rule."""
    left, todo, out = np.ones(len(hits), bool), set(range(len(names))), []
    while todo:
        found = {k: int(hits[left, k].sum()) for k in todo}
        k = min(todo, key=lambda k: (-found[k] / costs[k], costs[k], names[k]))
        out.append((names[k], costs[k], found[k]))
        left &= ~hits[:, k]
        todo.remove(k)
    return out


def estimate(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7, sample_files: int = SAMPLE_FILES) -> list[tuple[str, float, int]]:
    """(rule, seconds on the sample beyond those of reading it, rows rejected of those left), in the order in which to apply the rules. One
    pass over the sample tells for every rule which rows it rejects; then each is timed by itself."""
    local = _sample(docs, sample_rows, seed, sample_files).repartition(8).persist()
    try:
        tests = rules(F.col("t"))
        names = list(tests)
        hits = np.array([r[0] for r in local.select(F.array(*tests.values())).collect()], bool).reshape(-1, len(names))

        def timed(rule: Column) -> float:
            began = time.perf_counter()
            local.agg(F.count_if(rule)).collect()
            return time.perf_counter() - began

        floor = min(timed(F.octet_length("t") < k) for k in range(2))
        costs = [max(timed(tests[name]) - floor, 1e-3) for name in names]
    finally:
        local.unpersist()
    return ordered(names, costs, hits)


def cascade(text: Column, order: list[str]) -> Column:
    """True for a text that breaks none of the rules; each is reached only by rows that passed those before it, and a list that several
    need is made when the first of them is reached, once. Null for none."""
    plain, listed = text_rules(text), list_rules()

    def rest(at: int, made: dict[str, Column]) -> Column:
        out, stop = None, at
        while stop < len(order) and (order[stop] in plain or all(k in made for k in listed[order[stop]][0])):
            name = order[stop]
            test = plain[name] if name in plain else listed[name][1](*(made[k] for k in listed[name][0]))
            out = F.when(test, False) if out is None else out.when(test, False)
            stop += 1
        end = F.lit(True) if stop == len(order) else _listed(text, listed[order[stop]][0], made, lambda more: rest(stop, more))
        return end if out is None else out.otherwise(end)

    return F.when(text.isNull(), False).otherwise(rest(0, {}))


def filter_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that break no rule, all columns unchanged.

    Null, empty and blank texts are rejected; texts too short for a share to mean anything pass the rules on shares; repeated rows
    are judged each on its own and so alike; an empty table gives an empty table; other columns, whatever their names, are
    carried along untouched. Whole texts count, however long.
    """
    order = [name for name, *_ in estimate(docs, sample_rows)]
    spread = common.dealt(docs, docs)
    return spread.where(cascade(common.text_of(spread), order))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return filter_quality(docs).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


def keep_sql() -> str:
    """The same decision in DuckDB SQL, over a table documents."""
    x, c, w, m = LIMITS, LEAST["chars"], LEAST["words"], LEAST["lines"]
    bound = lambda value, name, test: f"list_transform([{value}], lambda {name}: {test})[1]"
    words, lines = "list_filter(string_split(text, ' '), lambda x: x <> '')", r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]'))"
    times = lambda char, of="text": f"(length({of}) - length(replace({of}, {char}, '')))"
    found = lambda kind: f"len(regexp_extract_all(text, '{kind}'))"
    grams = lambda k: f"list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: list_slice(w, i, i + {k - 1}))"
    within = lambda items: f"list_sum(list_transform(range(0, greatest(len({items}), 1), {WINDOW}), lambda j: len(list_distinct(list_slice({items}, j + 1, j + {WINDOW})))))"
    chars = lambda items: f"list_sum(list_transform({items}, lambda x: length(x)))"
    starred = lambda kind: f"len(list_filter(l, lambda x: regexp_matches(x, '{kind}')))"
    counts = {"symbols": found(SYMBOLS), "exclamations": times("'!'"), "capitals": found(CAPITALS), "digits": found(DIGITS)}
    limit, fewer = f"{x['distinct_words']}::DOUBLE", f"{x['distinct_grams']}::DOUBLE"
    stop = ", ".join(f"'{y}'" for y in STOP_WORDS)
    of_words = [
        f"{chars('w')} + len(w) < {x['short_words']}::DOUBLE * len(w)",
        f"CASE WHEN len(list_distinct(w)) < {limit} * len(w) THEN {within('w')} < {limit} * len(w) OR {bound(grams(SEQUENCE), 'g', f'len(list_distinct(g)) < {limit} * len(g)')} ELSE false END",
        f"CASE WHEN len(list_distinct(w)) < {fewer} * len(w) + {GRAM} THEN {bound(grams(GRAM), 'g', f'{within("g")} < {fewer} * len(g)')} ELSE false END",
    ]
    of_lines = [
        f"len(l) - len(list_distinct(l)) > {x['repeated_lines']}::DOUBLE * len(l)",
        f"{chars('l')} - {chars('list_distinct(l)')} > {x['repeated_chars']}::DOUBLE * {chars('l')}",
        f"{starred(BULLET)} > {x['bullets']}::DOUBLE * len(l)",
        f"{starred(ELLIPSIS)} > {x['ellipses']}::DOUBLE * len(l)",
    ]
    function_words = f"len(w) >= {LEAST['stop_words']} AND len(list_intersect([{stop}], w)) < {FUNCTION_WORDS}"
    bad = [
        r"NOT regexp_matches(text, '[^ \t\r\n]')",
        *(f"(length(text) >= {c} AND {n} > {x[k]}::DOUBLE * length(text))" for k, n in counts.items()),
        f"(length(text) >= {c} AND {times("'|'", f"regexp_replace(text, '{TABLE_ROW}', '', 'g')")} > {x['pipes']}::DOUBLE * length(text))",
        f"(length(text) >= {c} AND length(text) > {x['word_length']}::DOUBLE * ({times("' '")} + {times('chr(10)')} + 1))",
        bound(words, "w", f"len(w) > {w} AND ({' OR '.join(of_words)})"),
        bound(lines, "l", f"len(l) > {m} AND ({' OR '.join(of_lines)})"),
        f"({times("' '")} >= {w} AND {found(LETTERED)} < {x['lettered']}::DOUBLE * {found(TOKEN)})",
        bound(words, "w", function_words),
    ]
    return f"text IS NOT NULL AND NOT ({' OR '.join(bad)})"


SQL = f"SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE {keep_sql()}"
