"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns,
at most 3**rules of them however many documents there are, estimates how often each rule votes what on good and
on bad documents. A document's verdict is the posterior probability of good, at least 0.5 to keep it; no single
rule decides. Documents that fail the base rule (under 50 words, or more than half of the words in repeated
three-word windows) are rejected at once.

Defined results: null and empty text have no words and fail the base rule; a very long text is judged whole; repeated
rows are judged alike, each; a posterior of exactly 0.5 keeps;
n_repeat_words and n_dup_lines count within one text; an empty table gives no rows; other columns pass through
``keep`` untouched and are ignored by ``quality``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import GAP_RE, WORD_RE, fresh, written

ROUNDS = 30
#: Pseudo-documents that hold each rule to what its votes mean, whose weight falls as the corpus grows; share of good at first.
HOLD, GOOD_AT_FIRST = 100, 0.85


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words in three-word windows that the text has at least twice."""

    def repeated(sorted_: Column) -> Column:
        before = lambda i: F.get(sorted_, i - 1)["h"]
        after = lambda i: F.get(sorted_, i + 1)["h"]
        twice = F.filter(sorted_, lambda x, i: F.coalesce(before(i) == x["h"], F.lit(False)) | F.coalesce(after(i) == x["h"], F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), repeated))


def measures(text: Column) -> Column:
    """A struct of what the rules look at: n_words, word_chars, n_symbols, n_marked
    (symbols at a word's end), n_ends (marks at a sentence's end), n_lines, n_dup_lines, n_repeat_words, n_distinct."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_RE))
        return let(
            lines,
            lambda lines: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.regexp_count(text, F.lit(rf"[#*$%&|<>](?={GAP_RE}|$)")).cast("long").alias("n_marked"),
                F.regexp_count(text, F.lit(rf"[.!?](?={GAP_RE}|$)")).cast("long").alias("n_ends"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _covered(words).cast("long").alias("n_repeat_words"),
                F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            ),
        )

    return let(F.array_remove(F.split(text, GAP_RE), ""), of)


def _vote(bad: Column, good: Column | None = None) -> Column:
    """A vote; without ``good`` the rule only ever votes bad or abstains."""
    return (F.when(bad, -1) if good is None else F.when(bad, -1).when(good, 1)).otherwise(0)


def votes(m: Column) -> list[Column]:
    """The rules' votes on measures, -1, 0 or 1 each, in the order of RULES."""
    n = m["n_words"]
    return [
        _vote(n < 30),
        _vote((m["word_chars"] < 2 * n) | (m["word_chars"] > 20 * n)),
        _vote(m["n_symbols"] * 10 > n, m["n_symbols"] * 100 <= n),
        _vote(m["n_marked"] * 20 > n, m["n_marked"] * 200 <= n),
        _vote(m["n_ends"] * 200 < n, m["n_ends"] * 50 > n),
        _vote((m["n_dup_lines"] > 2) & (m["n_dup_lines"] * 10 > 3 * m["n_lines"])),
        _vote(m["n_repeat_words"] * 10 > 3 * n, m["n_repeat_words"] * 10 <= n),
        _vote((m["n_distinct"] * 5 < n) & (n < 2000)),
    ]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


#: What the votes mean before any document was seen, on bad and on good ones, for rules that only vote bad and for
#: rules that vote both ways; one entry a rule.
ONE_WAY = ({-1: 0.3, 0: 0.69, 1: 0.01}, {-1: 0.01, 0: 0.98, 1: 0.01})
BOTH_WAYS = ({-1: 0.6, 0: 0.2, 1: 0.2}, {-1: 0.02, 0: 0.18, 1: 0.8})
RULES = (ONE_WAY, ONE_WAY, BOTH_WAYS, BOTH_WAYS, BOTH_WAYS, ONE_WAY, BOTH_WAYS, ONE_WAY)


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[dict[int, float]]]]:
    """Share of good and, for each rule, the odds of its votes on bad and good documents, from counts of patterns."""
    total = sum(n for _, n in patterns) or 1
    hold = HOLD
    share, odds = GOOD_AT_FIRST, RULES
    for _ in range(ROUNDS):
        sums = [[{v: hold * p for v, p in side.items()} for side in rule] for rule in RULES]
        good = GOOD_AT_FIRST * hold
        for pattern, n in patterns:
            x = posterior(pattern, share, odds)
            good += n * x
            for rule, v in enumerate(pattern):
                sums[rule][0][v] += n * (1 - x)
                sums[rule][1][v] += n * x
        share = good / (total + hold)
        odds = [[{v: c / sum(side.values()) for v, c in side.items()} for side in rule] for rule in sums]
    return share, odds


def posterior(pattern: tuple[int, ...], share: float, odds) -> float:
    lean = math.log(share / (1 - share)) + sum(math.log(rule[1][v] / rule[0][v]) for rule, v in zip(odds, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, lean))))


def judged(measured: DataFrame, m: Column) -> Column:
    """The posterior probability of good, as a column of ``measured``; one aggregation over all its rows."""
    counts = measured.select(*(v.alias(f"v{i}") for i, v in enumerate(votes(m)))).groupBy(*(f"v{i}" for i in range(len(RULES)))).count().collect()
    share, odds = estimate([(tuple(r[: len(RULES)]), r["count"]) for r in sorted(counts)])
    lean = F.lit(math.log(share / (1 - share)))
    for rule, vote in zip(odds, votes(m), strict=True):
        weight = {v: math.log(rule[1][v] / rule[0][v]) for v in (-1, 0, 1)}
        lean = lean + F.when(vote == -1, weight[-1]).when(vote == 1, weight[1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-lean))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base measures, base_failed, the posterior and kept."""
    measured = written(docs.select(F.col(id_col), measures(F.col(text_col)).alias("_m")), "quality")
    m = F.col("_m")
    p = judged(measured, m)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select(id_col, *(m[f].alias(f) for f in fields), base_failed(m).alias("base_failed"), p.alias("posterior"), (~base_failed(m) & (p >= 0.5)).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    name = fresh(docs.columns, "_quality")
    measured = written(docs.withColumn(name, measures(F.col(text_col))), "quality")
    m = F.col(name)
    return measured.where(~base_failed(m) & (judged(measured, m) >= 0.5)).drop(name)
