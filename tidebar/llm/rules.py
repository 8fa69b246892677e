"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes that a document is bad or good, or abstains. Expectation-maximisation over
the counts of vote patterns (at most 3 ** rules rows, whatever the data) estimates how often
each rule is right; the posterior probability of being good decides. A document with few
words or mostly repetition fails at once (``base_failed``).

Variety is the number of different words in each block of ``BLOCK`` words, added up, so texts
of any length are held to the same measure.

Words are runs between ASCII white space. Null text counts as empty: no words, base failed.
Very long texts are judged whole; repeated windows are found with hash sets and sorts inside
the row. Repeated rows are judged alike. On an empty table nothing is estimated or returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: Words per block in which different words are counted, so that variety doesn't fall with length.
BLOCK = 100
STEPS = 25
#: Column of measures; a name that the tables given don't use.
M = "__measures"

#: Name, what makes the rule vote bad, what makes it vote good, over the measures.
RULES = [
    ("length", "n_words < 10", "false"),
    ("symbols", "5 * n_symbols > n_words", "false"),
    ("lines", "2 * n_dup_lines > n_lines", "false"),
    ("repeats", "10 * n_repeat_words > n_words", "false"),
    ("variety", "5 * n_distinct < n_words", "false"),
    ("shouting", "2 * n_upper > word_chars", "false"),
    ("marks", "5 * n_marks > n_words", "false"),
    ("word_size", "word_chars > 14 * n_words OR word_chars < 2 * n_words", "false"),
    ("prose", "false", "50 * n_symbols <= n_words AND 5 * n_upper <= word_chars AND 20 * n_marks <= n_words"),
    ("fresh", "false", "20 * n_repeat_words <= n_words AND 50 * n_symbols <= n_words AND 3 * n_distinct > n_words"),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct of measures in the column ``M``."""
    some = f"coalesce(`{text}`, '')"
    step = docs.withColumn(f"{M}_words", F.expr(
        rf"regexp_extract_all({some}, '[^\\x20\\x09-\\x0D]+', 0)"))
    lines = f"filter(split({some}, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    step = step.withColumns({
        f"{M}_lines": F.expr(lines),
        f"{M}_hashes": F.expr(f"transform({M}_words, w -> xxhash64(w))"),
    })
    five = ", ".join(f"{M}_hashes[i + {k}]" for k in range(WINDOW))
    step = step.withColumn(f"{M}_windows", F.expr(
        f"CASE WHEN size({M}_hashes) >= {WINDOW} THEN transform(sequence(0, size({M}_hashes) - {WINDOW}),"
        f" i -> xxhash64({five})) ELSE array() END"))
    # Only texts with a repeated window sort them: pairs of hash and place, equal neighbours.
    step = step.withColumn(f"{M}_sorted", F.expr(
        f"CASE WHEN size(array_distinct({M}_windows)) < size({M}_windows) THEN"
        f" sort_array(transform({M}_windows, (h, i) -> struct(h AS h, i AS i))) END"))
    step = step.withColumn(f"{M}_starts", F.expr(
        f"sort_array(transform(filter(sequence(0, size({M}_sorted) - 1), k ->"
        f" {M}_sorted[k].h <=> get({M}_sorted, k - 1).h OR {M}_sorted[k].h <=> get({M}_sorted, k + 1).h),"
        f" k -> {M}_sorted[k].i))"))
    repeat = (f"coalesce(aggregate(transform({M}_starts, (s, k) -> least({WINDOW},"
              f" coalesce(get({M}_starts, k + 1) - s, {WINDOW}))), 0L, (a, x) -> a + x), 0L)")
    parts = {
        "n_words": f"CAST(size({M}_words) AS BIGINT)",
        "word_chars": f"CAST(length(array_join({M}_words, '')) AS BIGINT)",
        "n_symbols": f"CAST(regexp_count({some}, '[#*$%&|<>]') AS BIGINT)",
        "n_lines": f"CAST(size({M}_lines) AS BIGINT)",
        "n_dup_lines": f"CAST(size({M}_lines) - size(array_distinct({M}_lines)) AS BIGINT)",
        "n_repeat_words": repeat,
        "n_distinct": f"CAST(size(array_distinct(transform({M}_hashes, (h, i) -> xxhash64(h, i div {BLOCK})))) AS BIGINT)",
        "n_upper": f"CAST(regexp_count({some}, '\\\\p{{Lu}}') AS BIGINT)",
        "n_marks": f"CAST(regexp_count({some}, '[!?]') AS BIGINT)",
    }
    inside = ", ".join(f"'{name}', {sql}" for name, sql in parts.items())
    step = step.withColumn(f"{M}_m", F.expr(f"named_struct({inside})"))
    # A generator keeps later filters from being computed from the text once more.
    return step.select(*[F.col(f"`{c}`") for c in docs.columns],
                       F.explode(F.array(f"{M}_m")).alias(M))


def _on(sql: str) -> Column:
    """An expression over the measures."""
    for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                 "n_repeat_words", "n_distinct", "n_upper", "n_marks"):
        sql = sql.replace(name, f"{M}.{name}")
    return F.expr(sql)


def pattern() -> Column:
    """The votes as one number: a digit 0 (abstains), 1 (good) or 2 (bad) for each rule."""
    total = F.lit(0)
    for i, (_, bad, good) in enumerate(RULES):
        vote = F.when(_on(bad), 2).when(_on(good), 1).otherwise(0)
        total = total + vote * 3**i
    return total


def digits(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(RULES))]


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """Probability of being good for each pattern of votes.

    A rule that votes is right with its own accuracy, whatever the class; good and bad are
    alike likely before any vote, so that a document without a good vote isn't saved by
    being one of many. Nine right votes of ten are assumed for each rule beforehand.
    """
    codes = sorted(counts)
    votes = [digits(c) for c in codes]
    accuracy = [0.9] * len(RULES)
    bad = [0.5] * len(codes)
    for _ in range(STEPS):
        weigh = [math.log(a / (1 - a)) for a in accuracy]
        logit = [sum(w if x == 2 else -w for w, x in zip(weigh, v) if x) for v in votes]
        bad = [1 / (1 + math.exp(-x)) for x in logit]
        for i in range(len(RULES)):
            cast = [(b if v[i] == 2 else 1 - b, counts[c]) for b, c, v in zip(bad, codes, votes) if v[i]]
            right = sum(p * n for p, n in cast)
            accuracy[i] = min(max((right + 9) / (sum(n for _, n in cast) + 10), 0.55), 0.995)
    return {c: 1 - b for c, b in zip(codes, bad)}


def fit(docs: DataFrame, text: str = "text") -> dict[int, float]:
    """Posteriors by pattern; only counts of patterns reach the driver."""
    counts = measured(docs.select(text), text).groupBy(pattern().alias("p")).count().collect()
    return posteriors({r[0]: r[1] for r in counts})


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures in ``M``, then ``base_failed``, ``good`` (posterior) in ``M_verdict``."""
    model = fit(docs, text)
    seen = measured(docs, text)
    if model:
        by_pattern = F.create_map(*[F.lit(x) for c, p in model.items() for x in (c, p)])
        good = F.element_at(by_pattern, pattern())
    else:
        good = F.lit(None).cast("double")
    failed = _on(BASE_FAILED)
    return seen.withColumn(f"{M}_verdict", F.struct(
        failed.alias("base_failed"), good.alias("good"),
        (~failed & (good >= 0.5)).alias("kept")))


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    found = judged(docs, text)
    return found.filter(f"{M}_verdict.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
