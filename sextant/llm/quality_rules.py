"""Quality rules as weak supervision.

Each rule votes junk, quality or abstains.  Expectation-maximisation over the counts of vote patterns estimates how often each
rule casts each vote on quality and on junk text, and the share of quality text; a document is kept if its posterior probability of
quality is at least one half.  A few rules of old standing (``base_failed``) reject outright.

Counting is DataFrame code inside each row: words are an array, the windows of three words are hashed with their place and sorted,
and equal neighbours are found twice or more.  Patterns are at most 3 ** rules rows, whatever the corpus, so the estimation
itself runs on the driver.

Edge cases: a null text has no words and fails the base rules, as an empty one does; very long texts are one row's
arrays; ties at one half are kept; rows that repeat are judged alike; an empty table gives no rows; other columns
stay, and their names don't clash with the rules' own, which live in one struct.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

SPACE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50
THRESHOLD = 0.5
ITERATIONS = 60
#: ASCII characters that aren't letters.
OTHERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"
#: Rule: a measure, the range of it that votes quality and the range that votes junk; it abstains elsewhere.
RULES: dict[str, tuple[str, tuple[float, float], tuple[float, float]]] = {
    "symbols": ("n_symbols / n_words", (0.0, 0.05), (0.25, math.inf)),
    "letters": ("n_others / word_chars", (0.0, 0.1), (0.2, math.inf)),
    "repeats": ("n_repeat_words / n_words", (0.0, 0.15), (0.35, math.inf)),
    "stutter": ("n_stutter / n_words", (0.0, 0.02), (0.15, math.inf)),
    "capitals": ("n_upper / word_chars", (0.0, 0.12), (0.4, math.inf)),
    "shouting": ("n_marks / n_words", (0.0, 0.03), (0.25, math.inf)),
    "bars": ("n_bars / n_words", (0.0, 0.01), (0.15, math.inf)),
    "lines": ("n_dup_lines / n_lines", (0.0, 0.1), (0.3, math.inf)),
    "lengths": ("word_chars / n_words", (3.0, 10.0), (14.0, math.inf)),
    "sentences": ("n_stops / n_words", (0.02, 0.25), (0.0, 0.01)),
    "variety": ("n_distinct / n_words", (0.5, 1.0), (0.0, 0.35)),
}
#: Beforehand: P(vote | junk) and P(vote | quality), and the share of quality text.  They start the estimation and weigh as
#: much as BEFOREHAND of each class, so that the classes are junk and quality and not any two kinds of text.
FIRST = {-1: (0.3, 0.01), 1: (0.5, 0.9)}
FIRST_QUALITY = 0.8
BEFOREHAND = 0.05


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def repeated_words(w: Column) -> Column:
    """Words in windows of three that are found twice or more in ``w``, the first included."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def windows(v: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.struct(F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)).alias("h"), i.alias("p"))))

    return F.when(F.size(w) < 4, 0).otherwise(let(windows(w), twice))


def measures(text: Column) -> Column:
    """Struct of a text's counts; null counts as empty."""
    t = F.coalesce(text, F.lit(""))

    def without(marks: str) -> Column:
        return F.length(F.translate(t, marks, ""))

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).alias("n_dup_lines"))

    def of_words(w: Column) -> Column:
        stops = F.size(F.filter(w, lambda x: F.substring(x, -1, 1).isin(".", "!", "?")))
        stutter = F.size(F.filter(w, lambda x, k: F.coalesce(F.get(w, k - 1) == x, F.lit(False))))
        return F.struct(F.size(w).alias("n_words"), stutter.alias("n_stutter"), stops.alias("n_stops"), F.size(F.array_distinct(w)).alias("n_distinct"), repeated_words(w).alias("n_repeat_words"))

    with_words = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    n = F.length(t)
    return F.struct(
        let(words(t), of_words).alias("w"),
        let(with_words, lines).alias("l"),
        without(SPACE).alias("word_chars"),
        (n - without(SYMBOLS)).alias("n_symbols"),
        (n - without(OTHERS)).alias("n_others"),
        (n - without("!")).alias("n_marks"),
        (n - without("|")).alias("n_bars"),
        F.regexp_count(t, F.lit("\\p{Lu}")).alias("n_upper"),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame, name: str = "quality_counts") -> DataFrame:
    """Adds a struct column of the counts (long), the base verdict and each rule's vote: -1 junk, 1 quality, 0 abstains."""
    m = docs.withColumn(name, measures(F.col("text")))
    c = F.col(name)
    flat = {k: c["w"][k] for k in ("n_words", "n_stutter", "n_stops", "n_distinct", "n_repeat_words")} | {k: c["l"][k] for k in ("n_lines", "n_dup_lines")} | {k: c[k] for k in ("word_chars", "n_symbols", "n_others", "n_marks", "n_bars", "n_upper")}
    m = m.withColumn(name, F.struct(*(v.cast("long").alias(k) for k, v in flat.items())))
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])

    def vote(rule: str) -> Column:
        measure, quality, (bad_lo, bad_hi) = RULES[rule]
        over, under = (c[x] for x in measure.split(" / "))
        value = F.when(under > 0, over / under)
        return F.when(value.between(bad_lo, bad_hi), -1).when(value.between(*quality), 1).otherwise(0).cast("tinyint").alias(rule)

    return m.withColumn(name, F.struct(*(c[k].alias(k) for k in flat), failed.alias("base_failed"), F.struct(*map(vote, RULES)).alias("votes")))


Odds = list[dict[int, tuple[float, float]]]


def first_odds() -> Odds:
    return [FIRST | {0: tuple(1 - FIRST[-1][k] - FIRST[1][k] for k in (0, 1))} for _ in RULES]


def estimate(patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS) -> tuple[float, Odds]:
    """EM over (votes, count): the share of quality text, and for each rule, P(vote | junk) and P(vote | quality)."""
    share, first = FIRST_QUALITY, first_odds()
    odds = first
    known = BEFOREHAND * sum(count for _, count in patterns)
    for _ in range(iterations):
        weights = [(votes, count, posterior(votes, share, odds)) for votes, count in patterns]
        sums = [{v: [known * (1 - FIRST_QUALITY) * p[0], known * FIRST_QUALITY * p[1]] for v, p in start.items()} for start in first]
        bad, good = known * (1 - FIRST_QUALITY), known * FIRST_QUALITY
        for votes, count, q in weights:
            bad += count * (1 - q)
            good += count * q
            for own, v in zip(sums, votes, strict=True):
                own[v][0] += count * (1 - q)
                own[v][1] += count * q
        share = good / (good + bad)
        odds = [{v: (x[0] / bad, x[1] / good) for v, x in own.items()} for own in sums]
    return share, odds


def posterior(votes: tuple[int, ...], share: float, odds: Odds) -> float:
    x = math.log(share / (1 - share)) + sum(math.log(o[v][1] / o[v][0]) for v, o in zip(votes, odds, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def judged(docs: DataFrame, columns: list[str], name: str = "quality_counts", threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of the documents and the struct of :func:`counted`, with ``probability`` of quality and ``kept``."""
    rows = materialise(counted(docs, name).select(*columns, name), "quality-counts")
    votes = F.col(name)["votes"]
    patterns = rows.groupBy(*(votes[r].alias(r) for r in RULES)).count().collect()
    share, odds = estimate(sorted((tuple(r[x] for x in RULES), r["count"]) for r in patterns)) if patterns else (FIRST_QUALITY, first_odds())
    x = F.lit(math.log(share / (1 - share)))
    for rule, o in zip(RULES, odds, strict=True):
        gain = {v: math.log(p[1] / p[0]) for v, p in o.items()}
        x = x + F.when(votes[rule] == -1, gain[-1]).when(votes[rule] == 1, gain[1]).otherwise(gain[0])
    probability = 1 / (1 + F.exp(-x))
    kept = ~F.col(name)["base_failed"] & (probability >= threshold)
    return rows.withColumn(name, F.col(name).withField("probability", probability).withField("kept", kept))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = F.col("quality_counts")
    rows = judged(docs, ["doc_id"])
    return rows.select("doc_id", *(c[k].alias(k) for k in COUNTS), c["base_failed"].alias("base_failed"), c["kept"].alias("kept"), c["probability"].alias("probability"))
