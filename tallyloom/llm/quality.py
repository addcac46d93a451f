"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated, votes are weighed.

Everything runs as built-in expressions; the estimation sees only a histogram of vote patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import fresh
from tallyloom.sources.staging import stage

BLANK = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Very common words of the languages the votes know.
COMMON = "the of and to in is that de la le les et des der die und das el los que en un".split()


def text_statistics(text: Column) -> list[tuple[str, Column]]:
    """Columns to add one after another: counts of words, symbols, repeated lines and words.

    A window of eight words is compared by its 64-bit hash. Repeats are found by sorting hashes
    with their places, so a long text costs n log n; the words covered by repeated windows are
    the gaps between their starts, at most eight each.
    """
    word, line = F.col("_words"), F.col("_lines")
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(word) - WINDOW), lambda i: F.xxhash64(F.slice(word, i + 1, F.lit(WINDOW)))
    )
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, i, step: F.coalesce(F.get("_pairs", i + step)["h"] == x["h"], F.lit(False))
    found = F.filter("_pairs", lambda x, i: same(x, i, -1) | same(x, i, 1))
    gaps = F.transform("_starts", lambda s, i: F.least(F.coalesce(F.get("_starts", i + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
    none = F.array().cast("array<bigint>")
    return [
        ("_text", F.coalesce(text.cast("string"), F.lit(""))),
        ("_words", F.filter(F.split("_text", BLANK + "+"), lambda w: w != "")),
        ("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)),
        ("n_words", F.size("_words").cast("bigint")),
        ("word_chars", F.aggregate("_words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))),
        ("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint")),
        ("n_dup_lines", (F.size(line) - F.size(F.array_distinct(line))).cast("bigint")),
        ("n_lines", F.size(line).cast("bigint")),
        ("n_common", F.size(F.array_intersect(F.transform("_words", lambda w: F.lower(w)), F.array(*[F.lit(w) for w in COMMON])))),
        ("_hashes", F.when(F.size(word) > WINDOW, hashes).otherwise(none)),
        ("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes")),
        ("_pairs", F.when(F.col("_repeats"), pairs)),
        ("_starts", F.when(F.col("_repeats"), F.sort_array(F.transform(found, lambda x: x["i"])))),
        ("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("bigint")),
    ]


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_common"]


def votes() -> dict[str, Column]:
    """What each rule says of a text: 1 good, -1 bad, 0 nothing."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length, symbols = F.col("word_chars") / n, F.col("n_symbols") / n
    repeated, lines = F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    long = F.col("n_words") >= 50
    return {
        "length": rule(long, F.col("n_words") < 20),
        "word_length": rule(length.between(3, 10), (length < 2) | (length > 15)),
        "symbols": rule(symbols < 0.05, symbols > 0.3),
        "repeated_words": rule(repeated < 0.1, repeated > 0.3),
        "repeated_lines": rule((lines < 0.1) & (F.col("n_lines") > 1), lines > 0.3),
        "common_words": rule(F.col("n_common") >= 2, (F.col("n_common") == 0) & long),
    }


def estimate(histogram: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[float]]:
    """Share of good texts and accuracy of each rule, by expectation-maximisation.

    Given the quality of a text, rules are taken to err independently. Accuracies start at 0.8
    and stay in 0.55 to 0.98, so a rule is never read backwards; the share stays in 0.5 to 0.98.
    The histogram has at most 3 to the number of rules entries.
    """
    rules = len(histogram[0][0]) if histogram else 0
    share, right = 0.8, [0.8] * rules
    total = sum(n for _, n in histogram)
    for _ in range(rounds if total else 0):
        good, hits, cast = 0.0, [1.6] * rules, [2.0] * rules
        for pattern, n in histogram:
            odds = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, right))
            p = 1 / (1 + math.exp(-odds))
            good += p * n
            for r, v in enumerate(pattern):
                if v:
                    hits[r] += n * (p if v > 0 else 1 - p)
                    cast[r] += n
        share = min(max(good / total, 0.5), 0.98)
        right = [min(max(h / c, 0.55), 0.98) for h, c in zip(hits, cast)]
    return share, right


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key, _hash``, the statistics, the votes' ``quality`` (0 to 1), ``base_failed`` and ``kept``.

    A text fails at once with under 20 words or over 30 % of its words in repeated windows; any
    other is kept if its posterior probability of being good is at least a half. A null text has
    no words. ``_hash`` is the hash of the text, so that key and hash name a row's content even
    where keys are null or repeated. Statistics are written once, the votes are counted from them.
    """
    frame = docs.select(F.col(key).alias("_key"), F.col(text).alias("_raw"), F.xxhash64(F.col(text)).alias("_hash"))
    for name, column in text_statistics(F.col("_raw")):
        frame = frame.withColumn(name, column)
    said = stage(frame.select("_key", "_hash", *STATISTICS).withColumn("_votes", F.array(*votes().values())))
    counted = said.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3**6 patterns
    share, right = estimate(sorted((tuple(r["_votes"]), r["n"]) for r in counted))
    odds = F.lit(math.log(share / (1 - share)))
    for i, a in enumerate(right):
        odds = odds + F.col("_votes")[i] * math.log(a / (1 - a))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return said.withColumns({"quality": 1 / (1 + F.exp(-odds)), "base_failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)
    )


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of ``docs``. Equal rows share their verdict."""
    own, hash_ = fresh("key"), fresh("hash")
    bad = judge_quality(docs, key, text).where("not kept").select(F.col("_key").alias(own), F.col("_hash").alias(hash_)).distinct()
    same = F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text)) == F.col(hash_))
    return docs.join(bad, same, "left_anti")
