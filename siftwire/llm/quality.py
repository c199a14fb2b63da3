"""Quality rules: repetition and length rules, then a log-likelihood ratio of hashed n-grams.

Every whole text gets its word, symbol and repetition counts; the base rules fail short or repetitive texts.
The method compares two multinomials over hashed word n-grams (words and word pairs): one of the trusted
target texts, one of the raw corpus. A text's score is the sum of its n-grams' log-likelihood ratios divided
by their number. Every text is kept or not by a fixed threshold; no randomness is involved.

Only DataFrame functions are used. Counts are made over all documents with partial aggregation; what is
sent to every task are the log ratios, ``buckets`` numbers at any corpus size.

Defined results: a null text counts as empty; a text without words has score null and fails the base rules;
rows and ids may repeat; without trusted or raw texts all ratios are 0. Existing columns of the output names
are replaced, all others pass through.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of characters other than space and the code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
_OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeated_words(word: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found at least twice in the text.

    Windows are compared by 64-bit hashes. Texts whose windows all differ, nearly all of them, need no more
    than a distinct count; in the others the sorted windows give the places of those with an equal neighbour.
    """
    starts = F.sequence(F.lit(1), F.size(word) - window + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.element_at(word, i + k) for k in range(window))))

    def places(sorted_windows: Column) -> Column:
        same = lambda i, j: F.get(sorted_windows, i)["h"] == F.get(sorted_windows, j)["h"]
        twice = F.filter(sorted_windows, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # The array is bound to a lambda variable so that it is made once and not at every place.
    found = F.flatten(F.transform(F.array(placed), places))
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(window), p - s["last"])).cast("long").alias("n"), p.cast("int").alias("last")),
    )["n"]
    distinct = F.size(F.array_distinct(hashes))
    return F.when(F.size(word) <= window, F.lit(0).cast("long")).when(distinct == F.size(word) - window + 1, F.lit(0).cast("long")).otherwise(covered)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the whole text and ``base_failed``; the words stay in ``__words``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    counted = docs.withColumn("__words", words(F.col(text))).withColumn("n_repeat_words", repeated_words(F.col("__words")))
    return counted.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "base_failed": (F.size("__words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.size("__words")),
        }
    )


def _features(word: Column, buckets: int) -> Column:
    """Hash buckets of the words and of the word pairs."""
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    single = F.transform(word, lambda w: bucket(w))
    pairs = F.transform(F.slice(word, 2, F.greatest(F.size(word) - 1, F.lit(0))), lambda w, i: bucket(F.get(word, i), w))
    return F.concat(single, pairs)


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int, smoothing: float) -> list[float]:
    """The log of the target's over the raw corpus' smoothed share of each bucket, to six decimals.

    The counts of all documents come back as ``buckets`` rows at most, at any corpus size.
    """

    def tally(texts: DataFrame, name: str) -> DataFrame:
        worded = texts.select(words(F.col("text")).alias("word"))
        return worded.select(F.explode(_features(F.col("word"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    rows = tally(target, "t").join(tally(docs, "r"), "bucket", "full").fillna(0, ["t", "r"]).collect()
    all_t, all_r = sum(x["t"] for x in rows), sum(x["r"] for x in rows)
    ratios = [math.log(all_r + smoothing * buckets) - math.log(all_t + smoothing * buckets) if all_t and all_r else 0.0] * buckets
    if all_t and all_r:
        for x in rows:
            ratios[x["bucket"]] += math.log((x["t"] + smoothing) / (x["r"] + smoothing))
    return [round(x, 6) for x in ratios]


def assess(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, smoothing: float = 1.0, threshold: float = -0.05) -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``llr`` and ``kept``.

    ``target`` holds the trusted texts (text), ``docs`` is the raw corpus. ``threshold`` is the least score
    of a kept text: how many nats a mean n-gram may be less likely in the target than in the corpus.
    """
    # A text that the optimiser folds into one array constant.
    weight = F.from_json(F.lit(json.dumps(log_ratios(docs, target, buckets, smoothing))), "array<double>")
    scored = counts(docs).withColumn("__features", _features(F.col("__words"), buckets))
    total = F.aggregate("__features", F.lit(0.0), lambda s, b: s + F.get(weight, b))
    scored = scored.withColumn("llr", F.when(F.size("__features") > 0, total / F.size("__features")))
    scored = scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
    return scored.select(*(c for c in docs.columns if c not in _OUTPUT), *_OUTPUT)
