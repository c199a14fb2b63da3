import math
import re
from collections import Counter

from siftwire.llm import quality

SCHEMA = "doc_id long, text string, kept string"


def brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


TEXTS = [
    None,
    "",
    " \n\t ",
    "one two three",
    "a b c d e",
    "a b c d e f a b c d e",
    "a a a a a a a a a a a a",
    "x y\nx y\n\n\nx y \nx y",
    "# * $ % & | < > é ü 😀   no break",
    "one two three four five six seven eight nine ten eleven",
    " ".join(f"w{i}" for i in range(300)) + " w1 w2 w3 w4 w5 w6 " + " ".join(f"v{i}" for i in range(300)),
    " ".join(f"w{i % 50}" for i in range(5000)),
]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], None)], SCHEMA)
    got = quality.assess(docs, docs.where("doc_id = 9")).collect()
    assert len(got) == len(TEXTS) + 1
    for row in got:
        want = brute_force(row["text"])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == want
        assert row["kept"] in (True, False) and not (row["base_failed"] and row["kept"])
        assert (row["llr"] is None) == (row["n_words"] == 0)


def test_ratio_is_that_of_the_two_multinomials(spark):
    target = spark.createDataFrame([("good good words",)], "text string")
    docs = spark.createDataFrame([(0, "good good words", ""), (1, "bad junk junk junk", "")], SCHEMA)
    got = {r["doc_id"]: r["llr"] for r in quality.assess(docs, target, buckets=100_000, smoothing=0.5).collect()}
    share = lambda n, total: math.log((n + 0.5) / (total + 0.5 * 100_000))
    words = [("good", 2, 2), ("good", 2, 2), ("words", 1, 1), ("good good", 1, 1), ("good words", 1, 1)]
    assert abs(got[0] - sum(share(t, 5) - share(r, 12) for _, t, r in words) / 5) < 1e-5
    assert got[1] < 0 < got[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality.assess(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i j k", "")], SCHEMA)
    assert quality.assess(some, none).first()["llr"] == 0.0


def test_very_long_texts(spark):
    texts = [" ".join(f"w{i % 70_000}" for i in range(200_000)), "x" * 2_000_000, "a b\n" * 100_000, " ".join(f"v{i}" for i in range(150_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality.assess(docs, docs.where("doc_id = 3")).collect():
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == brute_force(row["text"])
