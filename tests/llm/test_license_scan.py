import math
import re

from siftwire.llm import license_scan as scan

SCHEMA = "doc_id long, text string, score string"
TEXTS = [
    None,
    "",
    "\n\n",
    "CC BY, cc-by! ccby cc by",
    "Licensed under CC BY-NC 4.0.",
    "All rights reserved.\nall RIGHTS\treserved all rights",
    "the GNU General Public\nLicense",
    "This work is licensed under the GNU General Public License, version 3.\nmore words",
    "Released\nunder the\nMIT License\n\nother paragraph",
    "x\n\nReleased under the MIT licence",
    "Licensed under the Apache License, Version 2.0 and some more text around it, which is no matter here",
    "CC BY ÀK İ é all rights reserved",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "word " * 3000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
]


def tokens(text):
    return re.findall(scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute_force(text, containment):
    text = text or ""
    words = tokens(text)
    places = [(i, label) for phrase, label in scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {label for _, label in places}, 0.0
    paragraphs = [p for p in re.split(r"\n[\x20\x09-\x0D]*\n", text) if "\n" in p]
    for block in text.split("\n") + paragraphs:
        own = set(tokens(block))
        for label, templates in scan.TEMPLATES.items():
            for t in map(set, map(tokens, templates)):
                if len(own & t) >= math.ceil(containment * len(t) - 1e-9):
                    labels.add(label)
                    score = max(score, len(own & t) / len(t))
    at = [i for i, _ in places]
    base = ",".join(sorted({label for _, label in places}))
    return len(words), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), 1.0 if at else score


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i % 9 or None, t, "old") for i, t in enumerate(TEXTS + TEXTS[:5])], SCHEMA)
    for containment in (0.9, 0.6):
        got = scan.scan(docs, containment=containment).collect()
        assert len(got) == len(TEXTS) + 5
        for row in got:
            assert tuple(row)[2:] == brute_force(row["text"], containment), row["text"]


def test_planted_lines_get_all_labels_that_they_meet(spark):
    docs = spark.createDataFrame([(4, TEXTS[4], ""), (7, TEXTS[7], ""), (8, TEXTS[8], ""), (12, TEXTS[12], "")], SCHEMA)
    got = {r["doc_id"]: r["labels"] for r in scan.scan(docs).collect()}
    assert got == {4: "cc-by,cc-by-4.0,cc-by-nc-4.0", 7: "gpl,gpl-3.0", 8: "mit", 12: "cc-by-4.0,cc-by-nc-4.0"}


def test_empty_table(spark):
    assert scan.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_template_that_a_block_meets_is_found(spark):
    by, nc, sa = "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0", "Licensed under CC BY-SA 4.0"
    long = "This work is licensed under a Creative Commons Attribution{} 4.0 International License".format
    pad, cc = "lorem ipsum " * 500, {"by": "cc-by-4.0", "nc": "cc-by-nc-4.0", "sa": "cc-by-sa-4.0"}
    texts = [
        (f"{by}. {nc}.", "by nc"), (f"{nc}. {by}.", "by nc"), (f"{by} and then {sa}", "by sa"), (f"{nc}, {sa}, {by}", "by nc sa"),
        (f"{pad}{by} {pad}{nc} {pad}", "by nc"), (f"{pad}{nc} {pad}{by} {pad}", "by nc"), (f"x {by}\ny {nc}\nend", "by nc"), (f"{by} or CC BY-NC 4.0", "by nc"),
        (f"{long('')}. {long('-NonCommercial')}.", "by nc"), (f"{long('-ShareAlike')}. {long('')}.", "by sa"),
        (nc, "by nc"), (f"{nc}. {sa}.", "by nc sa"), (f"{pad}{sa} {pad}", "by sa"), (f"{long('-NonCommercial')} {long('-ShareAlike')}", "by nc sa"), (by, "by"),
    ]
    docs = spark.createDataFrame([(i, t, "") for i, (t, _) in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: [x for x in r["labels"].split(",") if x != "cc-by"] for r in scan.scan(docs, phrases={"cc by": "cc-by"}).collect()}
    for i, (text, want) in enumerate(texts):
        assert got[i] == sorted(cc[k] for k in want.split()), text[-90:]
    alone = scan.scan(spark.createDataFrame([(1, by, "")], SCHEMA), containment=0.6).first()
    assert "cc-by-4.0" in alone["labels"].split(",")


def test_the_positional_filter_drops_candidates_but_no_result(spark):
    # Blocks with a rare token of a template and enough others, but too few that come after it in the global order.
    lines = ["the License compliance and of the software in with provided", "warranty License use compliance http www apache the a of to in", TEXTS[10], TEXTS[7], TEXTS[12]]
    docs = spark.createDataFrame([(i, f"{line} {i % 7}", "") for i, line in enumerate(lines * 20)], SCHEMA)
    for containment in (0.95, 0.6):
        found = {kind: scan.template_candidates(docs, containment=containment, positional=kind) for kind in (True, False)}
        met = {k: {(r["text_key"], r["label"], tuple(r["template"])) for r in v.where(f"size(array_intersect(tokens, template)) >= needed").collect()} for k, v in found.items()}
        assert met[True] == met[False] and met[True]
        assert found[True].count() < found[False].count()


def test_words_are_matched_by_named_characters(spark):
    """Same words as the contract's class, for every character of the first plane and some beyond, in less than half of its time."""
    import time

    from pyspark.sql import functions as F

    points = [*range(0xD800), *range(0xE000, 0x10000), 0x10000, 0x1F600, 0x10FFFF]
    one = spark.createDataFrame([("a" + chr(p) + "b",) for p in points], "text string")
    by = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    assert one.where(by(scan.WORD) != by(scan.SPARK_WORD)).count() == 0
    texts = spark.range(2000).select(F.repeat(F.lit("the quick brown fox, und noch ein Wörtchen 42. "), 60).alias("text")).repartition(2).cache()
    assert texts.count() == 2000

    def took(words):
        times = []
        for _ in range(3):
            began = time.perf_counter()
            texts.agg(F.sum(F.size(words))).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    assert took(scan.words(F.col("text"))) < took(by(scan.WORD)) / 2
