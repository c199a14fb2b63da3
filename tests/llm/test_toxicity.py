import random
from collections import Counter

from pyspark.sql import functions as F

from siftwire.llm import toxicity

SCHEMA = "doc_id long, text string, score string"


def made_up(n):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 < 2
        text = [rng.choice(words) for _ in range(rng.choice([5, 30, 200]))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vrumpfig", "Zagglo!", "plozzing"]))
        docs.append((i, " ".join(text), "old"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = made_up(800)
    odd = [(9000, None, ""), (9001, "", ""), (None, "plozzing vrumpfig Zagglo", ""), (9002, "vrumpfig " + "ne ra lo " * 250_000, "")]
    rows = spark.createDataFrame(docs + odd, SCHEMA).repartition(4)
    table = spark.createDataFrame(labels + [(0, None), (None, 1), (123456, 1)], "doc_id long, toxic int")
    got = toxicity.classify(rows, table).persist()
    assert got.count() == 804 and sorted(got.columns) == sorted(["doc_id", "text", "held_out", "score", "predicted"])
    judged = got.join(table.where("toxic is not null"), "doc_id").where("held_out")
    assert judged.where("predicted = toxic").count() / judged.count() > 0.97
    scores = {r["doc_id"]: r["score"] for r in got.where("doc_id is null or doc_id >= 9000").collect()}
    assert scores[9000] == scores[9001] < 0.5 < scores[None] and 0 <= scores[9002] <= 1
    assert {r["doc_id"] for r in got.where("held_out").select("doc_id").collect()} == {r["doc_id"] for r in rows.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first()["score"] < 0.01
    assert toxicity.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_counts_of_presences_are_those_of_a_plain_loop():
    import numpy as np
    import pyarrow as pa

    orders, bits = (3, 4, 5), 20
    long = "abc def ghij " * 60_000
    texts, toxic = [long, "abc def", None, "", long + "zq", "ABC def"], [1, 0, 0, 1, 0, 1]
    want = np.zeros((2, 1 << bits), int)
    for text, label in zip(texts, toxic, strict=True):
        points = toxicity._code_points(text)
        found = set()
        for buckets, ok in toxicity._grams(points, orders, bits):
            found |= set(buckets[ok].tolist())
        want[label, list(found)] += 1
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array(toxic, pa.int32())})
    for batches in ([batch], [batch.slice(0, 2), batch.slice(2)]):
        got = np.zeros((2, 1 << bits), int)
        for part in toxicity._count_udf(orders, bits)(iter(batches)):
            got[0, part["bucket"].to_numpy()] += part["clean"].to_numpy()
            got[1, part["bucket"].to_numpy()] += part["toxic"].to_numpy()
        assert (got == want).all()


def test_ratios_and_scores_are_those_of_the_formula(spark):
    """Log-count ratios from plain counts of presences, and scores from plain counts of places."""
    import numpy as np

    docs, labels = made_up(200)
    table = spark.createDataFrame(docs, SCHEMA).repartition(3)
    toxic = {}
    for doc_id, label in labels:
        if doc_id is not None and label in (0, 1):
            toxic[doc_id] = max(toxic.get(doc_id, 0), label)
    orders, bits = (3, 4, 5), 16

    def grams(text):
        found = Counter()
        for buckets, ok in toxicity._grams(toxicity._code_points(text), orders, bits):
            found.update(buckets[ok].tolist())
        return found

    rows = [(r["text"], toxic[r["doc_id"]]) for r in table.collect() if r["doc_id"] in toxic]
    classes = Counter(t for _, t in rows)
    present = [Counter(b for text, t in rows if t == c for b in grams(text)) for c in (0, 1)]
    train = spark.createDataFrame([(text or "", t) for text, t in rows], "text string, toxic int").repartition(3)
    got = {r["bucket"]: (r["ratio"], r["z"]) for r in toxicity.ratios_of(train, dict(classes), orders, bits, 0.5, 3).collect()}
    want = {}
    for b in present[0].keys() | present[1].keys():
        if present[0][b] + present[1][b] >= 3:
            p, q = present[1][b] + 0.5, present[0][b] + 0.5
            ratio = np.log(p / classes[1]) - np.log(q / classes[0])
            want[b] = (ratio, abs(ratio) / np.sqrt(1 / p + 1 / q))
    assert got.keys() == want.keys() and all(np.allclose(got[b], want[b], atol=1e-12) for b in want)

    for density in (True, False):
        model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"), bits=bits, max_features=500, density=density)
        best = sorted(want, key=lambda b: (-round(want[b][1], 9), b))
        assert set(model.buckets.tolist()) <= {b for b in best if want[b][1] >= want[best[499]][1] - 1e-6}
        kept = {int(b): float(w) for b, w in zip(model.buckets, model.weights, strict=True)}
        for row in toxicity.score(table, model, output="p").collect()[:40]:
            value = {b: np.log1p(1000 * n / (len(row["text"] or "") + 200)) if density else 1.0 for b, n in grams(row["text"]).items()}
            assert abs(row["p"] - 1 / (1 + np.exp(-(model.bias + sum(kept.get(b, 0.0) * x for b, x in value.items()))))) < 1e-9


def test_choices_are_made_without_held_out_rows(spark):
    docs, labels = made_up(200)
    table, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = toxicity.cross_validated(table, known, bits=14)
    turned = known.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, toxicity.cross_validated(table, turned, bits=14).collect()))
    right = {r["toxic"]: r["rejected"] / r["n"] for r in seen.collect()}
    assert right[1] > 0.8 and right[0] < 0.2


def test_densities_of_long_texts_are_those_of_a_plain_loop(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "PIECE", 50)
    orders, bits, rng = (2, 3, 5), 12, random.Random(1)
    texts = ["".join(rng.choices("abc ", k=n)) for n in (0, 1, 46, 47, 48, 49, 50, 51, 97, 98, 99, 100, 101, 230)] + [None]
    slot = np.arange(1 << bits, dtype=np.int32)
    rows, kept, dense = toxicity._hits(texts, slot, orders, bits)
    got = {(int(r), int(k)): d for r, k, d in zip(rows, kept, dense, strict=True)}
    want = {}
    for row, text in enumerate(texts):
        found = Counter()
        for buckets, ok in toxicity._grams(toxicity._code_points(text), orders, bits):
            found.update(buckets[ok].tolist())
        want |= {(row, b): np.log1p(1000 * n / (len(text or "") + 200)) for b, n in found.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_long_clean_texts_that_meet_a_word_by_chance(spark):
    """A word that every toxic text dwells on and long clean texts hold once."""
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 7))) for _ in range(200)]
    rows = []
    for i in range(400):
        text = rng.choices(words, k=60 if i % 2 else 600)
        for _ in range(3 if i % 2 else 1):
            text.insert(rng.randrange(len(text)), "plozz" + rng.choice(words))
        rows.append((i, " ".join(text), i % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.classify(table.select("doc_id", "text"), table.select("doc_id", "toxic")).join(table.select("doc_id", "toxic"), "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() / got.count() > 0.95
