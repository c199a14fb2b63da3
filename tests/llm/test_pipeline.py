import random

import corpus_pipeline
from siftwire.llm import ngram_join, queries
from tests.llm.test_ngram_join import brute_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_up():
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(60)]
        if i % 6 == 0:
            text[30] = "vrumpfig"
        if i % 7 == 1:
            text[10] = "password=b7db7aa4a5fcc78305"
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, t + " ending") for i, t in rows[:60]] + [(2000 + i, t) for i, t in rows[:40]] + [rows[1], (None, rows[2][1]), (3000, None), (3001, "")]
    return [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}", len(t or "")) for i, t in rows], labels


def test_stages_one_by_one(spark, tmp_path):
    rows, labels = made_up()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        after = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if "vrumpfig" not in (r["text"] or ""))
        if name == "near_duplicates":
            groups = brute_force([(r["doc_id"], r["text"]) for r in before], 5, 80)
            kept = {d for d, _, c in groups if d == c} | {None}
            assert sorted(map(str, {r["doc_id"] for r in after})) == sorted(map(str, kept)) and len(after) == len(kept)
        if name == "secrets":
            assert len(after) == len(before) and not any("b7db7aa4" in (r["text"] or "") for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
        if name == "source_mix":
            assert {(r["doc_id"], r["text"]) for r in after} <= {(r["doc_id"], r["text"]) for r in before} and 0.6 * len(before) < len(after) <= len(before)
        if name == "tokens":
            assert len(after) == len(before) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in after)
    assert queries.queries()["pipeline"] and ngram_join


def test_run_gives_the_last_stage(spark, tmp_path):
    rows, labels = made_up()
    spark.createDataFrame(rows[:40], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels[:40], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() <= 40


def test_empty_tables_and_extra_columns(spark, tmp_path):
    rows, labels = made_up()
    kinds = SCHEMA + ", score double, epoch string, n_tokens string, n string, secrets string"
    wide = [(*r, 0.5, "e", "t", "n", "s") for r in rows[:30]]
    for name, docs, known in (("none", [], []), ("wide", wide, labels)):
        folder = tmp_path / name
        spark.createDataFrame(docs, kinds).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        table = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, work in corpus_pipeline.STAGES[:-1]:
            out = work(spark, table, str(folder))
            assert out.columns == table.columns, stage
            assert (out.count() > 0) == bool(docs)
        got = corpus_pipeline.to_tokens(spark, out, str(folder))
        assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and (got.count() > 0) == bool(docs)


def test_held_out_labels_teach_nothing(spark, tmp_path):
    rows, labels = made_up()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    import zlib

    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b" / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [sorted(map(str, corpus_pipeline.drop_toxic(spark, docs, str(tmp_path / x)).collect())) for x in "ab"]
    assert kept[0] == kept[1]


def test_joins_with_checkpoints_get_no_bloom_filters_in_stages(spark):
    key = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    before = spark.conf.get(key)
    assert corpus_pipeline.frugal(lambda spark, docs, sf_dir: spark.conf.get(key))(spark, None, "") == "false"
    assert spark.conf.get(key) == before
