import zlib

import __spark_entry__ as e
from zephyrgrid.llm import language_id


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = e.queries()["op1_language_id"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]["lang"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held)
    assert right / len(held) > 0.97
    clear = [r for r in held if not r["rejected"]]
    assert len(clear) > 0.97 * len(held) and sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in clear) / len(clear) > 0.98


def test_odd_rows(docs, sample):
    model = language_id.fit(sample)
    frame = docs("lang_pred")
    rows = {(r["doc_id"]): r for r in language_id.predict(frame, model).collect()}
    assert len(language_id.predict(frame, model).collect()) == frame.count()
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and rows[i]["rejected"] for i in (2, 3, 4, 8))
    assert rows[6]["lang_pred"] == rows[7]["lang_pred"] and rows[5]["lang_pred"] != "und"
    kept = language_id.keep_known(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(not r["rejected"] for r in language_id.predict(frame, model).collect())


def test_no_labels_one_label_and_empty(docs, sample):
    frame = docs()
    nothing = language_id.fit(frame.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.predict(frame, nothing).collect()} == {"und"}
    single = language_id.fit(sample.where("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(frame, single).collect()} == {("und", 0.0), ("en", 1.0)}
    assert language_id.predict(frame.limit(0), single).count() == 0


def test_label_columns_are_no_inputs(sample):
    from pyspark.sql import functions as F
    model = language_id.fit(sample)
    plain = language_id.predict(sample, model).collect()
    blind = language_id.predict(sample.withColumns({"lang": F.lit("xx"), "source": F.lit(None)}), model).collect()
    assert sorted(plain) == sorted(blind)


def test_long_clean_texts_are_not_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null")
    model, texts = language_id.fit(docs), {}
    for r in docs.orderBy("doc_id").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    assert len(texts) == 4
    rows = [(lang, n, ("\n".join(t) * (1 + n // sum(map(len, t))))[:n]) for lang, t in texts.items() for n in (3_000, 400_000, 1_000_000, 2_000_000)]
    frame = spark.createDataFrame(rows, "lang string, n long, text string")
    got = language_id.predict(frame, model, ("lang", "n")).collect()
    assert len(got) == 16 and all(r["lang_pred"] == r["lang"] and not r["rejected"] and r["score"] > 0.05 for r in got)
    assert language_id.keep_known(frame, model).count() == 16


def test_segments_make_up_the_text():
    for n in (1, 4095, 4096, 4097, 100_001):
        parts = language_id.segments(bytes(range(256)) * (n // 256) + bytes(n % 256))
        assert b"".join(parts) == bytes(range(256)) * (n // 256) + bytes(n % 256)
        assert max(map(len, parts)) <= 4096 and max(map(len, parts)) - min(map(len, parts)) <= 1
