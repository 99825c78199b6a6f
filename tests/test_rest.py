import pytest
from pyspark.sql import functions as F

from velum.operators import evaluate, gate, mask, reports
from velum.sources import readers
from velum.streaming import streams

SPANS = "id string, pos int, start int, end int, entity string"


def test_span_metrics(spark):
    gold = spark.createDataFrame([("a", 0, 0, 5, "BR_CPF"), ("a", 1, 10, 15, "BR_CEP")], SPANS)
    predicted = spark.createDataFrame([("a", 0, 0, 4, "BR_CPF"), ("a", 1, 10, 15, "OTHER")], SPANS)
    for mode, want in (("exact", (0, 2, 2)), ("partial", (1, 1, 1)), ("untyped", (2, 0, 0))):
        rows = evaluate.counts(evaluate.match_spans(gold, predicted, mode)).collect()
        assert tuple(sum(r[c] for r in rows) for c in ("tp", "fp", "fn")) == want
    per_doc = evaluate.counts(evaluate.match_spans(gold, gold))
    assert evaluate.bootstrap_f1(per_doc, 50) == (1.0, 1.0)
    docs = spark.createDataFrame([("a", 20)], "id string, n_chars int")
    assert evaluate.char_kappa(gold, gold, docs).first().kappa == 1.0


def test_html_and_findings(spark, tmp_path):
    page = "<title>T</title><script>x</script><p>Art. 1 Vigente.</p><p><strike>Art. 2 Revogado.</strike></p><p>Art. 3 &eacute; valido.</p>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.text for r in readers.html_to_text(df).orderBy("page_id").collect()] == ["Art. 1 Vigente.\n\nArt. 3 é valido.", ""]
    (tmp_path / "f.csv").write_text("doc_id,sit_name,start,end\na,CPF,3,9\n")
    assert readers.findings_csv(spark, str(tmp_path / "f.csv")).first().entity == "BR_CPF"
    (tmp_path / "f.json").write_text('{"resourcesAffected":{"s3Object":{"key":"x/doc-1.txt"}},"classificationDetails":{"result":{"sensitiveData":[{"detections":[{"type":"ZZZ","occurrences":{"lineRanges":[{"startColumn":4,"endColumn":9}]}}]}]}}}\n')
    assert tuple(readers.findings_json(spark, str(tmp_path / "f.json")).first()) == ("doc-1", "OTHER", 3, 9)
    needles = spark.createDataFrame([("a", "x1 y x1", "x1", 0), ("a", "x1 y x1", "x1", 1), ("a", "x1 y x1", "x1", 2)], "id string, text string, needle string, no int")
    assert [r.start for r in readers.locate(needles, "id", "text", "needle", "no").orderBy("no").collect()] == [0, 5, None]
    answers = spark.createDataFrame([('sure {"entities":[{"type":"A","text":"b"},{"type":"A","text":""}]} ok',), ("none",)], "raw string")
    assert [len(r[0]) for r in answers.select(readers.tolerant_json(answers.raw)).collect()] == [1, 0]


def test_mask_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id":1,"text":"cpf 529.982.247-25"}\n')
    stream = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "in"))
    q = streams.mask_stream(stream, entities=["BR_CPF"]).writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("masked").first().masked == "cpf <BR_CPF>"


def test_entry_has_queries():
    import __spark_entry__

    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 50 and set(oracle) <= set(queries)


def test_sinks_and_gates(spark, tmp_path):
    df = spark.createDataFrame([(1, "cpf 529.982.247-25"), (2, "ola")], "doc_id long, text string")
    reports.write_text(mask.mask(df, entities=["BR_CPF"]), f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["cpf <BR_CPF>", "ola"]
    corpus = df.select(F.lit("dev").alias("file"), F.col("doc_id").alias("id"), "text", F.array(F.lit(1)).alias("spans"))
    made = reports.write_corpus(corpus, f"{tmp_path}/c", 42).first()
    assert (made.n_docs, made.n_spans, made.seed, len(made.sha256)) == (2, 2, 42, 64)
    assert spark.read.json(f"{tmp_path}/c/data").count() == 2
    decided = gate.decide(df, entities=["BR_CPF"])
    with pytest.raises(reports.IngestionError):
        reports.gate_ingestion(decided)
    passed, held = reports.gate_ingestion(decided, quarantine=True)
    assert [r.doc_id for r in passed.collect()] == [2] and [r.doc_id for r in held.collect()] == [1]
    assert [r.doc_id for r in reports.gate_answers(df, mask.residual(df, entities=["BR_CPF"])).collect()] == [2]
    spans = spark.createDataFrame([([(0, 5), (3, 8), (8, 9), (4, 6)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in spans.select(reports.without_overlaps_from_right(F.col("s"))).first()[0]] == [(4, 6), (8, 9)]


def test_find_in_sql_and_windows_on_a_stream(spark, tmp_path):
    streams.register_sql(spark, entities=["BR_CPF"])
    spark.createDataFrame([(1, "cpf 529.982.247-25")], "i int, text string").createOrReplaceTempView("texts")
    assert [r.entity for r in spark.sql("SELECT inline(velum_find(text)) FROM texts").collect()] == ["BR_CPF"]
    (tmp_path / "in").mkdir()
    lines = [f'{{"doc_id":{i},"at":"2024-01-01T00:{i:02d}:00Z","text":"cpf 529.982.247-25"}}' for i in (1, 2, 14)] + ['{"doc_id":9,"at":"2024-01-01T02:00:00Z","text":"cpf 529.982.247-25"}']
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("doc_id long, at timestamp, text string").json(str(tmp_path / "in"))
    counted = streams.exposure_by_window(streams.find_stream(stream, entities=["BR_CPF"]), "at")
    q = counted.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(r.n_matches for r in spark.table("windows").collect()) == [1, 2]
