"""The work on generated texts is dealt over all cores and done once for each row."""

import pytest

from velum.plans import catalog


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("customers")
    spark.range(2000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{where}/customer.parquet")
    return str(where)


@pytest.mark.parametrize("query", ["matches_per_document"])
def test_one_row_group_becomes_many_tasks(spark, customers, query):
    rows = catalog.QUERIES[query](spark, customers).rdd.glom().map(len).collect()
    assert len([n for n in rows if n]) >= 2 * spark.sparkContext.defaultParallelism
    assert max(rows) < sum(rows) / spark.sparkContext.defaultParallelism


def test_sentence_computes_its_number_once():
    from velum.functions import sqlx as F
    from velum.sources import synth

    assert synth.sentence(F.col("k")).sql.count("7919") == 2  # the number's base and the card's


@pytest.mark.parametrize("query, scans", [("vault_reveal", 3), ("top_exposed", 1), ("exposure_rollup", 1), ("residual_after_mask", 1), ("find_cpf_and_card", 1)])
def test_every_scan_of_texts_stands_over_dealt_keys(spark, customers, query, scans):
    plan = catalog.QUERIES[query](spark, customers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("FileScan parquet") == scans


def test_exit_codes_count_each_case_once(spark, customers, monkeypatch):
    from velum.operators import gate

    calls, whole = [], gate.find
    monkeypatch.setattr(gate, "find", lambda *args, **options: calls.append(1) or whole(*args, **options))
    rows = {(r.which, r.fail_on_suspect): r.exit_code for r in catalog.QUERIES["scan_exit_code"](spark, customers).collect()}
    assert len(calls) == 4
    assert rows == {("all", False): 1, ("all", True): 1, ("suspects", False): 0, ("suspects", True): 1, ("none", False): 0, ("none", True): 0, ("empty", False): 0, ("empty", True): 0}


def test_ascii_folds_without_the_table():
    from velum.operators import detect

    every = [chr(i) for i in range(128)] + ["É", "ＡÇ b", "ı", "K", "ß"]
    for text in [*every, "".join(every), "".join(map(chr, range(128)))]:
        assert detect._folded(text) == text.translate(detect._FOLD)


def _counting(name, *options):
    from velum.operators import detect
    from velum.operators.registry import entities

    calls = []
    whole = getattr(detect._Scanner, name)
    kind = type("Counting", (detect._Scanner,), {name: lambda self, *args: calls.append(1) or whole(self, *args)})
    return kind(entities(["BR_CPF"]), entities(), 0.0, True, False), calls


def test_a_batch_looks_for_shields_once():
    scanner, calls = _counting("shields")
    found = scanner.matches(["cpf 0052998224725", "cartao 4111111111111111", "cpf 5299822472500"] * 50)
    assert [[m.value for m in ms] for ms in found] == [["52998224725"], [], ["52998224725"]] * 50
    assert len(calls) == 1


def test_a_batch_is_searched_for_evasion_once():
    scanner, calls = _counting("candidates")
    found = scanner.matches(["cpf 529\u200b98224725", "cpf 5\u00ad29.982.247-2\u200b5 fim", "é 7\u200b8"] * 50)
    assert [[(m.start, m.end) for m in ms] for ms in found] == [[(4, 16)], [(4, 20)], []] * 50
    assert len(calls) == 2


def test_scan_reads_nothing_before_it_is_asked(spark):
    from pyspark.sql import functions as F

    from velum.operators import gate

    df = spark.range(1).select("id", F.raise_error(F.concat(F.lit("read "), F.col("id").cast("string"))).cast("string").alias("text"))
    found = gate.scan(df, entities=["BR_CPF"])
    assert "score" in found.report.columns
    with pytest.raises(Exception, match="read 0"):
        found.exit_code
