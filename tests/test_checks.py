import random

import numpy as np
from pyspark.sql import functions as F

from velum.functions import checks
from velum.functions import sqlx as X
from velum.functions import validators as V

ALPHABET = "0123456789"


def _near_valid(r, entity):
    """Values of the right shape, of which about one in ten passes."""
    n = {"BR_CPF": 11, "BR_CNPJ": 14, "BR_CNS": 15, "BR_NIS": 11, "BR_CNJ": 20, "BR_TITULO_ELEITOR": 12, "BR_CNH": 11, "BR_RENAVAM": r.choice([9, 10, 11]), "BR_TELEFONE": r.choice([10, 11, 12, 13]), "BR_CEP": 8, "BR_CNM": 16, "BR_CIB": 8, "BR_IPTU": r.choice([5, 6, 20, 21]), "BR_MATRICULA_IMOVEL": r.choice([1, 7, 8]), "BR_CARTAO": r.choice([12, 13, 14, 15, 16, 19])}.get(entity, 7)
    v = "".join(r.choices("0123456789ABCDEFGHJKXYZ" if entity in ("BR_CIB", "BR_CNPJ", "BR_PLACA") and r.random() < 0.7 else ALPHABET, k=n))
    if entity == "BR_PIX_EVP":
        v = "-".join("".join(r.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12))
    if entity == "BR_PLACA":
        v = "".join(r.choices("ABC", k=3)) + "".join(r.choices("12", k=1)) + r.choice(["A", "4", "-"]) + "77"
    if entity == "BR_CARTAO":
        v = r.choice(["4", "51", "34", "36", "6362" + "97", "3095", "9"]) + v
        v = v[:n]
    if entity in ("BR_CPF", "BR_NIS", "BR_CNH", "BR_CNS", "BR_CNM", "BR_CNJ", "BR_TITULO_ELEITOR"):
        v = v[: n - 2] + "".join(r.choices("0123456789", k=2))
    if entity == "BR_CNS":
        v = r.choice("12789") + v[1:11] + "0" * 3 + v[-1]
    if entity == "BR_CNM":
        v = v[:6] + "2" + v[7:]
    if entity == "BR_TITULO_ELEITOR":
        v = v[:8] + r.choice(["01", "02", "28", "29", "00", "13"]) + v[10:]
    kind = r.random()
    if kind < 0.1:
        v = v[0] * len(v)
    elif kind < 0.3:
        at = r.randrange(len(v))
        v = v[:at] + r.choice(" .-/ x") + v[at:]
    elif kind < 0.35:
        v = v.lower()
    return v


def test_both_forms_of_every_rule_agree(spark):
    """The rules as numpy sums and as SQL, on valid, nearly valid and odd values, of each entity."""
    r = random.Random(4)
    rows = [(e, _near_valid(r, e)) for e in checks.RULES for _ in range(1500)]
    by_digit = [(e, v[: len(v) - 1] + d) for e, v in rows[:: 25] for d in ALPHABET if v]
    rows += by_digit + [(e, v) for e in checks.RULES for v in ("", " ", "0", "00000000", "11111111111", "４１１１", "é")]
    df = spark.createDataFrame(rows, "entity string, value string")
    passed = {}
    for e in checks.RULES:
        want = df.where(F.col("entity") == e).select("value", X.column(V.is_valid(e, X.col("value"))).alias("ok")).collect()
        got = checks.valid(e, [x.value for x in want])
        wrong = [x.value for x, g in zip(want, got.tolist()) if x.ok != g]
        assert not wrong, (e, wrong[:5])
        passed[e] = int(got.sum())
    assert min(passed.values()) > 0, passed


def test_windows_are_judged_like_values():
    digits = "".join(random.Random(1).choices(ALPHABET, k=4000)) + "52998224725"
    codes = checks.rows([digits])[0]
    for e, n in (("BR_CPF", 11), ("BR_RENAVAM", 9), ("BR_CNS", 15), ("BR_CNJ", 20), ("BR_CNM", 16), ("BR_TITULO_ELEITOR", 12), ("BR_CARTAO", 16), ("BR_CIB", 8)):
        want = checks.valid(e, [digits[i : i + n] for i in range(len(digits) - n + 1)])
        assert np.array_equal(checks.valid_windows(e, codes, np.arange(len(want)), n), want)
