"""The registered queries, and for each the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as SF

from velum.functions import sqlx as F
from velum.functions import validators as V
from velum.functions.session import spread, table
from velum.functions.sqlx import X, column
from velum.functions.text import canonical_label, canonical_vault, collapse_blanks, fold, invisible_near_digit, normalise, strip_invisible
from velum.operators import evaluate, gate, mask, reports
from velum.operators.detect import find, spans, with_matches
from velum.sources import readers, synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DEMO_KEY = "7f3b9a1c5d2e8046"


def _add(name: str, query: Callable, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select(SF.col("c_custkey").cast("bigint").alias("k")), "k")


def _columns(df: DataFrame, **made: X) -> DataFrame:
    return df.select("*", *(column(x).alias(n) for n, x in made.items()))


# --- DuckDB text of the same arithmetic, written out independently of the Spark side -------------------------------

def d_digit(v: str, i: int) -> str:
    return f"(ascii(substr({v}, {i}, 1)) - 48)"


def d_sum(v: str, weights, first: int = 1) -> str:
    return "(" + " + ".join(f"{d_digit(v, first + n)} * {w}" for n, w in enumerate(weights)) + ")"


def d_low(r: str) -> str:
    return f"(CASE WHEN {r} < 2 THEN 0 ELSE 11 - {r} END)"


def d_base(width: int, factor: int = 7919, offset: int = 104729) -> str:
    return f"lpad(((k * {factor} + {offset}) % {10**width})::VARCHAR, {width}, '0')"


_K = "SELECT c_custkey::BIGINT AS k FROM customer"
_NEXT = "substr(v, 1, length(v) - 1) || ((substr(v, -1, 1)::INT + 1) % 10)::VARCHAR"
_CARD_W = "(" + " + ".join(f"(CASE WHEN {d_digit('b', i)} * {2 if i % 2 else 1} > 9 THEN {d_digit('b', i)} * 2 - 9 ELSE {d_digit('b', i)} * {2 if i % 2 else 1} END)" for i in range(1, 16)) + ")"
_CPF2 = d_low(f"(({d_sum('b', range(11, 2, -1))} + d1 * 2) % 11)")
_CNPJ_W = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
_CNPJ2 = d_low(f"(({d_sum('b', (6, *_CNPJ_W[:-1]))} + d1 * 2) % 11)")
_NIS_W = (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)

#: name: (entity, Spark value, DuckDB steps that end in a column v); one key in three is made wrong on both sides.
_VALUES = {
    "cpf": ("BR_CPF", lambda k: synth.cpf(k), f"b AS (SELECT k, {d_base(9)} AS b FROM keys), c AS (SELECT *, {d_low('(' + d_sum('b', range(10, 1, -1)) + ' % 11)')} AS d1 FROM b), val AS (SELECT k, b || d1 || {_CPF2} AS v FROM c)"),
    "cnpj": ("BR_CNPJ", lambda k: _then(F.concat(synth.base(k, 8), F.when(F.pmod(k, 2) == 0, "0001").otherwise("01AB")), lambda b: F.concat(b, V.cnpj_check_digits(b))), f"b AS (SELECT k, {d_base(8)} || CASE WHEN k % 2 = 0 THEN '0001' ELSE '01AB' END AS b FROM keys), c AS (SELECT *, {d_low('(' + d_sum('b', _CNPJ_W) + ' % 11)')} AS d1 FROM b), val AS (SELECT k, b || d1 || {_CNPJ2} AS v FROM c)"),
    "cns": ("BR_CNS", lambda k: V.cns_from_pis(F.concat("1", synth.base(k, 10))), f"b AS (SELECT k, '1' || {d_base(10)} AS b FROM keys), c AS (SELECT *, {d_sum('b', range(15, 4, -1))} AS t FROM b), val AS (SELECT k, b || CASE WHEN 11 - t % 11 = 10 THEN '001' || (11 - (t + 2) % 11) WHEN 11 - t % 11 = 11 THEN '0000' ELSE '000' || (11 - t % 11) END AS v FROM c)"),
    "nis": ("BR_NIS", lambda k: _then(synth.base(k, 10), lambda b: F.concat(b, V.nis_check_digit(b))), f"b AS (SELECT k, {d_base(10)} AS b FROM keys), val AS (SELECT k, b || CASE WHEN 11 - {d_sum('b', _NIS_W)} % 11 >= 10 THEN 0 ELSE 11 - {d_sum('b', _NIS_W)} % 11 END AS v FROM b)"),
    "cnj": ("BR_CNJ", lambda k: synth.cnj(k), f"b AS (SELECT k, {d_base(7)} AS s, '2017826' || {d_base(4, 31, 17)} AS r FROM keys), val AS (SELECT k, s || lpad((98 - (s || r || '00')::HUGEINT % 97)::VARCHAR, 2, '0') || r AS v FROM b)"),
    "titulo": ("BR_TITULO_ELEITOR", lambda k: _then(F.struct(synth.base(k, 8).alias("s"), F.lpad((F.pmod(k, 28) + 1).cast("string"), 2, "0").alias("u")), lambda x: F.concat(x["s"], x["u"], V.titulo_check_digits(x["s"], x["u"]))),
        f"b AS (SELECT k, {d_base(8)} || lpad((k % 28 + 1)::VARCHAR, 2, '0') AS b, k % 28 < 2 AS big FROM keys), c AS (SELECT *, {d_sum('b', range(2, 10))} % 11 AS r FROM b), e AS (SELECT *, CASE WHEN r = 10 THEN 0 WHEN big AND r = 0 THEN 1 ELSE r END AS d1 FROM c), f AS (SELECT *, ({d_sum('b', (7, 8), 9)} + d1 * 9) % 11 AS q FROM e), val AS (SELECT k, b || d1 || CASE WHEN q = 10 THEN 0 WHEN big AND q = 0 THEN 1 ELSE q END AS v FROM f)"),
    "cnh": ("BR_CNH", lambda k: _then(synth.base(k, 9), lambda b: F.concat(b, V.cnh_check_digits(b))), f"b AS (SELECT k, {d_base(9)} AS b FROM keys), c AS (SELECT *, {d_sum('b', range(9, 0, -1))} % 11 AS r, {d_sum('b', range(1, 10))} % 11 AS q FROM b), e AS (SELECT *, CASE WHEN q >= 10 THEN 0 WHEN r >= 10 THEN (q - 2 + 11) % 11 ELSE q END AS w FROM c), val AS (SELECT k, b || CASE WHEN r >= 10 THEN 0 ELSE r END || CASE WHEN w >= 10 THEN 0 ELSE w END AS v FROM e)"),
    "renavam": ("BR_RENAVAM", lambda k: _then(synth.base(k, 10), lambda b: F.concat(b, V.renavam_check_digit(b))), f"b AS (SELECT k, {d_base(10)} AS b FROM keys), val AS (SELECT k, b || CASE WHEN {d_sum('b', _NIS_W)} * 10 % 11 = 10 THEN 0 ELSE {d_sum('b', _NIS_W)} * 10 % 11 END AS v FROM b)"),
    "cnm": ("BR_CNM", lambda k: _then(F.concat(synth.base(k, 6), "2", synth.base(k, 7, 31, 17)), lambda b: F.concat(b, V.cnm_check_digits(b))), f"b AS (SELECT k, {d_base(6)} || '2' || {d_base(7, 31, 17)} AS b FROM keys), val AS (SELECT k, b || lpad((98 - (b || '00')::HUGEINT % 97)::VARCHAR, 2, '0') AS v FROM b)"),
    "cartao": ("BR_CARTAO", lambda k: synth.card(k), f"b AS (SELECT k, '4' || {d_base(14)} AS b FROM keys), val AS (SELECT k, b || (10 - {_CARD_W} % 10) % 10 AS v FROM b)"),
}


def _then(x: X, fn) -> X:
    from velum.functions.text import let

    return let(x, fn)


def _odd(v: X) -> X:
    """Of the valid values, by key: one digit repeated, one character too few, a stray one inside, or as it is."""
    n = F.char_length(v)
    turn = F.pmod(F.col("k"), 7)
    return F.when(turn == 1, F.repeat("5", n)).when(turn == 2, F.substr(v, 1, n - 1)).when(turn == 3, F.concat(F.substr(v, 1, 4), "x", F.substr(v, 5))).otherwise(v)


_D_ODD = "CASE k % 7 WHEN 1 THEN repeat('5', length(v)) WHEN 2 THEN substr(v, 1, length(v) - 1) WHEN 3 THEN substr(v, 1, 4) || 'x' || substr(v, 5) ELSE v END"
for _name, (_entity, _spark, _steps) in _VALUES.items():

    def _query(spark, sf_dir, entity=_entity, value=_spark):
        df = _columns(_keys(spark, sf_dir), v0=value(F.col("k")))
        df = _columns(df, value=F.when(F.pmod(F.col("k"), 3) == 0, synth.wrong_last_digit(F.col("v0"))).otherwise(_odd(F.col("v0"))))
        return _columns(df.select("k", "value"), valid=V.is_valid(entity, F.col("value")))

    _add(f"validate_{_name}", _query, f"WITH keys AS ({_K}), {_steps} SELECT k, CASE WHEN k % 3 = 0 THEN {_NEXT} ELSE {_D_ODD} END AS value, k % 3 != 0 AND k % 7 NOT IN (1, 2, 3) AS valid FROM val")

_SHAPES = {
    "placa": ("BR_PLACA", lambda k: F.concat("ABC", synth.base(k, 1), F.when(F.pmod(k, 3) == 0, "D").when(F.pmod(k, 3) == 1, "4").otherwise("-"), synth.base(k, 2, 31, 17)), f"'ABC' || {d_base(1)} || CASE k % 3 WHEN 0 THEN 'D' WHEN 1 THEN '4' ELSE '-' END || {d_base(2, 31, 17)}", "regexp_full_match(v, '[A-Z]{3}[0-9][0-9A-Z][0-9]{2}')"),
    "pix": ("BR_PIX_EVP", lambda k: F.concat(synth.base(k, 8), "-e89b-", F.pmod(k, 7).cast("string"), "2d3-a456-", synth.base(k, 12, 31, 17)), f"{d_base(8)} || '-e89b-' || (k % 7) || '2d3-a456-' || {d_base(12, 31, 17)}", "k % 7 BETWEEN 1 AND 5"),
    "telefone": ("BR_TELEFONE", lambda k: F.concat("(", F.lpad(F.pmod(k, 100).cast("string"), 2, "0"), ") 9", synth.base(k, 4), "-", synth.base(k, 4, 31, 17)), f"'(' || lpad((k % 100)::VARCHAR, 2, '0') || ') 9' || {d_base(4)} || '-' || {d_base(4, 31, 17)}", f"lpad((k % 100)::VARCHAR, 2, '0') IN ({', '.join(repr(a) for a in V.AREA_CODES)})"),
    "cep": ("BR_CEP", lambda k: F.concat(F.lpad(F.pmod(k, 3).cast("string"), 2, "0"), synth.base(k, 3), "-", synth.base(k, 3, 31, 17)), f"lpad((k % 3)::VARCHAR, 2, '0') || {d_base(3)} || '-' || {d_base(3, 31, 17)}", "k % 3 > 0"),
    "iptu": ("BR_IPTU", lambda k: F.when(F.pmod(k, 3) == 0, "000.000.0000-0").when(F.pmod(k, 3) == 1, "1.234").otherwise(F.concat("01.", synth.base(k, 6))), f"CASE k % 3 WHEN 0 THEN '000.000.0000-0' WHEN 1 THEN '1.234' ELSE '01.' || {d_base(6)} END", "k % 3 = 2"),
    "matricula": ("BR_MATRICULA_IMOVEL", lambda k: F.when(F.pmod(k, 3) == 0, "0.000").when(F.pmod(k, 3) == 1, "12345678").otherwise(k.cast("string")), "CASE k % 3 WHEN 0 THEN '0.000' WHEN 1 THEN '12345678' ELSE k::VARCHAR END", "k % 3 = 2"),
}
for _name, (_entity, _spark, _sql, _rule) in _SHAPES.items():

    def _query(spark, sf_dir, entity=_entity, value=_spark):
        return _columns(_columns(_keys(spark, sf_dir), value=value(F.col("k"))), valid=V.is_valid(entity, F.col("value")))

    _add(f"validate_{_name}", _query, f"WITH keys AS ({_K}), val AS (SELECT k, {_sql} AS v FROM keys) SELECT k, v AS value, {_rule} AS valid FROM val")

_CIB = "WITH keys AS (" + _K + f"), b AS (SELECT k, 'A' || {d_base(6)} AS b FROM keys), c AS (SELECT k, b, (10 * 4 + {d_sum('b', (3, 9, 5, 7, 1, 8), 2)}) % 31 AS r FROM b), val AS (SELECT k, b || substr('{V.CROCKFORD}', r::INT + 1, 1) AS v FROM c)"
_add("validate_cib", lambda s, d: _columns(_columns(_columns(_keys(s, d), v0=_then(F.concat("A", synth.base(F.col("k"), 6)), lambda b: F.concat(b, V.cib_check_char(b)))), value=_odd(F.col("v0"))).drop("v0"), valid=V.is_valid("BR_CIB", F.col("value"))), _CIB + f" SELECT k, {_D_ODD} AS value, k % 7 NOT IN (1, 2, 3) AS valid FROM val")

_CPF = "WITH keys AS (" + _K + "), " + _VALUES["cpf"][2]
_CARD = "WITH keys AS (" + _K + "), " + _VALUES["cartao"][2]
_TIT = "WITH keys AS (" + _K + "), " + _VALUES["titulo"][2]
_add("cpf_check_digits", lambda s, d: _columns(_keys(s, d), dv=V.cpf_check_digits(synth.base(F.col("k"), 9))), _CPF + " SELECT k, substr(v, 10, 2) AS dv FROM val")
_add("cnpj_check_digits", lambda s, d: _columns(_keys(s, d), dv=V.cnpj_check_digits(F.concat(synth.base(F.col("k"), 8), F.when(F.pmod(F.col("k"), 2) == 0, "0001").otherwise("01AB")))), "WITH keys AS (" + _K + "), " + _VALUES["cnpj"][2] + " SELECT k, substr(v, 13, 2) AS dv FROM val")
_add("cns_from_pis", lambda s, d: _columns(_keys(s, d), cns=V.cns_from_pis(F.concat("1", synth.base(F.col("k"), 10)))), "WITH keys AS (" + _K + "), " + _VALUES["cns"][2] + " SELECT k, v AS cns FROM val")
_add("luhn_check_digit", lambda s, d: _columns(_keys(s, d), dv=V.luhn_check_digit(F.concat("4", synth.base(F.col("k"), 14)))), _CARD + " SELECT k, substr(v, 16, 1) AS dv FROM val")
_add("titulo_state", lambda s, d: _columns(_columns(_keys(s, d), v=_VALUES["titulo"][1](F.col("k"))), state=V.titulo_state(F.col("v"))).drop("v"), _TIT + " SELECT k, CASE substr(v, 9, 2) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.STATES.items()) + " END AS state FROM val")
_add("plate_to_mercosur", lambda s, d: _columns(_keys(s, d), plate=V.plate_to_mercosur(F.concat("abc-", synth.base(F.col("k"), 4)))), f"WITH keys AS ({_K}), b AS (SELECT k, {d_base(4)} AS b FROM keys) SELECT k, 'ABC' || substr(b, 1, 1) || substr('ABCDEFGHIJ', substr(b, 2, 1)::INT + 1, 1) || substr(b, 3, 2) AS plate FROM b")
_add("format_cpf", lambda s, d: _columns(_keys(s, d), cpf=V.format_value("BR_CPF", synth.cpf(F.col("k")))), _CPF + " SELECT k, substr(v, 1, 3) || '.' || substr(v, 4, 3) || '.' || substr(v, 7, 3) || '-' || substr(v, 10, 2) AS cpf FROM val")
_add("format_cnj", lambda s, d: _columns(_keys(s, d), cnj=V.format_value("BR_CNJ", synth.cnj(F.col("k")))), "WITH keys AS (" + _K + "), " + _VALUES["cnj"][2] + " SELECT k, substr(v, 1, 7) || '-' || substr(v, 8, 2) || '.' || substr(v, 10, 4) || '.' || substr(v, 14, 1) || '.' || substr(v, 15, 2) || '.' || substr(v, 17, 4) AS cnj FROM val")
_add("card_brand", lambda s, d: _columns(_keys(s, d), brand=V.card_brand(F.concat(F.lpad(F.pmod(F.col("k"), 100).cast("string"), 2, "0"), synth.base(F.col("k"), 14)))),
     f"WITH keys AS ({_K}), b AS (SELECT k, lpad((k % 100)::VARCHAR, 2, '0') || {d_base(14)} AS v FROM keys) SELECT k, CASE " + " ".join(f"WHEN substr(v, 1, {len(a)}) BETWEEN '{a}' AND '{b}' THEN '{n}'" for a, b, ls, n in V.CARD_RANGES if "16" in ls.split(",")) + " END AS brand FROM b")
_add("validate_any", lambda s, d: _columns(_columns(_keys(s, d), entity=F.when(F.pmod(F.col("k"), 2) == 0, "BR_CPF").otherwise("BR_CEP"), value=synth.cpf(F.col("k"))), valid=V.validate(F.col("entity"), F.col("value"))), _CPF + " SELECT k, CASE WHEN k % 2 = 0 THEN 'BR_CPF' ELSE 'BR_CEP' END AS entity, v AS value, k % 2 = 0 AS valid FROM val")

# --- text ---------------------------------------------------------------------------------------------------------
_WIDE = "".join(chr(0xFF10 + i) for i in range(10))
_add("normalise_text", lambda s, d: _columns(_keys(s, d), text=normalise(F.concat(F.translate(F.col("k").cast("string"), "0123456789", _WIDE), "–１．／ é"))), f"SELECT k, k || '-1./ é' AS text FROM ({_K})")
_add("fold_text", lambda s, d: _columns(table(s, d, "documents").select("doc_id", "text"), folded=fold(F.col("text"))).drop("text"), "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZéèêóñüçäöíÉÈÊÓÑÜÇÄÖÍ', 'abcdefghijklmnopqrstuvwxyzeeeonucaoieeeonucaoi') AS folded FROM documents")
_add("strip_invisible", lambda s, d: _columns(_keys(s, d), text=strip_invisible(F.concat(F.col("k").cast("string"), "​1­2́é"))), f"SELECT k, k || '12é' AS text FROM ({_K})")
_add("has_invisible_near_digit", lambda s, d: _columns(_keys(s, d), near=invisible_near_digit(F.concat(F.when(F.pmod(F.col("k"), 2) == 0, "ab​cd").otherwise("a​b"), F.col("k").cast("string")))), f"SELECT k, k % 2 = 1 AS near FROM ({_K})")
_add("canonical_forms", lambda s, d: _columns(_keys(s, d), label=canonical_label(F.concat("ab-", F.translate(F.col("k").cast("string"), "0123456789", _WIDE))), vault=canonical_vault(F.concat("ab-", F.translate(F.col("k").cast("string"), "0123456789", _WIDE), ".x"))), f"SELECT k, 'AB' || k AS label, 'ABX' AS vault FROM ({_K})")
_add("collapse_blanks", lambda s, d: _columns(table(s, d, "documents").select("doc_id", "text"), flat=collapse_blanks(F.col("text"))).select("doc_id", SF.md5("flat").alias("flat")), r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS flat FROM documents")

# --- detection ----------------------------------------------------------------------------------------------------
_SENT = _CPF + f""", nr AS (SELECT k, CASE WHEN k % 5 = 0 THEN {_NEXT} ELSE v END AS v FROM val), cb AS (SELECT k, '4' || {d_base(14)} AS b FROM keys), cd AS (SELECT k, b || (10 - {_CARD_W} % 10) % 10 AS card FROM cb),
sh AS (SELECT k, v, CASE WHEN k % 3 = 0 THEN v ELSE substr(v, 1, 3) || '.' || substr(v, 4, 3) || '.' || substr(v, 7, 3) || '-' || substr(v, 10, 2) END AS shown FROM nr),
t AS (SELECT k, shown, card, 'registro de numero ' || k || ': ' || CASE WHEN k % 2 = 0 THEN 'CPF ' ELSE 'codigo ' END || shown || CASE WHEN k % 4 = 0 THEN ', cartao ' || card ELSE '' END || ' fim' AS text FROM sh JOIN cd USING (k))"""


def _texts(spark, sf_dir) -> DataFrame:
    return _columns(_keys(spark, sf_dir), text=synth.sentence(F.col("k")))


_CPF_ROWS = """SELECT k, 'BR_CPF' AS entity, (strpos(text, shown) - 1)::INT AS start, (strpos(text, shown) - 1 + length(shown))::INT AS "end", shown AS value, CASE WHEN k % 5 = 0 THEN 0.0 WHEN k % 2 = 0 THEN 0.95 ELSE 0.85 END AS score, 'N1' AS tier,
CASE WHEN k % 3 = 0 THEN 'cpf_compact' ELSE 'cpf_formatted' END AS pattern, k % 2 = 0 AS has_context, k % 5 != 0 AS valid_dv FROM t"""
_CARD_ROWS = """SELECT k, 'BR_CARTAO' AS entity, (strpos(text, card) - 1)::INT AS start, (strpos(text, card) - 1 + 16)::INT AS "end", card AS value, 0.95 AS score, 'N1' AS tier, 'cartao_16' AS pattern, true AS has_context, true AS valid_dv FROM t WHERE k % 4 = 0"""
_add("find_cpf", lambda s, d: find(_texts(s, d), entities=["BR_CPF"]), _SENT + f" SELECT * FROM ({_CPF_ROWS}) WHERE valid_dv")
_add("find_suspects", lambda s, d: find(_texts(s, d), entities=["BR_CPF"], report_invalid=True), _SENT + f" SELECT * FROM ({_CPF_ROWS}) WHERE valid_dv OR k % 3 != 0")
_add("find_cpf_and_card", lambda s, d: find(_texts(s, d), entities=["BR_CPF", "BR_CARTAO"]), _SENT + f" SELECT * FROM ({_CPF_ROWS}) WHERE valid_dv UNION ALL {_CARD_ROWS}")
_add("find_min_score", lambda s, d: find(_texts(s, d), entities=["BR_CPF"], min_score=0.9), _SENT + f" SELECT * FROM ({_CPF_ROWS}) WHERE score >= 0.9")
_add("find_required_context", lambda s, d: find(_columns(_keys(s, d), text=F.concat(F.when(F.pmod(F.col("k"), 2) == 0, "CEP ").otherwise("codigo "), "22290-", synth.base(F.col("k"), 3))), entities=["BR_CEP"]).select("k", "value", "score"), f"SELECT k, '22290-' || {d_base(3)} AS value, 0.5 AS score FROM ({_K}) WHERE k % 2 = 0")
_add("find_adjacent_matricula", lambda s, d: find(_columns(_keys(s, d), text=F.concat(F.when(F.pmod(F.col("k"), 3) == 0, "matrícula nº ").when(F.pmod(F.col("k"), 3) == 1, "matricula do aluno ").otherwise("imovel "), F.col("k").cast("string"), F.when(F.pmod(F.col("k"), 3) == 2, " no registro de imoveis").otherwise(" fim"))), entities=["BR_MATRICULA_IMOVEL"]).select("k", "value", "score"), f"SELECT k, k::VARCHAR AS value, 0.4 AS score FROM ({_K}) WHERE k % 3 != 1 AND k > 0")
_WINDOWS = _CPF + f""", x AS (SELECT k, 'cpf 00000000000000' || v AS text FROM val WHERE k % 2 = 0), w AS (SELECT k, a, substr(text, a + 1, 11) AS b FROM x, (SELECT unnest(range(4, 19)) AS a)), w1 AS (SELECT *, {d_low('(' + d_sum('b', range(10, 1, -1)) + ' % 11)')} AS d1 FROM w),
good AS (SELECT k, a, b FROM w1 WHERE b != repeat(substr(b, 1, 1), 11) AND substr(b, 10, 2) = d1::VARCHAR || {_CPF2}::VARCHAR), one AS (SELECT k, min(a) AS a FROM good GROUP BY k), two AS (SELECT k, min(good.a) AS a FROM good JOIN one USING (k) WHERE good.a >= one.a + 11 GROUP BY k), best AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""
_add("find_embedded", lambda s, d: find(_columns(_keys(s, d), text=F.concat(F.when(F.pmod(F.col("k"), 2) == 0, "cpf ").otherwise("registro "), "00000000000000", synth.cpf(F.col("k")))), entities=["BR_CPF"]).select("k", "start", "end", "value", "score", "pattern"), _WINDOWS + """ SELECT k, a::INT AS start, (a + 11)::INT AS "end", b AS value, 0.95 AS score, 'cpf_compact_embedded' AS pattern FROM best JOIN good USING (k, a)""")
_add("find_evaded", lambda s, d: find(_columns(_keys(s, d), text=F.concat("cpf ", _then(synth.cpf(F.col("k")), lambda v: F.concat(F.substring(v, 1, 3), "​", F.substring(v, 4, 8))))), entities=["BR_CPF"]).select("k", "start", "end", "score"), _CPF + ' SELECT k, 4::INT AS start, 16::INT AS "end", 0.95 AS score FROM val')
_add("find_card_documents", lambda s, d: find(table(s, d, "documents").select("doc_id", "text"), entities=["BR_CARTAO"]).groupBy("doc_id").agg(SF.count("*").alias("n")), None)
_add("find_documents", lambda s, d: find(table(s, d, "documents").select("doc_id", "text")))
_add("find_phone_spans", lambda s, d: _columns(table(s, d, "documents").select("doc_id", "text"), n=F.size(spans(F.col("text"), r"[0-9]{3}-[0-9]{4}")).cast("bigint")).drop("text"), "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}'))::BIGINT AS n FROM documents")
_add("sixteen_digit_spans", lambda s, d: _columns(table(s, d, "documents").select("doc_id", "text"), x=spans(F.col("text"), "[0-9]{16}")).select("doc_id", SF.explode("x").alias("x")).select("doc_id", "x.start", "x.end"), """SELECT doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + 16 * (i - 1))::INT AS start, (list_sum(list_transform(g[1:i], lambda x: length(x))) + 16 * i)::INT AS "end" FROM (SELECT doc_id, g, unnest(range(1, len(g))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[0-9]{16}') AS g FROM documents))""")

# --- masking ------------------------------------------------------------------------------------------------------
_CUT = "CASE WHEN k % 5 = 0 AND k % 3 = 0 THEN text ELSE replace(text, shown, '<BR_CPF{}>') END"
_add("mask_redact", lambda s, d: mask.mask(_texts(s, d), entities=["BR_CPF"]).select("k", "masked"), _SENT + f" SELECT k, {_CUT.format('')} AS masked FROM t")
_add("mask_pseudonym", lambda s, d: mask.mask(_columns(_keys(s, d), text=_then(synth.cpf(F.col("k")), lambda v: F.concat("cpf ", v, ", cpf ", synth.cpf_formatted(v), ", cpf ", synth.cpf(F.col("k") + 1)))), "pseudonym", entities=["BR_CPF"]).select("k", "masked"), f"SELECT k, 'cpf <BR_CPF_1>, cpf <BR_CPF_1>, cpf <BR_CPF_2>' AS masked FROM ({_K})")


def _d_hmac(message: str, key: str = DEMO_KEY) -> str:
    pad = key.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in pad).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


_KID = mask.key_id(DEMO_KEY.encode())
_add("mask_stable", lambda s, d: mask.mask(_texts(s, d), "pseudonym_stable", DEMO_KEY, entities=["BR_CPF"], report_invalid=False).select("k", "masked"), _SENT.replace("t AS (SELECT k, shown,", "t AS (SELECT k, v, shown,") + f" SELECT k, CASE WHEN k % 5 = 0 THEN text ELSE replace(text, shown, '<BR_CPF:{_KID}:' || substr({_d_hmac(chr(39) + 'BR_CPF:' + chr(39) + ' || v')}, 1, 12) || '>') END AS masked FROM t")
_add("residual_after_mask", lambda s, d: mask.residual(mask.mask(_texts(s, d), entities=["BR_CPF"]).select("k", SF.col("masked").alias("text")), entities=["BR_CPF", "BR_CARTAO"], report_invalid=True).select("k", "value", "start"),
     _SENT + f" SELECT k, card AS value, (strpos({_CUT.format('')}, card) - 1)::INT AS start FROM t WHERE k % 4 = 0 UNION ALL SELECT k, shown, (strpos(text, shown) - 1)::INT FROM t WHERE false")
_add("vault_protect", lambda s, d: mask.protect(_texts(s, d), DEMO_KEY, "k", entities=["BR_CPF"])[1].select("scope_id", "token", "value"), _SENT.replace("t AS (SELECT k, shown,", "t AS (SELECT k, v, shown,") + f" SELECT k::VARCHAR AS scope_id, '<BR_CPF:{_KID}:' || substr({_d_hmac(chr(39) + 'BR_CPF:' + chr(39) + ' || v')}, 1, 24) || '>' AS token, shown AS value FROM t WHERE k % 5 != 0")


def _round_trip(spark, sf_dir):
    docs, tokens = mask.protect(_texts(spark, sf_dir), DEMO_KEY, "k", entities=["BR_CPF"])
    return mask.reveal(docs.drop("text"), tokens).select("k", "revealed")


_add("vault_reveal", _round_trip, _SENT + " SELECT k, text AS revealed FROM t")

# --- gates and reports --------------------------------------------------------------------------------------------
_add("decide_block", lambda s, d: gate.decide(_texts(s, d), entities=["BR_CPF"]).select("k", "allowed", "reason"), _SENT + " SELECT k, k % 15 = 0 AS allowed, CASE WHEN k % 15 = 0 THEN '' ELSE 'BR_CPF' END AS reason FROM t")
_add("decide_allow_suspect", lambda s, d: gate.decide(_texts(s, d), entities=["BR_CPF"], on_suspect="allow").select("k", "allowed"), _SENT + " SELECT k, k % 5 = 0 AS allowed FROM t")
_add("scan_report", lambda s, d: gate.scan(_texts(s, d), threshold=0.9, entities=["BR_CPF"]).report, _SENT + f" SELECT * EXCLUDE (value) FROM ({_CPF_ROWS}) WHERE valid_dv AND score >= 0.9")


def _exit_codes(spark, sf_dir):
    rows = []
    for case, which in (("all", "true"), ("suspects", "k % 15 = 5"), ("none", "k % 15 = 0"), ("empty", "false")):
        found = gate.scan(_texts(spark, sf_dir).where(which), threshold=1.0, entities=["BR_CPF"])
        rows += [(case, fail, found.code(fail), found.n_valid, found.n_suspects) for fail in (False, True)]
    return spark.createDataFrame(rows, "which string, fail_on_suspect boolean, exit_code int, n_valid long, n_suspects long")


_WHICH = "SELECT * FROM (VALUES ('all', 0), ('suspects', 1), ('none', 2), ('empty', 3)) w(which, c), (VALUES (true), (false)) f(fail_on_suspect)"
_add("scan_exit_code", _exit_codes, _SENT + f", w AS ({_WHICH}), n AS (SELECT which, fail_on_suspect, count(*) FILTER (k % 5 != 0) AS n_valid, count(*) FILTER (k % 5 = 0 AND k % 3 != 0) AS n_suspects FROM w LEFT JOIN t ON c = 0 OR (c = 1 AND k % 15 = 5) OR (c = 2 AND k % 15 = 0) GROUP BY ALL) SELECT which, fail_on_suspect, (n_valid > 0 OR (fail_on_suspect AND n_suspects > 0))::INT AS exit_code, n_valid, n_suspects FROM n")
_add("report_lines", lambda s, d: gate.report_lines(find(_texts(s, d), entities=["BR_CPF"])), _SENT + f" SELECT format('{{:<20}} {{:7d}} {{:7d}} {{:5.2f}}  {{}}', entity, start, \"end\", score, repeat('*', length(value))) AS line FROM ({_CPF_ROWS}) WHERE valid_dv")
_add("exposure_rollup", lambda s, d: gate.exposure(find(_texts(s, d).withColumn("part", SF.col("k") % 3), entities=["BR_CPF", "BR_CARTAO"]), ["part"], "k"), _SENT + f" SELECT k % 3 AS part, entity, count(*) AS n_matches, count(DISTINCT k) AS n_docs FROM (SELECT * FROM ({_CPF_ROWS}) WHERE valid_dv UNION ALL {_CARD_ROWS}) GROUP BY ROLLUP (k % 3, entity)")
_add("top_exposed", lambda s, d: find(_texts(s, d), entities=["BR_CPF", "BR_CARTAO"]).groupBy((SF.col("k") % 11).alias("part")).agg(SF.count("*").alias("n")).orderBy(SF.desc("n"), "part").limit(5), _SENT + f" SELECT k % 11 AS part, count(*) AS n FROM (SELECT * FROM ({_CPF_ROWS}) WHERE valid_dv UNION ALL {_CARD_ROWS}) GROUP BY 1 ORDER BY n DESC, part LIMIT 5")

# --- evaluation ---------------------------------------------------------------------------------------------------


def _spans(spark, sf_dir, shift: X) -> DataFrame:
    return _columns(_keys(spark, sf_dir), id=F.col("k"), pos=F.lit(0), start=F.lit(10) + shift, end=F.lit(20) + shift, entity=F.when(F.pmod(F.col("k"), 2) == 0, "BR_CPF").otherwise("BR_CEP")).drop("k")


def _counts(spark, sf_dir, mode):
    shift = F.when(F.pmod(F.col("k"), 3) == 0, 5).when(F.pmod(F.col("k"), 3) == 1, 50).otherwise(0)
    counted = evaluate.counts(evaluate.match_spans(_spans(spark, sf_dir, F.lit(0)), _spans(spark, sf_dir, shift), mode))
    return counted.groupBy("entity").agg(*(SF.sum(c).alias(c) for c in ("tp", "fp", "fn")))


for _mode, _hit in (("exact", "k % 3 = 2"), ("partial", "k % 3 != 1"), ("untyped", "k % 3 != 1")):
    _add(f"span_counts_{_mode}", lambda s, d, mode=_mode: _counts(s, d, mode), f"SELECT CASE WHEN k % 2 = 0 THEN 'BR_CPF' ELSE 'BR_CEP' END AS entity, count(*) FILTER ({_hit})::BIGINT AS tp, count(*) FILTER (NOT ({_hit}))::BIGINT AS fp, count(*) FILTER (NOT ({_hit}))::BIGINT AS fn FROM ({_K}) GROUP BY 1")
_add("prf_by_entity", lambda s, d: evaluate.prf(_counts(s, d, "exact")), f"WITH c AS ({ORACLE['span_counts_exact']}) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM c")


def _grouping(spark, sf_dir):
    shift = F.when(F.pmod(F.col("k"), 3) == 0, 5).otherwise(0)
    counted = evaluate.counts(evaluate.match_spans(_spans(spark, sf_dir, F.lit(0)), _spans(spark, sf_dir, shift)))
    return evaluate.scores(counted, _columns(_keys(spark, sf_dir), id=F.col("k"), difficulty=F.concat("D", F.pmod(F.col("k"), 2).cast("string"))).drop("k")).select("entity", "difficulty", "tp", "fp", "fn")


_add("prf_grouping_sets", _grouping, f"WITH c AS (SELECT CASE WHEN k % 2 = 0 THEN 'BR_CPF' ELSE 'BR_CEP' END AS entity, 'D' || k % 2 AS difficulty, (k % 3 != 0)::INT AS tp, (k % 3 = 0)::INT AS fp FROM ({_K})) SELECT entity, difficulty, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fp)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((), (entity), (difficulty))")
_add("char_kappa", lambda s, d: evaluate.char_kappa(_spans(s, d, F.lit(0)), _spans(s, d, F.lit(5)), _columns(_keys(s, d), id=F.col("k"), n_chars=F.lit(100)).drop("k")).select("n", SF.round("kappa", 9).alias("kappa")),
     f"WITH c AS (SELECT unnest([(80 + 5, 'O', 'O'), (5, '1', 'O'), (5, '1', '1'), (5, 'O', '1')]) AS x, k % 2 AS e FROM ({_K})), t AS (SELECT CASE WHEN x[2] = 'O' THEN 'O' ELSE e::VARCHAR END AS a, CASE WHEN x[3] = 'O' THEN 'O' ELSE e::VARCHAR END AS b, x[1] AS n FROM c), g AS (SELECT a, b, sum(n) AS n FROM t GROUP BY 1, 2), s AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (a = b) AS same FROM g), l AS (SELECT a, sum(n) AS na FROM g GROUP BY 1), r AS (SELECT b, sum(n) AS nb FROM g GROUP BY 1), h AS (SELECT sum(na * nb) AS chance FROM l JOIN r ON a = b) SELECT n, round((same / n - chance / n / n) / (1 - chance / n / n), 9)::DOUBLE AS kappa FROM s, h")

# --- sources ------------------------------------------------------------------------------------------------------
_add("html_to_text", lambda s, d: readers.html_to_text(table(s, d, "pages"), keep=["page_id"]))
_add("paragraphs", lambda s, d: readers.paragraphs(table(s, d, "documents").select("doc_id", "text").withColumn("text", SF.regexp_replace("text", "\n", "\n\n")), min_len=200, max_len=1200).select("doc_id", SF.md5("text").alias("digest")), r"SELECT doc_id, md5(p) AS digest FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS p FROM documents) WHERE length(p) BETWEEN 200 AND 1200")
_add("matches_per_document", lambda s, d: with_matches(_texts(s, d), entities=["BR_CPF", "BR_CARTAO"]).select("k", SF.size("__matches").cast("bigint").alias("n")), _SENT + " SELECT k, ((k % 5 != 0)::INT + (k % 4 = 0)::INT)::BIGINT AS n FROM t")
# every entity at once: what the numbers of these sentences are for all 17 rules together isn't SQL; the rows of the two kinds that the text names are
_add("find_all", lambda s, d: find(_texts(s, d)))
_add("find_all_named", lambda s, d: find(_texts(s, d)).where("has_context AND entity IN ('BR_CPF', 'BR_CARTAO')").where(SF.col("entity") == SF.when(SF.col("value").rlike("^4[0-9]{15}$"), "BR_CARTAO").otherwise("BR_CPF")), _SENT + f" SELECT * FROM ({_CPF_ROWS}) WHERE valid_dv AND has_context UNION ALL {_CARD_ROWS}")


# --- reports, sets, retrieval ---------------------------------------------------------------------------------------
_add("entity_list", lambda s, d: _keys(s, d).select("k", reports.entity_list(SF.concat(SF.lit(" br_cpf,, br_"), SF.col("k").cast("string"), SF.lit(" , "))).alias("entities")).select("k", SF.array_join("entities", "|").alias("entities")), f"SELECT k, 'BR_CPF|BR_' || k AS entities FROM ({_K})")
_add("only_on_one_side", lambda s, d: reports.only_on_one_side(_keys(s, d).where("k % 2 = 0"), _keys(s, d).where("k % 3 = 0")), f"SELECT k, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM ({_K}) WHERE (k % 2 = 0) != (k % 3 = 0)")
_add("shared_ids", lambda s, d: reports.shared_ids(_keys(s, d).where("k % 2 = 0"), _keys(s, d).where("k % 3 = 0"), "k"), f"SELECT k FROM ({_K}) WHERE k % 6 = 0")
_QUESTION = "the license of the document and its terms for the people of the city"
_add("retrieve", lambda s, d: reports.retrieve(table(s, d, "documents"), _QUESTION, 10), f"WITH q AS (SELECT list_distinct(list_filter(regexp_split_to_array('{_QUESTION}', '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS q), s AS (SELECT doc_id, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3)), q))::BIGINT AS shared FROM documents, q) SELECT doc_id, shared FROM s WHERE shared > 0 ORDER BY shared DESC, doc_id LIMIT 10")


def _scores(spark, sf_dir):
    return _keys(spark, sf_dir).select("k", SF.concat(SF.lit("s"), SF.col("k") % 7).alias("system"), SF.concat(SF.lit("m"), SF.col("k") % 3).alias("mode"), ((SF.col("k") * 7919) % 1009).alias("f1"))


_SC = f"SELECT k, 's' || k % 7 AS system, 'm' || k % 3 AS mode, (k * 7919) % 1009 AS f1 FROM ({_K})"
_add("best_per_mode", lambda s, d: reports.best_per_mode(_scores(s, d)), f"SELECT *, f1 = max(f1) OVER (PARTITION BY mode) AS is_best FROM ({_SC})")
_add("fixed_order", lambda s, d: reports.ordered_by(_scores(s, d).select("system").distinct(), "system", ["s3", "s1", "s0"]), f"SELECT DISTINCT system, CASE system WHEN 's3' THEN 1 WHEN 's1' THEN 2 WHEN 's0' THEN 3 ELSE 4 END::BIGINT AS place FROM ({_SC})")
_add("latency_median", lambda s, d: reports.latency(_scores(s, d), "system", "f1"), f"SELECT system, median(f1)::DOUBLE AS median_ms, count(*) AS n FROM ({_SC}) GROUP BY 1")
_add("insert_or_ignore", lambda s, d: reports.insert_or_ignore(_scores(s, d).where("k % 2 = 0").select("k", "f1"), _scores(s, d).select((SF.col("k") - SF.col("k") % 3).alias("k"), (SF.col("f1") + 1).alias("f1")), "k"), f"WITH s AS (SELECT k, f1 FROM ({_SC}) WHERE k % 2 = 0) SELECT * FROM s UNION ALL SELECT k - k % 3 AS k, min(f1 + 1) AS f1 FROM ({_SC}) WHERE (k - k % 3) NOT IN (SELECT k FROM s) GROUP BY 1")
_add("file_counts", lambda s, d: reports.file_counts(_scores(s, d).select(SF.col("mode").alias("file"), SF.col("k").alias("id"), SF.col("system").alias("text"), SF.array_repeat("f1", SF.expr("CAST(k % 4 AS INT)")).alias("spans"))).drop("sha256"), f"SELECT mode AS file, count(*) AS n_docs, sum(k % 4)::BIGINT AS n_spans FROM ({_SC}) GROUP BY 1")
_add("findings_labels", lambda s, d: _keys(s, d).select("k", readers.label(SF.element_at(SF.array(*map(SF.lit, ("BRCPFNumber", "BRLegalEntityNumber", "PhoneNumber", "Brazil CPF Number", "Brazil Legal Entity Number (CNPJ)", "nothing known"))), SF.expr("CAST(k % 6 + 1 AS INT)"))).alias("entity")), f"SELECT k, CASE WHEN k % 6 IN (0, 3) THEN 'BR_CPF' WHEN k % 6 IN (1, 4) THEN 'BR_CNPJ' WHEN k % 6 = 2 THEN 'BR_TELEFONE' ELSE 'OTHER' END AS entity FROM ({_K})")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts hold an identifier, by kind, context and score."""
    return find(_texts(spark, sf_dir), entities=["BR_CPF", "BR_CARTAO"]).groupBy("entity", "has_context", "score").agg(SF.count("*").alias("n_matches"), SF.countDistinct("k").alias("n_texts"))
