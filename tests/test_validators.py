import pytest

from velum.functions import sqlx as X
from velum.functions import validators as V

VALID = {
    "BR_CPF": ["529.982.247-25", "52998224725", " 529 982 247 25 ", "168.995.350-09"], "BR_CNPJ": ["12.ABC.345/01DE-35", "12.abc.345/01de-35", "11222333000181"], "BR_CNS": ["729141777631701", "866 9074 3915 0002", "180636083770008"],
    "BR_NIS": ["120.37567.08-3"], "BR_CNJ": ["0000001-83.2017.8.26.0100"], "BR_TITULO_ELEITOR": ["102345670183", "1023 4567 0388", "100000010116"], "BR_CNH": ["12345678900", "10000004401"], "BR_RENAVAM": ["00639724361", "639724361"],
    "BR_PLACA": ["abc-1234", "ABC1D23"], "BR_PIX_EVP": ["123E4567-E89B-42D3-A456-426614174000"], "BR_TELEFONE": ["(21) 98765-4321", "+55 21 2345-6789", "5511987654321"], "BR_CEP": ["22290-140", "01310100"], "BR_CNM": ["123456.2.1234567-44"],
    "BR_CIB": ["A3N8Z4F-Y", "a3n8z4fy", "ABC1234-J"], "BR_IPTU": ["012.345.6789-0"], "BR_MATRICULA_IMOVEL": ["12.345", "7"], "BR_CARTAO": ["4111 1111 1111 1111", "3782 822463 10005", "3056 9309 0259 04", "6062 8288 8866 6688"],
}
INVALID = {
    "BR_CPF": ["529.982.247-24", "11111111111", "5299822472a", None], "BR_CNPJ": ["12.ABC.345/01DE-36", "12ÁBC34501DE35"], "BR_CNS": ["729141777631702", "329141777631701"], "BR_NIS": ["120.37567.08-4"], "BR_CNJ": ["0000001-83.2017.0.26.0100"],
    "BR_TITULO_ELEITOR": ["102345670184", "102345672999"], "BR_CNH": ["12345678901"], "BR_RENAVAM": ["00639724362", "6397243"], "BR_PLACA": ["AB1234"], "BR_PIX_EVP": ["123e4567-e89b-02d3-a456-426614174000"], "BR_TELEFONE": ["(20) 98765-4321", "123"],
    "BR_CEP": ["00999-999"], "BR_CNM": ["123456.4.1234567-44"], "BR_CIB": ["A3N8Z4F-X", "AAAAAAAA"], "BR_IPTU": ["12345"], "BR_MATRICULA_IMOVEL": ["0", "12345678"], "BR_CARTAO": ["4111 1111 1111 1112", "1002003004005005"],
}


def test_known_values(spark):
    rows = [(e, v, True) for e, vs in VALID.items() for v in vs] + [(e, v, False) for e, vs in INVALID.items() for v in vs]
    df = spark.createDataFrame(rows, "e string, v string, want boolean")
    got = df.withColumn("got", X.column(V.validate(X.col("e"), X.col("v"))))
    assert got.where("got IS NULL OR got != want").collect() == []


def test_constructors_and_formats(spark):
    row = spark.range(1).select(*(X.column(x).alias(n) for n, x in {
        "luhn": V.luhn_check_digit(X.lit("411111111111111")), "brand": V.card_brand(X.lit("2223003122003222")), "plate": V.plate_to_mercosur(X.lit("ABC-1234")), "cpf": V.format_value("BR_CPF", X.lit("52998224725")),
        "cnh": V.cnh_check_digits(X.lit("100000044")), "cnpj": V.cnpj_check_digits(X.lit("12ABC34501DE")), "state": V.titulo_state(X.lit("102345670183")), "none": V.cpf_check_digits(X.lit("12x")), "plain": V.card_is_valid(X.lit("1002003004005005"), False),
    }.items())).first()
    assert row.asDict() == {"luhn": "1", "brand": "mastercard", "plate": "ABC1C34", "cpf": "529.982.247-25", "cnh": "01", "cnpj": "35", "state": "SP", "none": None, "plain": True}


def test_unknown_entity():
    with pytest.raises(ValueError):
        V.is_valid("BR_NONE", X.lit("1"))
