"""Deterministic texts with identifiers, built from integer keys by the same arithmetic everywhere."""

from __future__ import annotations

from velum.functions import sqlx as F
from velum.functions import validators as V
from velum.functions.sqlx import X
from velum.functions.text import let


def base(key: X, width: int, factor: int = 7919, offset: int = 104729) -> X:
    """``width`` digits that spread over the keys."""
    return F.lpad(F.pmod(key.cast("bigint") * factor + offset, 10**width).cast("string"), width, "0")


def cpf(key: X) -> X:
    return let(base(key, 9), lambda b: F.concat(b, V.cpf_check_digits(b)))


def wrong_last_digit(value: X) -> X:
    n = F.char_length(value)
    return F.concat(F.substr(value, 1, n - 1), F.pmod(F.substr(value, n, 1).cast("int") + 1, 10).cast("string"))


def cpf_formatted(digits: X) -> X:
    return F.concat(F.substring(digits, 1, 3), ".", F.substring(digits, 4, 3), ".", F.substring(digits, 7, 3), "-", F.substring(digits, 10, 2))


def card(key: X) -> X:
    return let(F.concat("4", base(key, 14)), lambda b: F.concat(b, V.luhn_check_digit(b)))


def cnj(key: X) -> X:
    seq, rest = base(key, 7), F.concat("2017826", base(key, 4, 31, 17))
    return F.concat(seq, V.cnj_check_digits(seq, rest), rest)


def sentence(key: X) -> X:
    """A text whose shape turns with the key: label or none, formatted or compact, valid or one digit off."""
    number = let(cpf(key), lambda v: F.when(F.pmod(key, 5) == 0, wrong_last_digit(v)).otherwise(v))
    shown = let(number, lambda v: F.when(F.pmod(key, 3) == 0, v).otherwise(cpf_formatted(v)))
    word = F.when(F.pmod(key, 2) == 0, "CPF ").otherwise("codigo ")
    return F.concat("registro de numero ", key.cast("string"), ": ", word, shown, F.when(F.pmod(key, 4) == 0, F.concat(", cartao ", card(key))).otherwise(""), " fim")
