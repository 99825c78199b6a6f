"""Check digits and formats of seventeen Brazilian identifiers as Column expressions.

``is_valid(entity, value)`` is false for null and for anything of the wrong
shape. Constructors return null for a base of the wrong shape.
"""

from __future__ import annotations

from collections.abc import Callable

from velum.functions import sqlx as F
from velum.functions.sqlx import X

from velum.functions.text import WS, let

AREA_CODES = [str(n) for n in (*range(11, 20), 21, 22, 24, 27, 28, *range(31, 36), 37, 38, *range(41, 50), 51, *range(53, 56), *range(61, 70), 71, 73, 74, 75, 77, 79, *range(81, 90), *range(91, 100))]
STATES = dict(zip((f"{i:02d}" for i in range(1, 29)), "SP MG RJ RS BA PR CE PE SC GO MA PB PA ES PI RN AL MT MS DF SE AM RO AC AP RR TO ZZ".split()))
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: first prefix, last prefix, lengths, brand; the first row that fits wins
CARD_RANGES = [
    row.split()
    for row in """34 34 15 amex
37 37 15 amex
300 305 14 diners
3095 3095 14 diners
36 36 14 diners
3841 3841 16,19 hipercard
38 39 14 diners
3528 3589 16 jcb
4 4 13,16,19 visa
2221 2720 16 mastercard
51 55 16 mastercard
6011 6011 16,19 discover
622126 622925 16,19 discover
644 649 16,19 discover
65 65 16,19 discover
606282 606282 16,19 hipercard
627780 627780 16 elo
636297 636297 16 elo
636368 636368 16 elo""".splitlines()
]


def _strip(value: X, extra: str = "") -> X:
    return F.regexp_replace(value, f"{WS}|[{extra}]" if extra else WS, "")


def _d(v: X, i: int) -> X:
    """The i-th character's value, from 1; digits 0-9, letters as code - 48."""
    return F.ascii(F.substring(v, i, 1)) - 48


def _sum(v: X, weights, first: int = 1) -> X:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + _d(v, first + k) * w
    return total


def _low(r: X) -> X:
    """0 for a remainder under 2, else 11 less it; r, a sum over many digits, stands here once."""
    return (11 - r) % 11 % 10


def _text(*parts: X) -> X:
    return F.concat(*(p.cast("string") for p in parts))


def _varied(v: X) -> X:
    return ~v.rlike(r"^(.)\1*$")


def _checked(value: X, strip: str, shape: str, fn: Callable[[X], X], upper: bool = False) -> X:
    clean = _strip(value, strip)
    return F.coalesce(let(F.upper(clean) if upper else clean, lambda v: F.when(v.rlike(f"^(?:{shape})\\z"), fn(v)).otherwise(False)), F.lit(False))


def _shaped(base: X, shape: str, fn: Callable[[X], X]) -> X:
    return let(base, lambda v: F.when(v.rlike(f"^(?:{shape})\\z"), fn(v)))


def cpf_check_digits(base9: X) -> X:
    def made(v):
        return let(_low(_sum(v, range(10, 1, -1)) % 11), lambda d: _text(d, _low((_sum(v, range(11, 2, -1)) + d * 2) % 11)))

    return _shaped(base9, r"[0-9]{9}", made)


def cnpj_check_digits(base12: X) -> X:
    w = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    return _shaped(F.upper(base12), r"[0-9A-Z]{12}", lambda v: let(_low(_sum(v, w) % 11), lambda d: _text(d, _low((_sum(v, (6, *w[:-1])) + d * 2) % 11))))


def cns_from_pis(pis11: X) -> X:
    def made(v):
        def with_total(t):
            dv = 11 - t % 11
            return F.when(dv == 10, _text(v, F.lit("001"), 11 - (t + 2) % 11)).otherwise(_text(v, F.lit("000"), F.when(dv == 11, 0).otherwise(dv)))

        return let(_sum(v, range(15, 4, -1)), with_total)

    return _shaped(pis11, r"[12][0-9]{10}", made)


def nis_check_digit(base10: X) -> X:
    return _shaped(base10, r"[0-9]{10}", lambda v: let(11 - _sum(v, (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)) % 11, lambda r: F.when(r >= 10, 0).otherwise(r).cast("string")))


def _mod97(base: X) -> X:
    """98 - (base followed by 00) mod 97, two digits."""
    return F.lpad((98 - F.concat(base, F.lit("00")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")


def cnj_check_digits(sequence7: X, rest11: X) -> X:
    return _shaped(F.concat(sequence7, rest11), r"[0-9]{18}", _mod97)


def cnm_check_digits(base14: X) -> X:
    return _shaped(base14, r"[0-9]{14}", _mod97)


def titulo_check_digits(sequence8: X, state2: X) -> X:
    def made(v):
        big = F.substring(v, 9, 2).isin("01", "02")
        fixed = lambda r: F.when(r == 10, 0).when(big & (r == 0), 1).otherwise(r)
        return let(fixed(_sum(v, range(2, 10)) % 11), lambda d: _text(d, fixed((_sum(v, (7, 8), 9) + d * 9) % 11)))

    return _shaped(F.concat(sequence8, state2), r"[0-9]{8}(?:0[1-9]|1[0-9]|2[0-8])", made)


def titulo_state(value: X) -> X:
    code = F.substring(_strip(value, r".\-/"), 9, 2)
    return F.when(is_valid("BR_TITULO_ELEITOR", value), F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[code])


def cnh_check_digits(base9: X) -> X:
    def made(v):
        def second(first):
            off = F.when(first >= 10, 2).otherwise(0)
            r = _sum(v, range(1, 10)) % 11
            return let(F.when(r >= 10, 0).otherwise(F.pmod(r - off, F.lit(11))), lambda d: _text(F.when(first >= 10, 0).otherwise(first), F.when(d >= 10, 0).otherwise(d)))

        return let(_sum(v, range(9, 0, -1)) % 11, second)

    return _shaped(base9, r"[0-9]{9}", made)


def renavam_check_digit(base10: X) -> X:
    return _shaped(base10, r"[0-9]{10}", lambda v: let(_sum(v, (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)) * 10 % 11, lambda r: F.when(r == 10, 0).otherwise(r).cast("string")))


def cib_normalise(value: X) -> X:
    return F.translate(F.upper(_strip(value, r"\-")), "ILO", "110")


def cib_check_char(base7: X) -> X:
    def made(v):
        number = lambda i: F.instr(F.lit(CROCKFORD), F.substring(v, i, 1)) - 1
        rare = sum((number(k + 1) * w for k, w in enumerate((4, 3, 9, 5, 7, 1, 8))), F.lit(0)) % 31
        return F.when(v.rlike("^[0-9]+$"), _low(_sum(v, range(8, 1, -1)) % 11).cast("string")).otherwise(F.substr(F.lit(CROCKFORD), rare + 1, F.lit(1)))

    return _shaped(cib_normalise(base7), f"[{CROCKFORD}]{{7}}", made)


def luhn_check_digit(base: X) -> X:
    return _shaped(base, r"[0-9]{1,30}", lambda v: ((10 - _luhn_sum(F.concat(v, F.lit("0"))) % 10) % 10).cast("string"))


def _luhn_sum(v: X) -> X:
    chars = F.filter(F.split(v, ""), lambda c: c != "")

    def add(a, x):
        d = F.ascii(x["c"]) - 48
        return a + F.when(x["even"] & (d > 4), 2 * d - 9).when(x["even"], 2 * d).otherwise(d)

    return F.aggregate(F.transform(chars, lambda c, i: F.struct(c.alias("c"), ((F.char_length(v) - i) % 2 == 0).alias("even"))), F.lit(0), add)


def card_brand(value: X) -> X:
    def made(v):
        out = F.lit(None).cast("string")
        for low, high, lengths, name in reversed(CARD_RANGES):
            out = F.when(F.char_length(v).isin(*map(int, lengths.split(","))) & F.substring(v, 1, len(low)).between(low, high), name).otherwise(out)
        return out

    return _shaped(_strip(value, r"\-"), r"[0-9]{13,19}", made)


def plate_to_mercosur(value: X) -> X:
    """Old plates get a letter for their fifth character; new ones stay."""
    clean = F.upper(_strip(value, r"\-"))
    return let(clean, lambda v: F.when(v.rlike(r"^[A-Z]{3}[0-9]{4}\z"), F.concat(F.substring(v, 1, 4), F.substr(F.lit("ABCDEFGHIJ"), _d(v, 5) + 1, F.lit(1)), F.substring(v, 6, 2))).when(v.rlike(r"^[A-Z]{3}[0-9][A-Z][0-9]{2}\z"), v))


def _cns(v):
    built = F.substring(v, 1, 11)
    return F.when(F.substring(v, 1, 1).isin("1", "2"), v == cns_from_pis(built)).otherwise(_sum(v, range(15, 0, -1)) % 11 == 0)


def _phone(value):
    def made(v):
        own = F.when(v.startswith("55") & F.char_length(v).isin(12, 13), F.substring(v, 3, 11)).otherwise(v)
        return let(own, lambda d: F.substring(d, 1, 2).isin(*AREA_CODES) & (d.rlike(r"^[0-9]{2}9[0-9]{8}\z") | d.rlike(r"^[0-9]{2}[2-5][0-9]{7}\z")))

    return F.coalesce(let(F.regexp_replace(value, "[^0-9]", ""), made), F.lit(False))


def _renavam(value):
    return _checked(F.when(F.char_length(_strip(value, r".\-")).isin(9, 11), F.lpad(_strip(value, r".\-"), 11, "0")), "", r"[0-9]{11}", lambda v: _varied(v) & (F.substring(v, 11, 1) == renavam_check_digit(F.substring(v, 1, 10))))


VALIDATORS: dict[str, Callable[[X], X]] = {
    "BR_CPF": lambda x: _checked(x, r".\-/", r"[0-9]{11}", lambda v: _varied(v) & (F.substring(v, 10, 2) == cpf_check_digits(F.substring(v, 1, 9)))),
    "BR_CNPJ": lambda x: _checked(x, r".\-/", r"[0-9A-Z]{12}[0-9]{2}", lambda v: _varied(v) & (F.substring(v, 13, 2) == cnpj_check_digits(F.substring(v, 1, 12))), upper=True),
    "BR_CNS": lambda x: _checked(x, r".\-", r"[12789][0-9]{14}", _cns),
    "BR_NIS": lambda x: _checked(x, r".\-/", r"[0-9]{11}", lambda v: _varied(v) & (F.substring(v, 11, 1) == nis_check_digit(F.substring(v, 1, 10)))),
    "BR_CNJ": lambda x: _checked(x, r".\-", r"[0-9]{13}[1-9][0-9]{6}", lambda v: F.substring(v, 8, 2) == _mod97(F.concat(F.substring(v, 1, 7), F.substring(v, 10, 11)))),
    "BR_TITULO_ELEITOR": lambda x: _checked(x, r".\-/", r"[0-9]{12}", lambda v: _varied(v) & F.coalesce(F.substring(v, 11, 2) == titulo_check_digits(F.substring(v, 1, 8), F.substring(v, 9, 2)), F.lit(False))),
    "BR_CNH": lambda x: _checked(x, r".\-", r"[0-9]{11}", lambda v: _varied(v) & (F.substring(v, 10, 2) == cnh_check_digits(F.substring(v, 1, 9)))),
    "BR_RENAVAM": _renavam,
    "BR_PLACA": lambda x: _checked(x, r"\-", r"[A-Z]{3}[0-9](?:[0-9]|[A-Z])[0-9]{2}", lambda v: F.lit(True), upper=True),
    "BR_PIX_EVP": lambda x: F.coalesce(F.lower(_trim(x)).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"), F.lit(False)),
    "BR_TELEFONE": _phone,
    "BR_CEP": lambda x: _checked(x, r".\-", r"[0-9]{8}", lambda v: v >= "01000000"),
    "BR_CNM": lambda x: _checked(x, r".\-", r"[0-9]{6}[23][0-9]{9}", lambda v: F.substring(v, 15, 2) == cnm_check_digits(F.substring(v, 1, 14))),
    "BR_CIB": lambda x: F.coalesce(let(cib_normalise(x), lambda v: F.when(v.rlike(f"^[{CROCKFORD}]{{8}}\\z"), _varied(v) & (F.substring(v, 8, 1) == cib_check_char(F.substring(v, 1, 7)))).otherwise(False)), F.lit(False)),
    "BR_IPTU": lambda x: _checked(x, r".\-/", r"[0-9]{6,20}", _varied),
    "BR_MATRICULA_IMOVEL": lambda x: _checked(x, r".", r"[0-9]{1,7}", lambda v: v.rlike("[1-9]")),
    "BR_CARTAO": lambda x: card_is_valid(x),
}


def _trim(x: X) -> X:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def card_is_valid(value: X, require_brand: bool = True) -> X:
    def made(v):
        ok = _varied(v) & (_luhn_sum(v) % 10 == 0)
        return ok & card_brand(v).isNotNull() if require_brand else ok

    return _checked(value, r"\-", r"[0-9]{13,19}", made)


def is_valid(entity: str, value: X) -> X:
    if entity not in VALIDATORS:
        raise ValueError(f"no validator for {entity!r}")
    return VALIDATORS[entity](value)


def validate(entity: X, value: X) -> X:
    """is_valid() with the entity from a column; an entity that is not known gives null."""
    out = F.lit(None).cast("boolean")
    for name in VALIDATORS:
        out = F.when(entity == name, is_valid(name, value)).otherwise(out)
    return out


#: entity: (characters that formatting removes, what is taken from where); "@" stands for a digit or letter
_MASKS = {
    "BR_CPF": "@@@.@@@.@@@-@@", "BR_CNPJ": "@@.@@@.@@@/@@@@-@@", "BR_CNS": "@@@ @@@@ @@@@ @@@@", "BR_NIS": "@@@.@@@@@.@@-@", "BR_CNJ": "@@@@@@@-@@.@@@@.@.@@.@@@@",
    "BR_CNM": "@@@@@@.@.@@@@@@@-@@", "BR_CIB": "@@@@@@@-@",
}


def format_value(entity: str, value: X) -> X:
    """The value in its usual punctuation; null if it isn't valid."""
    if entity not in _MASKS:
        raise ValueError(f"no format for {entity!r}")
    plain = cib_normalise(value) if entity == "BR_CIB" else F.upper(_strip(value, r".\-/"))

    def made(v):
        parts, i = [], 0
        for c in _MASKS[entity]:
            if c == "@":
                i += 1
                parts.append(F.substring(v, i, 1))
            else:
                parts.append(F.lit(c))
        return F.concat(*parts)

    return F.when(is_valid(entity, value), let(plain, made))
