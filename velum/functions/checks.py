"""Check digits of whole batches: the rules of ``validators`` on numpy matrices, for operators that see values in Arrow batches.

A value becomes a row of character codes less 48 (digits 0 to 9, capitals from
17), values of one length become one matrix, and a rule is a few weighted sums
over its columns. ``validators`` has the same rules as SQL; tests hold them together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

from velum.functions.validators import AREA_CODES, CARD_RANGES, CROCKFORD

_CNPJ = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
_NIS = (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def rows(values: Sequence[str]) -> np.ndarray:
    """Values of equal length, ASCII, as a matrix of codes less 48."""
    return np.frombuffer("".join(values).encode("ascii"), np.uint8).reshape(len(values), -1).astype(np.int64) - 48


def _sum(m: np.ndarray, weights: Sequence[int], first: int = 0) -> np.ndarray:
    return m[:, first : first + len(weights)] @ np.array(weights)


def _low(r: np.ndarray) -> np.ndarray:
    return np.where(r < 2, 0, 11 - r)


def varied(m: np.ndarray) -> np.ndarray:
    return (m != m[:, :1]).any(axis=1)


def _mod97(m: np.ndarray) -> np.ndarray:
    """98 - (the digits of each row followed by 00) mod 97."""
    rest = np.zeros(len(m), np.int64)
    for column in m.T:
        rest = (rest * 10 + column) % 97
    return 98 - rest * 100 % 97


def _cpf(m):
    d = _low(_sum(m, range(10, 1, -1)) % 11)
    return varied(m) & (m[:, 9] == d) & (m[:, 10] == _low((_sum(m, range(11, 2, -1)) + 2 * d) % 11))


def _cnpj(m):
    d = _low(_sum(m, _CNPJ) % 11)
    return varied(m) & (m[:, 12] == d) & (m[:, 13] == _low((_sum(m, (6, *_CNPJ[:-1])) + 2 * d) % 11))


def _cns(m):
    total = _sum(m, range(15, 4, -1))
    dv = 11 - total % 11
    ten = dv == 10
    tail = np.stack([0 * dv, 0 * dv, ten, np.where(ten, 11 - (total + 2) % 11, np.where(dv == 11, 0, dv))], axis=1)
    return np.isin(m[:, 0], (1, 2, 7, 8, 9)) & np.where(m[:, 0] <= 2, (m[:, 11:] == tail).all(axis=1), _sum(m, range(15, 0, -1)) % 11 == 0)


def _nis(m):
    d = 11 - _sum(m, _NIS) % 11
    return varied(m) & (m[:, 10] == np.where(d >= 10, 0, d))


def _cnj(m):
    return (m[:, 13] != 0) & (m[:, 7] * 10 + m[:, 8] == _mod97(np.delete(m, (7, 8), axis=1)))


def _titulo(m):
    state = m[:, 8] * 10 + m[:, 9]
    big = (state == 1) | (state == 2)
    fixed = lambda r: np.where(r == 10, 0, np.where(big & (r == 0), 1, r))
    d = fixed(_sum(m, range(2, 10)) % 11)
    return varied(m) & (state >= 1) & (state <= 28) & (m[:, 10] == d) & (m[:, 11] == fixed((_sum(m, (7, 8), 8) + 9 * d) % 11))


def _cnh(m):
    first, second = _sum(m, range(9, 0, -1)) % 11, _sum(m, range(1, 10)) % 11
    over = first == 10
    second = np.where(second == 10, 0, (second - 2 * over) % 11)
    return varied(m) & (m[:, 9] == np.where(over, 0, first)) & (m[:, 10] == np.where(second == 10, 0, second))


def _renavam(m):
    m = np.pad(m, ((0, 0), (11 - m.shape[1], 0)))
    return varied(m) & (m[:, 10] == _sum(m, _NIS) * 10 % 11 % 10)


def _cnm(m):
    return ((m[:, 6] == 2) | (m[:, 6] == 3)) & (m[:, 14] * 10 + m[:, 15] == _mod97(m[:, :14]))


def _cib(m):
    place = np.full(128, -1)
    place[rows([CROCKFORD])[0]] = np.arange(32)
    number = place[m]
    numeric = (m[:, :7] <= 9).all(axis=1)
    return varied(m) & (number[:, 7] == np.where(numeric, _low(_sum(m, range(8, 1, -1)) % 11), _sum(number, (4, 3, 9, 5, 7, 1, 8)) % 31))


def luhn(m: np.ndarray) -> np.ndarray:
    doubled = m.copy()
    doubled[:, -2::-2] *= 2
    return (doubled - 9 * (doubled > 9)).sum(axis=1) % 10 == 0


def _card(m):
    n, known = m.shape[1], np.zeros(len(m), bool)
    for low, high, lengths, _ in CARD_RANGES:
        if str(n) in lengths.split(","):
            prefix = _sum(m, [10 ** (len(low) - 1 - i) for i in range(len(low))])
            known |= (prefix >= int(low)) & (prefix <= int(high))
    return varied(m) & luhn(m) & known


def _any(m):
    return np.ones(len(m), bool)


#: entity: (characters that are no part of the value, shape of the rest, rule for its rows)
RULES: dict[str, tuple[str, str, Callable[[np.ndarray], np.ndarray]]] = {
    "BR_CPF": (r"[\s.\-/]", r"[0-9]{11}", _cpf), "BR_CNPJ": (r"[\s.\-/]", r"[0-9A-Z]{12}[0-9]{2}", _cnpj), "BR_CNS": (r"[\s.\-]", r"[12789][0-9]{14}", _cns), "BR_NIS": (r"[\s.\-/]", r"[0-9]{11}", _nis),
    "BR_CNJ": (r"[\s.\-]", r"[0-9]{13}[1-9][0-9]{6}", _cnj), "BR_TITULO_ELEITOR": (r"[\s.\-/]", r"[0-9]{12}", _titulo), "BR_CNH": (r"[\s.\-]", r"[0-9]{11}", _cnh), "BR_RENAVAM": (r"[\s.\-]", r"[0-9]{9}|[0-9]{11}", _renavam),
    "BR_PLACA": (r"[\s\-]", r"[A-Z]{3}[0-9][0-9A-Z][0-9]{2}", _any), "BR_PIX_EVP": (r"^\s+|\s+$", r"[0-9A-F]{8}-[0-9A-F]{4}-[1-5][0-9A-F]{3}-[89AB][0-9A-F]{3}-[0-9A-F]{12}", _any),
    "BR_TELEFONE": (r"[^0-9]", rf"(?:55(?=[0-9]{{10,11}}$))?(?:{'|'.join(AREA_CODES)})(?:9[0-9]{{8}}|[2-5][0-9]{{7}})", _any), "BR_CEP": (r"[\s.\-]", r"(?!00)[0-9]{8}", _any),
    "BR_CNM": (r"[\s.\-]", r"[0-9]{6}[23][0-9]{9}", _cnm), "BR_CIB": (r"[\s\-]", f"[{CROCKFORD}]{{8}}", _cib), "BR_IPTU": (r"[\s.\-/]", r"[0-9]{6,20}", varied), "BR_MATRICULA_IMOVEL": (r"[\s.]", r"(?=.*[1-9])[0-9]{1,7}", _any),
    "BR_CARTAO": (r"[\s\-]", r"[0-9]{13,19}", _card),
}
_COMPILED = {k: (re.compile(strip), re.compile(shape), rule) for k, (strip, shape, rule) in RULES.items()}


def valid(entity: str, values: Sequence[str]) -> np.ndarray:
    """Which of the values pass the entity's rule."""
    strip, shape, rule = _COMPILED[entity]
    out = np.zeros(len(values), bool)
    by_length: dict[int, list[tuple[int, str]]] = {}
    for i, v in enumerate(values):
        clean = strip.sub("", v).upper()
        if entity == "BR_CIB":
            clean = clean.translate({73: "1", 76: "1", 79: "0"})
        if shape.fullmatch(clean):
            by_length.setdefault(len(clean), []).append((i, clean))
    for found in by_length.values():
        out[[i for i, _ in found]] = rule(rows([c for _, c in found]))
    return out


def valid_windows(entity: str, digits: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows of n digits that begin at ``starts`` pass. Any shape that is all digits and of length n is known to fit."""
    return RULES[entity][2](digits[starts[:, None] + np.arange(n)]) if len(starts) else np.zeros(0, bool)
