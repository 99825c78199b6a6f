"""Text normalisation as SQL expressions: lengths and offsets stay those of the original text."""

from __future__ import annotations

import unicodedata

from velum.functions import sqlx as F
from velum.functions.sqlx import X

DASHES, BLANKS, SLASHES, DOTS = "‐‑‒–—―−﹣－", "    　", "⁄∕／", "．․"
#: White space as Python's str methods see it; Java's \\s is ASCII only.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INVISIBLE = r"[\p{Cf}\p{Mn}\x{3164}\x{115f}\x{1160}\x{ffa0}]"
#: Without ideographs, Hangul syllables and private use, which hold no digits and no ASCII letters under accents.
_SCALARS = [chr(i) for i in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000))]


def _swaps() -> dict[str, str]:
    out = dict.fromkeys(DASHES, "-") | dict.fromkeys(BLANKS, " ") | dict.fromkeys(SLASHES, "/") | dict.fromkeys(DOTS, ".")
    for c in _SCALARS:
        if c not in out and c.isdigit():
            out[c] = str(unicodedata.digit(c))
    for i in range(0xFF21, 0xFF5B):
        out.setdefault(chr(i), chr(i - 0xFEE0))
    return out


def _folds() -> dict[str, str]:
    out = {chr(i): chr(i + 32) for i in range(65, 91)}
    for c in _SCALARS:
        low = unicodedata.normalize("NFD", c.lower())[:1]
        if low and low.isascii() and low.isalnum():
            out[c] = low
    return out


SWAPS, FOLDS = _swaps(), _folds()
OTHER_DIGITS = "".join(c for c in _SCALARS if c.isdigit())


def let(value: X, fn) -> X:
    """``fn`` of ``value``, computed once (a lambda variable, where a plain expression would be repeated at each use)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _mapped(text: X, table: dict[str, str]) -> X:
    return F.translate(text, "".join(table), "".join(table.values()))


def normalise(text: X) -> X:
    """Look-alike dashes, blanks, slashes, dots, digits and full-width letters to ASCII, one for one."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), _mapped(text, SWAPS)).otherwise(text)


def fold(text: X) -> X:
    """Small letters without accents where they are ASCII letters below the accent, one for one."""
    return _mapped(text, FOLDS)


def strip_invisible(text: X) -> X:
    return F.regexp_replace(text, INVISIBLE, "")


def visible_places(text: X) -> X:
    """Place in ``text`` of each character that strip_invisible() keeps."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: ~x["c"].rlike(INVISIBLE)), lambda x: x["i"])


def invisible_near_digit(text: X) -> X:
    """Does a digit of any script stand within two places of an invisible character?"""
    digit = f"[0-9{OTHER_DIGITS}]"
    near = f"(?s){digit}.{{0,1}}{INVISIBLE}|{INVISIBLE}.{{0,1}}{digit}"
    return text.rlike(INVISIBLE) & text.rlike(near)


def canonical_label(value: X) -> X:
    """What a stable label is computed from: visible, normalised, letters and digits only, capitals."""
    return F.upper(F.regexp_replace(normalise(strip_invisible(value)), "[^0-9A-Za-z]", ""))


def canonical_vault(value: X) -> X:
    """What a vault token is computed from: ASCII letters and digits only, capitals; look-alikes are not normalised."""
    return F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))


def collapse_blanks(text: X) -> X:
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def char_offset(text: X, byte_offset: X) -> X:
    """Code points before a UTF-8 byte offset."""
    return F.char_length(F.decode(F.substr(F.encode(text, "UTF-8"), 1, byte_offset.cast("int")), "UTF-8"))
