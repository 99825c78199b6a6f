"""Operator 8 [native]: format-preserving Feistel pseudonyms for personal data.

Card numbers (Luhn), social security numbers, IPv4 addresses, telephone
numbers and dates are validated and then permuted by a keyed Feistel network
inside their own format; e-mail addresses and secrets (the value after
``token =`` and the like) go through the same network position by position,
letters to letters and digits to digits. Equal values get equal pseudonyms in
every document, different ones different pseudonyms. Round functions are
HMAC-SHA-256 under the key, with the kind and the round as tweak.

All of it is DataFrame expressions: one alternation finds the candidates,
``split`` gives what stands between them, each candidate is validated and
replaced, and the text is joined again. No shuffle; only texts with a digit or
one of ``@ = :`` are looked at (every kind needs one).

A secret has 16 characters or more, or 8 if a letter and a digit are among
them; a password has 4 or more of any printable kind but quotes, commas,
semicolons, angle brackets and backslashes. The key may stand in quotes.

A candidate that fails its validation stays as it is. A date has its year
first or last, '/', '.' or '-' between its parts, and days and months of one
or two digits. It keeps its century; one with the year last counts as day,
month, year where that is a date, else as month, day, year. A card keeps its
first six digits and gets a new check digit; other groups of digits beside it
(an expiry month) stay. A value after a secret's key that looks like a number of
some kind and fails its check is a secret.

Cases: a null or empty text stays so and has no findings; repeated rows are
treated alike; an empty table gives an empty result; other columns are kept,
and one named as an output is replaced. Texts are treated whole.

The key's HMAC pads stand in the plan as literals and so in explain() output
and the event log; restrict both as you restrict the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.session import table

#: For tests and the registered query; give your own to pseudonymise().
DEMO_KEY = b"velum demonstration key 7f3b9a1c"
ROUNDS = 8
SPANS = "array<struct<kind:string,start:int,length:int>>"
#: Hits whose places are found in one run.
RUN = 256

_PASSWORD, _SECRET = "password|passwd", r"token|secret|api[_\-]?key|access[_\-]?key"
#: A password runs to the next blank, quote, comma, semicolon, angle bracket or backslash.
_PASSWORD_VALUE = r"[!-~&&[^\"'`,;<>\\]]{4,}+"
#: Of fewer than 16 characters only with a letter and a digit, so that words and counts after "token:" stay.
_SECRET_VALUE = r"(?=[A-Za-z0-9])(?:[A-Za-z0-9_/+\-]{16,}+|(?=[A-Za-z_/+\-]{0,14}[0-9])(?=[0-9_/+\-]{0,14}[A-Za-z])[A-Za-z0-9_/+\-]{8,15}+(?![A-Za-z0-9_/+\-]))"
_DATES = "|".join(rf"\d{{4}}{s}\d{{1,2}}{s}\d{{1,2}}|\d{{1,2}}{s}\d{{1,2}}{s}\d{{4}}" for s in ("/", r"\.", "-"))


def _after(keys: str) -> str:
    """What stands before a secret: a key, perhaps its closing quote, '=' or ':', perhaps an opening quote."""
    return rf"(?i:{keys})[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?"


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": rf"(?=[!-~])(?<=[\"'=:\s])(?<=[=:][ \t]{{0,3}}[\"']?)(?:(?<={_after(_PASSWORD)}){_PASSWORD_VALUE}|(?<={_after(_SECRET)}){_SECRET_VALUE})",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "date": rf"(?<!\d[/.\-])(?<![\d/\-])(?:{_DATES})(?![\d/\-]|\.\d)",
    "phone": r"(?<![\w+])(?:\+1[ .\-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .\-])[2-9]\d{2}[ .\-]\d{4}(?!\d)|(?<![\w+])\+(?!1[ .\-(])\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,4}(?!\d)",
    "card": r"(?<![\d])\d(?:[ \-]?\d){12,18}(?![\d])",
}
CANDIDATE = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = list(PATTERNS)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once; written out, it is computed anew at each use, in a lambda for each element."""
    return F.transform(F.array(value), use)[0]


def _hmac(key: bytes, message: Column) -> Column:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _rounds() -> Column:
    return F.array(*(F.lit(r) for r in range(ROUNDS)))


def permute_number(key: bytes, kind: str, x: Column, y: Column, mx, my) -> Column:
    """A keyed permutation of pairs (x, y), 0 <= x < mx and 0 <= y < my: struct<x, y>."""
    long = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long")

    def step(a, r):
        drawn = F.conv(F.substring(_hmac(key, F.concat_ws("|", F.lit(kind), r.cast("string"), a["my"].cast("string"), a["y"].cast("string"))), 1, 15), 16, 10).cast("long")
        return F.struct(a["y"].alias("x"), ((a["x"] + drawn % a["mx"]) % a["mx"]).alias("y"), a["my"].alias("mx"), a["mx"].alias("my"))

    return F.aggregate(_rounds(), F.struct(long(x).alias("x"), long(y).alias("y"), long(mx).alias("mx"), long(my).alias("my")), step)


def permute_text(key: bytes, kind: str, text: Column, letters=26) -> Column:
    """A keyed permutation of the strings of one format: each digit, small and capital letter (of the first ``letters``) stays of its kind."""

    def moved(half: Column, drawn: Column) -> Column:
        def char(c, i, drawn, letters):
            code, b = F.ascii(c), F.conv(F.substr(drawn, 1 + 2 * (i % 32), F.lit(2)), 16, 10).cast("int")
            turn = lambda first, n: F.char((first + (code - first + b) % n).cast("long"))
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, letters)).when(c.between("A", "Z"), turn(65, letters)).otherwise(c)

        chars = lambda v: F.transform(F.filter(F.split(half, ""), lambda c: c != ""), lambda c, i: char(c, i, v["drawn"], v["letters"]))
        return F.array_join(_let(F.struct(drawn.alias("drawn"), (letters if isinstance(letters, Column) else F.lit(letters)).alias("letters")), chars), "")

    def step(a, r):
        drawn = _hmac(key, F.concat_ws("|", F.lit(kind), r.cast("string"), F.length(a["x"]).cast("string"), a["y"]))
        return F.struct(a["y"].alias("x"), moved(a["x"], drawn).alias("y"))

    def whole(t):
        n = F.floor(F.length(t) / 2).cast("int")
        made = F.aggregate(_rounds(), F.struct(F.substr(t, F.lit(1), n).alias("x"), F.substr(t, n + 1).alias("y")), step)
        return _let(made, lambda p: F.concat(p["x"], p["y"]))

    return _let(text, whole)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits, the last one undoubled."""

    def value(c, i, n):
        d = F.ascii(c) - 48
        twice = (n - 1 - i) % 2 == 1
        return F.when(twice & (d >= 5), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    values = lambda chars: F.transform(chars, lambda c, i: value(c, i, F.size(chars)))
    return F.aggregate(_let(F.filter(F.split(digits, ""), lambda c: c != ""), values), F.lit(0), lambda a, d: a + d)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""

    def char(c, i, v):
        k = F.length(_digits(F.substr(v["shape"], F.lit(1), i + 1)))
        return F.when(c.between("0", "9"), F.substr(v["digits"], k, F.lit(1))).otherwise(c)

    chars = lambda v: F.transform(F.filter(F.split(v["shape"], ""), lambda c: c != ""), lambda c, i: char(c, i, v))
    return F.array_join(_let(F.struct(shape.alias("shape"), digits.alias("digits")), chars), "")


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _email(key: bytes, m: Column) -> Column:
    name, tld = F.regexp_extract(m, r"^(.*)(\.[A-Za-z]+)$", 1), F.regexp_extract(m, r"^(.*)(\.[A-Za-z]+)$", 2)
    return F.concat(permute_text(key, "email", F.lower(name)), tld)


def _ip(key: bytes, m: Column) -> Column:
    o = [F.get(F.split(m, r"\."), F.lit(i)).cast("long") for i in range(4)]
    p = permute_number(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    made = F.transform(F.array(p), lambda p: F.concat_ws(".", F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256))
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), made[0])


def _ssn(key: bytes, m: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 1-665, 667-899
    p = permute_number(key, "ssn", index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    made = F.transform(F.array(p), lambda p: F.concat_ws("-", _pad(F.when(p["x"] >= 665, p["x"] + 2).otherwise(p["x"] + 1), 3), _pad(F.floor(p["y"] / 9999) + 1, 2), _pad(p["y"] % 9999 + 1, 4)))
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), made[0])


def _date(key: bytes, m: Column) -> Column:
    part = [F.get(F.split(m, r"[/.\-]"), F.lit(i)) for i in range(3)]
    year_first = F.length(part[0]) == 4
    as_date = lambda y, a, d: F.try_to_timestamp(F.concat_ws("-", y, _pad(a, 2), _pad(d, 2)), F.lit("yyyy-MM-dd")).cast("date")
    day_first = as_date(part[2], part[1], part[0])
    date = F.when(year_first, as_date(*part)).otherwise(F.coalesce(day_first, as_date(part[2], part[0], part[1])))

    def made(d):
        century = (F.floor(F.year(d) / 100) * 100).cast("int")
        first = F.make_date(century, F.lit(1), F.lit(1))
        leap = century % 400 == 0  # a century of 36525 = 75 * 487 days, else 36524 = 92 * 397
        my, mx = F.when(leap, 487).otherwise(397), F.when(leap, 75).otherwise(92)
        n = F.datediff(d, first)
        p = permute_number(key, "date", F.floor(n / my), n % my, mx, my)
        moved = F.transform(F.array(p), lambda p: F.date_add(first, (p["x"] * my + p["y"]).cast("int")))[0]
        like = lambda x, old: F.when(F.length(old) == 1, x.cast("string")).otherwise(_pad(x, 2))

        def written(t):
            y, a, d = _pad(F.year(t), 4), F.month(t), F.day(t)
            sep = F.regexp_extract(m, r"[/.\-]", 0)
            month_first = F.concat(like(a, part[0]), sep, like(d, part[1]), sep, y)
            return F.when(year_first, F.concat(y, sep, like(a, part[1]), sep, like(d, part[2]))).when(day_first.isNotNull(), F.concat(like(d, part[0]), sep, like(a, part[1]), sep, y)).otherwise(month_first)

        return F.transform(F.array(moved), written)[0]

    return F.transform(F.array(date), lambda d: F.when(d.isNotNull() & (F.year(d) >= 1000), made(d)))[0]


def _phone(key: bytes, m: Column) -> Column:
    d = _digits(m)
    national = (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))
    own = F.right(d, F.lit(10))
    area, exchange, line = F.substring(own, 1, 3).cast("long"), F.substring(own, 4, 3).cast("long"), F.substring(own, 7, 4).cast("long")
    p = permute_number(key, "phone", area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000)
    moved = F.transform(F.array(p), lambda p: F.concat(_pad(p["x"] + 200, 3), _pad(F.floor(p["y"] / 10000) + 200, 3), _pad(p["y"] % 10000, 4)))[0]
    code = F.substr(d, F.lit(1), F.length(d) - 10)
    abroad = F.concat(F.substring(d, 1, 2), permute_text(key, "phone", F.substr(d, F.lit(3))))
    n = F.length(d)
    return F.when(national & (area >= 200) & (exchange >= 200), _refill(m, F.concat(code, moved))).when(m.startswith("+") & n.between(8, 15), _refill(m, abroad))


def _card(key: bytes, m: Column) -> Column:
    """The first run of whole groups in ``m`` with 13 to 19 digits that pass, the longest of those that begin there; what stands around it stays."""
    def cuts(skip):  # before and own, by literal patterns: those of an array would be compiled anew for each card
        at = lambda n, group: F.regexp_extract(m, rf"^((?:\d+[ \-]){{{skip}}})(\d(?:[ \-]?\d){{{n - 1}}})(?![0-9])", group)
        return F.array(*(F.struct(at(n, 1).alias("before"), at(n, 2).alias("own")) for n in range(19, 12, -1)))

    def good(x):
        return (F.length(x["own"]) > 0) & _let(_digits(x["own"]), lambda d: (_luhn(d) % 10 == 0) & ~d.rlike(r"^(\d)\1*$"))

    def made(p):
        before, own = p["before"], p["own"]

        def whole(d):
            body = F.concat(F.substring(d, 1, 6), permute_text(key, "card", F.substr(d, F.lit(7), F.length(d) - 7)))
            return _let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

        return F.concat(before, _refill(own, _let(_digits(own), whole)), F.substr(m, F.length(before) + F.length(own) + 1))

    fit = F.coalesce(*(F.get(F.filter(cuts(skip), good), F.lit(0)) for skip in range(6)))
    return _let(fit, lambda p: F.when(p.isNotNull(), made(p)))


def _secret(key: bytes, m: Column) -> Column:
    return permute_text(key, "secret", m, F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 6).otherwise(26))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """``docs`` with the text's personal data replaced, and ``found_col``: array<struct<kind, start, length>> (code points, in the new text)."""
    if len(key) < 16:
        raise ValueError("a key has 16 bytes at least")
    makers = {"email": _email, "secret": _secret, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}
    cols = [c for c in docs.columns if c.lower() not in (found_col.lower(),)]
    # the other columns under names of their own (as a struct they would be pruned field by field through the steps below)
    held = {c: f"__c{i}" for i, c in enumerate(cols) if c != text_col}
    names = list(held.values())
    df = docs.select(*(F.col(c).alias(n) for c, n in held.items()), F.col(text_col).alias("text"))
    may = F.col("text").rlike("[0-9@=:]")
    df = df.select(*names, "text", F.inline(F.array(F.struct(F.when(may, F.regexp_extract_all("text", F.lit(CANDIDATE), 0)).alias("raw")))))

    def judged(m):
        kind = F.lit(None).cast("string")
        for k in ("secret", *(k for k in reversed(KINDS) if k != "secret")):  # the last that holds counts: numbers before secrets
            # a whole match of its own pattern; look-arounds have been met in the text
            kind = F.when(m.rlike("^(?:" + _inside(k) + ")$"), F.lit(k)).otherwise(kind)
        return F.struct(m.alias("old"), kind.alias("kind"))

    def replaced(x):
        made = F.lit(None).cast("string")
        for k in KINDS:
            made = F.when(x["kind"] == k, makers[k](key, x["old"])).otherwise(made)
        return F.struct(x["old"].alias("old"), x["kind"].alias("kind"), made.alias("new"))

    def settled(x, i):
        # what looks like a number of some kind but isn't one is still a secret where a key stands before it
        keyed = x["new"].isNull() & F.get(F.col("gaps"), i).rlike(f"{_after(_PASSWORD + '|' + _SECRET)}$")
        return F.struct(x["old"].alias("old"), F.when(keyed, F.lit("secret")).otherwise(x["kind"]).alias("kind"), F.when(keyed, _secret(key, x["old"])).otherwise(x["new"]).alias("new"))

    some = F.col("raw").isNotNull() & (F.size("raw") > 0)
    df = df.select(*names, "text", F.inline(F.array(F.struct(F.when(some, F.transform(F.transform("raw", judged), replaced)).alias("hits"), F.when(some, F.split("text", CANDIDATE)).alias("gaps")))))
    df = df.select(*names, "text", "gaps", F.inline(F.array(F.struct(F.transform("hits", settled).alias("hits")))))
    new, some = F.transform("hits", lambda x: F.coalesce(x["new"], x["old"])), F.col("hits").isNotNull()
    df = df.select(*names, "text", "gaps", "hits", F.inline(F.array(F.struct(F.when(some, new).alias("new")))))
    whole = F.array_join(F.flatten(F.transform("gaps", lambda g, i: F.array(g, F.coalesce(F.get("new", i), F.lit(""))))), "")

    def placed(a, i):
        hit, at, length = F.get("hits", i), a["at"] + F.length(F.get("gaps", i)), F.length(F.get("new", i))
        span = F.struct(hit["kind"].alias("kind"), at.alias("start"), length.alias("length"))
        return F.struct((at + length).alias("at"), F.when(hit["new"].isNull(), a["spans"]).otherwise(F.array_append(a["spans"], span)).alias("spans"))

    def run(a, first):
        # an array grows by copies: hits are placed by runs, so that a text of many hits doesn't take the square of their number
        own = F.aggregate(F.sequence(first, F.least(first + (RUN - 1), F.size("hits") - 1)), F.struct(a["at"].alias("at"), F.array().cast(SPANS).alias("spans")), placed)
        return _let(own, lambda x: F.struct(x["at"].alias("at"), F.array_append(a["runs"], x["spans"]).alias("runs")))

    spans = F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("runs")), run, lambda a: F.flatten(a["runs"]))
    text = F.when(some, whole).otherwise(F.col("text"))
    return df.select(
        *(text.alias(c) if c == text_col else F.col(held[c]).alias(c) for c in cols),
        F.when(some, spans).otherwise(F.array().cast(SPANS)).alias(found_col),
    )


def _inside(kind: str) -> str:
    """A kind's pattern for the matched string alone."""
    import re

    if kind == "secret":
        return f"{_PASSWORD_VALUE}|{_SECRET_VALUE}"
    p = PATTERNS[kind].replace(r"(?<!\d[/.\-])", "")
    return re.sub(r"\(\?<!\[[^\]]*\]\)", "", p)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, and what was found in it, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, DEMO_KEY).withColumn("n_found", F.size("pii").cast("long"))


def safe_documents(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """``docs`` with pseudonyms in their texts and n_chars anew."""
    made = pseudonymise(docs, key, found_col="__pii")
    return made.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)
