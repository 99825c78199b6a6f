"""SQL text with the manners of Column expressions.

The find() expression has tens of thousands of nodes. Built Column by Column,
each node costs a round trip to the JVM; as SQL text it is parsed there at
once. ``column()`` turns an expression into a Column.
"""

from __future__ import annotations

import inspect
import itertools

from pyspark.sql import Column
from pyspark.sql import functions as _F

_fresh = itertools.count()


class X:
    """``op`` is the operator at the top, None for what needs no parentheses (the parser is slow on nested ones)."""

    __slots__ = ("sql", "op")

    def __init__(self, sql: str, op: str | None = None):
        self.sql, self.op = sql, op

    def __str__(self):
        return self.sql

    __hash__ = None


def _part(x, op: str, left: bool = False) -> str:
    x = lit(x)
    return x.sql if x.op is None or (left and x.op == op and op in ("+", "AND", "OR")) else f"({x.sql})"


def lit(v) -> X:
    if isinstance(v, X):
        return v
    if v is None:
        return X("NULL")
    if v is True or v is False:
        return X("TRUE" if v else "FALSE")
    if isinstance(v, float):
        return X(f"{v!r}D")
    if isinstance(v, int):
        return X(str(v))
    return X("'" + str(v).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'")


def col(name: str) -> X:
    return X("`" + name.replace("`", "``") + "`")


def column(x: X) -> Column:
    return _F.expr(x.sql)


def _bin(op, swap=False):
    return (lambda a, b: X(f"{_part(b, op, True)} {op} {_part(a, op)}", op)) if swap else (lambda a, b: X(f"{_part(a, op, True)} {op} {_part(b, op)}", op))


for _name, _op in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "and": "AND", "or": "OR"}.items():
    setattr(X, f"__{_name}__", _bin(_op))
for _name, _op in {"radd": "+", "rsub": "-", "rmul": "*", "rmod": "%", "rand": "AND", "ror": "OR"}.items():
    setattr(X, f"__{_name}__", _bin(_op, True))
X.__invert__ = lambda a: X(f"NOT {_part(a, '')}", "NOT")
X.__neg__ = lambda a: X(f"- {_part(a, '')}", "NEG")
X.__getitem__ = lambda a, k: X(f"{_part(a, '')}.`{k}`") if isinstance(k, str) else X(f"{_part(a, '')}[{lit(k)}]")
X.rlike = lambda a, p: X(f"rlike({a}, {lit(p)})")
X.startswith = lambda a, p: X(f"startswith({a}, {lit(p)})")
X.contains = lambda a, p: X(f"contains({a}, {lit(p)})")
X.isin = lambda a, *vs: X(f"{_part(a, '')} IN ({', '.join(str(lit(v)) for v in vs)})", "IN")
X.between = lambda a, b, c: X(f"{_part(a, '')} BETWEEN {_part(b, '')} AND {_part(c, '')}", "BETWEEN")
X.isNull = lambda a: X(f"isnull({a})")
X.isNotNull = lambda a: X(f"isnotnull({a})")
X.cast = lambda a, t: X(f"CAST({a} AS {t})")
X.alias = lambda a, n: Named(a, n)


class Named:
    def __init__(self, x: X, name: str):
        self.x, self.name = x, name


class When(X):
    __slots__ = ("cases",)

    def __init__(self, cases):
        self.cases = cases
        super().__init__("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " END")

    def when(self, c, v):
        return When([*self.cases, (c, lit(v))])

    def otherwise(self, v):
        return X("CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in self.cases) + f" ELSE {lit(v)} END")


def when(c, v) -> When:
    return When([(c, lit(v))])


def struct(*fields: Named) -> X:
    return X("named_struct(" + ", ".join(f"'{f.name}', {f.x}" for f in fields) + ")")


def array(*xs) -> X:
    return X(f"array({', '.join(str(lit(x)) for x in xs)})")


def _lambda(fn) -> str:
    names = [f"v{next(_fresh)}" for _ in inspect.signature(fn).parameters]
    body = lit(fn(*map(X, names)))
    return (f"({', '.join(names)})" if len(names) > 1 else names[0]) + f" -> {body}"


def transform(a, fn) -> X:
    return X(f"transform({a}, {_lambda(fn)})")


def filter(a, fn) -> X:  # noqa: A001
    return X(f"filter({a}, {_lambda(fn)})")


def exists(a, fn) -> X:
    return X(f"exists({a}, {_lambda(fn)})")


def zip_with(a, b, fn) -> X:
    return X(f"zip_with({a}, {b}, {_lambda(fn)})")


def aggregate(a, start, merge, finish=None) -> X:
    return X(f"aggregate({a}, {lit(start)}, {_lambda(merge)}{', ' + _lambda(finish) if finish else ''})")


def substring(a, pos, n) -> X:
    return X(f"substring({a}, {lit(pos)}, {lit(n)})")


def substr(a, pos, n=None) -> X:
    return X(f"substring({a}, {lit(pos)}{'' if n is None else f', {lit(n)}'})")


def _plain(name):
    return lambda *xs: X(f"{name}({', '.join(str(lit(x)) for x in xs)})")


ascii, upper, lower, char_length, translate, regexp_replace, lpad, coalesce, split, regexp_extract_all = map(_plain, "ascii upper lower char_length translate regexp_replace lpad coalesce split regexp_extract_all".split())  # noqa: A001
get, concat, slice, size, array_append, array_sort, flatten, sequence, greatest, least, pmod, create_map, instr, raise_error = map(_plain, "get concat slice size array_append array_sort flatten sequence greatest least pmod map instr raise_error".split())  # noqa: A001
trim, encode, decode, unhex, sha2, array_join, array_distinct, array_position, repeat, concat_ws, array_compact, array_contains, floor, mod = map(_plain, "trim encode decode unhex sha2 array_join array_distinct array_position repeat concat_ws array_compact array_contains floor mod".split())
