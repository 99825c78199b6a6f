"""find(): candidates, context, evasion and embedded passes, overlap resolution; one row's expression, no shuffle.

The JVM picks the texts that can hold an identifier at all (one scan for
digits); only these go, in Arrow batches, to a scanner that works on a whole
batch at a time: every pattern runs once over the joined texts, check digits
are column sums over all candidates of an entity, and only candidates that
pass are looked at one by one. As SQL expressions the same passes took about
200 times as long: each span became a walk over its text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as SF

from velum.functions import checks
from velum.functions import sqlx as F
from velum.functions.sqlx import X
from velum.functions.text import FOLDS, INVISIBLE, OTHER_DIGITS, SWAPS
from velum.operators.registry import TIERS, Entity
from velum.operators.registry import entities as registered

MATCH = "struct<entity:string,start:int,end:int,value:string,score:double,tier:string,pattern:string,has_context:boolean,valid_dv:boolean>"
MATCHES = f"array<{MATCH}>"
FIELDS = ("entity", "start", "end", "value", "score", "tier", "pattern", "has_context", "valid_dv")
_ARROW = pa.struct([("entity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64()), ("tier", pa.string()), ("pattern", pa.string()), ("has_context", pa.bool_()), ("valid_dv", pa.bool_())])
SUSPECT_FROM, MAX_CHARS = 0.5, 5_000_000
MIN_RUN, RUN_CAP, AFTER_REACH = 9, 64, 40
#: How many plain digits the patterns of the entities with a check digit accept.
DIGITS = {
    "BR_CPF": (("cpf_compact", 11), ("cpf_irregular_punctuation", 11)), "BR_CNPJ": (("cnpj_compact", 14),), "BR_CNS": (("cns_compact", 15),), "BR_NIS": (("nis_compact", 11),), "BR_CNJ": (("cnj_compact", 20),),
    "BR_TITULO_ELEITOR": (("titulo_spaced", 12),), "BR_CNH": (("cnh_compact", 11),), "BR_RENAVAM": (("renavam_11", 11), ("renavam_9", 9)), "BR_CNM": (("cnm_compact", 16),), "BR_CIB": (("cib", 8),),
    "BR_CARTAO": (("cartao_16", 16), ("cartao_amex", 15), ("cartao_compact", 13)),
}
_SWAP, _FOLD = ({ord(a): b for a, b in t.items()} for t in (SWAPS, FOLDS))


def _ranges(chars: str) -> str:
    """The characters as ranges of a class, in Java's and Python's notation alike."""
    out, codes = "", sorted(map(ord, chars))
    begin = codes[0]
    for a, b in zip(codes, [*codes[1:], -1]):
        if b != a + 1:
            out, begin = out + (chr(begin) if begin == a else f"{chr(begin)}-{chr(a)}"), b
    return out


_ANY_DIGIT = f"[0-9{_ranges(OTHER_DIGITS)}]"
_DIGIT = re.compile(_ANY_DIGIT)
_RUN = re.compile(f"(?<![0-9])[0-9]{{{MIN_RUN},}}(?![0-9])")
_HIDDEN = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), INVISIBLE)
_INVISIBLE = regex.compile(_HIDDEN)
_NEAR = regex.compile(f"(?s){_ANY_DIGIT}.?{_HIDDEN}|{_HIDDEN}.?{_ANY_DIGIT}")
#: What a text without digits must hold for an entity that can do without them.
_WORDS_ONLY = re.compile("cib|cadastro imobiliario")


def spans(text: X, pattern: str) -> X:
    """array<struct<start, end>> of a pattern's matches, in code points; null text: empty."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)

    def add(a, x):
        start = a["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["h"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    walked = F.aggregate(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))), F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda a: a["out"])
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _folded(text: str) -> str:
    """fold() of a text; of ASCII only capitals change."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def _alternation(words: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


class _Context:
    """Does one of an entity's words stand near a span?"""

    def __init__(self, spec: Entity):
        self.adjacent = bool(spec.before or spec.after)
        self.reach = max(map(len, spec.before), default=0) + spec.gap + 3 if self.adjacent else spec.window
        if self.adjacent:
            self.before = re.compile(rf"(?<![0-9a-z]){_alternation(spec.before)}[^0-9a-z]{{0,{spec.gap}}}(?:o[^0-9a-z]{{1,2}})?\Z" if spec.before else r"(?!)")
            self.after = re.compile(rf"[^0-9a-z]{{0,{spec.gap}}}(?:[a-z]{{1,3}}[^0-9a-z]{{1,2}})?{_alternation(spec.after)}(?![0-9a-z])" if spec.after else r"(?!)")
        else:
            self.words = re.compile(rf"(?<![0-9a-z]){_alternation(spec.words)}(?![0-9a-z])" if spec.words else r"(?!)")
            self.anywhere = re.compile(_alternation(spec.words) if spec.words else r"(?!)")

    def near(self, norm: str, start: int, end: int, first: int, last: int) -> bool:
        """norm[first:last] is the text that the span is in."""
        left = norm[max(first, start - self.reach) : start]
        right = norm[end : min(last, end + (AFTER_REACH if self.adjacent else self.reach))]
        left, right = _folded(left), _folded(right)
        if self.adjacent:
            return bool(self.before.search(left) or self.after.match(right))
        return bool(self.words.search(f"{left} {right}"))


@dataclass
class _Found:
    spec: Entity
    start: int  # in the text
    end: int
    pattern: str
    context: bool
    valid: bool
    value: str = ""

    @property
    def score(self) -> float:
        return 0.0 if not self.valid else self.spec.scores[0] if self.context else self.spec.scores[1]

    def row(self) -> tuple:
        return self.spec.id, self.start, self.end, self.value, self.score, self.spec.tier, self.pattern, self.context, self.valid


def _in_letters(norm: str, start: int, end: int) -> bool:
    """Does the token around a run of digits hold a letter?"""
    while start and norm[start - 1].isalnum():
        start -= 1
        if norm[start].isalpha():
            return True
    while end < len(norm) and norm[end].isalnum():
        if norm[end].isalpha():
            return True
        end += 1
    return False


def _clash(a: _Found, b: _Found) -> bool:
    return a.start < b.end and b.start < a.end


def _joined(norms: list[str]) -> tuple[str, list[int]]:
    """The texts, a NUL after each, as one; where each begins, and the end."""
    return "\0".join(norms) + "\0", [0, *np.cumsum([len(t) + 1 for t in norms]).tolist()]


class _Scanner:
    """The passes over a batch of texts, for the entities asked for; ``every``: all that can shield a span."""

    def __init__(self, specs: Sequence[Entity], every: Sequence[Entity], min_score: float, resolve: bool, report_invalid: bool):
        self.specs, self.every = list(specs), list(every)
        self.min_score, self.resolve, self.report_invalid = min_score, resolve, report_invalid
        self.patterns = {s.id: [(name, re.compile(p), base) for name, p, base in s.patterns] for s in (*specs, *every)}
        self.context = {s.id: _Context(s) for s in (*specs, *every)}
        self.place = {s.id: i for i, s in enumerate(self.specs)}

    def owned(self, spec: Entity, joined: str, begins: list[int]) -> dict[tuple[int, int], int]:
        """Every span that a pattern of the entity hits, with the first pattern that does."""
        out: dict[tuple[int, int], int] = {}
        for k, (_, pattern, _) in enumerate(self.patterns[spec.id]):
            if spec.built_in:  # none of these reaches over the NUL between texts
                hits = (m.span() for m in pattern.finditer(joined))
            else:
                hits = ((m.start() + a, m.end() + a) for a, b in zip(begins, begins[1:]) for m in pattern.finditer(joined[a : b - 1]))
            for span in hits:
                out.setdefault(span, k)
        return out

    def candidates(self, norms: list[str], specs: Iterable[Entity], report_invalid: bool) -> list[list[_Found]]:
        """For each text what its entities' patterns, check digits and contexts leave, in order of entity, pattern, place."""
        joined, begins = _joined(norms)
        out: list[list[_Found]] = [[] for _ in norms]
        for spec in specs:
            owned = self.owned(spec, joined, begins)
            if not owned:
                continue
            good = spec.check([joined[a:b] for a, b in owned])
            suspects = {k for k, (_, _, base) in enumerate(spec.patterns) if base >= SUSPECT_FROM} if report_invalid and spec.tier == "N1" else set()
            context, names = self.context[spec.id], [p[0] for p in spec.patterns]
            for ((start, end), k), ok in zip(owned.items(), good.tolist()):
                if not ok and k not in suspects:
                    continue
                i = bisect_right(begins, start) - 1
                near = context.near(joined, start, end, begins[i], begins[i + 1] - 1)
                if near or not ok or not spec.required:
                    out[i].append(_Found(spec, start - begins[i], end - begins[i], names[k], near, ok))
        return out

    def evaded(self, texts: list[str]) -> list[list[_Found]]:
        """For each text the matches that appear once invisible characters are taken out, placed in the original text."""
        out = self.candidates([_INVISIBLE.sub("", t).translate(_SWAP) for t in texts], self.specs, self.report_invalid) if texts else []
        for text, found in zip(texts, out):
            hidden = {m.start() for m in _INVISIBLE.finditer(text)} if found else ()
            at = [i for i in range(len(text)) if i not in hidden] if found else ()
            for m in found:
                m.start, m.end = at[m.start], at[m.end - 1] + 1
        return [[m for m in found if m.spec.tier == "N1" or m.context] for found in out]

    def embedded(self, norms: list[str], found: list[list[_Found]]) -> list[list[_Found]]:
        """Identifiers with a valid check digit and context inside a longer run of digits, in a token without letters."""
        own, out = [s for s in self.specs if s.id in DIGITS and s.built_in], [[] for _ in norms]
        runs = [(i, *m.span()) for i, norm in enumerate(norms) for m in _RUN.finditer(norm)] if own else []
        runs = [r for r in runs if not _in_letters(norms[r[0]], *r[1:])]
        if not runs:
            return out
        codes = checks.rows(["".join(norms[i][a:b] for i, a, b in runs)])[0]
        text_of, first, last = np.array(runs).T
        length = last - first
        at = np.cumsum(length) - length
        taken = {i: {(m.start, m.end) for m in found[i]} for i in set(text_of.tolist())}
        dug: list[tuple[int, _Found]] = []
        said: dict[tuple[int, str], bool] = {}
        folded: dict[int, str] = {}
        for spec in own:
            context = self.context[spec.id]
            for name, n in DIGITS[spec.id]:
                count = np.maximum(length - n + 1, 0)
                run = np.repeat(np.arange(len(runs)), count)
                step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
                near_end = (length[run] <= RUN_CAP) | (step < RUN_CAP) | (step >= length[run] - RUN_CAP)
                run, step = run[near_end], step[near_end]
                good = checks.valid_windows(spec.id, codes, at[run] + step, n)
                for i, a in zip(text_of[run[good]].tolist(), (first[run] + step)[good].tolist()):
                    if (i, spec.id) not in said:  # most texts don't hold any of its words
                        folded[i] = folded.get(i) or _folded(norms[i])
                        said[i, spec.id] = bool(context.anywhere.search(folded[i]))
                    if not said[i, spec.id] or (a, a + n) in taken[i] or not context.near(norms[i], a, a + n, 0, len(norms[i])):
                        continue
                    taken[i].add((a, a + n))
                    dug.append((i, _Found(spec, a, a + n, f"{name}_embedded", True, True)))
        whole = sorted({i for i, _ in dug})
        shields = dict(zip(whole, self.shields([norms[i] for i in whole])))
        for i, m in dug:
            if not any(x <= m.start and m.end <= y and y - x > m.end - m.start for x, y in shields[i]):
                out[i].append(m)
        return out

    def shields(self, norms: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the spans of complete values of any kind, which nothing is dug out of."""
        joined, begins = _joined(norms)
        out: list[list[tuple[int, int]]] = [[] for _ in norms]
        for spec in self.every if norms else ():
            spans = list(self.owned(spec, joined, begins))
            for (a, b), ok in zip(spans, spec.check([joined[a:b] for a, b in spans]).tolist() if spans else ()):
                if ok:
                    i = bisect_right(begins, a) - 1
                    if not spec.required or self.context[spec.id].near(joined, a, b, begins[i], begins[i + 1] - 1):
                        out[i].append((a - begins[i], b - begins[i]))
        return out

    def best(self, found: list[_Found], n_chars: int) -> list[_Found]:
        """The best of overlapping matches by tier, score, length, entity order, place, arrival."""
        covered = bytearray(n_chars)
        kept = []
        for m in sorted(found, key=lambda m: (TIERS.get(m.spec.tier, 9), -m.score, m.start - m.end, self.place[m.spec.id], m.start)):
            if 1 not in covered[m.start : m.end]:
                covered[m.start : m.end] = b"\1" * (m.end - m.start)
                kept.append(m)
        return kept

    def matches(self, texts: list[str]) -> list[list[_Found]]:
        """Of each text, in position order."""
        norms = [t if t.isascii() else t.translate(_SWAP) for t in texts]
        digits = [i for i, t in enumerate(texts) if _DIGIT.search(t)]
        # without digits: only for entities that can do without, where their words or an entity of the caller's may be
        bare = [s for s in self.specs if not s.needs_digit]
        rest = set(range(len(texts))) - set(digits) if bare else ()
        if all(s.built_in for s in bare):
            rest = [i for i in rest if _WORDS_ONLY.search(_folded(_INVISIBLE.sub("", norms[i])))]
        out: list[list[_Found]] = [[] for _ in texts]
        for which, specs in ((digits, self.specs), (sorted(rest), bare)):
            if not which:
                continue
            own = [norms[i] for i in which]
            plain = self.candidates(own, specs, self.report_invalid)
            hiding = [n for n, i in enumerate(which) if not texts[i].isascii() and _NEAR.search(texts[i])]
            for n, more in zip(hiding, self.evaded([texts[which[n]] for n in hiding])):
                plain[n] += more
            for i, found, more in zip(which, plain, self.embedded(own, plain)):
                text, found = texts[i], found + more
                by_place = lambda ms: sorted(ms, key=lambda m: (m.start, m.end))
                sure = [m for m in found if m.valid and m.score >= self.min_score]
                kept = by_place(self.best(sure, len(text)) if self.resolve else sure)
                if self.report_invalid:
                    free = [m for m in found if not m.valid and not any(_clash(m, k) for k in kept)]
                    kept = by_place(kept + self.best(free, len(text)))
                for m in kept:
                    m.value = text[m.start : m.end]
                out[i] = kept
        return out

    def column(self, texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        found = iter(self.matches([t for t in values if t is not None]))
        rows, ends = [], [0]
        for t in values:
            if t is not None:
                rows.extend(m.row() for m in next(found))
            ends.append(len(rows))
        columns = list(zip(*rows)) or [()] * len(FIELDS)
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], fields=list(_ARROW))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def check_score(score: float) -> None:
    if isinstance(score, bool) or not isinstance(score, (int, float)) or math.isnan(score) or not 0 <= score <= 1:
        raise ValueError(f"a score lies between 0 and 1: {score!r}")


def find_udf(entities: Iterable[str] | None = None, min_score: float = 0.0, resolve: bool = True, report_invalid: bool = False):
    """The scanner as an Arrow function of a text column, also for ``spark.udf.register``."""
    check_score(min_score)
    scanner = _Scanner(registered(entities), registered(), min_score, resolve, report_invalid)

    def scan(texts: pa.Array) -> pa.Array:
        return scanner.column(texts)

    # declared nondeterministic so that the optimizer neither copies the call nor moves it into other operators
    return SF.arrow_udf(scan, MATCHES).asNondeterministic()


def find_column(text: Column | str, entities: Iterable[str] | None = None, min_score: float = 0.0, resolve: bool = True, report_invalid: bool = False, max_chars: int | None = MAX_CHARS) -> Column:
    """array<match> of each text (null: null), from that row alone: it works on streams as on tables.

    Texts without a digit of any script are passed over unless an entity that
    is asked for can do without one.
    """
    check_score(min_score)
    text = SF.col(text) if isinstance(text, str) else text
    specs = registered(entities)
    possible = text.rlike(r"\p{N}")  # the scanner looks closer
    bare = [s for s in specs if not s.needs_digit]
    if bare:
        possible = possible | text.rlike(r"[^\x00-\x7f]|(?i:cib|cadastro imobiliario)") if all(s.built_in for s in bare) else SF.lit(True)
    if max_chars is not None:
        too_long = SF.raise_error(SF.concat(SF.lit("a text has "), SF.char_length(text).cast("string"), SF.lit(f" characters, over the limit of {max_chars}"))).cast("string")
        text_or_error = SF.when(SF.char_length(text) > max_chars, too_long).otherwise(text)
    else:
        text_or_error = text

    found = find_udf(entities, min_score, resolve, report_invalid)(SF.when(possible | (SF.char_length(text) > (max_chars or 1 << 31)), text_or_error))
    return SF.when(text.isNotNull(), found)


def find(df: DataFrame, text_col: str = "text", keep: Iterable[str] | None = None, **options) -> DataFrame:
    """One row for each match: the columns ``keep`` (all but the text if not given) and the match's fields."""
    kept = [c for c in df.columns if c != text_col] if keep is None else list(keep)
    arrays = with_matches(df, text_col, **options).select(*kept, SF.explode("__matches").alias("m"))
    return arrays.select(*(SF.col(c) for c in kept if c not in FIELDS), *(SF.col(f"m.{f}").alias(f) for f in FIELDS))


def with_matches(df: DataFrame, text_col: str = "text", matches_col: str = "__matches", **options) -> DataFrame:
    """``df`` with the matches of each text as an array."""
    return df.drop(matches_col).select("*", find_column(SF.col(text_col), **options).alias(matches_col))


__all__ = ["MATCHES", "find", "find_column", "find_udf", "spans", "with_matches"]
