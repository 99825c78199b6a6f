"""The catalog of identifiers: what each looks like, how it is checked, which words stand near it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

from velum.functions import checks
from velum.functions import sqlx as F
from velum.functions.sqlx import X

TIERS = {"N1": 1, "N2": 2, "N3": 3, "N4": 4}


@dataclass(frozen=True)
class Entity:
    id: str
    tier: str
    patterns: tuple[tuple[str, str, float], ...]  # name, regular expression (Python's), base score
    validator: Callable[[str], bool] | None  # built-in entities have their rule in functions.checks
    words: tuple[str, ...]
    window: int
    required: bool
    scores: tuple[float, float]  # with context, without
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    gap: int = 0
    needs_digit: bool = True
    built_in: bool = True

    def check(self, values: list[str]) -> np.ndarray:
        """Which of the values are valid; without a validator all are."""
        if self.built_in:
            return checks.valid(self.id, values)
        return np.array([self.validator is None or bool(self.validator(v)) for v in values], bool)


def _make(id, tier, window, required, scores, words, *patterns, **more) -> Entity:
    made = tuple((name, regex, base) for name, base, regex in patterns)
    return Entity(id, tier, made, None, tuple(sorted(words.split("|"))), window, required, scores, **more)


_C = "0-9A-HJKMNP-TV-Za-hjkmnp-tv-z"
_HEX = "[0-9a-fA-F]"
BUILT_IN = (
    _make("BR_CPF", "N1", 50, False, (0.95, 0.85), "portador do cpf|contribuinte|inscrito no cpf|cpf|cadastro de pessoas fisicas|cadastro de pessoa fisica",
          ("cpf_formatted", 0.5, r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"), ("cpf_compact", 0.1, r"\b\d{11}\b"), ("cpf_irregular_punctuation", 0.3, r"\b\d{3}(?:[\s.]?\d{3}){2}[\s\-./]?\d{2}\b")),
    _make("BR_CNPJ", "N1", 50, False, (0.95, 0.85), "empresa|pessoa juridica|inscrita sob o|inscrita no cnpj|cnpj|cadastro nacional da pessoa juridica",
          ("cnpj_formatted", 0.5, r"\b[0-9A-Za-z]{2}(?:\.[0-9A-Za-z]{3}){2}/[0-9A-Za-z]{4}-\d{2}\b"), ("cnpj_compact", 0.1, r"\b[0-9A-Za-z]{12}\d{2}\b"),
          ("cnpj_spaced", 0.3, r"\b[0-9A-Za-z]{2}(?:[\s.][0-9A-Za-z]{3}){2}[\s/][0-9A-Za-z]{4}[\s-]\d{2}\b")),
    _make("BR_CNS", "N1", 50, False, (0.95, 0.85), "sus|cns|cartao nacional de saude|cartao do sus|cartao sus", ("cns_formatted", 0.5, r"\b[12789]\d{2}(?:[\s.]\d{4}){3}\b"), ("cns_compact", 0.2, r"\b[12789]\d{14}\b")),
    _make("BR_NIS", "N1", 50, False, (0.95, 0.8), "numero de identificacao social|pis/pasep|nit|pasep|pis|nis",
          ("nis_formatted", 0.5, r"\b\d{3}\.\d{5}\.\d{2}-\d\b"), ("nis_compact", 0.1, r"\b\d{11}\b"), ("nis_spaced", 0.3, r"\b\d{3}[\s.]\d{5}[\s.]\d{2}[\s-]\d\b")),
    _make("BR_CNJ", "N1", 60, False, (0.95, 0.9), "recurso|acao|numero do processo|proc.|autos|processo",
          ("cnj_formatted", 0.6, r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b"), ("cnj_compact", 0.1, r"\b\d{20}\b"), ("cnj_spaced", 0.3, r"\b\d{7}[\s-]\d{2}[\s.]\d{4}[\s.]\d[\s.]\d{2}[\s.]\d{4}\b")),
    _make("BR_TITULO_ELEITOR", "N1", 60, False, (0.95, 0.8), "secao|zona|justica eleitoral|zona eleitoral|eleitora|eleitor|inscricao|inscricao eleitoral|titulo eleitoral|titulo de eleitor", ("titulo_spaced", 0.3, r"\b\d{4}(?:\s?\d{4}){2}\b")),
    _make("BR_CNH", "N1", 50, True, (0.95, 0.85), "registro da cnh|habilitacao|carteira nacional de habilitacao|carteira de habilitacao|cnh", ("cnh_compact", 0.1, r"\b\d{11}\b")),
    _make("BR_RENAVAM", "N1", 50, True, (0.95, 0.85), "codigo renavam|registro nacional de veiculos automotores|renavam", ("renavam_11", 0.1, r"\b\d{11}\b"), ("renavam_9", 0.1, r"\b\d{9}\b")),
    _make("BR_PLACA", "N2", 50, False, (0.7, 0.5), "automovel|moto|carro|veiculo|placa", ("placa_old", 0.4, r"\b[A-Z]{3}-?\d{4}\b"), ("placa_mercosur", 0.5, r"\b[A-Z]{3}\d[A-Z]\d{2}\b")),
    _make("BR_PIX_EVP", "N2", 50, True, (0.7, 0.5), "chave|chave aleatoria|chave pix|pix", ("pix_uuid", 0.3, rf"\b{_HEX}{{8}}-{_HEX}{{4}}-[1-5]{_HEX}{{3}}-[89abAB]{_HEX}{{3}}-{_HEX}{{12}}\b")),
    _make("BR_TELEFONE", "N2", 40, False, (0.7, 0.5), "ligar|fone|contato|whats|whatsapp|cel|celular|telefone|tel", ("telefone", 0.3, r"(?<![0-9+])(?:\+?55[\s-]?)?\(?\d{2}\)?[\s-]?9?\d{4}[\s-]?\d{4}(?![0-9])")),
    _make("BR_CEP", "N3", 30, True, (0.5, 0.3), "codigo de enderecamento postal|codigo postal|cep", ("cep", 0.2, r"\b\d{5}-?\d{3}\b")),
    _make("BR_CNM", "N1", 60, False, (0.95, 0.9), "imovel|registro de imoveis|matricula|codigo nacional de matricula|cnm",
          ("cnm_formatted", 0.6, r"\b\d{6}\.[23]\.\d{7}-?\d{2}\b"), ("cnm_compact", 0.1, r"\b\d{6}[23]\d{9}\b"), ("cnm_spaced", 0.3, r"\b\d{6}[\s.][23][\s.]\d{7}[\s-]\d{2}\b")),
    _make("BR_CIB", "N1", 50, True, (0.95, 0.9), "cadastro imobiliario|cadastro imobiliario brasileiro|cib", ("cib", 0.2, rf"\b[{_C}]{{7}}-?[{_C}]\b"), ("cib_spaced", 0.2, rf"\b[{_C}]{{7}}\s[{_C}]\b"), needs_digit=False),
    _make("BR_IPTU", "N3", 40, True, (0.5, 0.3), "cadastro municipal|sql|inscricao do imovel|indice cadastral|inscricao imobiliaria|iptu", ("iptu", 0.2, r"\b\d[\d.\-/]{4,24}\d\b")),
    _make("BR_MATRICULA_IMOVEL", "N3", 30, True, (0.4, 0.3), "cartorio de registro de imoveis|registro de imoveis|matricula no|matricula n|matricula imobiliaria|matricula do imovel",
          ("matricula_dotted", 0.2, r"\b\d{1,3}(?:\.\d{3}){1,2}\b"), ("matricula_plain", 0.1, r"\b\d{1,7}\b"),
          before=("matricula sob o n", "matricula no", "matricula n", "matricula imobiliaria", "matricula do imovel", "matricula"), after=("cri", "rgi", "cartorio de registro de imoveis", "registro de imoveis"), gap=4),
    _make("BR_CARTAO", "N1", 40, False, (0.95, 0.8), "final|amex|hipercard|elo|mastercard|visa|debito|credito|cartao",
          ("cartao_16", 0.5, r"\b\d{4}(?:[ -]?\d{4}){3}\b"), ("cartao_amex", 0.4, r"\b\d{4}[ -]?\d{6}[ -]?\d{5}\b"), ("cartao_compact", 0.1, r"\b\d{13,19}\b")),
)

_entities: dict[str, Entity] = {e.id: e for e in BUILT_IN}
_frozen = False

_VARIABLE = re.compile(r"(?<!\\)(?:[*+]|\{\d+,\d*\}|\?(?![:=!<]))")


class RegistryError(ValueError):
    """An entity that the catalog refuses."""


def entities(only: Iterable[str] | None = None) -> list[Entity]:
    """The registered entities in order, or those asked for in the order asked."""
    if only is None:
        return list(_entities.values())
    only = list(only)
    unknown = [e for e in only if e not in _entities]
    if unknown:
        raise ValueError(f"unknown entities: {unknown}")
    return [_entities[e] for e in only]


def check_regex(pattern: str) -> None:
    """Refuse shapes that can take exponential time: a variable repeat inside a repeat, or equal branches under one."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise RegistryError(f"not a regular expression: {pattern!r}: {e}") from e
    stack: list[int] = []
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            stack.append(i)
        elif c == ")" and stack:
            body, rest = re.sub(r"^\?(?:[:=!]|<[=!]|P?<\w+>)", "", pattern[stack.pop() + 1 : i]), pattern[i + 1 :]
            repeat = re.match(r"[*+]|\{(\d+)(,(\d*))?\}", rest)
            many = repeat and (repeat[0][0] in "*+" or repeat[2] is not None or int(repeat[1] or 0) >= 2)
            if many:
                bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", body)
                if repeat[0][0] in "*+" or repeat[2] is not None:
                    if _VARIABLE.search(bare):
                        raise RegistryError(f"a variable repeat inside a repeat: {pattern!r}")
                branches = bare.split("|")
                if len(set(branches)) < len(branches):
                    raise RegistryError(f"equal branches under a repeat: {pattern!r}")
        i += 1


def register_entity(id: str, patterns: Iterable[tuple[str, str, float]], tier: str = "N2", validator: Callable[[str], bool] | None = None, words: Iterable[str] = (), window: int = 50, required: bool | None = None, score_with_context: float = 0.7, score_without_context: float = 0.5, replace_existing: bool = False, unsafe_regex: bool = False, needs_digit: bool = False) -> Entity:
    """Add an entity. ``validator`` tells whether a value that a pattern has hit is a valid one; it runs in Arrow batches."""
    global _entities
    if _frozen:
        raise RegistryError("the registry is frozen")
    if not re.fullmatch(r"[A-Z][A-Z0-9_]{1,40}", id):
        raise RegistryError(f"an id is made of capitals, digits and _: {id!r}")
    known = _entities.get(id)
    if known and known.built_in:
        raise RegistryError(f"{id} is built in and stays as it is")
    if known and not replace_existing:
        raise RegistryError(f"{id} is there already")
    if tier not in TIERS:
        raise RegistryError(f"no tier {tier!r}")
    if tier == "N1" and validator is None:
        raise RegistryError("tier N1 means a check digit: give a validator")
    patterns = list(patterns)
    for s in (score_with_context, score_without_context, *(p[2] for p in patterns)):
        if not (isinstance(s, (int, float)) and not math.isnan(s) and 0 <= s <= 1):
            raise RegistryError(f"a score lies between 0 and 1: {s!r}")
    if not patterns:
        raise RegistryError("an entity has a pattern at least")
    needed = tier == "N3" if required is None else required
    words = tuple(w.lower() for w in words)
    if needed and not words:
        raise RegistryError("context is required but there are no words")
    if not unsafe_regex:
        for _, regex, _ in patterns:
            check_regex(regex)
    made = Entity(id, tier, tuple(patterns), validator, tuple(sorted(words)), window, needed, (score_with_context, score_without_context), needs_digit=needs_digit, built_in=False)
    _entities = _entities | {id: made}
    return made


def unregister_entity(id: str) -> None:
    global _entities
    if _frozen:
        raise RegistryError("the registry is frozen")
    if id not in _entities:
        raise RegistryError(f"no entity {id!r}")
    if _entities[id].built_in:
        raise RegistryError(f"{id} is built in and stays")
    _entities = {k: v for k, v in _entities.items() if k != id}


def freeze() -> None:
    global _frozen
    _frozen = True


def unfreeze() -> None:
    global _frozen
    _frozen = False


def is_frozen() -> bool:
    return _frozen


def confidence(entity: str, valid: X) -> X:
    """For external scorers: true = certain, false = drop, null = keep the pattern's own score."""
    spec = entities([entity])[0]
    sure = F.lit(True) if spec.tier == "N1" and not spec.required else F.lit(None).cast("boolean")
    return F.when(~valid, F.lit(False)).otherwise(sure)
