"""Selections written as text, such as ``protein and not (name CA or around 3.5 resname HOH)``.

A text becomes Columns: predicates on one atom are the Columns of ``selection``; those on other atoms (around, same,
byres, bonded, group) become a flag that a left join on ``atom_index`` brings in. So ``and``, ``or`` and ``not`` join
both kinds freely, and Catalyst plans the whole.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.operators import selection as S

_START, _INNER = r"A-Za-z0-9_*?.+/\[", r"#@%\]!"
_WORD = f"[{_START}{_INNER}-]"
_TOKEN = re.compile(
    rf"""\s*(?:(?P<mark>[():-])|(?P<op>[<>=!]=?)|\\(?P<escaped>.{_WORD}*)
    |'(?P<single>(?:\\.|[^'\\])*)'|"(?P<double>(?:\\.|[^"\\])*)"
    |(?P<odd>\d+(?![\deE.])[{_START}{_INNER}]+)|(?P<number>(?:\d|\.(?=\d))(?:[eE][+-]?|[\d.])*)
    |(?P<word>[{_START}]{_WORD}*))""",
    re.X | re.S,
)
_PLAIN = {"all": lambda: F.lit(True), "none": lambda: F.lit(False), "protein": S.protein, "backbone": S.backbone, "water": S.water, "nucleic": S.nucleic, "nucleicbackbone": S.nucleic_backbone, "nucleicbase": S.nucleic_base, "nucleicsugar": S.nucleic_sugar}
_LABELS = {"name": "name", "resname": "resname", "element": "element", "chainid": "chain_id", "segid": "segid", "type": "atom_type"}
_NUMBERS = {"resid": ("resid", 0), "resnum": ("resid", 0), "index": ("atom_index", 0), "bynum": ("atom_index", 1)}
_SAME = {k: k for k in ("x", "y", "z", "resid", "residue", "resname", "name", "element", "segid", "mass", "charge")} | {"resnum": "resid", "type": "atom_type", "segment": "segid"}
_KEYWORDS = {*_PLAIN, *_LABELS, *_NUMBERS, "and", "or", "not", "global", "byres", "bonded", "group", "prop", "around", "point", "same", "atom", "as"}


class SelectionError(ValueError):
    """A text that is no selection, or one that names a group which was not given."""


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) pairs; kinds are mark, op, quoted, number and word."""
    found, at = [], 0
    while text[at:].strip():
        if not (m := _TOKEN.match(text, at)):
            raise SelectionError(f"unexpected character at {at} of {text!r}")
        kind, value, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind in ("single", "double"):
            value = re.sub(r"\\(.)", r"\1", value, flags=re.S)
        found.append(({"single": "quoted", "double": "quoted", "escaped": "quoted", "odd": "word"}.get(kind, kind), value))
    return found


class _Reader:
    """Recursive descent over the tokens; nodes are tuples of a kind and its parts."""

    def __init__(self, text: str):
        self.text, self.left = text, tokens(text)[::-1]
        if not self.left:
            raise SelectionError("empty selection")

    def error(self, wanted: str) -> SelectionError:
        return SelectionError(f"expected {wanted} {'before ' + repr(self.left[-1][1]) if self.left else 'at the end'} in {self.text!r}")

    def word(self, *wanted: str) -> bool:
        """Take the next token if it is one of these words."""
        hit = bool(self.left) and self.left[-1][0] == "word" and self.left[-1][1].lower() in wanted
        if hit:
            self.left.pop()
        return hit

    def mark(self, *wanted: str) -> bool:
        hit = bool(self.left) and self.left[-1][0] == "mark" and self.left[-1][1] in wanted
        if hit:
            self.left.pop()
        return hit

    def either(self) -> tuple:
        node = self.both()
        while self.word("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.one()
        while self.word("and"):
            node = ("and", node, self.one())
        return node

    def one(self) -> tuple:
        if self.word("not"):
            return ("not", self.one())
        if self.mark("("):
            node = self.either()
            if not self.mark(")"):
                raise self.error("a closing parenthesis")
            return node
        if not self.left or self.left[-1][0] != "word":
            raise self.error("a predicate")
        name = self.left.pop()[1].lower()
        if name in _PLAIN:
            return ("column", _PLAIN[name]())
        if name in _LABELS:
            return ("column", S.matches(_LABELS[name], *self.values()))
        if name in _NUMBERS:
            column, offset = _NUMBERS[name]
            return ("column", S.within(column, *self.ranges(signed=column == "resid"), offset=offset))
        if name in ("global", "byres", "bonded"):
            return (name, self.one())
        if name == "group":
            return ("group", self.value())
        if name == "prop":
            absolute = self.word("abs")
            axis = self.value().lower()
            if axis not in ("x", "y", "z") or not self.left or self.left[-1][0] != "op" or self.left[-1][1] in ("=", "!"):
                raise self.error("an axis and a comparison")
            return ("column", S.compare(axis, self.left.pop()[1], self.number(), absolute))
        if name == "around":
            return ("around", self.number(), self.one())
        if name == "point":
            return ("column", S.point(*(self.number() for _ in range(4))))
        if name == "same":
            attribute = self.value().lower()
            if attribute not in _SAME or not self.word("as"):
                raise self.error("an attribute and 'as'")
            return ("same", _SAME[attribute], self.either())
        if name == "atom":
            return ("column", S.atom(self.value(), self.integer(), self.value()))
        raise SelectionError(f"unknown predicate {name!r} in {self.text!r}")

    def value(self) -> str:
        if not self.left or self.left[-1][0] in ("mark", "op"):
            raise self.error("a value")
        return self.left.pop()[1]

    def values(self) -> list[str]:
        found = []
        while self.left and self.left[-1][0] in ("word", "quoted", "number") and not (self.left[-1][0] == "word" and self.left[-1][1].lower() in _KEYWORDS):
            found.append(self.value())
        if not found:
            raise self.error("a value")
        return found

    def number(self) -> float:
        sign = -1.0 if self.mark("-") else 1.0
        if not self.left or self.left[-1][0] != "number":
            raise self.error("a number")
        try:
            return sign * float(self.left.pop()[1])
        except ValueError as bad:
            raise self.error("a number") from bad

    def integer(self) -> int:
        if not float(x := self.number()).is_integer():
            raise self.error("a whole number")
        return int(x)

    def ranges(self, signed: bool) -> list[tuple[int, int]]:
        found = []
        while self.left and (self.left[-1][0] == "number" or self.left[-1] == ("mark", "-")):
            low = self.integer()
            high = self.integer() if self.mark(":", "-") or self.word("to") else low
            if low > high or (low < 0 and not signed):
                raise SelectionError(f"bad range {low}:{high} in {self.text!r}")
            found.append((low, high))
        if not found:
            raise self.error("a number")
        return found


def parse(text: str) -> tuple:
    """The tree of a selection; a text that is none raises ``SelectionError``."""
    reader = _Reader(text)
    node = reader.either()
    if reader.left:
        raise reader.error("the end")
    return node


def _parts(node: tuple) -> list[tuple]:
    return [x for x in node[1:] if isinstance(x, tuple)]


def _has(node: tuple, kind: str) -> bool:
    return node[0] == kind or any(_has(x, kind) for x in _parts(node))


def _groups(node: tuple) -> set[str]:
    return {node[1]} if node[0] == "group" else set().union(*map(_groups, _parts(node)))


@dataclass
class _Scope:
    atoms: DataFrame
    everything: DataFrame
    bonds: DataFrame | None
    groups: Mapping[str, DataFrame]
    by: tuple[str, ...]
    numbers: count = field(default_factory=count)


def _flag(node: tuple, rows: DataFrame, scope: _Scope) -> tuple[DataFrame, Column]:
    """rows with the flags that a node needs, and the Column that says which of them it takes."""
    kind = node[0]
    if kind == "column":
        return rows, F.coalesce(node[1], F.lit(False))  # nulls never match
    if kind == "global":
        return _flag(node[1], rows, scope)
    if kind == "not":
        rows, inner = _flag(node[1], rows, scope)
        return rows, ~inner
    if kind in ("and", "or"):
        rows, a = _flag(node[1], rows, scope)
        rows, b = _flag(node[2], rows, scope)
        return rows, (a & b if kind == "and" else a | b)
    if kind == "group":
        hit = scope.groups[node[1]]
    elif kind == "bonded":
        others, inner = _flag(node[1], scope.atoms, scope)
        hit = rows.where(F.lit(False)).select(*scope.by, "atom_index") if scope.bonds is None else S.bonded(rows, scope.bonds, inner, others, scope.by)
    elif kind in ("same", "byres"):
        others, inner = _flag(node[-1], scope.atoms, scope)
        hit = S.same(rows, node[1] if kind == "same" else "residue", inner, others, scope.by)
    else:
        others, inner = _flag(node[2], scope.everything if _has(node[2], "global") else scope.atoms, scope)
        outside, own = _flag(node[2], rows, scope)
        hit = S.around(outside.where(~own), node[1], inner, others, scope.by)
    name = f"_hit{next(scope.numbers)}"
    keys = [k for k in (*scope.by, "atom_index") if k in hit.columns]  # a group may hold for all frames
    marks = hit.select(*(F.col(k).alias(f"{name}_{k}") for k in keys)).distinct().withColumn(name, F.lit(True))
    met = rows.join(marks, [rows[k] == marks[f"{name}_{k}"] for k in keys], "left")
    return met.drop(*(f"{name}_{k}" for k in keys)), F.coalesce(F.col(name), F.lit(False))


def select(atoms: DataFrame, text: str, bonds: DataFrame | None = None, groups: Mapping[str, DataFrame] | None = None, everything: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The atoms that a text selects, with their columns.

    ``atoms`` holds the columns that the text asks for, and atom_index once in each frame of ``by``. ``groups``: tables of atom_index by
    name; a name that is missing is an error before anything runs. ``everything``: the atoms that ``global`` means;
    at the root of a text it selects among these. Null values never match, so ``not`` takes them; without bonds
    nothing is bonded; an empty table gives an empty result.
    """
    node, groups = parse(text), groups or {}
    if missing := _groups(node) - set(groups):
        raise SelectionError(f"unknown group {sorted(missing)[0]!r}")
    rows = everything if node[0] == "global" and everything is not None else atoms
    marked, chosen = _flag(node, rows, _Scope(rows, everything if everything is not None else rows, bonds, groups, by))
    return marked.where(chosen).select(rows.columns)
