"""Syntax tree of a query, and its printed form."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from decimal import Decimal
from math import isinf, isnan


@dataclass(frozen=True)
class Node:
    pass


def number_text(v: float) -> str:
    if isnan(v):
        return "NaN"
    if isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    return format(Decimal(repr(float(v))), "f").removesuffix(".0")


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _ms(ms: int) -> str:
    return f"{ms // 1000}s" if ms % 1000 == 0 else f"{ms}ms"


@dataclass(frozen=True)
class Number(Node):
    value: float

    def __str__(self) -> str:
        return number_text(self.value)


@dataclass(frozen=True)
class String(Node):
    value: str

    def __str__(self) -> str:
        return _quoted(self.value)


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str
    value: str

    def __str__(self) -> str:
        return f"{self.label}{self.op}{_quoted(self.value)}"


@dataclass(frozen=True)
class Shift:
    """``offset`` in ms, and ``@`` as ms, 'start' or 'end'."""

    offset: int = 0
    at: int | str | None = None

    def __str__(self) -> str:
        at = "" if self.at is None else f" @ {self.at}()" if isinstance(self.at, str) else f" @ {self.at / 1000:.3f}"
        off = "" if not self.offset else f" offset {'-' * (self.offset < 0)}{_ms(abs(self.offset))}"
        return at + off


@dataclass(frozen=True)
class Selector(Node):
    matchers: tuple[Matcher, ...]
    shift: Shift = Shift()
    range: int | None = None

    @property
    def name(self) -> str | None:
        return next((m.value for m in self.matchers if m.label == "__name__" and m.op == "="), None)

    def __str__(self) -> str:
        rest = [m for m in self.matchers if not (m.label == "__name__" and m.op == "=")]
        body = (self.name or "") + ("{" + ",".join(map(str, rest)) + "}" if rest or not self.name else "")
        return body + (f"[{_ms(self.range)}]" if self.range is not None else "") + str(self.shift)


@dataclass(frozen=True)
class Subquery(Node):
    expr: Node
    range: int
    step: int | None
    shift: Shift = Shift()

    def __str__(self) -> str:
        return f"({self.expr})[{_ms(self.range)}:{_ms(self.step) if self.step else ''}]{self.shift}"


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Aggregate(Node):
    op: str
    expr: Node
    param: Node | None = None
    labels: tuple[str, ...] = ()
    without: bool = False
    grouped: bool = False

    def __str__(self) -> str:
        by = f" {'without' if self.without else 'by'} ({', '.join(self.labels)}) " if self.grouped else ""
        inner = f"{self.param}, {self.expr}" if self.param is not None else str(self.expr)
        return f"{self.op}{by}({inner})"


@dataclass(frozen=True)
class Matching:
    """Which labels match, which side is the many side, and fills; ``on`` None means all labels."""

    labels: tuple[str, ...] = ()
    on: bool = False
    given: bool = False
    card: str = "one-to-one"
    include: tuple[str, ...] = ()
    fill_left: float | None = None
    fill_right: float | None = None

    def __str__(self) -> str:
        out = f" {'on' if self.on else 'ignoring'} ({', '.join(self.labels)})" if self.given else ""
        if self.card in ("many-to-one", "one-to-many"):
            out += f" group_{'left' if self.card == 'many-to-one' else 'right'} ({', '.join(self.include)})"
        if self.fill_left is not None:
            out += f" fill_left ({number_text(self.fill_left)})"
        if self.fill_right is not None:
            out += f" fill_right ({number_text(self.fill_right)})"
        return out


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    bool_: bool = False
    matching: Matching = field(default_factory=Matching)

    def __str__(self) -> str:
        return f"({self.left}) {self.op}{' bool' * self.bool_}{self.matching} ({self.right})"


@dataclass(frozen=True)
class Negative(Node):
    expr: Node

    def __str__(self) -> str:
        return f"-({self.expr})"


def tree(node) -> dict | list | str | float | None:
    """The tree as plain values, for JSON."""
    if is_dataclass(node):
        return {"type": type(node).__name__.lower()} | {f.name: tree(getattr(node, f.name)) for f in fields(node)}
    return [tree(x) for x in node] if isinstance(node, tuple) else node
