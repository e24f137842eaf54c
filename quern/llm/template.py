"""A small sandboxed template language for chat formats, compiled to Python closures.

    {% for m in messages %}...{% endfor %}      m.role, m.text; loop.index, loop.first, loop.last
    {% if x %}...{% elif y %}...{% else %}...{% endif %}
    {% generation %}...{% endgeneration %}      text that the model is to learn
    {{ expression }}    {# comment #}

Expressions have strings, integers, names, dotted fields, + == != and or not in,
parentheses and filters (| escape, trim, upper, lower). There are no calls, no
subscripts and no Python attributes: a name or field that the caller didn't
provide is an error when the template is compiled or rendered.

parse() gives a syntax tree, fold() computes what is constant in it, and
compile_template() turns the tree into nested closures. Rendering is a generator
of (text, is_generation) that reads messages one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_SYMBOL = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[+|.()]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template is not in the language, or asks for what isn't there."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _symbols(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _SYMBOL.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        number, string, name, sign = m.groups()
        if number:
            out.append(("const", int(number)))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
        elif name in ("and", "or", "not", "in", "true", "false"):
            out.append(("const", name == "true") if name in ("true", "false") else ("sign", name))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent; lowest first: or, and, not, comparison, +, filter, field."""

    def __init__(self, source: str):
        self.source, self.symbols, self.at = source, _symbols(source), 0

    def whole(self) -> Any:
        out = self.either("or", lambda: self.either("and", self.negation))
        if self.at < len(self.symbols):
            raise TemplateError(f"more than an expression: {self.source!r}")
        return out

    def next_is(self, *signs: str) -> str | None:
        if self.at < len(self.symbols) and self.symbols[self.at][0] == "sign" and self.symbols[self.at][1] in signs:
            self.at += 1
            return self.symbols[self.at - 1][1]
        return None

    def either(self, sign: str, part: Callable) -> Any:
        out = part()
        while self.next_is(sign):
            out = Op(sign, (out, part()))
        return out

    def negation(self) -> Any:
        return Op("not", (self.negation(),)) if self.next_is("not") else self.comparison()

    def comparison(self) -> Any:
        out = self.sum()
        while sign := self.next_is("==", "!=", "in"):
            out = Op(sign, (out, self.sum()))
        return out

    def sum(self) -> Any:
        return self.either("+", self.filtered)

    def filtered(self) -> Any:
        out = self.field()
        while self.next_is("|"):
            out = Filter(out, self.word())
        return out

    def field(self) -> Any:
        out = self.atom()
        while self.next_is("."):
            out = Field(out, self.word())
        return out

    def word(self) -> str:
        if self.at >= len(self.symbols) or self.symbols[self.at][0] != "name":
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return self.symbols[self.at - 1][1]

    def atom(self) -> Any:
        if self.next_is("("):
            out = self.either("or", lambda: self.either("and", self.negation))
            if not self.next_is(")"):
                raise TemplateError(f"a bracket is open in {self.source!r}")
            return out
        if self.at < len(self.symbols) and self.symbols[self.at][0] == "const":
            self.at += 1
            return Const(self.symbols[self.at - 1][1])
        return Name(self.word())


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of Text, Emit, If, For and Generation."""
    parts, at = [], 0
    for m in _PART.finditer(source):
        parts.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            parts.append(("emit", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
    parts.append(("text", source[at:]))
    body, rest = _body(parts, 0, ())
    if rest < len(parts):
        raise TemplateError(f"{parts[rest][1]} without its beginning")
    return body


def _body(parts: list, at: int, ends: tuple) -> tuple[tuple, int]:
    """Nodes up to a tag whose first word is in `ends`, or the end; where that is."""
    out = []
    while at < len(parts):
        kind, value = parts[at]
        word, _, rest = value.partition(" ") if kind == "tag" else ("", "", "")
        if kind == "text":
            out += [Text(value)] if value else []
        elif kind == "emit":
            out.append(Emit(_Expression(value).whole()))
        elif word in ends:
            return tuple(out), at
        elif word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"can't read {value!r}")
            body, at = _body(parts, at + 1, ("endfor",))
            out.append(For(m[1], _Expression(m[2]).whole(), body))
        elif word == "generation":
            body, at = _body(parts, at + 1, ("endgeneration",))
            out.append(Generation(body))
        elif word == "if":
            cases, other = [], ()
            while word in ("if", "elif"):
                condition = _Expression(rest).whole()
                body, at = _body(parts, at + 1, ("elif", "else", "endif"))
                cases.append((condition, body))
                word, _, rest = parts[at][1].partition(" ") if at < len(parts) else ("", "", "")
            if word == "else":
                other, at = _body(parts, at + 1, ("endif",))
            out.append(If(tuple(cases), other))
        else:
            return tuple(out), at
        at += 1
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return tuple(out), at


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def _fold_expression(x: Any, filters: dict[str, Callable]) -> Any:
    if isinstance(x, Field):
        return replace(x, of=_fold_expression(x.of, filters))
    if isinstance(x, Filter):
        of = _fold_expression(x.of, filters)
        if x.name not in filters:
            raise TemplateError(f"no filter {x.name!r}")
        return Const(filters[x.name](of.value)) if isinstance(of, Const) else Filter(of, x.name)
    if isinstance(x, Op):
        args = tuple(_fold_expression(a, filters) for a in x.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_OPS[x.sign](*(a.value for a in args)))
        if x.sign in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (x.sign == "and") else args[0]
        return Op(x.sign, args)
    return x


def fold(body: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant expressions computed, dead branches gone and neighbouring texts joined."""
    out: list = []
    for node in body:
        new: tuple = (node,)
        if isinstance(node, Emit):
            value = _fold_expression(node.value, filters)
            new = (Text(str(value.value)),) if isinstance(value, Const) else (Emit(value),)
        elif isinstance(node, For):
            new = (replace(node, over=_fold_expression(node.over, filters), body=fold(node.body, filters)),)
        elif isinstance(node, Generation):
            new = (Generation(fold(node.body, filters)),)
        elif isinstance(node, If):
            cases, other = [], fold(node.other, filters)
            for condition, inner in node.cases:
                condition, inner = _fold_expression(condition, filters), fold(inner, filters)
                if not isinstance(condition, Const):
                    cases.append((condition, inner))
                elif condition.value:
                    other = inner
                    break
            new = (If(tuple(cases), other),) if cases else other
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return tuple(out)


def _value(x: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(x, Const):
        return lambda env, v=x.value: v
    if isinstance(x, Name):

        def name(env: dict, key: str = x.name) -> Any:
            if key not in env:
                raise TemplateError(f"no name {key!r}")
            return env[key]

        return name
    if isinstance(x, Field):
        of = _value(x.of, filters)

        def field(env: dict, key: str = x.name) -> Any:
            whole = of(env)
            if not isinstance(whole, dict) or key not in whole:
                raise TemplateError(f"no field {key!r}")
            return whole[key]

        return field
    if isinstance(x, Filter):
        of, f = _value(x.of, filters), filters[x.name]
        return lambda env: f(of(env))
    args = [_value(a, filters) for a in x.args]
    if x.sign == "and":
        return lambda env: args[0](env) and args[1](env)
    if x.sign == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _OPS[x.sign]
    return lambda env: f(*(a(env) for a in args))


Piece = tuple[str, bool]


def _render(body: tuple, filters: dict[str, Callable], learn: bool) -> Callable[[dict], Iterator[Piece]]:
    return_all = [_node(x, filters, learn) for x in body]

    def run(env: dict) -> Iterator[Piece]:
        for f in return_all:
            yield from f(env)

    return run


def _node(x: Any, filters: dict[str, Callable], learn: bool) -> Callable[[dict], Iterable[Piece]]:
    if isinstance(x, Text):
        piece = ((x.text, learn),)
        return lambda env: piece
    if isinstance(x, Emit):
        value = _value(x.value, filters)
        return lambda env: ((str(value(env)), learn),)
    if isinstance(x, Generation):
        return _render(x.body, filters, True)
    if isinstance(x, If):
        cases = [(_value(c, filters), _render(b, filters, learn)) for c, b in x.cases]
        other = _render(x.other, filters, learn)

        def choose(env: dict) -> Iterable[Piece]:
            return next((b for c, b in cases if c(env)), other)(env)

        return choose
    over, body = _value(x.over, filters), _render(x.body, filters, learn)

    def loop(env: dict) -> Iterator[Piece]:
        items, none = iter(over(env)), object()
        now, index = next(items, none), 1
        while now is not none:
            after = next(items, none)
            yield from body(env | {x.name: now, "loop": {"index": index, "first": index == 1, "last": after is none}})
            now, index = after, index + 1

    return loop


def _reads(x: Any) -> int:
    """How often a run may read the messages at most; a read within a loop counts twice."""
    if isinstance(x, tuple):
        return sum(map(_reads, x))
    if isinstance(x, Name):
        return int(x.name == "messages")
    if isinstance(x, Op):
        return _reads(x.args)
    if isinstance(x, Field | Filter):
        return _reads(x.of)
    if isinstance(x, Emit):
        return _reads(x.value)
    if isinstance(x, Generation):
        return _reads(x.body)
    if isinstance(x, For):
        return _reads(x.over) + 2 * _reads(x.body)
    if isinstance(x, If):
        return sum(_reads(c) for c, _ in x.cases) + max(_reads(b) for b in (*(b for _, b in x.cases), x.other))
    return 0


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function of messages (dicts; any iterable, read once) that yields pieces of the output.
    A template that may read the messages a second time, when none are left, is refused."""
    filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower} | (filters or {})
    tree = fold(parse(source), filters)
    if _reads(tree) > 1:
        raise TemplateError("the messages are a stream: they can be read once")
    run = _render(tree, filters, False)
    return lambda messages: run({"messages": messages})
