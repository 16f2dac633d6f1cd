"""A small template language for conversations, compiled to Python closures.

    text {{ expression }} {% for m in messages %} … {% endfor %} {% if e %} … {% elif e %} … {% else %} … {% endif %}
    {% set name = e %} {% generation %} … {% endgeneration %} {# comment #}; a "-" inside a mark takes the white space beside it

Expressions have literals, lists, names, a.name, a[i], the usual operators, "x if c else y" and filters ("e | name(arguments)").
A template sees what it is given and nothing else: fields are looked up in dicts and the loop alone, never on Python objects, there are
no calls but the listed filters, no loops but over given lists, and marks nest at most MAX_DEPTH deep. So a template ends, and its
time and output are bounded by the data's size to the power of its loops' depth.

`compile_template` parses to a tree, folds what is constant (operators and filters of literals, branches with a known condition, neighbouring
texts) and turns each node into a closure. Output under {% generation %} is reported as spans of code points.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

MAX_DEPTH = 16


class TemplateError(ValueError):
    """A template that can't be parsed, or a value that it can't use."""


# --- tree -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Filtered:
    name: str
    of: object
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class Set:
    name: str
    of: object


@dataclass(frozen=True)
class If:
    branches: tuple   # (condition, body); the last condition of an else is Const(True)


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing ----------------------------------------------------------------------------

MARK = re.compile(r"\{%-?(.*?)-?%\}|\{\{-?(.*?)-?\}\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
                   r"""|(?P<sign>==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
KEYWORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}


def _string(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), quoted[1:-1], flags=re.S)


class _Tokens:
    def __init__(self, source: str, filters):
        self.list, at, self.filters = [], 0, filters
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r} in {source!r}")
            self.list.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.source = 0, source

    def peek(self, *texts: str) -> bool:
        kind, text = self.list[self.at] if self.at < len(self.list) else ("end", "")
        return kind != "string" and text in texts

    def take(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.at += 1
            return self.list[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r} in {self.source!r}")

    def next(self) -> tuple[str, str]:
        if self.at == len(self.list):
            raise TemplateError(f"unexpected end of {self.source!r}")
        self.at += 1
        return self.list[self.at - 1]

    def name(self) -> str:
        kind, text = self.next()
        if kind != "name" or text in KEYWORDS:
            raise TemplateError(f"expected a name in {self.source!r}")
        return text

    def done(self) -> None:
        if self.at < len(self.list):
            raise TemplateError(f"unexpected {self.list[self.at][1]!r} in {self.source!r}")


#: Binary operators from the weakest to the strongest; comparisons stand between `not` and the sums.
COMPARE, SUM, PRODUCT = ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*", "%")


def _expression(t: _Tokens, depth: int = 0):
    if depth > MAX_DEPTH:
        raise TemplateError(f"expression nests too deep: {t.source!r}")
    value = _either(t, depth)
    if t.take("if"):
        test = _either(t, depth)
        value = Choice(test, value, _expression(t, depth + 1) if t.take("else") else Const(""))
    return value


def _either(t, depth):
    left = _both(t, depth)
    while t.take("or"):
        left = Binary("or", left, _both(t, depth))
    return left


def _both(t, depth):
    left = _negated(t, depth)
    while t.take("and"):
        left = Binary("and", left, _negated(t, depth))
    return left


def _negated(t, depth):
    times = 0
    while t.take("not"):
        times += 1
    value = _compared(t, depth)
    return value if not times else Unary("not", value if times % 2 else Unary("not", value))


def _compared(t, depth):
    left = _sum(t, depth)
    while True:
        if t.peek("not") and t.at + 1 < len(t.list) and t.list[t.at + 1] == ("name", "in"):
            t.at += 2
            left = Unary("not", Binary("in", left, _sum(t, depth)))
        elif op := t.take(*COMPARE):
            left = Binary(op, left, _sum(t, depth))
        else:
            return left


def _sum(t, depth):
    left = _product(t, depth)
    while op := t.take(*SUM):
        left = Binary(op, left, _product(t, depth))
    return left


def _product(t, depth):
    left = _signed(t, depth)
    while op := t.take(*PRODUCT):
        left = Binary(op, left, _signed(t, depth))
    return left


def _signed(t, depth):
    if t.take("-"):
        return Unary("-", _signed(t, depth + 1) if depth < MAX_DEPTH else _postfix(t, depth))
    return _postfix(t, depth)


def _postfix(t, depth):
    value = _atom(t, depth)
    while True:
        if t.take("."):
            value = Field(value, Const(t.name()))
        elif t.take("["):
            value = Field(value, _expression(t, depth + 1))
            t.need("]")
        elif t.take("|"):
            name, args = t.name(), ()
            if name not in t.filters:
                raise TemplateError(f"no filter {name!r}")
            if t.take("("):
                args = _items(t, ")", depth)
            value = Filtered(name, value, args)
        else:
            return value


def _items(t, end, depth) -> tuple:
    out = []
    while not t.take(end):
        out.append(_expression(t, depth + 1))
        if not t.peek(end):
            t.need(",")
    return tuple(out)


def _atom(t, depth):
    kind, text = t.next()
    if kind == "number":
        return Const(int(text))
    if kind == "string":
        return Const(_string(text))
    if kind == "name" and text in ("true", "false", "none"):
        return Const({"true": True, "false": False, "none": None}[text])
    if kind == "name" and text not in KEYWORDS:
        return Name(text)
    if text == "(":
        value = _expression(t, depth + 1)
        t.need(")")
        return value
    if text == "[":
        return ListOf(_items(t, "]", depth))
    raise TemplateError(f"unexpected {text!r} in {t.source!r}")


def _parts(source: str) -> list[tuple[str, str]]:
    """(kind, content) of texts, outputs and statements; comments are gone, "-" has taken the white space beside it."""
    out, at, strip = [], 0, False
    for m in [*MARK.finditer(source), None]:
        text = source[at:m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m and m[0][2] == "-":
            text = text.rstrip()
        if any(mark in text for mark in ("{%", "{{", "{#")):
            raise TemplateError(f"a mark isn't closed: {text[-40:]!r}")
        if text:
            out.append(("text", text))
        if m:
            if m[1] is not None or m[2] is not None:
                out.append(("statement", m[1]) if m[1] is not None else ("output", m[2]))
            at, strip = m.end(), len(m[0]) > 4 and m[0][-3] == "-"
    return out


def parse(source: str, filters: dict[str, Callable] | None = None) -> tuple:
    """The statements of a template, as a tree."""
    filters = filters or FILTERS
    parts, at = _parts(source), 0

    def body(ends: tuple[str, ...], depth: int):
        nonlocal at
        if depth > MAX_DEPTH:
            raise TemplateError("marks nest too deep")
        nodes = []
        while at < len(parts):
            kind, content = parts[at]
            at += 1
            if kind == "text":
                nodes.append(Text(content))
                continue
            t = _Tokens(content, filters)
            if kind == "output":
                nodes.append(Output(_expression(t)))
                t.done()
                continue
            word = t.next()[1]
            if word in ends:
                return tuple(nodes), word, t
            if word == "set":
                name = t.name()
                t.need("=")
                nodes.append(Set(name, _expression(t)))
                t.done()
            elif word == "for":
                name = t.name()
                t.need("in")
                over = _expression(t)
                t.done()
                inner, _, end = body(("endfor",), depth + 1)
                end.done()
                nodes.append(For(name, over, inner))
            elif word == "if":
                test, branches = _expression(t), []
                t.done()
                while True:
                    inner, word, t = body(("elif", "else", "endif") if test != "else" else ("endif",), depth + 1)
                    branches.append((Const(True) if test == "else" else test, inner))
                    test = _expression(t) if word == "elif" else "else"
                    t.done()
                    if word == "endif":
                        break
                nodes.append(If(tuple(branches)))
            elif word == "generation":
                t.done()
                inner, _, end = body(("endgeneration",), depth + 1)
                end.done()
                nodes.append(Generation(inner))
            else:
                raise TemplateError(f"unexpected statement {content.strip()!r}")
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return tuple(nodes), "", None

    return body((), 0)[0]


# --- values -----------------------------------------------------------------------------

def text_of(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} is not a text")


def field_of(value, key):
    """An entry of a dict, or an item of a list or text; nothing else has fields. Missing ones are none."""
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _numbers(f):
    def run(a, b):
        if not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
            raise TemplateError("expected numbers")
        return f(a, b)
    return run


def _plus(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a + b
    raise TemplateError("+ takes two numbers or two texts")


def _ordered(f):
    def run(a, b):
        try:
            return f(a, b)
        except TypeError:
            raise TemplateError("these values have no order") from None
    return run


def _within(a, b):
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    return isinstance(b, (list, tuple, dict)) and a in b


def _remainder(a, b):
    if b == 0:
        raise TemplateError("remainder of 0")
    return a % b


BINARY = {"==": operator.eq, "!=": operator.ne, "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt),
          ">=": _ordered(operator.ge), "in": _within, "+": _plus, "-": _numbers(operator.sub), "*": _numbers(operator.mul),
          "%": _numbers(_remainder), "~": lambda a, b: text_of(a) + text_of(b)}
UNARY = {"not": operator.not_, "-": lambda a: _numbers(operator.sub)(0, a)}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(), "lower": lambda v: text_of(v).lower(), "upper": lambda v: text_of(v).upper(),
    "capitalize": lambda v: text_of(v).capitalize(), "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else 0,
    "default": lambda v, other="": other if v is None else v, "replace": lambda v, old, new: text_of(v).replace(text_of(old), text_of(new)),
    "first": lambda v: field_of(v, 0), "last": lambda v: field_of(v, -1)}


# --- folding ----------------------------------------------------------------------------

def fold(node, filters: dict[str, Callable] | None = None):
    """The same node with what is constant worked out; a constant that fails is left to fail when it is rendered."""
    filters = filters or FILTERS
    go = lambda n: fold(n, filters)
    if isinstance(node, Field):
        node = Field(go(node.of), go(node.key))
        return _tried(field_of, node, node.of, node.key)
    if isinstance(node, ListOf):
        node = ListOf(tuple(map(go, node.items)))
        return _tried(lambda *items: list(items), node, *node.items)
    if isinstance(node, Unary):
        node = Unary(node.op, go(node.of))
        return _tried(UNARY[node.op], node, node.of)
    if isinstance(node, Binary):
        node = Binary(node.op, go(node.left), go(node.right))
        if node.op in ("and", "or"):
            if not isinstance(node.left, Const):
                return node
            return node.right if bool(node.left.value) == (node.op == "and") else node.left
        return _tried(BINARY[node.op], node, node.left, node.right)
    if isinstance(node, Choice):
        test, yes, no = go(node.test), go(node.yes), go(node.no)
        return (yes if test.value else no) if isinstance(test, Const) else Choice(test, yes, no)
    if isinstance(node, Filtered):
        node = Filtered(node.name, go(node.of), tuple(map(go, node.args)))
        return _tried(filters[node.name], node, node.of, *node.args)
    if isinstance(node, Output):
        of = go(node.of)
        if isinstance(of, Const) and not isinstance(of.value, (list, tuple, dict)):
            return Text(text_of(of.value))
        return Output(of)
    if isinstance(node, Set):
        return Set(node.name, go(node.of))
    if isinstance(node, For):
        return For(node.name, go(node.over), fold_body(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold_body(node.body, filters))
    if isinstance(node, If):
        branches = []
        for test, inner in node.branches:
            test = go(test)
            if isinstance(test, Const) and not test.value:
                continue
            branches.append((test, fold_body(inner, filters)))
            if isinstance(test, Const):
                break
        return If(tuple(branches))
    return node


def _tried(f, node, *parts):
    if all(isinstance(p, Const) for p in parts):
        try:
            return Const(f(*(p.value for p in parts)))
        except Exception:  # whatever it is, rendering will meet it again if it gets there
            return node
    return node


def fold_body(nodes: tuple, filters: dict[str, Callable] | None = None) -> tuple:
    """Folded statements; branches that are always taken stand in place of their `if`, and texts that meet are one."""
    out: list = []
    for node in nodes:
        node = fold(node, filters)
        flat = [node]
        if isinstance(node, If):
            if not node.branches:
                continue
            if node.branches[0][0] == Const(True):
                flat = list(node.branches[0][1])
        for n in flat:
            if isinstance(n, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + n.text)
            elif n != Text(""):
                out.append(n)
    return tuple(out)


# --- closures ---------------------------------------------------------------------------

class _Out:
    """Pieces of output, their length in code points, and the spans under generation marks."""

    __slots__ = ("pieces", "size", "spans", "depth")

    def __init__(self):
        self.pieces, self.size, self.spans, self.depth = [], 0, [], 0

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _value(node, filters) -> Callable:
    """A closure that takes the variables and gives the expression's value."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Field):
        of, key = _value(node.of, filters), _value(node.key, filters)
        if isinstance(node.key, Const):
            fixed = node.key.value
            return lambda env: field_of(of(env), fixed)
        return lambda env: field_of(of(env), key(env))
    if isinstance(node, ListOf):
        items = [_value(n, filters) for n in node.items]
        return lambda env: [f(env) for f in items]
    if isinstance(node, Unary):
        f, of = UNARY[node.op], _value(node.of, filters)
        return lambda env: f(of(env))
    if isinstance(node, Binary):
        left, right = _value(node.left, filters), _value(node.right, filters)
        if node.op == "and":
            return lambda env: left(env) and right(env)
        if node.op == "or":
            return lambda env: left(env) or right(env)
        f = BINARY[node.op]
        return lambda env: f(left(env), right(env))
    if isinstance(node, Choice):
        test, yes, no = (_value(n, filters) for n in (node.test, node.yes, node.no))
        return lambda env: yes(env) if test(env) else no(env)
    f, of, args = filters[node.name], _value(node.of, filters), [_value(n, filters) for n in node.args]

    def filtered(env):
        try:
            return f(of(env), *(a(env) for a in args))
        except TypeError as e:
            raise TemplateError(f"filter {node.name}: {e}") from None
    return filtered


def _statement(node, filters) -> Callable:
    """A closure that takes the variables and the output."""
    if isinstance(node, Text):
        text, size = node.text, len(node.text)

        def put(env, out):
            out.pieces.append(text)
            out.size += size
        return put
    if isinstance(node, Output):
        of = _value(node.of, filters)
        return lambda env, out: out.put(text_of(of(env)))
    if isinstance(node, Set):
        of, name = _value(node.of, filters), node.name

        def assign(env, out):
            env[name] = of(env)
        return assign
    if isinstance(node, If):
        branches = [(_value(test, filters), _block(inner, filters)) for test, inner in node.branches]

        def choose(env, out):
            for test, inner in branches:
                if test(env):
                    return inner(env, out)
        return choose
    if isinstance(node, For):
        over, name, inner = _value(node.over, filters), node.name, _block(node.body, filters)

        def loop(env, out):
            items = over(env)
            if items is None:
                return
            if not isinstance(items, (list, tuple)):
                raise TemplateError("a loop takes a list")
            mine = dict(env)  # what a loop sets ends with it
            for i, item in enumerate(items):
                mine[name] = item
                mine["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                inner(mine, out)
        return loop
    inner = _block(node.body, filters)

    def generation(env, out):
        start, out.depth = out.size, out.depth + 1
        inner(env, out)
        out.depth -= 1
        if not out.depth:
            out.spans.append((start, out.size))
    return generation


def _block(nodes, filters) -> Callable:
    run = [_statement(n, filters) for n in nodes]
    if len(run) == 1:
        return run[0]

    def block(env, out):
        for f in run:
            f(env, out)
    return block


def compile_template(source: str, **filters: Callable) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function of the variables that gives the text and the spans under generation marks; nested marks are one span.

    `filters` adds to the listed ones. An unknown name or field is none, which is written as nothing.
    """
    own = {**FILTERS, **filters}
    run = _block(fold_body(parse(source, own), own), own)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(variables), out)
        return "".join(out.pieces), out.spans
    return render
