"""A sandboxed template language for conversations, compiled to Python closures.

Statements: for (over turns or a list), if / elif / else, set (names, and members of a namespace), generation (around
what a model shall learn). Expressions: string, whole-number, true, false and none literals, names, members as x.y or x['y'],
x[k:], comparisons, in, is, and / or / not, + - ~ % //, x if y else z, registered filters and a few methods of strings.
loop has index, index0, first, last, previtem and nextitem. A dash in a tag strips the white space beside it.
Nothing else can be called or reached, and names that are not given are undefined: false, and written as nothing.

A template is parsed into a tree, its constant parts (given variables included) are folded, and each node becomes a closure that
yields (text, learn) pieces. Turns are rendered as they arrive and gone through once, so a conversation may have any length.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator


class TemplateError(ValueError):
    pass


class _Undefined:
    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


UNDEFINED = _Undefined()

#: A backslash marks a character that would otherwise belong to a marker.
FILTERS: dict[str, Callable[[str], str]] = {
    "escape": lambda s: re.sub(r"[\\#<]", r"\\\g<0>", s),
    "escape_name": lambda s: re.sub(r"[\\#<:]", r"\\\g<0>", s),
    "lower": str.lower,
    "upper": str.upper,
    "trim": str.strip,
    "capitalize": str.capitalize,
    "title": str.title,
}
#: Methods that strings have in templates, with the largest number of arguments (strings only).
METHODS = {"strip": 1, "lstrip": 1, "rstrip": 1, "lower": 0, "upper": 0, "title": 0, "capitalize": 0, "startswith": 1, "endswith": 1, "replace": 2}
TESTS: dict[str, Callable[[object], bool]] = {
    "defined": lambda v: v is not UNDEFINED,
    "undefined": lambda v: v is UNDEFINED,
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "true": lambda v: v is True,
    "false": lambda v: v is False,
}


class Turns:
    """Turns as they arrive, gone through once.

    Besides the turn at hand, the one before it and those after it that were asked for, only the first HEAD stay in reach;
    a template that asks for another one, for a place from the end or for the number of turns is refused.
    """

    HEAD = 4

    def __init__(self, rows: Iterable[object]) -> None:
        self.rows, self.head, self.held, self.first, self.begun = iter(rows), [], deque(), 0, False

    def at(self, k: int) -> object:
        """The turn number k; undefined beyond the last."""
        while self.first + len(self.held) <= k:
            row = next(self.rows, UNDEFINED)
            if row is UNDEFINED:
                return row
            self.held.append(row)
            if len(self.head) < self.HEAD:
                self.head.append(row)
        if 0 <= k < len(self.head):
            return self.head[k]
        if k < self.first:
            raise TemplateError(f"turn {k} is out of reach")
        return self.held[k - self.first]

    def forget(self, k: int) -> None:
        while self.held and self.first < k:
            self.held.popleft()
            self.first += 1


class View:
    """The turns from number start on."""

    def __init__(self, turns: Turns, start: int = 0) -> None:
        self.turns, self.start = turns, start

    def at(self, k: int) -> object:
        if k < 0:
            raise TemplateError("turns have no places from the end")
        return self.turns.at(self.start + k)

    def __bool__(self) -> bool:
        return self.at(0) is not UNDEFINED

    def loops(self) -> Iterator[tuple[object, Loop]]:
        if self.turns.begun:
            raise TemplateError("turns can be gone through once")
        self.turns.begun = True
        k = 0
        while (turn := self.at(k)) is not UNDEFINED:
            self.turns.forget(self.start + k - 1)
            yield turn, Loop(self, k)
            k += 1


class Loop:
    """What the name loop has in a loop's body."""

    MEMBERS: dict[str, Callable[[View, int], object]] = {
        "index": lambda v, k: k + 1,
        "index0": lambda v, k: k,
        "first": lambda v, k: k == 0,
        "last": lambda v, k: v.at(k + 1) is UNDEFINED,
        "previtem": lambda v, k: v.at(k - 1) if k else UNDEFINED,
        "nextitem": lambda v, k: v.at(k + 1),
    }

    def __init__(self, view: View, k: int) -> None:
        self.view, self.k = view, k

    def get(self, name: object) -> object:
        if name not in self.MEMBERS:
            raise TemplateError(f"a loop has no {name!r}")
        return self.MEMBERS[name](self.view, self.k)


_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_TAG = re.compile(r"({#.*?#}|{%(?:" + _STRING + r"|[^'\"])*?%}|{{(?:" + _STRING + r"|[^'\"])*?}})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>" + _STRING + r")|(?P<int>\d+)|(?P<op>==|!=|<=|>=|//|[<>|()\[\].,:=+\-~%])|(?P<name>[A-Za-z_]\w*))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LITERALS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_WORDS = {"if", "else", "and", "or", "not", "in", "is"}


class _Expression:
    """A recursive-descent parser of one expression; nodes are tuples headed by their kind."""

    def __init__(self, source: str) -> None:
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def _peek(self, *values: str, ahead: int = 0) -> bool:
        at = self.at + ahead
        return at < len(self.tokens) and self.tokens[at][0] in ("op", "name") and self.tokens[at][1] in values

    def _next(self, *values: str) -> str:
        if not self._peek(*values):
            return ""
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _expect(self, value: str) -> None:
        if not self._next(value):
            raise TemplateError(f"{value} expected")

    def _take(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> tuple:
        node = self._choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def _choice(self) -> tuple:
        node = self._or()
        if self._next("if"):
            test = self._or()
            node = ("choose", test, node, self._choice() if self._next("else") else ("const", UNDEFINED))
        return node

    def _or(self) -> tuple:
        node = self._and()
        while self._next("or"):
            node = ("or", node, self._and())
        return node

    def _and(self) -> tuple:
        node = self._not()
        while self._next("and"):
            node = ("and", node, self._not())
        return node

    def _not(self) -> tuple:
        return ("not", self._not()) if self._next("not") else self._compare()

    def _compare(self) -> tuple:
        node = self._joined()
        while True:
            if op := self._next("==", "!=", "<", "<=", ">", ">=", "in"):
                node = ("op", op, node, self._joined())
            elif self._peek("not") and self._peek("in", ahead=1):
                self.at += 2
                node = ("not", ("op", "in", node, self._joined()))
            elif self._next("is"):
                negated, name = self._next("not"), self._take("name")
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                node = ("not", ("test", name, node)) if negated else ("test", name, node)
            else:
                return node

    def _joined(self) -> tuple:
        node = self._term()
        while op := self._next("+", "-", "~"):
            node = ("op", op, node, self._term())
        return node

    def _term(self) -> tuple:
        node = self._signed()
        while op := self._next("%", "//"):
            node = ("op", op, node, self._signed())
        return node

    def _signed(self) -> tuple:
        return ("op", "-", ("const", 0), self._signed()) if self._next("-") else self._postfix()

    def _arguments(self) -> list[tuple]:
        args = []
        while not self._next(")"):
            if args:
                self._expect(",")
            args.append(self._choice())
        return args

    def _postfix(self) -> tuple:
        node = self._primary()
        while True:
            if self._next("."):
                name = self._take("name")
                if self._next("("):
                    args = self._arguments()
                    if name not in METHODS or len(args) > METHODS[name] or len(args) < METHODS[name] and not name.endswith("strip"):
                        raise TemplateError(f"no method {name!r} with {len(args)} arguments")
                    node = ("method", name, node, *args)
                else:
                    node = ("member", node, ("const", name))
            elif self._next("["):
                if self._next(":"):
                    raise TemplateError("slices go to the end: x[k:]")
                key = self._choice()
                if self._next(":"):
                    node = ("slice", node, key)
                else:
                    node = ("member", node, key)
                self._expect("]")
            elif self._next("|"):
                name = self._take("name")
                args = self._arguments() if self._next("(") else []
                if name == "default" and len(args) == 1:
                    node = ("choose", ("test", "defined", node), node, args[0])
                elif name in ("length", "tojson") and not args:
                    node = (name, node)
                elif name in FILTERS and not args:
                    node = ("filter", name, node)
                else:
                    raise TemplateError(f"no filter {name!r} with {len(args)} arguments")
            else:
                return node

    def _primary(self) -> tuple:
        if self._next("("):
            node = self._choice()
            self._expect(")")
            return node
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else ""
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), self._take("str")[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", int(self._take("int")))
        name = self._take("name")
        if name in _LITERALS:
            return ("const", _LITERALS[name])
        if name in _WORDS:
            raise TemplateError(f"unexpected {name!r}")
        if not self._next("("):
            return ("name", name)
        if name == "raise_exception":
            args = self._arguments()
            if len(args) == 1:
                return ("raise", args[0])
        if name == "namespace":
            pairs = []
            while not self._next(")"):
                if pairs:
                    self._expect(",")
                key = self._take("name")
                self._expect("=")
                pairs.append((key, self._choice()))
            return ("namespace", tuple(k for k, _ in pairs), *(v for _, v in pairs))
        raise TemplateError(f"{name} can't be called so")


def _parts(template: str, trim_blocks: bool) -> list[str]:
    """Texts and tags by turns, white space beside tags stripped as they say."""
    parts = _TAG.split(template)
    for k in range(0, len(parts), 2):
        if "{%" in parts[k] or "{{" in parts[k] or "{#" in parts[k]:
            raise TemplateError(f"a tag without end in {parts[k]!r}")
        before, after = parts[k - 1] if k else "", parts[k + 1] if k + 1 < len(parts) else ""
        text = parts[k]
        if before[-3:-2] == "-":
            text = text.lstrip()
        elif trim_blocks and before[:2] in ("{%", "{#"):
            text = text.removeprefix("\n")
        if after[2:3] == "-":
            text = text.rstrip()
        elif trim_blocks and after[:2] in ("{%", "{#"):
            line = text.rpartition("\n")[2]
            if not line.strip(" \t") and (len(line) < len(text) or not k or parts[k].startswith("\n")):
                text = text[: len(text) - len(line)]
        parts[k] = text
    return parts


def parse(template: str, trim_blocks: bool = False) -> list[tuple]:
    """The syntax tree: ("text", s), ("out", e), ("for", name, e, body), ("if", e, body, other), ("set", names, e), ("generation", body).

    With trim_blocks, as published chat templates expect it, a statement takes the newline after it and the blanks before it on its line.
    """
    parts = _parts(template, trim_blocks)

    def block(*ends: str) -> tuple[list[tuple], str, str]:
        nodes = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{#"):
                continue
            inner = part[2:-2].removeprefix("-").removesuffix("-").strip()
            if part.startswith("{{"):
                nodes.append(("out", _Expression(inner).parse()))
            elif part.startswith("{%"):
                word, rest = re.fullmatch(r"(\w*)\s*(.*)", inner, re.DOTALL).groups()
                if word in ends:
                    if rest and word != "elif":
                        raise TemplateError(part)
                    return nodes, word, rest
                if word == "for":
                    m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.DOTALL)
                    if not m:
                        raise TemplateError(part)
                    nodes.append(("for", m[1], _Expression(m[2]).parse(), block("endfor")[0]))
                elif word == "if":
                    nodes.append(branch(rest))
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z_]\w*)(?:\.(\w+))?\s*=(?!=)\s*(.+)", rest, re.DOTALL)
                    if not m or m[1] in ("loop", "turns", "messages"):
                        raise TemplateError(part)
                    nodes.append(("set", (m[1], m[2]), _Expression(m[3]).parse()))
                elif word == "generation" and not rest:
                    nodes.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(part)
            elif part:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return nodes, "", ""

    def branch(test: str) -> tuple:
        body, end, rest = block("elif", "else", "endif")
        other = [branch(rest)] if end == "elif" else block("endif")[0] if end == "else" else []
        return ("if", _Expression(test).parse(), body, other)

    return block()[0]


def assigned(nodes: list[tuple]) -> set[str]:
    """The names that a tree sets anywhere."""
    names: set[str] = set()
    for node in nodes:
        if node[0] == "for":
            names |= {node[1], *assigned(node[3])}
        elif node[0] == "if":
            names |= assigned(node[2]) | assigned(node[3])
        elif node[0] == "set":
            names.add(node[1][0])
        elif node[0] == "generation":
            names |= assigned(node[1])
    return names


#: Kinds of expressions that depend on their parts alone, and where these begin in a node.
_PURE = {"op": 2, "not": 1, "and": 1, "or": 1, "filter": 2, "method": 2, "test": 2, "member": 1, "slice": 1, "length": 1, "tojson": 1, "choose": 1}


def fold(node: tuple, known: dict[str, object] = {}) -> tuple:
    """An expression with its constant parts, and the known names in it, computed."""
    kind = node[0]
    if kind == "name" and node[1] in known:
        return ("const", known[node[1]])
    at = _PURE.get(kind, {"namespace": 2, "raise": 1}.get(kind, len(node)))
    node = (*node[:at], *(fold(a, known) for a in node[at:]))
    if kind in ("and", "or", "choose") and node[1][0] == "const":
        if kind == "choose":
            return node[2] if node[1][1] else node[3]
        return node[2] if bool(node[1][1]) == (kind == "and") else node[1]
    if kind in _PURE and all(a[0] == "const" for a in node[at:]):
        return ("const", _value(node)({}))
    return node


def fold_body(nodes: list[tuple], known: dict[str, object] = {}) -> list[tuple]:
    """A body without constant conditions and outputs; neighbouring texts are joined."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "out":
            e = fold(node[1], known)
            new = [("text", str(e[1]))] if e[0] == "const" else [("out", e)]
        elif kind == "for":
            new = [("for", node[1], fold(node[2], known), fold_body(node[3], known))]
        elif kind == "if":
            e = fold(node[1], known)
            if e[0] == "const":
                new = fold_body(node[2] if e[1] else node[3], known)
            else:
                new = [("if", e, fold_body(node[2], known), fold_body(node[3], known))]
        elif kind == "set":
            new = [("set", node[1], fold(node[2], known))]
        elif kind == "generation":
            new = [("generation", fold_body(node[1], known))]
        else:
            new = [node]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            else:
                out.append(n)
    return out


def _member(v: object, key: object) -> object:
    if isinstance(v, dict):
        return v.get(key, UNDEFINED)
    if isinstance(v, Loop):
        return v.get(key)
    if isinstance(v, View) and isinstance(key, int):
        return v.at(key)
    if isinstance(v, str | list) and isinstance(key, int):
        return v[key] if -len(v) <= key < len(v) else UNDEFINED
    raise TemplateError(f"no member {key!r}")


def _from(v: object, k: object) -> object:
    if isinstance(v, View) and isinstance(k, int) and k >= 0:
        return View(v.turns, v.start + k)
    if isinstance(v, str | list) and isinstance(k, int):
        return v[k:]
    raise TemplateError("no such slice")


def _length(v: object) -> int:
    if isinstance(v, str | list | dict):
        return len(v)
    raise TemplateError("no length: turns are gone through as they arrive")


def _binary(op: str, a: object, b: object) -> object:
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "~":
        return str(a) + str(b)
    if op == "in" and (isinstance(b, dict | list) or isinstance(a, str) and isinstance(b, str)):
        return a in b
    if isinstance(a, str) and isinstance(b, str) and op in ("+", "<", "<=", ">", ">="):
        return {"+": str.__add__, "<": str.__lt__, "<=": str.__le__, ">": str.__gt__, ">=": str.__ge__}[op](a, b)
    if isinstance(a, int) and isinstance(b, int) and op != "in" and not (op in ("%", "//") and b == 0):
        return {"+": int.__add__, "-": int.__sub__, "%": int.__mod__, "//": int.__floordiv__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}[op](a, b)
    raise TemplateError(f"{op} can't be used here")


def _text_method(name: str, v: object, args: list[object]) -> object:
    if not isinstance(v, str) or not all(isinstance(a, str) for a in args):
        raise TemplateError(f"{name} is for texts")
    return getattr(v, name)(*args)


def _raise(message: object) -> None:
    raise TemplateError(str(message))


Value = Callable[[dict], object]


def _value(node: tuple) -> Value:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, name=node[1]: env.get(name, UNDEFINED)
    if kind == "namespace":
        values = [_value(a) for a in node[2:]]
        return lambda env: {k: v(env) for k, v in zip(node[1], values, strict=True)}
    at = {**_PURE, "raise": 1}[kind]
    args = [_value(a) for a in node[at:]]
    a, b, c = (args + [None] * 2)[:3] if len(args) < 3 else args
    if kind == "member" and node[2][0] == "const" and isinstance(node[2][1], str):
        key = node[2][1]

        def member(env: dict) -> object:
            v = a(env)
            return v.get(key, UNDEFINED) if type(v) is dict else _member(v, key)

        return member
    if kind == "op":
        if node[1] == "==":
            return lambda env: a(env) == b(env)
        return lambda env, op=node[1]: _binary(op, a(env), b(env))
    if kind == "method":
        return lambda env: _text_method(node[1], a(env), [f(env) for f in args[1:]])
    if kind == "filter":
        return lambda env, f=FILTERS[node[1]]: f(str(a(env)))
    if kind == "test":
        return lambda env, f=TESTS[node[1]]: f(a(env))
    return {
        "not": lambda env: not a(env),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
        "choose": lambda env: b(env) if a(env) else c(env),
        "member": lambda env: _member(a(env), b(env)),
        "slice": lambda env: _from(a(env), b(env)),
        "length": lambda env: _length(a(env)),
        "tojson": lambda env: json.dumps(_plain(a(env)), ensure_ascii=False),
        "raise": lambda env: _raise(a(env)),
    }[kind]


def _plain(v: object) -> object:
    if isinstance(v, str | int | list | dict) or v is None:
        return v
    raise TemplateError("no JSON for this value")


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _body(nodes: list[tuple]) -> Render:
    steps = [_step(n) for n in nodes]

    def run(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, learn)

    return run


def _step(node: tuple) -> Render:
    kind = node[0]
    if kind == "text":
        return lambda env, learn, s=node[1]: iter(((s, learn),))
    if kind == "out":
        value = _value(node[1])
        return lambda env, learn: iter(((str(value(env)), learn),))
    if kind == "generation":
        inner = _body(node[1])
        return lambda env, learn: inner(env, True)
    if kind == "if":
        test, body, other = _value(node[1]), _body(node[2]), _body(node[3])
        return lambda env, learn: (body if test(env) else other)(env, learn)
    if kind == "set":
        (name, part), value = node[1], _value(node[2])

        def put(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
            if not part:
                env[name] = value(env)
            elif name in env and type(env[name]) is dict:
                env[name][part] = value(env)
            else:
                raise TemplateError(f"{name} is no namespace")
            return iter(())

        return put
    name, items, body = node[1], _value(node[2]), _body(node[3])

    def loop(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
        over = items(env)
        if isinstance(over, list):
            over = View(Turns(over))
        if not isinstance(over, View):
            raise TemplateError("a loop goes over turns or a list")
        for item, state in over.loops():
            yield from body({**env, name: item, "loop": state}, learn)

    return loop


def compile_template(template: str, variables: dict[str, object] | None = None, trim_blocks: bool = False) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from turns (dicts, under the names turns and messages) to pieces of text, each with whether it is under a generation marker.

    variables (texts, numbers, truth values, lists of these) are folded into the template where it sets no such name.
    """
    nodes, given = parse(template, trim_blocks), dict(variables or {})
    own = assigned(nodes) | {"turns", "messages", "loop"}
    body = _body(fold_body(nodes, {k: v for k, v in given.items() if k not in own}))

    def render(turns: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        view = View(Turns(turns))
        return body({**given, "turns": view, "messages": view}, False)

    return render
