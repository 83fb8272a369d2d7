"""A small sandboxed template language, compiled to Python closures.

    {{ expr }}   {% for x in expr %}   {% if expr %} {% elif expr %} {% else %}
    {% set x = expr %}   {% generation %} ... {% endgeneration %}   {# comment #}

Expressions: names, 'text', integers, ``a.key`` and ``a['key']`` (keys of
mappings only, never attributes of objects), ``==  !=  and  or  not``, ``~``
(texts joined), ``x | filter``, brackets; in a loop ``loop.first``, ``loop.last``
and ``loop.index0``.  Nothing else can be reached: no calls, no attributes, no
imports, and a template can't loop but over what it is given.

``compile_template`` parses the source into a syntax tree, folds constants
(operators and filters of constants, conditions that are constant, neighbouring
texts), and turns each node into a closure ``run(scope, out)``.  ``out`` receives
``text(s)`` and ``mark(begins)`` at the edges of a generation block.  A loop
draws its items one by one with one item ahead, so a conversation may be an
iterator of any length.  With ``stream`` the template is a generator that stops
before each further item of its outermost loops.
"""

from __future__ import annotations

import re


class TemplateError(ValueError):
    pass


TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z]\w*)|(?P<int>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
                   r"|(?P<op>==|!=|[.\[\]()|~]))")
PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
WORDS = {"and", "or", "not", "true", "false", "none"}


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1], flags=re.S)


class _Parser:
    """Expressions as tuples: ("const", v), ("name", n), ("key", e, e), ("filter", e, n), (op, e, ...)."""

    def __init__(self, source: str):
        self.todo, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.todo.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.todo.append(("end", ""))

    def take(self, *values: str) -> str | None:
        if self.todo[0][1] in values and self.todo[0][0] in ("op", "name"):
            return self.todo.pop(0)[1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing before {self.todo[0][1]!r}")

    def name(self) -> str:
        kind, value = self.todo.pop(0)
        if kind != "name" or value in WORDS or value.startswith("_"):
            raise TemplateError(f"not a name: {value!r}")
        return value

    def whole(self):
        e = self.either()
        if self.todo[0][0] != "end":
            raise TemplateError(f"unexpected {self.todo[0][1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = ("and", e, self.negated())
        return e

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        e = self.joined()
        while op := self.take("==", "!="):
            e = (op, e, self.joined())
        return e

    def joined(self):
        e = self.filtered()
        while self.take("~"):
            e = ("~", e, self.filtered())
        return e

    def filtered(self):
        e = self.atom()
        while op := self.take("|", ".", "["):
            if op == "|":
                e = ("filter", e, self.name())
            elif op == ".":
                e = ("key", e, ("const", self.name()))
            else:
                e = ("key", e, self.either())
                self.need("]")
        return e

    def atom(self):
        kind, value = self.todo.pop(0)
        if kind == "int":
            return ("const", int(value))
        if kind == "text":
            return ("const", _unquote(value))
        if kind == "op" and value == "(":
            e = self.either()
            self.need(")")
            return e
        if kind == "name" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        self.todo.insert(0, (kind, value))
        return ("name", self.name())


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("print", e), ("for", name, e, body), ("if",
    [(condition, body)]), ("set", name, e), ("generation", body)."""
    stack: list[tuple[str, list, list]] = [("", [], [])]  # kind, the body that grows, what the block has so far
    for part in PART.split(source):
        body = stack[-1][1]
        if part.startswith("{#") or not part:
            continue
        if part.startswith("{{"):
            body.append(("print", _Parser(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            kind, _, done = stack[-1]
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"not a loop: {rest!r}")
                stack.append(("for", [], [_Parser(m[1]).name(), _Parser(m[2]).whole()]))
            elif word == "if":
                stack.append(("if", [], [_Parser(rest).whole()]))
            elif word in ("elif", "else") and kind == "if":
                if done[-1] == ("const", True):
                    raise TemplateError(f"{word} after else")
                test = _Parser(rest).whole() if word == "elif" else ("const", True)
                stack[-1] = ("if", [], [*done, body, test])
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq:
                    raise TemplateError(f"not an assignment: {rest!r}")
                body.append(("set", _Parser(name).name(), _Parser(value).whole()))
            elif word == "generation":
                stack.append(("generation", [], []))
            elif word == "end" + kind and kind:
                stack.pop()
                if kind == "for":
                    stack[-1][1].append(("for", *done, body))
                elif kind == "if":
                    all_ = [*done, body]
                    stack[-1][1].append(("if", list(zip(all_[::2], all_[1::2]))))
                else:
                    stack[-1][1].append(("generation", body))
            else:
                raise TemplateError(f"unexpected {part!r}")
        else:
            body.append(("text", part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} isn't closed")
    return stack[0][1]


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def fold_expr(e: tuple, filters: dict) -> tuple:
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "filter":
        if e[2] not in filters:
            raise TemplateError(f"no filter {e[2]!r}")
        inner = fold_expr(e[1], filters)
        return ("const", filters[e[2]](inner[1])) if inner[0] == "const" else ("filter", inner, e[2])
    parts = [fold_expr(x, filters) for x in e[1:]]
    if all(p[0] == "const" for p in parts) and kind != "key":
        return ("const", expr((kind, *parts), filters)({}))
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def fold(body: list[tuple], filters: dict) -> list[tuple]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)
    for node in body:
        kind = node[0]
        if kind == "print":
            e = fold_expr(node[1], filters)
            node = ("text", _text(e[1])) if e[0] == "const" else ("print", e)
        elif kind == "set":
            node = ("set", node[1], fold_expr(node[2], filters))
        elif kind == "for":
            node = ("for", node[1], fold_expr(node[2], filters), fold(node[3], filters))
        elif kind == "generation":
            node = ("generation", fold(node[1], filters))
        elif kind == "if":
            arms = []
            for c, b in node[1]:
                c = fold_expr(c, filters)
                if c[0] == "const" and not c[1]:
                    continue
                arms.append((c, fold(b, filters)))
                if c[0] == "const":
                    break
            if not arms:
                continue
            if arms[0][0][0] == "const":
                for n in arms[0][1]:
                    add(n)
                continue
            node = ("if", arms)
        add(node)
    return out


def expr(e: tuple, filters: dict):
    """A closure scope -> value."""
    kind = e[0]
    if kind == "const":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    if kind == "filter":
        inner, f = expr(e[1], filters), filters[e[2]]
        return lambda scope: f(inner(scope))
    a = expr(e[1], filters)
    if kind == "not":
        return lambda scope: not a(scope)
    b = expr(e[2], filters)
    if kind == "key":
        def key(scope):
            v = a(scope)
            return v.get(b(scope)) if isinstance(v, dict) else None
        return key
    return {"and": lambda scope: a(scope) and b(scope), "or": lambda scope: a(scope) or b(scope),
            "==": lambda scope: a(scope) == b(scope), "!=": lambda scope: a(scope) != b(scope),
            "~": lambda scope: _text(a(scope)) + _text(b(scope))}[kind]


def block(body: list[tuple], filters: dict):
    """A closure (scope, out) -> None."""
    steps = [_step(n, filters) for n in body]

    def run(scope, out):
        for s in steps:
            s(scope, out)
    return run if len(steps) != 1 else steps[0]


def _step(node: tuple, filters: dict):
    kind = node[0]
    if kind == "text":
        return lambda scope, out, s=node[1]: out.text(s)
    if kind == "print":
        e = expr(node[1], filters)
        return lambda scope, out: out.text(_text(e(scope)))
    if kind == "set":
        e = expr(node[2], filters)

        def assign(scope, out, n=node[1]):
            scope[n] = e(scope)
        return assign
    if kind == "generation":
        inner = block(node[1], filters)

        def marked(scope, out):
            out.mark(True)
            inner(scope, out)
            out.mark(False)
        return marked
    if kind == "if":
        arms = [(expr(c, filters), block(b, filters)) for c, b in node[1]]

        def choose(scope, out):
            for c, b in arms:
                if c(scope):
                    return b(scope, out)
        return choose
    items, inner, name = expr(node[2], filters), block(node[3], filters), node[1]

    def loop(scope, out):
        for inside in _items(items(scope), name, scope):
            inner(inside, out)
    return loop


def _loops(node: tuple) -> bool:
    if node[0] == "if":
        return any(_loops(n) for _, b in node[1] for n in b)
    return node[0] == "for" or node[0] == "generation" and any(map(_loops, node[1]))


def streamed(body: list[tuple], filters: dict):
    """As ``block``, a generator that stops before each further item of an outermost loop."""
    steps = [(_streamed_step(n, filters), True) if _loops(n) else (_step(n, filters), False) for n in body]

    def run(scope, out):
        for s, stops in steps:
            if stops:
                yield from s(scope, out)
            else:
                s(scope, out)
    return run


def _streamed_step(node: tuple, filters: dict):
    kind = node[0]
    if kind == "generation":
        body = streamed(node[1], filters)

        def marked(scope, out):
            out.mark(True)
            yield from body(scope, out)
            out.mark(False)
        return marked
    if kind == "if":
        arms = [(expr(c, filters), streamed(b, filters)) for c, b in node[1]]

        def choose(scope, out):
            for c, b in arms:
                if c(scope):
                    yield from b(scope, out)
                    return
        return choose
    items, inner, name = expr(node[2], filters), block(node[3], filters), node[1]

    def loop(scope, out):
        for i, inside in enumerate(_items(items(scope), name, scope)):
            if i:
                yield
            inner(inside, out)
    return loop


def _items(values, name: str, scope: dict):
    """The scope of each item of a loop, drawn with one item ahead."""
    it = iter(values or ())
    scope, i, end = dict(scope), 0, object()
    item = next(it, end)
    while item is not end:
        after = next(it, end)
        scope[name], scope["loop"] = item, {"first": i == 0, "last": after is end, "index0": i}
        yield scope
        item, i = after, i + 1


def compile_template(source: str, filters: dict, stream: bool = False):
    """A function render(scope, out) of the template; with ``stream`` a generator."""
    return (streamed if stream else block)(fold(parse(source), filters), filters)
