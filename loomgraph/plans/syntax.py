"""The query language: tokens and syntax tree. A hand-written recursive-descent parser over a bounded Cypher subset."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..model import GraphError

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
REFUSED = ("UNION", "OPTIONAL", "UNWIND", "CALL", "FOREACH", "DISTINCT", "CASE", "LOAD", "REMOVE", "STARTS", "ENDS", "CONTAINS", "IN", "OR", "AND", "NOT", "XOR", "EXISTS")
DEFAULT_LIMIT = 100
MOST_HOPS = 8


@dataclass(frozen=True)
class NodePattern:
    name: str | None
    label: str | None
    props: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Hop:
    type: str
    low: int | None = None  #: None: exactly one hop
    high: int | None = None


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePattern, ...]
    hops: tuple[Hop, ...] = ()
    path: str | None = None


@dataclass(frozen=True)
class Item:
    """``name``, ``name.key`` or an aggregate of one of them or *; ``text`` is what was written, ``alias`` what it is called."""

    text: str
    name: str | None
    key: str | None = None
    aggregate: str | None = None
    alias: str | None = None

    @property
    def column(self) -> str:
        return self.alias or self.text


@dataclass(frozen=True)
class Order:
    name: str
    key: str | None
    descending: bool

    @property
    def text(self) -> str:
        return f"{self.name}.{self.key}" if self.key else self.name


@dataclass(frozen=True)
class Assignment:
    name: str
    key: str
    value: object
    increment_of: tuple[str, str] | None = None


@dataclass(frozen=True)
class Query:
    kind: str  #: read, create, merge, set, delete
    pattern: Pattern
    where: tuple[str, str, object] | None = None
    with_items: tuple[Item, ...] = ()
    items: tuple[Item, ...] = ()
    order: tuple[Order, ...] = ()
    skip: int = 0
    limit: int | None = None
    sets: tuple[Assignment, ...] = ()
    on_create: tuple[Assignment, ...] = ()
    on_match: tuple[Assignment, ...] = ()
    detach: bool = False
    target: str | None = None


_TOKEN = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<number>\d+(?:\.\d+)?(?!\w))|(?P<range>\.\.)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<param>\$[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>->|<-|[()\[\]{}:,.*=+\-<>;]))""")


@dataclass
class Parser:
    text: str
    params: dict[str, object]
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        pos, end = 0, len(self.text.rstrip())
        while pos < end:
            m = _TOKEN.match(self.text, pos)
            if not m:
                raise GraphError("cypher_syntax", f"at {pos}: {self.text[pos : pos + 20]!r}")
            # 1..3 lexes as 1 .. 3
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()
        if self.tokens and self.tokens[-1] == ("mark", ";"):
            self.tokens.pop()
        for i, (kind, t) in enumerate(self.tokens):
            named = i > 0 and self.tokens[i - 1][1] in (":", ".", "(", ",", "{") or i + 1 < len(self.tokens) and self.tokens[i + 1][1] in (".", ":")
            if kind == "word" and t.upper() in REFUSED and not (named and not (self.tokens[i - 1][1] == "(" and t.upper() == "DISTINCT")):
                raise GraphError("unsupported_cypher", t.upper())

    # ------------------------------------------------------------- helpers

    def peek(self, *texts: str, ahead: int = 0) -> bool:
        if self.at + ahead >= len(self.tokens):
            return False
        kind, t = self.tokens[self.at + ahead]
        return (t.upper() if kind == "word" else t) in texts and kind != "string"

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            got = self.tokens[self.at][1] if self.at < len(self.tokens) else "end"
            raise GraphError("cypher_syntax", f"{text} expected, {got} found")

    def ident(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise GraphError("cypher_syntax", "a name is expected")

    def integer(self) -> int:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "number" and self.tokens[self.at][1].isdigit():
            self.at += 1
            return int(self.tokens[self.at - 1][1])
        raise GraphError("cypher_syntax", "a whole number is expected")

    def value(self) -> object:
        sign = -1 if self.take("-") else 1
        if self.at >= len(self.tokens):
            raise GraphError("cypher_syntax", "a value is expected")
        kind, t = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            n = int(t) if t.isdigit() else float(t)
            if isinstance(n, float) and n in (float("inf"), float("-inf")):
                raise GraphError("non_finite_number", t)
            return sign * n
        if sign < 0:
            raise GraphError("cypher_syntax", "a number is expected after -")
        if kind == "string":
            return t[1:-1]
        if kind == "param":
            if t[1:] not in self.params:
                raise GraphError("missing_cypher_param", t[1:])
            return self.params[t[1:]]
        if kind == "word" and t.lower() in ("true", "false"):
            return t.lower() == "true"
        if kind == "word" and t.lower() == "null":
            return None
        raise GraphError("cypher_syntax", f"a value is expected, {t} found")

    # ------------------------------------------------------------- patterns

    def node(self) -> NodePattern:
        self.need("(")
        name = self.ident() if self.tokens[self.at][0] == "word" else None
        label = self.ident() if self.take(":") else None
        props: dict[str, object] = {}
        if self.take("{"):
            while True:
                key = self.ident()
                self.need(":")
                v = self.value()
                if key in props and props[key] != v:
                    raise GraphError("contradictory_filter", key)
                props[key] = v
                if not self.take(","):
                    break
            self.need("}")
        self.need(")")
        return NodePattern(name, label, tuple(props.items()))

    def pattern(self) -> Pattern:
        path = None
        if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "word" and self.peek("=", ahead=1):
            path = self.ident()
            self.need("=")
        nodes, hops = [self.node()], []
        while self.take("-"):
            self.need("[")
            self.need(":")
            kind, low, high = self.ident(), None, None
            if self.take("*"):
                low, high = 1, MOST_HOPS
                if self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
                    low = high = self.integer()
                    if self.take(".."):
                        high = self.integer()
                if low > high or high == 0:
                    raise GraphError("invalid_range", f"{low}..{high}")
            self.need("]")
            self.need("->")
            hops.append(Hop(kind, low, high))
            nodes.append(self.node())
        if any(h.low is not None for h in hops) and len(hops) > 1:
            raise GraphError("unsupported_cypher", "a variable-length hop stands alone")
        names = [n.name for n in nodes if n.name]
        if len(set(names)) < len(names):
            raise GraphError("repeated_binding", "a name is used twice in one pattern")
        return Pattern(tuple(nodes), tuple(hops), path)

    # ------------------------------------------------------------- clauses

    def item(self, alias: bool = False) -> Item:
        word = self.ident()
        if word.upper() in AGGREGATES and self.peek("("):
            self.need("(")
            name = key = None
            if self.take("*"):
                arg = "*"
                if word.upper() != "COUNT":
                    raise GraphError("cypher_syntax", f"{word}(*)")
            else:
                name = arg = self.ident()
                if self.take("."):
                    key = self.ident()
                    arg = f"{name}.{key}"
            self.need(")")
            out = Item(f"{word.upper()}({arg})", name, key, word.upper())
        elif self.take("."):
            key = self.ident()
            out = Item(f"{word}.{key}", word, key)
        else:
            out = Item(word, word)
        if self.peek("AS"):
            self.need("AS")
            return Item(out.text, out.name, out.key, out.aggregate, self.ident())
        if alias:
            raise GraphError("cypher_syntax", "AS is expected after a WITH item")
        return out

    def items(self, alias: bool = False) -> tuple[Item, ...]:
        out = [self.item(alias)]
        while self.take(","):
            out.append(self.item(alias))
        return tuple(out)

    def sets(self) -> tuple[Assignment, ...]:
        out = []
        while True:
            name = self.ident()
            self.need(".")
            key = self.ident()
            self.need("=")
            if self.tokens[self.at][0] == "word" and self.peek(".", ahead=1):
                other = self.ident()
                self.need(".")
                other_key = self.ident()
                self.need("+")
                out.append(Assignment(name, key, self.value(), (other, other_key)))
            else:
                out.append(Assignment(name, key, self.value()))
            if not self.take(","):
                return tuple(out)

    def query(self) -> Query:
        if self.take("CREATE"):
            q = Query("create", self.pattern())
        elif self.take("MERGE"):
            pattern = self.pattern()
            create: tuple[Assignment, ...] = ()
            match: tuple[Assignment, ...] = ()
            while self.take("ON"):
                on_create = self.take("CREATE")
                if not on_create:
                    self.need("MATCH")
                self.need("SET")
                if on_create:
                    create += self.sets()
                else:
                    match += self.sets()
            q = Query("merge", pattern, on_create=create, on_match=match)
        else:
            self.need("MATCH")
            q = self.match()
        if self.at < len(self.tokens):
            raise GraphError("cypher_syntax", f"unexpected {self.tokens[self.at][1]}")
        return q

    def match(self) -> Query:
        pattern, where = self.pattern(), None
        if self.take("WHERE"):
            name = self.ident()
            self.need(".")
            key = self.ident()
            self.need("=")
            where = (name, key, self.value())
        if self.take("SET"):
            return Query("set", pattern, where, sets=self.sets())
        if self.peek("DETACH") or self.peek("DELETE"):
            detach = self.take("DETACH")
            self.need("DELETE")
            return Query("delete", pattern, where, detach=detach, target=self.ident())
        with_items = self.items(True) if self.take("WITH") else ()
        self.need("RETURN")
        items, order, skip, limit = self.items(), [], 0, None
        if self.take("ORDER"):
            self.need("BY")
            while True:
                name = self.ident()
                key = self.ident() if self.take(".") else None
                down = self.take("DESC")
                if not down:
                    self.take("ASC")
                order.append(Order(name, key, down))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            skip = self.integer()
        if self.take("LIMIT"):
            limit = self.integer()
        return Query("read", pattern, where, with_items, items, tuple(order), skip, limit)


def parse(text: str, params: dict[str, object] | None = None) -> Query:
    return Parser(text, params or {}).query()
