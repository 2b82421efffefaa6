"""The query language: tree, text parser and builder.

    query   := '{' selects '}'
    selects := ( select ','? )*
    select  := name ( 'as' name )? ( '(' filters ')' )? ( '{' selects '}' )?
    filters := ( filter ','? )*
    filter  := 'skip' ':' number | 'take' ':' number | 'after' ':' name | 'before' ':' name
    name    := [A-Za-z_][A-Za-z0-9_]* | '"' any but '"' '"'
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_NUMBER = (1 << 64) - 1


class QueryError(ValueError):
    pass


class UnexpectedChar(QueryError):
    def __init__(self, char: str, position: int):
        super().__init__(f"unexpected {char!r} at {position}")
        self.char, self.position = char, position


class UnexpectedEnd(QueryError):
    def __init__(self):
        super().__init__("unexpected end")


class UnknownFilter(QueryError):
    def __init__(self, name: str, position: int):
        super().__init__(f"unknown filter {name!r} at {position}")
        self.name, self.position = name, position


@dataclass(frozen=True)
class Filter:
    """kind: skip or take (an int), after or before (a key: str, or index bytes from the builder)."""

    kind: str
    value: int | str | bytes


@dataclass(frozen=True)
class Select:
    name: str
    alias: str | None = None
    filters: tuple[Filter, ...] = ()
    selects: tuple[Select, ...] = ()

    @property
    def output(self) -> str:
        return self.alias if self.alias is not None else self.name


@dataclass(frozen=True)
class Query:
    selects: tuple[Select, ...]

    @staticmethod
    def parse(text: str) -> Query:
        return _Parser(text).query()


def select(name: str, *selects: Select | str, alias: str | None = None, **filters) -> Select:
    """Builder: ``select("orders", "o_orderkey", skip=1, take=3, after=b"..")`` is the tree that text gives."""
    return Select(name, alias, tuple(Filter(k, v) for k, v in filters.items()), tuple(s if isinstance(s, Select) else Select(s) for s in selects))


def query(*selects: Select | str) -> Query:
    return Query(tuple(s if isinstance(s, Select) else Select(s) for s in selects))


_TOKEN = re.compile(r'(?P<space>[ \t\r\n\f]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>[0-9]+)|"(?P<quoted>[^"]*)"|(?P<mark>[{}(),:])')


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, [], 0
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                self.tokens.append(("end", "") if text[at] == '"' else ("bad", text[at]))
                self.tokens[-1] += (len(text[:at].encode()),)
                break
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[m.lastgroup], len(text[:at].encode())))
            at = m.end()
        self.tokens.append(("end", "", len(text.encode())))

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at][:2]

    def fail(self):
        kind, value, position = self.tokens[self.at]
        if kind == "end":
            raise UnexpectedEnd
        raise UnexpectedChar('"' if kind == "quoted" else value[0], position)

    def mark(self, char: str) -> bool:
        if self.peek() == ("mark", char):
            self.at += 1
            return True
        return False

    def expect(self, char: str) -> None:
        if not self.mark(char):
            self.fail()

    def take(self, *kinds: str) -> str:
        kind, value = self.peek()
        if kind not in kinds:
            self.fail()
        self.at += 1
        return value

    def query(self) -> Query:
        self.expect("{")
        out = Query(self.selects())
        if self.peek()[0] != "end" or self.tokens[self.at][2] != len(self.text.encode()):
            self.fail()
        return out

    def selects(self) -> tuple[Select, ...]:
        out = []
        while not self.mark("}"):
            out.append(self.select())
            self.mark(",")
        return tuple(out)

    def select(self) -> Select:
        name, alias, filters, selects = self.take("word", "quoted"), None, (), ()
        if self.peek() == ("word", "as"):
            self.at += 1
            # a field that is followed by the field "as" reads as an alias, so the alias must follow
            alias = self.take("word", "quoted")
        if self.mark("("):
            filters = self.filters()
        if self.mark("{"):
            selects = self.selects()
        return Select(name, alias, filters, selects)

    def filters(self) -> tuple[Filter, ...]:
        out = []
        while not self.mark(")"):
            position = self.tokens[self.at][2]
            kind = self.take("word")
            self.expect(":")
            if kind in ("skip", "take"):
                number_at = self.tokens[self.at][2]
                value: int | str = int(self.take("number"))
                if value > MAX_NUMBER:
                    raise UnexpectedChar(str(value)[0], number_at)
            elif kind in ("after", "before"):
                value = self.take("word", "quoted")
            else:
                raise UnknownFilter(kind, position)
            out.append(Filter(kind, value))
            self.mark(",")
        return tuple(out)
