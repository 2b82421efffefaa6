"""Mutations: trees of assignments and deletions, and the entries that they come to."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from ..functions.codec import Terminator, encode_path

Segment = str | bytes


class _Delete:
    def __repr__(self):
        return "DELETE"


#: Stands for a tombstone in a literal.
DELETE = _Delete()


@dataclass(frozen=True)
class Assign:
    segment: Segment
    value: Any


@dataclass(frozen=True)
class Delete:
    segment: Segment


@dataclass(frozen=True)
class Nested:
    segment: Segment
    inner: tuple[Mutation, ...]


@dataclass(frozen=True)
class Compose:
    parts: tuple[Mutation, ...]


Mutation = Assign | Delete | Nested | Compose


def mutation(literal: dict[Segment, Any]) -> Compose:
    """A literal: str keys are fields, bytes keys are fractional indices; dict values nest, DELETE deletes, all else is assigned.

    A map as a value is ``Assign(segment, {...})`` in place of the dict.
    """
    out: list[Mutation] = []
    for segment, value in literal.items():
        if isinstance(value, (Assign, Delete, Nested, Compose)):
            out.append(value)
        elif value is DELETE:
            out.append(Delete(segment))
        elif isinstance(value, dict):
            out.append(Nested(segment, mutation(value).parts))
        else:
            out.append(Assign(segment, value))
    return Compose(tuple(out))


def entries(m: Mutation, path: tuple[Segment, ...] = ()) -> Iterator[tuple[bytes, str | None, bool]]:
    """(key, JSON value, deleted) of each leaf in textual order; a deletion is of that one key, not of what is below."""
    if isinstance(m, Compose):
        for part in m.parts:
            yield from entries(part, path)
    elif isinstance(m, Nested):
        for part in m.inner:
            yield from entries(part, (*path, m.segment))
    elif isinstance(m, Delete):
        yield encode_path([*path, m.segment], Terminator()), None, True
    else:
        yield encode_path([*path, m.segment], Terminator()), json.dumps(m.value, ensure_ascii=False), False
