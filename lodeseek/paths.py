"""Paths A/B/C as columns; arrays on the way fan out to one flat array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import invalid
from .schema import Field, Index


def _inner(part: str, many: bool):
    if many:  # flatten gives null for a null inside
        return lambda x: F.filter(F.coalesce(x[part], F.array()), lambda y: y.isNotNull())
    return lambda x: x[part]


def steps(col: Column | None, fields: tuple[Field, ...], path: str, many: bool = False) -> tuple[Column, bool, Field]:
    """Column at path below col (None: the row), whether it is an array of values, and the field."""
    found = None
    for part in path.split("/"):
        found = next((f for f in fields if f.name == part), None)
        if found is None:
            raise invalid(f"no field {path}")
        if col is None:
            col = F.col(f"`{part}`")
        elif many:
            present = F.filter(col, lambda x: x.isNotNull())
            col = F.transform(present, _inner(part, found.collection))
            col = F.flatten(col) if found.collection else col
        else:
            col = col[part]
        many, fields = many or found.collection, found.fields
    return col, many, found


def resolve(index: Index, path: str) -> tuple[Column, bool, Field]:
    return steps(None, index.fields, path)


def project(fields: tuple[Field, ...], paths: list[str], row: Column | None = None) -> list[Column]:
    """Columns that keep only paths, as nested structs; a parent wins over its parts, elements without a value go."""
    out = []
    for f in fields:
        own = [p.partition("/")[2] for p in paths if p == f.name or p.startswith(f.name + "/")]
        if not own:
            continue
        col = F.col(f"`{f.name}`") if row is None else row[f.name]
        if "" not in own:
            shape = _shape(f, own)
            if f.collection:
                some = F.filter(F.transform(col, shape), _any_of(own))
                col = F.when(F.size(some) > 0, some)
            else:
                col = F.when(col.isNotNull(), shape(col))
        out.append(col.alias(f.name))
    return out


def _shape(f: Field, own: list[str]):
    return lambda x: F.struct(*project(f.fields, own, x))


def _any_of(own: list[str]):
    names = list(dict.fromkeys(p.partition("/")[0] for p in own))

    def some(x):
        test = x[names[0]].isNotNull()
        for n in names[1:]:
            test = test | x[n].isNotNull()
        return test

    return some
