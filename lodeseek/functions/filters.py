"""Filter expressions: text -> tree -> one boolean column.

Every leaf is wrapped so that it is true or false before NOT sees it. For WHERE, which drops what is
null as well as what is false, leaves outside NOT stay bare, and literals take their column's type, so
that plain comparisons reach the scan.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid
from ..paths import steps
from ..schema import EQUALITY, NUMBERS, Field, Index
from . import dates

OPS = ("eq", "ne", "gt", "ge", "lt", "le")
MIRROR = {"eq": "eq", "ne": "ne", "gt": "lt", "ge": "le", "lt": "gt", "le": "ge"}
TEXT_TESTS = ("startswith", "endswith", "contains")
TEXT_VALUES = ("length", "indexof", "substring", "tolower", "toupper", "trim")
DATE_VALUES = ("year", "month", "day", "hour", "minute", "second", "datepart", "date", "time", "dateadd", "datediff")
_token = re.compile(r"\s*(?:(?P<str>'(?:[^']|'')*')|(?P<num>[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w]))|(?P<name>[A-Za-z_][\w./]*)|(?P<sign>[(),:]))")


@dataclass(frozen=True)
class Instant:
    """A point in time, of utcdatetime() or now()."""

    at: datetime


@dataclass(frozen=True)
class Node:
    kind: str  # and or not compare in test any all match empty isnull
    args: tuple = ()
    children: tuple["Node", ...] = field(default=())


@dataclass(frozen=True)
class Value:
    """What a comparison has on its left: a path, or a function of one."""

    name: str  # "path" or a function's name
    path: str | None = None
    args: tuple = ()


def instant(text: str) -> Instant:
    if not re.match(dates._FORM, text):
        raise invalid(f"date and time {text!r}")
    try:
        t = datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
    except ValueError:
        raise invalid(f"date and time {text!r}") from None
    return Instant((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc))


class _Parser:
    def __init__(self, text: str, now: datetime | None = None):
        self.now = Instant(now or datetime.now(timezone.utc))
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _token.match(text, at)
            if not m:
                raise invalid(f"filter can't be read at {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, text: str | None = None) -> str:
        k, t = self.peek()
        if kind and k != kind or text is not None and t != text or k == "end":
            raise invalid(f"filter: {text or kind or 'more'} is missing before {t!r}")
        self.i += 1
        return t

    def is_(self, text: str, k: int = 0) -> bool:
        return self.peek(k)[1] == text and self.peek(k)[0] in ("name", "sign")

    def whole(self) -> Node:
        out = self.any_of()
        if self.peek()[0] != "end":
            raise invalid(f"filter goes on after its end: {self.peek()[1]!r}")
        return out

    def any_of(self) -> Node:
        found = [self.all_of()]
        while self.is_("or"):
            self.i += 1
            found.append(self.all_of())
        return found[0] if len(found) == 1 else Node("or", (), tuple(found))

    def all_of(self) -> Node:
        found = [self.one()]
        while self.is_("and"):
            self.i += 1
            found.append(self.one())
        return found[0] if len(found) == 1 else Node("and", (), tuple(found))

    def one(self) -> Node:
        if self.is_("not"):
            self.i += 1
            return Node("not", (), (self.one(),))
        if self.is_("("):
            self.i += 1
            out = self.any_of()
            self.take("sign", ")")
            return out
        return self.leaf()

    def literal(self) -> Any:
        kind, t = self.peek()
        if kind == "str":
            self.i += 1
            return t[1:-1].replace("''", "'")
        if kind == "num":
            self.i += 1
            return int(t) if re.fullmatch(r"[+-]?\d+", t) else float(t)
        if kind == "name" and t in ("true", "false", "null"):
            self.i += 1
            return {"true": True, "false": False, "null": None}[t]
        if kind == "name" and t in ("utcdatetime", "now"):
            self.i += 1
            self.take("sign", "(")
            out = instant(self.literal()) if t == "utcdatetime" else self.now
            self.take("sign", ")")
            return out
        raise invalid(f"filter: {t!r} is no literal")

    def texts(self) -> str:
        out = self.literal()
        if not isinstance(out, str):
            raise invalid("filter: a text is missing")
        return out

    def number(self) -> int:
        out = self.literal()
        if isinstance(out, bool) or not isinstance(out, (int, float)) or out != int(out):
            raise invalid("filter: a whole number is missing")
        return int(out)

    def path(self) -> str:
        return self.take("name")

    def leaf(self) -> Node:
        kind, t = self.peek()
        if kind in ("str", "num") or t in ("true", "false", "null", "utcdatetime", "now"):
            value = self.literal()
            op = self.take("name")
            if op not in OPS:
                raise invalid(f"filter: {op!r} is no comparison")
            return Node("compare", (self.value(), MIRROR[op], value))
        if kind == "name" and self.is_("(", 1):
            if t in TEXT_TESTS:
                self.i += 2
                p = self.path()
                self.take("sign", ",")
                out = Node("test", (t, p, self.texts()))
                self.take("sign", ")")
                return out
            if t in ("search.ismatch", "search.ismatchscoring"):
                self.i += 2
                pattern = self.texts()
                self.take("sign", ",")
                paths = tuple(x.strip() for x in (self.texts() if self.peek()[0] == "str" else self.path()).split(","))
                while self.is_(","):
                    self.i += 1
                    self.literal() if self.peek()[0] in ("str", "num") else self.take("name")
                self.take("sign", ")")
                if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
                    raise invalid("filter: look-around and back references aren't supported")
                try:
                    re.compile(pattern)
                except re.error as e:
                    raise invalid(f"filter: pattern {pattern!r}: {e}") from None
                return Node("match", (pattern, paths))
            if t in ("search.isempty", "search.isnull"):
                self.i += 2
                out = Node(t[7:].replace("is", "is" if t.endswith("null") else ""), (self.path(),))
                self.take("sign", ")")
                return out
            head, _, last = t.rpartition("/")
            if last in ("any", "all") and head:
                self.i += 2
                var = self.take("name")
                self.take("sign", ":")
                out = Node(last, (head, var, self.inner(var)))
                self.take("sign", ")")
                return out
        if kind == "name" and self.peek(1)[1] in ("any", "all") and self.peek(2)[0] == "name" and self.peek(1)[0] == "name":
            p, last, var = self.path(), self.take("name"), self.take("name")
            return Node(last, (p, var, self.inner(var)))
        left = self.value()
        op = self.take("name")
        if op == "in" and left.name == "path":
            self.take("sign", "(")
            found = [self.literal()]
            while self.is_(","):
                self.i += 1
                found.append(self.literal())
            self.take("sign", ")")
            return Node("in", (left.path, tuple(found)))
        if op not in OPS:
            raise invalid(f"filter: {op!r} is no comparison")
        return Node("compare", (left, op, self.literal()))

    def inner(self, var: str) -> Node:
        p = self.take("name")
        if p != var and not p.startswith(var + "/"):
            raise invalid(f"filter: {p!r} doesn't start with {var!r}")
        op = self.take("name")
        if op not in OPS:
            raise invalid(f"filter: {op!r} is no comparison")
        return Node("compare", (Value("path", p[len(var) + 1 :]), op, self.literal()))

    def value(self) -> Value:
        name = self.take("name")
        if not self.is_("("):
            return Value("path", name)
        if name not in TEXT_VALUES + DATE_VALUES:
            raise invalid(f"filter: no function {name!r}")
        self.i += 1
        if name == "datepart":
            part = self.texts() if self.peek()[0] == "str" else self.take("name")
            if part not in dates.PARTS:
                raise invalid(f"filter: no part {part!r}")
            self.take("sign", ",")
            out = Value("datepart", self.path(), (part,))
        elif name in ("dateadd", "datediff"):
            unit = self.texts() if self.peek()[0] == "str" else self.take("name")
            if unit not in dates.MONTHS and unit not in dates.SECONDS:
                raise invalid(f"filter: no unit {unit!r}")
            self.take("sign", ",")
            if name == "dateadd":
                n = self.number()
                self.take("sign", ",")
                out = Value(name, self.path(), (unit, n))
            else:
                ends = [self.end()]
                self.take("sign", ",")
                ends.append(self.end())
                out = Value(name, next((e for e in ends if isinstance(e, str)), None), (unit, *ends))
        elif name in ("indexof", "substring"):
            p = self.path()
            self.take("sign", ",")
            args: tuple = (self.texts(),) if name == "indexof" else (self.number(),)
            if name == "substring" and self.is_(","):
                self.i += 1
                args += (self.number(),)
            out = Value(name, p, args)
        elif name in dates.PARTS:
            out = Value("datepart", self.path(), (name,))
        else:
            out = Value(name, self.path())
        self.take("sign", ")")
        return out

    def end(self):
        """Either side of datediff: a path, or an instant."""
        if self.peek()[0] == "str":
            return instant(self.texts())
        return self.literal() if self.peek()[1] in ("utcdatetime", "now") else self.path()


def parse(text: str, now: datetime | None = None) -> Node:
    """The tree of a filter; now() is fixed here. InvalidQuery where it can't be read."""
    return _Parser(text, now).whole()


def validate(node: Node, index: Index) -> None:
    """InvalidQuery where the filter doesn't suit the index."""

    def need(path: str) -> Field:
        f = index.at(path)
        parts = path.split("/")
        if f is None:
            raise invalid(f"no field {path}")
        if f.vector or not (f.filterable or any((g := index.at("/".join(parts[:k]))) and g.filterable for k in range(1, len(parts)))):
            raise invalid(f"{path} isn't filterable")
        return f

    def multi(path: str) -> bool:
        parts = path.split("/")
        return any(index.at("/".join(parts[: k + 1])).collection for k in range(len(parts)))

    def ordered(f: Field, many: bool, op: str, value) -> None:
        if op not in ("eq", "ne") and value is not None and (f.type in EQUALITY or many and f.complex):
            raise invalid(f"{f.name} can't be compared by {op}")

    for c in node.children:
        validate(c, index)
    if node.kind == "compare":
        left, op, value = node.args
        for p in [left.path, *(a for a in left.args[1:] if left.name == "datediff" and isinstance(a, str))]:
            if p is None:
                continue
            f = need(p)
            if left.name == "path":
                ordered(f, multi(p), op, value)
            elif left.name in TEXT_VALUES and f.type != "String":
                raise invalid(f"{left.name} needs a text, {p} is none")
            elif left.name in DATE_VALUES and f.type != "DateTimeOffset":
                raise invalid(f"{left.name} needs a date, {p} is none")
        if isinstance(value, Instant) and left.name == "path" and index.at(left.path).type != "DateTimeOffset":
            raise invalid(f"{left.path} is no date")
    elif node.kind == "in":
        need(node.args[0])
    elif node.kind == "test":
        if need(node.args[1]).type != "String":
            raise invalid(f"{node.args[0]} needs a text")
    elif node.kind == "match":
        for p in node.args[1]:
            if need(p).type != "String":
                raise invalid("search.ismatch needs texts")
    elif node.kind in ("empty", "isnull"):
        need(node.args[0])
    elif node.kind in ("any", "all"):
        inside = node.args[2].args[0].path
        f = index.at(node.args[0])
        if f is None or not f.complex or not inside:
            need(node.args[0])
        elif index.at(f"{node.args[0]}/{inside}"):
            need(f"{node.args[0]}/{inside}")
        if not multi(node.args[0]):
            raise invalid(f"{node.args[0]} is no collection")
        left, op, value = node.args[2].args
        if f.complex != bool(left.path):
            raise invalid("a lambda compares the element, or a field of a complex one")
        if left.path:
            g = index.at(f"{node.args[0]}/{left.path}")
            if g is None:
                raise invalid(f"no field {node.args[0]}/{left.path}")
            ordered(g, False, op, value)
        else:
            ordered(f, False, op, value)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kind(f: Field) -> str:
    return "number" if f.type in NUMBERS else "bool" if f.type == "Boolean" else "complex" if f.complex or f.type == "GeographyPoint" else "text"


def _literal_kind(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "instant" if isinstance(v, Instant) else "text"


def _op(op: str, a: Column, b: Column) -> Column:
    return {"eq": a == b, "ne": a != b, "gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]


WHOLE = {"Int8", "SByte", "Int16", "Int32", "Int64"}
MILLI = timedelta(milliseconds=1)


def _number(op: str, col: Column, f: Field, value: int | float) -> Column:
    """col op value in the column's own type: whole numbers against whole ones, so that no column is cast."""
    if f.type not in WHOLE:
        return _op(op, col, F.lit(float(value)))
    if math.isinf(value) or abs(value) >= 2**63:
        return _op(op, F.lit(0.0), F.lit(float(value))) & col.isNotNull()
    if value != int(value):
        if op in ("eq", "ne"):
            return F.lit(op == "ne") & col.isNotNull()
        op, value = {"gt": ("ge", math.ceil(value)), "ge": ("ge", math.ceil(value)), "lt": ("le", math.floor(value)), "le": ("le", math.floor(value))}[op]
    return _op(op, col, F.lit(int(value)))


class Compiler:
    """Compiles trees for an index; times: paths whose column is a timestamp and not a text."""

    def __init__(self, index: Index, schema: T.StructType | None = None):
        self.index = index
        self.times = {f.name: f.dataType for f in schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))} if schema else {}

    def column(self, node: Node, bare: bool = False) -> Column:
        """bare: where null and false are the same."""
        if node.kind in ("and", "or"):
            out = self.column(node.children[0], bare)
            for c in node.children[1:]:
                out = out & self.column(c, bare) if node.kind == "and" else out | self.column(c, bare)
            return out
        if node.kind == "not":
            return ~self.column(node.children[0])
        made = getattr(self, f"_{node.kind}")(node)
        return made if bare else _sure(made)

    def at(self, path: str) -> tuple[Column, bool, Field]:
        col, many, f = steps(None, self.index.fields, path)
        if path in self.times:
            col = dates.normal(col.cast("timestamp"))
        return col, many, f

    def moment(self, path: str) -> Column:
        if path in self.times:
            return F.col(f"`{path}`").cast("timestamp")
        col, many, _ = self.at(path)
        return dates.timestamp(F.get(col, F.lit(0)) if many else col)

    def _leaf(self, col: Column, f: Field, op: str, value: Any) -> Column:
        """col op value for a value that is there."""
        kind = _literal_kind(value)
        if kind == "instant":
            return _op(op, dates.normal(dates.timestamp(col)), F.lit(value.at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.at.microsecond // 1000:03d}Z"))
        if kind != _kind(f):
            return F.lit(False)
        return _number(op, col, f, value) if kind == "number" else _op(op, col, F.lit(value))

    def _moment_leaf(self, path: str, op: str, value: Instant) -> Column:
        """A timestamp column against an instant, both to the millisecond, without touching the column."""
        at = value.at.replace(microsecond=value.at.microsecond // 1000 * 1000)
        col, own = F.col(f"`{path}`"), self.times[path]
        if isinstance(own, T.DateType):
            col = col.cast("timestamp")
        lit = lambda t: F.lit(t).cast("timestamp_ntz") if isinstance(own, T.TimestampNTZType) else F.lit(t)
        low, high = lit(at), lit(at + MILLI)
        inside = (col >= low) & (col < high)
        return {"eq": inside, "ne": col.isNull() | ~inside, "gt": col >= high, "ge": col >= low, "lt": col < low, "le": col < high}[op]

    def compare(self, col: Column, many: bool, f: Field, op: str, value: Any) -> Column:
        if not many:
            if value is None:
                return col.isNull() if op == "eq" else col.isNotNull() if op == "ne" else F.lit(False)
            if op == "ne":
                return col.isNull() | (self._leaf(col, f, op, value) if _literal_kind(value) == _kind(f) else F.lit(False))
            return self._leaf(col, f, op, value)
        if value is None:
            some = _sure(F.exists(col, lambda x: x.isNull()))
            return col.isNull() | some if op == "eq" else col.isNotNull() & ~some if op == "ne" else F.lit(False)
        if op == "ne":
            return ~self.compare(col, True, f, "eq", value)
        return _sure(F.exists(col, lambda x: _sure(self._leaf(x, f, op, value))))

    def _compare(self, n: Node) -> Column:
        left, op, value = n.args
        if left.name == "path" and left.path in self.times and (value is None or isinstance(value, Instant)):
            col = F.col(f"`{left.path}`")
            return self.compare(col, False, self.index.at(left.path), op, None) if value is None else self._moment_leaf(left.path, op, value)
        if left.name == "path":
            return self.compare(*self.at(left.path), op, value)
        made, kind = self.value(left)
        if value is None:
            return made.isNotNull() if op == "ne" else F.lit(False)
        if isinstance(value, Instant):
            value = value.at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.at.microsecond // 1000:03d}Z"
        if kind != _literal_kind(value):
            return F.lit(False)
        return _op(op, made.cast("double") if kind == "number" else made, F.lit(value))

    def value(self, v: Value) -> tuple[Column, str]:
        if v.name in TEXT_VALUES:
            col, many, _ = self.at(v.path)
            col = F.get(F.filter(col, lambda x: x.isNotNull()), F.lit(0)) if many else col
            if v.name == "length":
                return F.char_length(col), "number"
            if v.name == "indexof":
                return F.instr(col, v.args[0]) - 1 if v.args[0] else F.when(col.isNotNull(), 0), "number"
            if v.name == "substring":
                start, size = v.args[0], v.args[1] if len(v.args) > 1 else 2**31 - 1
                made = F.lit("") if start < 0 or size <= 0 else F.substring(col, start + 1, size)
                return F.when(col.isNotNull(), made), "text"
            if v.name == "trim":
                return F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), "text"
            return (F.lower(col) if v.name == "tolower" else F.upper(col)), "text"
        if v.name == "datediff":
            a, b = (F.lit(e.at).cast("timestamp") if isinstance(e, Instant) else self.moment(e) for e in v.args[1:])
            return dates.diff(v.args[0], a, b), "number"
        ts = self.moment(v.path)
        if v.name == "datepart":
            return dates.part(v.args[0], ts), "number"
        if v.name == "dateadd":
            return dates.add(*v.args, ts), "text"
        return (dates.date_of(ts) if v.name == "date" else dates.time_of(ts)), "text"

    def _in(self, n: Node) -> Column:
        col, many, f = self.at(n.args[0])
        plain = [v for v in n.args[1] if v is not None and _literal_kind(v) == _kind(f) != "instant"]
        if not many and len(plain) == len([v for v in n.args[1] if v is not None]) and all(isinstance(v, (str, bool, int)) and f.type not in ("Single", "Double", "Half") for v in plain):
            found = col.isin(plain) if plain else F.lit(False)
            return col.isNull() | found if len(plain) < len(n.args[1]) else found
        out = F.lit(False)
        for v in n.args[1]:
            out = out | _sure(self.compare(col, many, f, "eq", v))
        return out

    def _each(self, path: str, test) -> Column:
        col, many, _ = self.at(path)
        return F.exists(col, lambda x: _sure(test(x))) if many else test(col)

    def _test(self, n: Node) -> Column:
        name, path, text = n.args
        return self._each(path, lambda x: getattr(F, name)(x, F.lit(text)))

    def _match(self, n: Node) -> Column:
        out = F.lit(False)
        for p in n.args[1]:
            out = out | _sure(self._each(p, lambda x: x.rlike("(?iu)" + n.args[0])))
        return out

    def _empty(self, n: Node) -> Column:
        col, many, f = self.at(n.args[0])
        blank = (lambda x: x.isNull() | _sure(x == "")) if _kind(f) == "text" else lambda x: x.isNull()
        return col.isNull() | _sure(F.forall(col, blank)) if many else blank(col)

    def _isnull(self, n: Node) -> Column:
        col, many, _ = self.at(n.args[0])
        return col.isNull() | _sure(F.exists(col, lambda x: x.isNull())) if many else col.isNull()

    def _lambda(self, n: Node, quantifier) -> Column:
        col, _, f = self.at(n.args[0])
        left, op, value = n.args[2].args

        def body(x: Column) -> Column:
            if not left.path:
                return _sure(self.compare(x, False, f, op, value))
            return _sure(self.compare(*steps(x, f.fields, left.path), op, value))

        return col.isNotNull() & _sure(quantifier(col, body))

    def _any(self, n: Node) -> Column:
        return self._lambda(n, F.exists)

    def _all(self, n: Node) -> Column:
        return self._lambda(n, F.forall)


def compile_filter(text: str, index: Index, schema: T.StructType | None = None, check: bool = True, bare: bool = False) -> Column:
    """A boolean column for a filter's text, never null; bare: for WHERE, null where it might as well be false."""
    node = parse(text)
    if check:
        validate(node, index)
    return Compiler(index, schema).column(node, bare)
