"""Query texts to trees: the simple syntax and the full one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import invalid


@dataclass(frozen=True)
class Clause:
    """kind: term, phrase, fuzzy, prefix, regex, range, all. field: None for all in scope."""

    kind: str
    text: str = ""
    field: str | None = None
    distance: int = 0
    boost: float = 1.0
    upper: str = ""
    inclusive: tuple[bool, bool] = (True, True)


@dataclass(frozen=True)
class Group:
    must: tuple = ()
    should: tuple = ()
    never: tuple = ()
    boost: float = 1.0


def simple(text: str | None, mode: str = "any") -> Group | Clause:
    """Terms, "phrases", -excluded, term~ and term~0..2; + changes nothing. Nothing or * is all."""
    if text is None or text.strip() in ("", "*"):
        return Clause("all")
    want, never, at = [], [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        sign = text[at] if text[at] in "+-" else ""
        at += len(sign)
        if at >= len(text) or text[at].isspace():
            raise invalid("a sign without a term")
        if text[at] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(text, at)
            if not m:
                raise invalid("a quote isn't closed")
            clause = Clause("phrase", m[1].replace('""', '"'))
        else:
            m = re.compile(r'[^\s"]+').match(text, at)
            word, tilde, n = m[0].partition("~")
            if tilde:
                if not word or n not in ("", "0", "1", "2"):
                    raise invalid(f"fuzzy term {m[0]!r}")
                d = 2 if n == "" else int(n)
                clause = Clause("fuzzy", word, distance=d) if d else Clause("term", word)
            else:
                clause = Clause("term", word)
        at = m.end()
        (never if sign == "-" else want).append(clause)
    if not want:
        return Group(must=(Clause("all"),), never=tuple(never))
    return Group(must=tuple(want), never=tuple(never)) if mode == "all" else Group(should=tuple(want), never=tuple(never))


_lex = re.compile(
    r'\s*(?:(?P<op>&&|\|\||AND\b|OR\b|NOT\b|[+!()-])|(?P<field>[\w/]+):(?!\s|$)|(?P<phrase>"(?:[^"\\]|\\.)*")|(?P<regex>/(?:[^/\\]|\\.)+/)'
    r"|(?P<range>[\[{]\s*\S+\s+TO\s+[^\]}\s]+\s*[\]}])|(?P<term>(?:[^\s:()\"\[\]{}^~/\\]|\\.)+))"
)
_after = re.compile(r"(?:~(?P<fuzzy>\d+(?:\.\d+)?)?)?(?:\^(?P<boost>\d+(?:\.\d+)?))?")


class _Full:
    def __init__(self, text: str, mode: str, fields: set[str]):
        self.mode, self.fields, self.tokens, at, text = mode, fields, [], 0, text.rstrip()
        while at < len(text):
            m = _lex.match(text, at)
            if not m:
                raise invalid(f"query can't be read at {text[at:at + 20]!r}")
            at, kind, extra = m.end(), m.lastgroup, None
            if kind in ("phrase", "term", "regex", "range") or m[kind] == ")":
                extra = _after.match(text, at)
                at = extra.end()
            self.tokens.append((kind, m[kind], extra))
        self.i = 0

    def peek(self):
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "", None)

    def whole(self):
        out = self.group(None)
        if self.peek()[0] != "end":
            raise invalid("a bracket isn't opened")
        return out

    def group(self, field):
        """AND makes its neighbours required, NOT and - exclude, + requires; the rest follows the mode."""
        items: list[list] = []
        while self.peek()[0] != "end" and self.peek()[1] != ")":
            joined = ""
            sign = ""
            while self.peek()[0] == "op" and self.peek()[1] not in "()":
                op = self.peek()[1]
                self.i += 1
                if op in ("AND", "&&", "OR", "||"):
                    joined = "AND" if op in ("AND", "&&") else "OR"
                    if not items:
                        raise invalid(f"{op} without a left side")
                else:
                    sign = "+" if op == "+" else "-"
            if self.peek()[0] == "end" or self.peek()[1] == ")":
                raise invalid("an operator without a right side")
            one = self.one(field)
            plain = "+" if self.mode == "all" and joined != "OR" or joined == "AND" else ""
            if joined == "AND" and items[-1][0] == "":
                items[-1][0] = "+"
            if joined == "OR" and self.mode == "all" and items[-1][0] == "+":
                items[-1][0] = ""
            items.append([sign or plain, one])
        by = {s: tuple(x for t, x in items if t == s) for s in ("+", "", "-")}
        if not items:
            raise invalid("an empty group")
        must = by["+"] or (() if by[""] else (Clause("all"),))
        return Group(must=must, should=by[""], never=by["-"])

    def one(self, field):
        kind, text, extra = self.peek()
        self.i += 1
        if kind == "field":
            if text not in self.fields:
                raise invalid(f"no searchable field {text}")
            return self.one(text)
        if text == "(":
            out = self.group(field)
            if self.peek()[1] != ")":
                raise invalid("a bracket isn't closed")
            extra = self.peek()[2]
            self.i += 1
            return Group(out.must, out.should, out.never, float(extra["boost"] or 1)) if extra else out
        if kind == "op":
            raise invalid(f"{text!r} is out of place")
        boost = float(extra["boost"] or 1)
        fuzzy = "~" in extra[0]
        if kind == "phrase":
            return Clause("phrase", re.sub(r"\\(.)", r"\1", text[1:-1]), field, boost=boost)
        if kind == "regex":
            try:
                re.compile(text[1:-1])
            except re.error as e:
                raise invalid(f"pattern {text}: {e}") from None
            return Clause("regex", text[1:-1], field, boost=boost)
        if kind == "range":
            low, high = re.split(r"\s+TO\s+", text[1:-1].strip())
            return Clause("range", low, field, boost=boost, upper=high, inclusive=(text[0] == "[", text[-1] == "]"))
        word = re.sub(r"\\(.)", r"\1", text)
        if text == "*":
            return Clause("all", boost=boost)
        if fuzzy:
            d = 2 if not extra["fuzzy"] else min(2, int(float(extra["fuzzy"])))
            return Clause("fuzzy", word, field, distance=d, boost=boost) if d else Clause("term", word, field, boost=boost)
        if text.endswith("*") and not text.endswith("\\*"):
            return Clause("prefix", word[:-1], field, boost=boost)
        return Clause("term", word, field, boost=boost)


def full(text: str | None, mode: str, fields: list[str]) -> Group | Clause:
    """AND OR NOT + - ( ) field: "phrase" term* term~ /regex/ [a TO b] ^boost."""
    if text is None or not text.strip():
        return Clause("all")
    if text.count('"') % 2:
        raise invalid("a quote isn't closed")
    return _Full(text, mode, set(fields)).whole()


def terms(node, wanted: bool = True) -> list[Clause]:
    """Clauses that a hit can owe its place to."""
    if isinstance(node, Clause):
        return [node] if wanted and node.kind != "all" else []
    return [c for n in (*node.must, *node.should) for c in terms(n)]


def synonyms(rules: list[str], term: str) -> list[str]:
    """Other words for a term by rules "a, b" and "a, b => c"."""
    out: list[str] = []
    term = term.lower()
    for rule in rules:
        left, arrow, right = rule.partition("=>")
        sides = [[w.strip().lower() for w in s.split(",") if w.strip()] for s in (left, right)]
        if term in sides[0]:
            out += sides[1] if arrow else [w for w in sides[0] if w != term]
    return list(dict.fromkeys(x for w in out for x in w.split()))
