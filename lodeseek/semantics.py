"""Semantic configurations of an index and the semantic part of a request, checked."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from .errors import SearchError, invalid

#: Default and largest number of answers and of captions.
ANSWERS, CAPTIONS = (3, 5), (1, 3)
PARTIAL = {"throwError": False, "fail": False, "returnPartialResults": True, "partial": True}


def _bad(message: str) -> SearchError:
    return SearchError("InvalidIndex", message)


def _text(of: Any, key: str, what: str) -> str:
    value = of.get(key) if isinstance(of, dict) else None
    if not isinstance(value, str) or not value:
        raise _bad(f"{what} needs a {key}")
    return value


def _items(of: dict, key: str) -> list:
    value = of.get(key)
    if value is not None and not isinstance(value, list):
        raise _bad(f"{key} is no list")
    return value or []


def configurations(index, spec: Any) -> dict[str, dict[str, list[str]]]:
    """Fields for answers and for captions by configuration's name; index: what is known of it so far."""
    out: dict[str, dict[str, list[str]]] = {}
    for c in _items(spec or {}, "configurations"):
        name = _text(c, "name", "a semantic configuration")
        if name in out:
            raise _bad(f"semantic configuration {name} is there twice")
        if (c.get("reranker") or {}).get("name", "standard") != "standard":
            raise _bad(f"{name}: no such reranker")
        if c.get("rescorers"):
            raise _bad(f"{name}: rescorers aren't supported")
        made = _by_role(index, c) if "priorities" in c or "sources" in c else _by_field(index, c.get("prioritizedFields") or {})
        out[name] = {k: list(dict.fromkeys(v)) for k, v in made.items()}
    return out


def _by_role(index, c: dict) -> dict[str, list[str]]:
    """priorities name fields for answers and captions; sources are checked."""
    out: dict[str, list[str]] = {"answers": [], "captions": []}
    if "priorities" in c:
        given = c["priorities"]
        if not isinstance(given, dict) or not any(k in given for k in out):
            raise _bad("priorities need answers or captions")
        for role in out:
            if role in given:
                if not _items(given, role):
                    raise _bad(f"priorities: {role} is empty")
                for p in given[role]:
                    f = index.at(p) if isinstance(p, str) and p else None
                    if f is None or not f.retrievable:
                        raise _bad(f"priority field {p!r} isn't retrievable")
                    out[role].append(p)
    for s in _items(c, "sources"):
        _text(s, "name", "a source")
        if s.get("type", "text") != "text":
            raise _bad(f"source {s['name']}: only texts are supported")
        f = index.at(_text(s, "field", "a source"))
        if f is None or not f.searchable or f.type != "String":
            raise _bad(f"source field {s['field']} isn't a searchable text")
    return out


def _by_field(index, given: Any) -> dict[str, list[str]]:
    """The title and content fields serve answers and captions, keywords answers alone."""
    if not isinstance(given, dict):
        raise _bad("prioritizedFields is no object")
    names = lambda *keys: [_text(x, "fieldName", k) for k in keys for x in _items(given, k)]
    title = [_text(given["titleField"], "fieldName", "titleField")] if given.get("titleField") else []
    content, keywords = names("prioritizedContentFields", "contentFields"), names("prioritizedKeywordsFields", "keywordsFields")
    for p in [*title, *content, *keywords]:
        if index.at(p) is None:
            raise _bad(f"semantic field {p} doesn't exist")
    return {"answers": title + content + keywords, "captions": title + content}


@dataclass(frozen=True)
class Wanted:
    """What a request wants of a configuration; null counts: not asked for."""

    configuration: str | None
    answers: int | None
    captions: int | None
    questions: tuple[str, ...] = ()
    partial: bool = False


def wanted(request: dict) -> Wanted | None:
    """The nested form, whose counts must be in range, or the flat one, whose counts are drawn into it; null without either."""
    nested = request.get("semantic")
    if nested is None:
        return _flat(request)
    if not isinstance(nested, dict):
        raise invalid("semantic is no object")
    name = nested.get("semanticConfiguration")
    if not isinstance(name, str) or not name:
        raise invalid("semantic needs a semanticConfiguration")
    context = nested.get("queryContext")
    if context is not None and not isinstance(context, dict):
        raise invalid("queryContext is no object")
    questions = (context or {}).get("questions")
    if questions is not None and (not isinstance(questions, list) or not all(isinstance(q, str) for q in questions)):
        raise invalid("questions are no list of texts")
    captions = _block(nested.get("captions"), "captions", CAPTIONS)
    answers = _block(nested.get("answers"), "answers", ANSWERS)
    inner = _block((nested.get("captions") or {}).get("answers"), "captions.answers", ANSWERS)
    return Wanted(name, answers if answers is not None else inner, captions, tuple(questions or ()), _partial(nested.get("semanticErrorHandling")))


def _first(request: dict, *keys: str) -> Any:
    """The value of the first of keys that isn't null."""
    return next((request[k] for k in keys if request.get(k) is not None), None)


def _flat(request: dict) -> Wanted | None:
    """The options of client libraries: a configuration by name, answers and captions as texts such as "extractive|count-3"."""
    name = _first(request, "semanticConfiguration", "semanticConfigurationName")
    if name is None and request.get("queryType") != "semantic":
        return None
    if name is not None and (not isinstance(name, str) or not name):
        raise invalid("semanticConfiguration is no name")
    handling = _partial(_first(request, "semanticErrorHandling", "semanticErrorMode"))
    return Wanted(name, _option(request, "answers", "queryAnswer", ANSWERS), _option(request, "captions", "queryCaption", None), partial=handling)


def _option(request: dict, key: str, older: str, rule: tuple[int, int] | None) -> int | None:
    """How many extractive answers or captions: by the text under key, or without one by the older pair of properties. rule null: there is no count."""
    text = request.get(key)
    if isinstance(text, str):
        kind, *rest = re.split("[|,]", text)
        counts = [m[1] for x in rest if (m := re.fullmatch(r"count-\s*\+?(\d+)", x.strip()))]
        count = int(counts[-1]) if counts else None
    else:
        kind, count = request.get(older), request.get(f"{older}Count")
    if not isinstance(kind, str) or kind.strip() != "extractive":
        return None
    if rule is None:
        return CAPTIONS[0]
    return rule[0] if isinstance(count, bool) or not isinstance(count, int) or count < 0 else min(max(1, count), rule[1])


def _block(given: Any, label: str, rule: tuple[int, int]) -> int | None:
    if given is None:
        return None
    if not isinstance(given, dict):
        raise invalid(f"semantic {label} is no object")
    if given.get("type", "extractive") != "extractive":
        raise invalid(f"semantic {label}: only extractive ones are supported")
    count = given.get("count")
    if count is None:
        return rule[0]
    if isinstance(count, bool) or not isinstance(count, int) or not 1 <= count <= rule[1]:
        raise invalid(f"semantic {label}: the count goes from 1 to {rule[1]}")
    return count


def _partial(mode: Any) -> bool:
    if mode is None:
        return False
    if mode not in PARTIAL:
        raise invalid(f"semanticErrorHandling {mode!r}")
    return PARTIAL[mode]
