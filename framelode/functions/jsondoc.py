"""JSON documents with keys at any depth: canonical form, digests, removal, remapping, patches. Arrow functions over text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def walk(value: object, visit: Callable[[str, str, object], tuple[bool, object]], path: str = "") -> object:
    """value rebuilt with what visit(path, key, child) says of each key: whether it stays, and its new child."""
    if isinstance(value, dict):
        out = {}
        for key, child in value.items():
            at = f"{path}.{key}" if path else key
            stays, child = visit(at, key, child)
            if stays:
                out[key] = walk(child, visit, at)
        return out
    if isinstance(value, list):
        return [walk(child, visit, f"{path}[{i}]") for i, child in enumerate(value)]
    return value


def _mapped(f: Callable[[object], object], kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


def canonical_json(doc: Column) -> Column:
    """Canonical text of a document; null where it isn't JSON."""
    return _mapped(lambda t: None if (v := parsed(t)) is None else canonical(v), "string")(doc)


def content_digest(doc: Column, fields: tuple[str, ...]) -> Column:
    """SHA-256 of the canonical form of a document's fields, an absent one as null."""
    def digest(text):
        v = parsed(text)
        return hashlib.sha256(canonical({k: v.get(k) for k in fields}).encode()).hexdigest() if isinstance(v, dict) else None

    return _mapped(digest, "string")(doc)


def without_keys(doc: Column, keys: tuple[str, ...], anchors: tuple[str, ...] = (), unknown: tuple[str, ...] = ()) -> Column:
    """The document without keys at any depth; values of anchor keys that are in unknown become 'unknown'."""
    def clean(text):
        v = parsed(text)
        return None if v is None else canonical(walk(v, lambda _, k, c: (k not in keys, "unknown" if k in anchors and c in unknown else c)))

    return _mapped(clean, "string")(doc)


def removed_keys(doc: Column, keys: tuple[str, ...]) -> Column:
    """How many keys without_keys removes."""
    def count(text):
        found: list[str] = []
        walk(parsed(text), lambda _, k, c: (not (k in keys and not found.append(k)), c))
        return len(found)

    return _mapped(count, "int")(doc)


def matching_values(doc: Column, values: tuple[str, ...]) -> Column:
    """How many strings of the document, at any depth, are one of values."""
    def count(value) -> int:
        if isinstance(value, dict):
            return sum(map(count, value.values()))
        return sum(map(count, value)) if isinstance(value, list) else int(isinstance(value, str) and value in values)

    return _mapped(lambda t: count(parsed(t)), "int")(doc)


def prohibited_keys(doc: Column, tokens: tuple[str, ...]) -> Column:
    """Paths of keys, at any depth, that contain one of the tokens."""
    def find(text):
        found: list[str] = []
        walk(parsed(text), lambda at, k, c: (True, c) if not any(t in k.lower() for t in tokens) else (found.append(at) is None, c))
        return found

    return _mapped(find, "array<string>")(doc)


def remap_digests(doc: Column, table: dict[str, str]) -> Column:
    """The document with every string that is a key of the table replaced, wherever it stands. The table is one run's migration."""
    def swap(value):
        if isinstance(value, str):
            return table.get(value, value)
        if isinstance(value, list):
            return [swap(v) for v in value]
        return {k: swap(v) for k, v in value.items()} if isinstance(value, dict) else value

    return _mapped(lambda t: None if (v := parsed(t)) is None else canonical(swap(v)), "string")(doc)


FENCE = re.compile(r"`{3,}[ \t]*\w*")


def first_object(text: str | None) -> str | None:
    """The first JSON object in free text, None if there is none. Marks of code fences (three backticks and a word) don't count."""
    said = FENCE.sub(" ", text or "")
    for brace in re.finditer(r"\{", said):
        try:
            value = json.JSONDecoder().raw_decode(said, brace.start())[0]
        except ValueError:
            continue
        return canonical(value)
    return None


def extract_json(text: Column) -> Column:
    return _mapped(first_object, "string")(text)


def merge(base: dict, patch: dict) -> dict:
    """base with patch laid over it, objects merged key by key."""
    return {**base, **{k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in patch.items()}}
