"""Items of batched replies: JSON however it was wrapped, listed or broken off."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

THOUGHT = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
FENCE = re.compile(r"^```[^\n]*\n(.*?)(?:\n?```\s*)?\Z", re.S)


def loaded(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def objects(value: object) -> list[dict] | None:
    """The objects of a list, or of the results of one object."""
    if isinstance(value, dict):
        value = value.get("results")
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else None


def balanced(text: str) -> tuple[list[dict], str]:
    """Whole objects that stand in the text one after another, and the rest from the first that isn't closed."""
    found, decoder, at = [], json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            found.append(value)
        at = text.find("{", end)
    return [x for x in found if isinstance(x, dict)], text


def repaired(text: str) -> list[dict] | None:
    """A reply that breaks off: cut behind its last whole value, its open brackets closed."""
    for end in [i + 1 for i in range(len(text) - 1, -1, -1) if text[i] in '}]"0123456789el'][:200]:
        stack, quoted, skip = [], False, False
        for ch in text[:end]:
            if skip:
                skip = False
            elif ch == "\\":
                skip = quoted
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif not quoted and ch in "}]" and stack:
                stack.pop()
        if not quoted and stack:
            value = loaded(text[:end] + "".join(reversed(stack)))
            found = objects(value) or ([value] if isinstance(value, dict) and "results" not in value else None)
            if found:
                return found
    return None


def items(reply: str | None) -> list[str]:
    """The items of a reply, each as JSON: of a results object, an array, lines, objects in running text, or what is whole of a reply that breaks off."""
    text = THOUGHT.sub("", reply or "").strip()
    if m := FENCE.match(text):
        text = m[1].strip()
    if text and text[0] not in "{[" and "{" in text:
        text = text[text.index("{") :]
    value = loaded(text)
    found = objects(value)
    if found is None:
        lines = [x for x in text.splitlines() if x.strip()]
        rows = [loaded(x) for x in lines]
        found = rows if len(rows) > 1 and all(isinstance(x, dict) for x in rows) else None
    if found is None:
        inner = re.search(r'"results"\s*:\s*\[', text)
        whole, _ = balanced(text[inner.end() :] if inner else text)
        found = whole or repaired(text) or []
    return [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in found]


def reply_items(reply: Column) -> Column:
    """An array of items as JSON; the parsing is sequential, so it runs in Arrow batches."""

    @F.pandas_udf("array<string>")
    def _items(s: pd.Series) -> pd.Series:
        return s.map(items)

    return _items(reply)
