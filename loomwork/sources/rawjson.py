"""Reading raw JSON columns inside Arrow batches.

A value may be held as a JSON string that holds the object; unreadable text gives None. Nesting of
any depth is read: the C scanner gives up at a few thousand levels, after which an explicit stack takes over.
"""

from __future__ import annotations

import json
import re

_DECODER = json.JSONDecoder()
_STRING = json.decoder.scanstring
_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|true|false|null|NaN|-?Infinity")
_NAMED = {"true": True, "false": False, "null": None}


class Located(str):
    """A decoded string that knows where each of its characters stands in the raw text it was read from."""

    source: "Located | None" = None
    starts: list[int]

    def raw(self, at: int) -> int:
        """The place in the raw text of character at; of the closing quote for the string's length."""
        here = self.starts[at]
        return self.source.raw(here) if self.source is not None else here


#: A character of a quoted string: an escaped pair of surrogates is one.
_CHARACTER = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]", re.S)


def _deep(text: str, located: bool = False):
    """Parse without recursion. located: strings come as Located."""
    root: list = []
    stack: list = [root]
    key: list = [None]
    pos = _BLANK.match(text, 0).end()
    want = "value"
    while True:
        ch = text[pos : pos + 1]
        if want in ("value", "first") and ch != "]":
            if ch == "{" or ch == "[":
                new: dict | list = {} if ch == "{" else []
                _put(stack[-1], key, new)
                stack.append(new)
                key.append(None)
                pos, want = pos + 1, "key1" if ch == "{" else "first"
            else:
                if ch == '"':
                    begin = pos + 1
                    value, pos = _STRING(text, begin)
                    if located:
                        value = Located(value)
                        value.source = text if isinstance(text, Located) else None
                        value.starts = [m.start() for m in _CHARACTER.finditer(text, begin, pos - 1)] + [pos - 1]
                else:
                    m = _ATOM.match(text, pos)
                    if not m:
                        raise ValueError("value expected")
                    word, pos = m.group(), m.end()
                    value = _NAMED[word] if word in _NAMED else float(word) if re.search("[.eEIN]", word) else int(word)
                _put(stack[-1], key, value)
                want = "next"
        elif want in ("key", "key1"):
            if ch == "}" and want == "key1":
                stack.pop(), key.pop()
                pos, want = pos + 1, "next"
            elif ch == '"':
                key[-1], pos = _STRING(text, pos + 1)
                pos = _BLANK.match(text, pos).end()
                if text[pos : pos + 1] != ":":
                    raise ValueError("colon expected")
                pos, want = pos + 1, "value"
            else:
                raise ValueError("key expected")
        elif want == "first" or (want == "next" and len(stack) > 1):
            top = stack[-1]
            if ch == "," and want == "next":
                pos, want = pos + 1, "key" if isinstance(top, dict) else "value"
            elif ch == ("}" if isinstance(top, dict) else "]"):
                stack.pop(), key.pop()
                pos, want = pos + 1, "next"
            else:
                raise ValueError("delimiter expected")
        else:
            raise ValueError("unexpected text")
        pos = _BLANK.match(text, pos).end()
        if want == "next" and len(stack) == 1:
            if pos != len(text):
                raise ValueError("text after the value")
            return root[0]


def _put(holder, key, value) -> None:
    if isinstance(holder, dict):
        holder[key[-1]] = value
    else:
        holder.append(value)


def parse(text: str | None):
    """The value of a JSON text; None if it is null, unreadable or absent."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except RecursionError:
        try:
            return _deep(text)
        except (ValueError, IndexError, KeyError):
            return None
    except ValueError:
        return None


def parse_located(text: str | None):
    """parse, whose strings are Located; slower, for the rows of which something is to be changed in place."""
    try:
        return None if text is None else _deep(text, located=True)
    except (ValueError, IndexError, KeyError):
        return None


def opened_located(value):
    """opened for located values."""
    for _ in range(2):
        if isinstance(value, str):
            inner = parse_located(value)
            if isinstance(inner, (dict, list, str)):
                value = inner
    return value


def opened(value):
    """value, or the object or array that it holds as a JSON string."""
    if isinstance(value, str):
        inner = parse(value)
        if isinstance(inner, str):
            inner = parse(inner)
        if isinstance(inner, (dict, list)):
            return inner
    return value


def message_parts(text: str | None) -> list[tuple[int, dict]]:
    """(position, part) of each object in content; string content is one text part at 0."""
    message = opened(parse(text))
    if not isinstance(message, dict):
        return []
    content = message.get("content")
    if isinstance(content, str):
        return [(0, {"type": "text", "text": content})]
    if isinstance(content, list):
        return [(i, p) for i, p in enumerate(content) if isinstance(p, dict)]
    return []


def result_value(text: str | None):
    """tool_use_result as an object or array, or as the plain text that it is."""
    if text is None:
        return None
    value = parse(text)
    return text if value is None and text.strip() != "null" else opened(value)


def strings(value) -> list[str]:
    """Every string below value, in document order, without recursion."""
    found, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            stack.extend(reversed(x.values()))
    return found
