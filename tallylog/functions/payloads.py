"""Reading JSON payloads whose fields nobody declared."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

import xxhash


class _Fraction(float):
    """A number written with a fraction."""


class _Exponent(float):
    """A number written with an exponent and no fraction."""


def _number(text: str) -> float:
    return _Fraction(text) if "." in text else _Exponent(text)


def _reject(name: str) -> None:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_float=_number, parse_constant=_reject).decode


def _object(text: str) -> dict | None:
    try:
        found = _decode(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def read_object(payload: str | None) -> dict | None:
    """The JSON object that payload is, or decodes to as base64; None if it's neither (null, empty, broken, other JSON)."""
    if not payload:
        return None
    found = _object(payload)
    if found is None and payload.lstrip()[:1] != "{":
        try:
            found = _object(base64.b64decode(payload, validate=True).decode("utf-8"))
        except (binascii.Error, UnicodeDecodeError, ValueError):
            return None
    return found


def kind_of(value: object) -> str:
    """'string', 'integer', 'decimal', 'boolean' or 'array'."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return "array"
    return "decimal" if isinstance(value, _Fraction) else "integer"


def fields(record: dict, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of every value other than null; objects are descended into, arrays aren't."""
    todo = [(path, record)]
    while todo:
        at, node = todo.pop()
        for name, value in node.items():
            full = f"{at}.{name}" if at else name
            if isinstance(value, dict):
                todo.append((full, value))
            elif value is not None:
                yield full, value


def plain(value: object) -> str:
    """A value as text: strings as they are, numbers shortest, the rest as JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and not isinstance(value, bool):
        return str(int(value)) if value.is_integer() else repr(float(value))
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def fingerprint(value: object) -> bytes:
    """16 bytes that are equal for equal values; numbers compare by value, and never equal a string or boolean."""
    tag = "n" if isinstance(value, (int, float)) and not isinstance(value, bool) else kind_of(value)[0]
    return xxhash.xxh3_128_digest((tag + plain(value)).encode("utf-8", "surrogatepass"))


def clean(text: str) -> str:
    """Text that can be stored: lone surrogates become '?'."""
    return text.encode("utf-8", "replace").decode("utf-8")
