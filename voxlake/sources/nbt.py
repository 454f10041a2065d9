"""Named binary tags: compounds of typed values, in either byte order.

Values keep their type as ``(kind, value)``; kinds are byte, short, int, long,
float, double, bytes, string, list, compound, ints, longs. Which byte order and
string length form a file uses is outside the world format, so both are
parameters: ``big``, ``little``, or ``network`` (little-endian with varints).
"""

from __future__ import annotations

import struct

from .codec import FormatError, Reader, Writer

#: Tag numbers.
KINDS = ["end", "byte", "short", "int", "long", "float", "double", "bytes", "string", "list", "compound", "ints", "longs"]
_PLAIN = {"byte": "b", "short": "h", "int": "i", "long": "q", "float": "f", "double": "d"}


def _number(r: Reader, code: str, order: str):
    if order == "network" and code in "iq":
        return r.varint()
    return struct.unpack((">" if order == "big" else "<") + code, r.take(struct.calcsize(code)))[0]


def _text(r: Reader, order: str) -> str:
    if order == "network":
        n = shift = 0
        while True:
            octet = r.take(1)[0]
            n |= (octet & 127) << shift
            shift += 7
            if octet < 128 or shift > 28:
                break
    else:
        n = _number(r, "H", order)
    return bytes(r.take(n, "nbt string")).decode("utf-8", "replace")


def _value(r: Reader, kind: str, order: str, depth: int = 0):
    if depth > 512:
        raise FormatError("tags nest too deep")
    if kind in _PLAIN:
        return kind, _number(r, _PLAIN[kind], order)
    if kind == "string":
        return kind, _text(r, order)
    if kind == "compound":
        out = {}
        while (tag := r.take(1)[0]) != 0:
            if tag >= len(KINDS):
                raise FormatError(f"tag {tag}")
            name = _text(r, order)
            out[name] = _value(r, KINDS[tag], order, depth + 1)
        return kind, out
    if kind == "list":
        tag, n = r.take(1)[0], _number(r, "i", order)
        if tag >= len(KINDS) or n < 0 or n > r.left() + 1:
            raise FormatError("list header")
        return kind, (KINDS[tag], [_value(r, KINDS[tag], order, depth + 1)[1] for _ in range(n)] if tag else [])
    n = _number(r, "i", order)
    if n < 0 or n > r.left():
        raise FormatError("array length")
    if kind == "bytes":
        return kind, bytes(r.take(n))
    return kind, [_number(r, "i" if kind == "ints" else "q", order) for _ in range(n)]


#: Kinds of fixed width by tag, and all tags by kind.
_CODES = [_PLAIN.get(k) for k in KINDS]
_WIDTHS = [struct.calcsize(f"<{c}") if c else 0 for c in _CODES]
_TAGS = {k: i for i, k in enumerate(KINDS)}


def _at(data: bytes, at: int, tag: int, end: str, depth: int = 0) -> tuple:
    """The value at ``at`` and where it ends, in an order of fixed widths; reading on past the end raises one of several errors."""
    code = _CODES[tag]
    if code:
        return struct.unpack_from(end + code, data, at)[0], at + _WIDTHS[tag]
    if depth > 512:
        raise FormatError("tags nest too deep")
    if tag == 8:
        n = struct.unpack_from(end + "H", data, at)[0]
        begin, at = at + 2, at + 2 + n
        if at > len(data):
            raise FormatError("nbt string")
        return data[begin:at].decode("utf-8", "replace"), at
    if tag == 10:
        out = {}
        while (sub := data[at]) != 0:
            if sub >= len(KINDS):
                raise FormatError(f"tag {sub}")
            name, at = _at(data, at + 1, 8, end)
            value, at = _at(data, at, sub, end, depth + 1)
            out[name] = (KINDS[sub], value)
        return out, at + 1
    if tag == 9:
        sub, n = data[at], struct.unpack_from(end + "i", data, at + 1)[0]
        at += 5
        if sub >= len(KINDS) or n < 0 or n > len(data) - at + 1:
            raise FormatError("list header")
        if _CODES[sub]:
            return (KINDS[sub], list(struct.unpack_from(f"{end}{n}{_CODES[sub]}", data, at))), at + n * _WIDTHS[sub]
        items = []
        for _ in range(n if sub else 0):
            item, at = _at(data, at, sub, end, depth + 1)
            items.append(item)
        return (KINDS[sub], items), at
    n = struct.unpack_from(end + "i", data, at)[0]
    at += 4
    if n < 0 or n > len(data) - at:
        raise FormatError("array length")
    if tag == 7:
        return data[at : at + n], at + n
    code, width = ("i", 4) if tag == 11 else ("q", 8)
    return list(struct.unpack_from(f"{end}{n}{code}", data, at)), at + n * width


def decode(data: bytes, order: str = "little") -> dict:
    """The root compound, name -> (kind, value); no bytes are an empty compound."""
    if not data:
        return {}
    if order != "network":
        data, end = bytes(data), ">" if order == "big" else "<"
        if data[0] != _TAGS["compound"]:
            raise FormatError("the root is not a compound")
        try:
            return _at(data, _at(data, 1, 8, end)[1], 10, end)[0]
        except (struct.error, IndexError) as e:
            raise FormatError("tags end early") from e
    r = Reader(data)
    if r.take(1)[0] != KINDS.index("compound"):
        raise FormatError("the root is not a compound")
    _text(r, order)
    return _value(r, "compound", order)[1]


def _put_number(w: Writer, code: str, value, order: str) -> None:
    if order == "network" and code in "iq":
        w.varint(value)
    else:
        w.parts.write(struct.pack((">" if order == "big" else "<") + code, value))


def _put_text(w: Writer, text: str, order: str) -> None:
    data = text.encode()
    if order == "network":
        n = len(data)
        while n > 127:
            w.parts.write(bytes([n & 127 | 128]))
            n >>= 7
        w.parts.write(bytes([n]))
    else:
        _put_number(w, "H", len(data), order)
    w.parts.write(data)


def _put(w: Writer, kind: str, value, order: str) -> None:
    if kind in _PLAIN:
        _put_number(w, _PLAIN[kind], value, order)
    elif kind == "string":
        _put_text(w, value, order)
    elif kind == "compound":
        for name in sorted(value):
            sub, inner = value[name]
            w.parts.write(bytes([KINDS.index(sub)]))
            _put_text(w, name, order)
            _put(w, sub, inner, order)
        w.parts.write(b"\0")
    elif kind == "list":
        sub, items = value
        w.parts.write(bytes([KINDS.index(sub)]))
        _put_number(w, "i", len(items), order)
        for item in items:
            _put(w, sub, item, order)
    elif kind == "bytes":
        _put_number(w, "i", len(value), order)
        w.parts.write(value)
    else:
        _put_number(w, "i", len(value), order)
        for item in value:
            _put_number(w, "i" if kind == "ints" else "q", item, order)


def _string(text: str, end: str) -> bytes:
    data = text.encode()
    return struct.pack(end + "H", len(data)) + data


def _emit(out: list[bytes], tag: int, value, end: str) -> None:
    """``_put`` for orders of fixed widths."""
    code = _CODES[tag]
    if code:
        out.append(struct.pack(end + code, value))
    elif tag == 8:
        out.append(_string(value, end))
    elif tag == 10:
        for name in sorted(value):
            kind, inner = value[name]
            sub = _TAGS[kind]
            out.append(bytes((sub,)) + _string(name, end))
            _emit(out, sub, inner, end)
        out.append(b"\0")
    elif tag == 9:
        kind, items = value
        sub = _TAGS[kind]
        out.append(struct.pack(end + "Bi", sub, len(items)))
        if _CODES[sub]:
            out.append(struct.pack(f"{end}{len(items)}{_CODES[sub]}", *items))
        else:
            for item in items:
                _emit(out, sub, item, end)
    elif tag == 7:
        out.append(struct.pack(end + "i", len(value)) + value)
    else:
        out.append(struct.pack(f"{end}i{len(value)}{'i' if tag == 11 else 'q'}", len(value), *value))


def encode(compound: dict, order: str = "little") -> bytes:
    """A root compound without a name; keys in order, so equal compounds have equal bytes."""
    if order != "network":
        out = [b"\x0a\0\0"]
        _emit(out, _TAGS["compound"], compound, ">" if order == "big" else "<")
        return b"".join(out)
    w = Writer()
    w.parts.write(bytes([KINDS.index("compound")]))
    _put_text(w, "", order)
    _put(w, "compound", compound, order)
    return w.done()


def plain(compound: dict) -> dict[str, str]:
    """The scalar values of a compound as text."""
    return {k: str(v) for k, (kind, v) in compound.items() if kind in _PLAIN or kind == "string"}
