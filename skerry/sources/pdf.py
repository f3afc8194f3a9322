"""Text of PDF files: the strings that content streams show.

Streams are plain or deflated. Strings are read as UTF-16 if they say so, else as
Windows-1252; fonts with their own glyph numbering, encryption and scanned pages
give no text.
"""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<((?:[^<>]|<[^<]|>[^>]|<<.*?>>)*)>>\s*stream\r?\n", re.S)
#: Strings, hexadecimal strings, numbers, names and operators of a content stream.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
#: A kerning step of a shown array that is as wide as a blank.
_WIDE = -180.0


def _plain(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:

        def unescaped(m):
            c = m.group(1)
            if c[:1].isdigit():
                return bytes([int(c, 8) & 255])
            return _ESCAPES.get(c, b"" if c in (b"\n", b"\r", b"\r\n") else c)

        raw = _ESCAPE.sub(unescaped, token[1:-1])
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    out, args, inside = [], [], False
    for token in _TOKEN.findall(content):
        if token in (b"BT", b"ET"):
            inside = token == b"BT"
            out.append("\n")
            args = []
        elif not inside:
            continue
        elif token[:1] in b"(<":
            args.append(_plain(token))
        elif re.fullmatch(rb"[-+.\d]+", token):
            args.append(token)
        elif token in (b"[", b"]") or token[:1] == b"/":
            continue
        else:
            if token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"'):
                    out.append("\n")
                for x in args:
                    if isinstance(x, str):
                        out.append(x)
                    elif token == b"TJ" and float(x) <= _WIDE:
                        out.append(" ")
            elif token == b"T*" or (token in (b"Td", b"TD", b"Tm") and args and float(args[-1]) != 0):
                out.append("\n")
            elif token in (b"Td", b"TD"):
                out.append(" ")
            args = []
    return "".join(out)


def pdf_text(data: bytes) -> str | None:
    """The text of a PDF file, lines in the order of the file; null if it isn't one or shows none."""
    if not data.lstrip()[:5] == b"%PDF-" or b"/Encrypt" in data:
        return None
    parts = []
    for m in _STREAM.finditer(data):
        head, at = m.group(1), m.end()
        if b"/Image" in head or (b"/Filter" in head and b"/FlateDecode" not in head):
            continue
        body = data[at : data.find(b"endstream", at)]
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(data[at:])
            except zlib.error:
                continue
        if b"BT" in body:
            parts.append(_shown(body))
    lines = (" ".join(x.split()) for x in "\n".join(parts).split("\n"))
    return "\n".join(x for x in lines if x) or None
