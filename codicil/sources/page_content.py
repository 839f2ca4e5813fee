"""What is drawn on a page, from its content stream: images and how much of the page they cover, vector work, text that is not shown.

The stream's own language is read here (operands, then an operator); what opens a
document and finds its pages, resources and text is injected, so this runs with
any reader. ``inspector`` makes of it a function for ``corpus.inspect_pages``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

#: Fixed values of the page description language: operators that show text, and that paint paths or shadings.
SHOW_TEXT = frozenset((b"Tj", b"TJ", b"'", b'"'))
PAINT = frozenset((b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"sh"))
INVISIBLE = 3
#: Bytes of a page's stream at most.
MAX_STREAM = 50_000_000

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s()<>\[\]{}/%]*|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+|\(")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")


@dataclass
class Page:
    """A page as its reader gives it. xobjects: name to kind (Image, Form)."""

    content: bytes
    width: float
    height: float
    text: str = ""
    xobjects: dict[str, str] = field(default_factory=dict)


def _string_end(data: bytes, at: int) -> int:
    """Behind a string in round brackets, which may hold balanced ones and escapes."""
    depth = 1
    while at < len(data) and depth:
        c = data[at]
        at += 2 if c == 0x5C else 1
        depth += (c == 0x28) - (c == 0x29)
    return at


def operations(data: bytes) -> Iterator[tuple[list, bytes]]:
    """Operands and operator of each step. Numbers are floats, names start with a slash, strings and containers are given as they are not needed, by None."""
    operands: list = []
    at, nested = 0, 0
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token == b"(":
            at = _string_end(data, at)
            token = b"()"
        if token.startswith(b"%"):
            continue
        if token in (b"[", b"<<", b"{"):
            nested += 1
        elif token in (b"]", b">>", b"}"):
            nested = max(0, nested - 1)
            if not nested:
                operands.append(None)
        elif nested:
            continue
        elif token.startswith((b"(", b"<")):
            operands.append(None)
        elif token.startswith(b"/"):
            operands.append(token.decode("latin-1"))
        elif _NUMBER.match(token):
            operands.append(float(token))
        else:
            if token == b"ID":  # an image within the stream: bytes up to EI
                end = re.compile(rb"\sEI(?=\s|$)").search(data, at)
                at = end.end() if end else len(data)
                token = b"BI"
            elif token == b"BI":
                operands = []
                continue
            yield operands, token
            operands = []


def _times(m: tuple, n: tuple) -> tuple:
    """The matrix that applies m first, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def evidence(page: Page) -> dict:
    """Counts and coverage of one page; an error where its stream is too large."""
    if len(page.content) > MAX_STREAM:
        return {"inspection_error": "content_stream_too_large", "content_stream_bytes": len(page.content)}
    state, stack = ((1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 0), []  # matrix, text mode
    found = {"text_show_operations": 0, "image_count": 0, "vector_operations": 0, "unresolved_xobjects": 0}
    hidden, cover, area = 0, 0.0, abs(page.width * page.height)

    def image() -> float:
        a, b, c, d = state[0][:4]
        found["image_count"] += 1
        return min(abs(a * d - b * c) / area, 1.0) if area else 0.0

    for operands, op in operations(page.content):
        if op == b"q":
            stack.append(state)
        elif op == b"Q":
            state = stack.pop() if stack else state
        elif op == b"cm" and len(operands) == 6 and None not in operands:
            state = (_times(tuple(operands), state[0]), state[1])
        elif op == b"Tr" and operands and isinstance(operands[0], float):
            state = (state[0], int(operands[0]))
        elif op in SHOW_TEXT:
            found["text_show_operations"] += 1
            hidden += state[1] == INVISIBLE
        elif op in PAINT:
            found["vector_operations"] += 1
        elif op == b"BI":
            cover = max(cover, image())
        elif op == b"Do" and operands:
            kind = page.xobjects.get(str(operands[-1]))
            if kind is None:
                found["unresolved_xobjects"] += 1
            elif kind == "Image":
                cover = max(cover, image())
    return found | {"invisible_text": hidden > 0, "dominant_image_coverage": round(cover, 6), "content_stream_bytes": len(page.content), "inspection_error": None}


def inspector(pages_of: Callable[[bytes], Iterable[Page]]) -> Callable[[bytes], Iterator[dict]]:
    """For ``corpus.inspect_pages``: text and evidence of each page; a page that fails is its own result and hides no other."""

    def run(content: bytes) -> Iterator[dict]:
        for number, page in enumerate(pages_of(content), 1):
            try:
                yield {"pdf_page": number, "text": page.text} | evidence(page)
            except Exception as e:  # noqa: BLE001
                yield {"pdf_page": number, "text": None, "inspection_error": f"{type(e).__name__}: {e}"}

    return run


SCHEMA = (
    "source_id string, pdf_page int, text string, text_show_operations int, image_count int, vector_operations int, unresolved_xobjects int, invisible_text boolean,"
    " dominant_image_coverage double, content_stream_bytes long, inspection_error string")
