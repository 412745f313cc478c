"""Numbers as C's ``printf`` writes them, and strings escaped for each format."""

from __future__ import annotations

import json
import re


def g(value: float, digits: int) -> str:
    return "%.*g" % (digits, value)


def json_string(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def script_string(text: str) -> str:
    """A JSON string that can stand in a script element."""
    return json_string(text).replace("<", "\\u003c")


def dot_string(text: str) -> str:
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + re.sub(r'["\\\x00-\x1f]', lambda m: named.get(m[0], f"\\x{ord(m[0]):02x}"), text) + '"'


def markdown(text: str) -> str:
    return re.sub(r"([|\\])", r"\\\1", text).replace("\r", " ").replace("\n", " ")


def html(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(plain, entity)
    return text


#: TeX's special characters.
TEX = {
    "\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "_": r"\_", "%": r"\%",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}


def tex(text: str) -> str:
    return "".join(TEX.get(c, " " if c in "\r\n" else c) for c in text)
