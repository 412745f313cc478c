"""POSIX extended regular expressions in Java's dialect, for ``rlike``."""

from __future__ import annotations

from colligate.errors import OptionError

# POSIX character classes and the Java classes with the same members.
CLASSES = {
    "alpha": r"\p{IsAlphabetic}",
    "digit": "0-9",
    "alnum": r"\p{IsAlphabetic}\p{IsDigit}",
    "upper": r"\p{IsUppercase}",
    "lower": r"\p{IsLowercase}",
    "space": r"\s\x0B\p{Zs}",
    "blank": r" \t\p{Zs}",
    "punct": r"\p{IsPunctuation}\p{S}",
    "print": r"\P{C}",
    "graph": r"\P{C}&&[^\p{Z}]",
    "cntrl": r"\p{Cc}",
    "xdigit": "0-9A-Fa-f",
}


def to_java(pattern: str) -> str:
    """The pattern for Java; what is not an extended regular expression raises."""
    out, at, n = ["(?s)"], 0, len(pattern)
    while at < n:
        ch = pattern[at]
        if ch == "[":
            text, at = _bracket(pattern, at)
            out.append(text)
            continue
        if ch == "\\":
            if at + 1 == n:
                raise OptionError("a backslash ends the pattern")
            follows = pattern[at + 1]
            if follows.isalnum():
                raise OptionError(f"\\{follows} is not part of an extended regular expression")
            out.append("\\" + follows)
            at += 2
            continue
        if ch in "*+?" and at + 1 < n and pattern[at + 1] in "+?":
            raise OptionError("possessive and reluctant quantifiers are not part of extended regular expressions")
        if pattern.startswith("(?", at):
            raise OptionError("(? is not part of an extended regular expression")
        out.append(r"\z" if ch == "$" else ch)
        at += 1
    return "".join(out)


def _bracket(pattern: str, at: int) -> tuple[str, int]:
    """The bracket expression at ``at``, and where it ends."""
    k, out = at + 1, ["["]
    if pattern[k : k + 1] == "^":
        out.append("^")
        k += 1
    first = True
    while True:
        if k >= len(pattern):
            raise OptionError("a bracket expression has no end")
        ch = pattern[k]
        if ch == "]" and not first:
            return "".join([*out, "]"]), k + 1
        first = False
        if pattern.startswith("[:", k):
            end = pattern.find(":]", k)
            name = pattern[k + 2 : end]
            if end < 0 or name not in CLASSES:
                raise OptionError(f"unknown character class in {pattern!r}")
            out.append(f"[{CLASSES[name]}]")
            k = end + 2
            continue
        if pattern.startswith(("[=", "[."), k):
            raise OptionError("collating elements are not supported")
        out.append("\\" + ch if ch in "\\[]&^~" else ch)
        k += 1
