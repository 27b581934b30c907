"""Patterns written for Python's ``re`` as equivalent patterns of the JVM.

The two differ in white space, word borders, line ends and group references;
each difference is spelt out here, so the rule tables can stay as they are.
"""

from __future__ import annotations

import re

#: Members of Python's Unicode white space, for use inside a class.
SPACE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as text.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: White space without line breaks.
BLANK = r" \t\x0b\x0c\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"[\p{L}\p{N}_]"
BORDER = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def pattern(source: str, multiline: bool = False) -> str:
    """``source`` for the JVM: same matches as in Python on any text."""
    out, at, inside = [], 0, False
    while at < len(source):
        two = source[at : at + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\b" and not inside:
            out.append(BORDER)
        elif two[0] == "\\":
            out.append(two)
        else:
            if two[0] == "[" and inside:
                out.append("\\")  # a bracket inside a class is plain in Python
            elif two[0] == "&" and inside:
                out.append("\\")
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            at += 1
            continue
        at += 2
    return ("(?md)" if multiline else "(?d)" if "$" in source or "^" in source else "") + "".join(out)


def replacement(source: str) -> str:
    """Group references in the JVM's way."""
    return re.sub(r"\\(\d)", r"$\1", source.replace("$", r"\$"))
