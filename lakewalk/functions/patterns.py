"""Shell patterns and POSIX regular expressions as Java ones."""

from __future__ import annotations

import re

CLASSES = {
    "alpha": r"\p{Alpha}",
    "digit": r"\p{Digit}",
    "alnum": r"\p{Alnum}",
    "upper": r"\p{Upper}",
    "lower": r"\p{Lower}",
    "space": r"\s",
    "punct": r"\p{Punct}",
    "xdigit": r"\p{XDigit}",
    "blank": r" \t",
    "print": r"\p{Print}",
    "graph": r"\p{Graph}",
    "cntrl": r"\p{Cntrl}",
}


def _bracket(pattern: str, i: int) -> tuple[str, int] | None:
    """The bracket expression that opens at i as a Java class, and where it ends; None if it isn't closed."""
    j = i + 1
    negated = pattern[j : j + 1] in ("!", "^")
    j += negated
    inside, first = "", True
    while j < len(pattern):
        if pattern[j] == "]" and not first:
            return f"[{'^' if negated else ''}{inside}]", j + 1
        named = re.compile(r"\[:(\w+):\]").match(pattern, j)
        if named and named[1] in CLASSES:
            inside, j = inside + CLASSES[named[1]], named.end()
        else:
            inside += pattern[j] if pattern[j].isalnum() or pattern[j] in "-_ " else "\\" + pattern[j]
            j += 1
        first = False
    return None


def glob(pattern: str) -> str:
    """A shell pattern for a whole string. ``*`` and ``?`` match slashes too; a period at the start of the string is only
    matched by one in the pattern. Backslashes quote; a bracket that isn't closed stands for itself."""
    out, i = "", 0
    guard = "(?!\\.)"
    while i < len(pattern):
        c = pattern[i]
        start = guard if i == 0 else ""
        if c == "*":
            out, i = out + start + ".*", i + 1
        elif c == "?":
            out, i = out + start + ".", i + 1
        elif c == "[" and (found := _bracket(pattern, i)):
            out, i = out + start + found[0], found[1]
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return rf"(?s)\A(?:{out})\z"


def basic(pattern: str) -> str:
    """A POSIX basic regular expression, searched anywhere: ``\\( \\) \\{ \\}`` are operators and the bare characters
    literal; ``\\| \\+ \\?`` as common extensions; a star at the start of an expression is literal, as are ``^`` and ``$``
    within one."""
    out, i, start = "", 0, True
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "[" and (found := _bracket(pattern, i)):
            out, i, start = out + found[0], found[1], False
        elif two in (r"\(", r"\|"):
            out, i, start = out + two[1], i + 2, True
        elif two in (r"\)", r"\{", r"\}", r"\+", r"\?"):
            out, i, start = out + two[1], i + 2, False
        elif c == "\\" and len(two) == 2:
            out, i, start = out + (two if two[1].isdigit() or two[1] in "wWbBsS" else re.escape(two[1])), i + 2, False
        elif c == "*":
            out, i, start = out + (r"\*" if start else "*"), i + 1, start and False
        elif c == "^":
            out, i = out + ("^" if start else r"\^"), i + 1
        elif c == "$":
            end = i + 1 == len(pattern) or pattern[i + 1 : i + 3] in (r"\)", r"\|")
            out, i, start = out + (r"\z" if end else r"\$"), i + 1, False
        elif c in "+?|(){}":
            out, i, start = out + "\\" + c, i + 1, False
        else:
            out, i, start = out + (c if c == "." else re.escape(c)), i + 1, False
    return f"(?s){out}"


def extended(pattern: str) -> str:
    """A POSIX extended regular expression, searched anywhere. Bracket expressions are rewritten, the rest is alike."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "[" and (found := _bracket(pattern, i)):
            out, i = out + found[0], found[1]
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + pattern[i : i + 2], i + 2
        else:
            out, i = out + pattern[i], i + 1
    return f"(?s){out}"


def child_pattern(argument: str) -> str:
    """An argument of the shell's listing for one component: ``*`` stands for any characters, the rest is extended."""
    return extended("^" + argument.replace("*", ".*") + "$")
