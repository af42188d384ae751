"""Mode bits: types, permissions and changes of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewalk.schema import DIRECTORY, DIRECTORY_MODE, FILE, FORMAT_MASK, LINK, LINK_MODE, REGULAR, UNKNOWN

CLASSES = {"u": 6, "g": 3, "o": 0}
BITS = {"r": 4, "w": 2, "x": 1}


def format_bits(mode: Column) -> Column:
    return mode.bitwiseAND(FORMAT_MASK)


def type_of(mode: Column) -> Column:
    """The entry type of a mode; null for null."""
    f = format_bits(mode)
    return F.when(f == REGULAR, FILE).when(
        f == DIRECTORY_MODE, DIRECTORY
    ).when(f == LINK_MODE, LINK).when(mode.isNotNull(), UNKNOWN)


def permissions(mode: Column) -> Column:
    return mode.bitwiseAND(0o777)


def mode_string(mode: Column) -> Column:
    """Such as 'drwxr-x---'. The first letter is d, l or -; set-id and sticky bits aren't shown."""
    f = format_bits(mode)
    letters = [F.when(f == DIRECTORY_MODE, "d").when(f == LINK_MODE, "l").otherwise("-")]
    for shift in (6, 3, 0):
        letters += [F.when(mode.bitwiseAND(bit << shift) != 0, letter).otherwise("-") for letter, bit in BITS.items()]
    return F.when(mode.isNotNull(), F.concat(*letters))


@dataclass(frozen=True)
class Clause:
    """One change: for ``who`` (letters of ugo), add or remove ``what`` (letters of rwxX), or copy from class ``source``."""

    who: str
    operator: str
    what: str = ""
    source: str = ""
    masked: bool = False


def parse_change(text: str) -> int | list[Clause]:
    """'750' as bits, 'u+rwX,go-w,o=g' as clauses.

    Up to four octal digits are bits. Otherwise clauses follow each other, divided by commas: letters of ugoa (none: all,
    but for the umask), then + or - and letters of rwxX, or = and exactly one of u, g, o. ValueError for anything else.
    """
    if re.fullmatch("[0-7]{1,4}", text):
        return int(text, 8)
    clauses = []
    for part in filter(None, text.split(",")):
        found = re.fullmatch("([ugoa]*)(?:([+-])([rwxX]*)|(=)([ugo]))", part)
        if not found:
            raise ValueError(f"not a change of modes: {part!r}")
        who = "ugo" if not found[1] or "a" in found[1] else "".join(c for c in "ugo" if c in found[1])
        clauses.append(Clause(who, found[2] or "=", found[3] or "", found[5] or "", not found[1]))
    if not clauses:
        raise ValueError("no change of modes")
    return clauses


def _has(mode: Column, bits: int) -> Column:
    return mode.bitwiseAND(bits) != 0


def _set(mode: Column, bits: int, when: Column | None = None) -> Column:
    return mode.bitwiseOR(bits) if when is None else F.when(when, mode.bitwiseOR(bits)).otherwise(mode)


def _clear(mode: Column, bits: int, when: Column | None = None) -> Column:
    return mode.bitwiseAND(~bits) if when is None else F.when(when, mode.bitwiseAND(~bits)).otherwise(mode)


def changed(mode: Column, is_directory: Column, change: str, umask: int = 0o022) -> Column:
    """The low bits of the mode after a change; clauses apply from left to right.

    X for the user concerns directories only; for group and others +X follows the user's x (or adds it to directories)
    and -X always removes x. Clauses without letters of ugoa leave the bits of the umask as they were. Bits replace all
    twelve low bits. Null stays null.
    """
    parsed = parse_change(change)
    if isinstance(parsed, int):
        return F.when(mode.isNotNull(), F.lit(parsed))
    new = mode.bitwiseAND(0o7777)
    for clause in parsed:
        old = new
        if clause.operator == "=":
            source = F.shiftright(old, CLASSES[clause.source]).bitwiseAND(7)
            for c in clause.who:
                new = new.bitwiseAND(~(7 << CLASSES[c])).bitwiseOR(F.shiftleft(source, CLASSES[c]))
        else:
            for c in clause.who:
                shift = CLASSES[c]
                plain = sum(BITS[x] << shift for x in set(clause.what) if x in BITS)
                new = _set(new, plain) if clause.operator == "+" else _clear(new, plain)
                if "X" in clause.what:
                    bit = 1 << shift
                    if c == "u":
                        new = _set(new, bit, is_directory) if clause.operator == "+" else _clear(new, bit, is_directory)
                    else:
                        new = _set(
                            new, bit, _has(new, 0o100) | is_directory
                        ) if clause.operator == "+" else _clear(new, bit)
            if clause.masked:
                new = new.bitwiseAND(~umask & 0o7777).bitwiseOR(old.bitwiseAND(umask))
    return new


def overridden(mode: Column, kind: Column, file_bits: int | None = None, directory_bits: int | None = None) -> Column:
    """The mode with its low twelve bits replaced, for files and for directories; links keep theirs, and so does an entry
    for which no bits are given. Entries of other types go with the files."""
    new = mode
    if file_bits is not None:
        new = F.when((kind != DIRECTORY) & (kind != LINK), mode.bitwiseAND(~0o7777).bitwiseOR(file_bits)).otherwise(new)
    if directory_bits is not None:
        new = F.when(kind == DIRECTORY, mode.bitwiseAND(~0o7777).bitwiseOR(directory_bits)).otherwise(new)
    return new


def parse_override(text: str) -> tuple[int, int]:
    """'0750' or 'D0755,F0644' as (bits of files, bits of directories)."""
    if re.fullmatch("[0-7]{1,4}", text):
        return int(text, 8), int(text, 8)
    found = dict(re.findall("(?:^|,)([DF])([0-7]{1,4})(?=,|$)", text))
    if sorted(found) != ["D", "F"]:
        raise ValueError(f"not modes: {text!r}")
    return int(found["F"], 8), int(found["D"], 8)
