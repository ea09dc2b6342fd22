"""Patterns of the `where` language, written again for the engine that runs them.

The language has the syntax and meaning of linear-time regular expressions: ASCII classes, `.` that stops at line feeds
only, `$` that is the very end, POSIX classes, two spellings of named groups, case folding over all of Unicode. Java reads
much of the same text in another way, so a pattern is parsed and every part is emitted with its meaning spelled out.
Groups are not captured: a test only asks whether there is a match. What has no equivalent is refused.
"""
from __future__ import annotations

import re

from rowproof.errors import PredicateError

# ASCII classes by name, as code point ranges.
CLASSES = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\x00\x7f", "blank": "\t\t  ", "cntrl": "\x00\x1f\x7f\x7f", "digit": "09",
    "graph": "!~", "lower": "az", "print": " ~", "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ", "word": "09AZaz__", "xdigit": "09AFaf",
}
SHORT = {"d": "09", "w": "09AZaz__", "s": "\t\n\f\r  "}
CONTROLS = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
_REPEAT = re.compile(r"\{\d+(,\d*)?\}")
_GROUP = re.compile(r"\?(?:P?<(?P<name>\w+)>|(?P<flags>[imsU]*(?:-[imsU]+)?)(?P<end>[:)]))")
_WORD = "[0-9A-Za-z_]"
ANY = r"[\x{0}-\x{10FFFF}]"


def _ranges(pairs: str) -> list[tuple[int, int]]:
    return [(ord(pairs[i]), ord(pairs[i + 1])) for i in range(0, len(pairs), 2)]


def _outside(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, low = [], 0
    for a, b in sorted(ranges):
        if a > low:
            out.append((low, a - 1))
        low = max(low, b + 1)
    return out + ([(low, 0x10FFFF)] if low <= 0x10FFFF else [])


def _set(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]"


class _Pattern:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def refused(self, what: str) -> PredicateError:
        return PredicateError(f"the pattern {self.text!r} holds {what}, which has no equivalent here")

    def take(self, count: int = 1) -> str:
        found = self.text[self.at:self.at + count]
        self.at += count
        return found

    def rest(self) -> str:
        return self.text[self.at:]

    def alternatives(self, flags: frozenset[str], open_: bool) -> str:
        """Up to the closing bracket, if one is open; flags set on the way hold to its end."""
        out: list[str] = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == ")" and open_:
                break
            if c == "|":
                self.take()
                out.append("|")
                continue
            if c == "(" and (group := _GROUP.match(self.text, self.at + 1)) and group["end"] == ")":
                flags = self.flagged(flags, group["flags"])
                self.at = group.end()
                continue
            if self.text.startswith(r"\Q", self.at):
                end = self.text.find(r"\E", self.at)
                literal = self.text[self.at + 2:end if end >= 0 else len(self.text)]
                self.at = end + 2 if end >= 0 else len(self.text)
                out += [self.cased(_set([(ord(x), ord(x))]), flags) for x in literal[:-1]]
                if not literal:
                    continue
                atom = self.cased(_set([(ord(literal[-1]), ord(literal[-1]))]), flags)
            else:
                atom = self.atom(flags)
            out.append(self.repeated(atom, flags))
        return "".join(out)

    @staticmethod
    def flagged(flags: frozenset[str], change: str) -> frozenset[str]:
        on, _, off = change.partition("-")
        return (flags | set(on)) - set(off)

    @staticmethod
    def cased(atom: str, flags: frozenset[str]) -> str:
        return f"(?iu:{atom})" if "i" in flags else atom

    def repeated(self, atom: str, flags: frozenset[str]) -> str:
        while self.at < len(self.text):
            if self.text[self.at] in "*+?":
                count = self.take()
            elif found := _REPEAT.match(self.text, self.at):
                count = found.group()
                self.at = found.end()
            else:
                break
            lazy = self.text[self.at:self.at + 1] == "?"
            self.at += lazy
            atom = f"(?:{atom}){count}{'?' if lazy != ('U' in flags) else ''}"
        return atom

    def atom(self, flags: frozenset[str]) -> str:
        c = self.take()
        if c == "(":
            inner = flags
            if self.text[self.at:self.at + 1] == "?":
                group = _GROUP.match(self.text, self.at)
                if not group:
                    raise self.refused(f"({self.rest()[:3]}")
                inner = self.flagged(flags, group["flags"] or "")
                self.at = group.end()
            body = self.alternatives(inner, True)
            self.take()
            return f"(?:{body})"
        if c == "[":
            return self.cased(self.members(), flags)
        if c == ".":
            return ANY if "s" in flags else _set(_outside([(10, 10)]))
        if c == "^":
            return r"(?<![^\n])" if "m" in flags else r"\A"
        if c == "$":
            return r"(?![^\n])" if "m" in flags else r"\z"
        if c == "\\":
            return self.escaped(flags)
        return self.cased(_set([(ord(c), ord(c))]), flags)

    def escaped(self, flags: frozenset[str]) -> str:
        c = self.text[self.at:self.at + 1]
        edge = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
        simple: dict[str, str] = {"A": r"\A", "z": r"\z", "b": edge, "B": f"(?!{edge})"}
        if c in simple:
            self.take()
            return simple[c]
        if c == "C":
            raise self.refused(r"\C")
        found = self.shorthand()
        if found is not None:
            return self.cased(found, flags)
        code = self.code()
        return self.cased(_set([(code, code)]), flags)

    def shorthand(self) -> str | None:
        """A class after a backslash, as a set; null if it is a single character."""
        c = self.text[self.at:self.at + 1]
        if c and c in "dwsDWS":
            self.take()
            ranges = _ranges(SHORT[c.lower()])
            return _set(_outside(ranges) if c.isupper() else ranges)
        if c and c in "pP":
            self.take()
            name = self.take()
            if name == "{":
                end = self.text.index("}", self.at)
                name, self.at = self.text[self.at:end], end + 1
            negated = (c == "P") != name.startswith("^")
            name = name.lstrip("^")
            if name == "Any":
                return r"(?!)" if negated else ANY
            # One or two letters name a general category, longer names a script.
            known = name if len(name) <= 2 else f"Is{name}"
            return f"\\{'P' if negated else 'p'}{{{known}}}"
        return None

    def code(self) -> int:
        """The character after a backslash."""
        c = self.take()
        if c in CONTROLS:
            return CONTROLS[c]
        if c == "x":
            if self.text[self.at:self.at + 1] == "{":
                end = self.text.index("}", self.at)
                code, self.at = int(self.text[self.at + 1:end], 16), end + 1
                return code
            return int(self.take(2), 16)
        if c in "01234567":
            digits = c
            while len(digits) < 3 and self.text[self.at:self.at + 1] in tuple("01234567"):
                digits += self.take()
            return int(digits, 8)
        if c.isalnum():
            raise self.refused(f"\\{c}")
        return ord(c)

    def members(self) -> str:
        """A bracketed class: plain characters as one set, classes of Unicode beside it."""
        negated = self.text[self.at:self.at + 1] == "^"
        self.at += negated
        ranges: list[tuple[int, int]] = []
        others: list[str] = []
        first = True
        while first or self.text[self.at] != "]":
            first = False
            if posix := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at):
                self.at = posix.end()
                found = _ranges(CLASSES[posix[2]])
                ranges += _outside(found) if posix[1] else found
                continue
            if self.text[self.at] == "\\":
                self.take()
                if (known := self.shorthand()) is not None:
                    others.append(known)
                    continue
                low = self.code()
            else:
                low = ord(self.take())
            high = low
            if self.text[self.at:self.at + 1] == "-" and self.text[self.at + 1:self.at + 2] not in ("]", ""):
                self.take()
                high = ord(self.take()) if self.text[self.at] != "\\" else (self.take() and self.code())
            ranges.append((low, high))
        self.take()
        if not others:
            return _set(_outside(ranges)) if negated and _outside(ranges) else _set(ranges) if not negated else "(?!)"
        either = "|".join(([_set(ranges)] if ranges else []) + others)
        return f"(?:(?!{either}){ANY})" if negated else f"(?:{either})"


def engine_pattern(pattern: str) -> str:
    """The pattern as Java reads it. It has to be one that the linear-time engine accepts."""
    return _Pattern(pattern).alternatives(frozenset(), False)

