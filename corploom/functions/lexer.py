"""One scan of C-like text into tokens, and what is read off them.

Tokens are words, numbers, arrows and single marks, with their places.  With
``literals`` comments and quoted text are passed over; without, they are text
like any other.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .source_text import ACCESS_WIDTHS, DEFINITION, SCRUB

_MARK = r"[A-Za-z_]\w*|\d\w*|->|\S"
_PLAIN = re.compile(_MARK)
_LEXED = re.compile(rf'(?P<passed>"[^"\\]*+(?:\\.[^"\\]*+)*+"|\'[^\'\\]*+(?:\\.[^\'\\]*+)*+\'|/\*.*?\*/|//[^\n]*)|(?P<mark>{_MARK})', re.S)
_WORD = re.compile(r"[A-Za-z_]\w*")
_NUMBER = re.compile(r"0x[0-9a-fA-F]+|\d+")

#: Words before a bracket that are no calls.
KEYWORDS = {"if", "for", "while", "switch", "return", "sizeof", "case"}
#: Scalar types whose declarations tell the width of an element.
SCALARS = {
    "int", "uint", "short", "ushort", "char", "uchar", "byte", "undefined1", "undefined2", "undefined4", "undefined8",
    "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t",
}


class Tokens:
    def __init__(self, text: str, literals: bool = True):
        found = [m for m in _LEXED.finditer(text) if m["mark"]] if literals else list(_PLAIN.finditer(text))
        self.text = text
        self.mark = [m[0] for m in found]
        self.start = [m.start() for m in found]
        self.end = [m.end() for m in found]
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self._round()

    def _round(self) -> None:
        """``mate``: the other one of two round brackets, -1 where there is none; ``outer``: the open one round a token."""
        n = len(self.mark)
        self.mate, self.outer = [-1] * n, [-1] * n
        held: list[int] = []
        for k, mark in enumerate(self.mark):
            if mark == ")" and held:
                j = held.pop()
                self.mate[j], self.mate[k] = k, j
            self.outer[k] = held[-1] if held else -1
            if mark == "(":
                held.append(k)

    def __len__(self) -> int:
        return len(self.mark)

    def at(self, k: int) -> str:
        return self.mark[k] if 0 <= k < len(self.mark) else ""

    def is_word(self, k: int) -> bool:
        return bool(_WORD.match(self.at(k)))

    def is_number(self, k: int) -> bool:
        return bool(_NUMBER.fullmatch(self.at(k)))

    def apart(self, k: int) -> bool:
        """Whether white space or a comment stands before a token."""
        return k < len(self) and self.start[k] > self.end[k - 1]

    def line(self, place: int) -> int:
        return bisect_right(self.breaks, place - 1) + 1

    def line_text(self, place: int) -> str:
        begin = self.text.rfind("\n", 0, place) + 1
        stop = self.text.find("\n", place)
        return self.text[begin : stop if stop >= 0 else len(self.text)]


def scrub(text: str) -> str:
    """Comments gone and literals emptied, as ``source_text.scrubbed`` does."""
    for rx, new in SCRUB:
        text = re.sub(rx, new, text)
    return text


def without_literals(text: str) -> str:
    """Comments and quoted text as blanks, so that places stay what they are."""
    return _LEXED.sub(lambda m: m[0] if m["mark"] else " " * len(m[0]), text)


def access_width(kind: str) -> int:
    """Bytes of an access by its type's name; 0 for pointers and unknown types."""
    name = kind.replace(" ", "").lower()
    if "*" in name:
        return 0
    return next((n for how, part, n in ACCESS_WIDTHS if (part in name if how == "has" else part == name)), 0)


def number(mark: str) -> int | None:
    """A hex or decimal number as a signed 64-bit one; null if it is too large for that."""
    n = int(mark, 16) if mark.startswith("0x") else int(mark)
    return n if n < 1 << 63 else n - (1 << 64) if n < 1 << 64 else None


# memory accesses


def _displaced_at(tk: Tokens, k: int) -> tuple[int, int, int, int, str] | None:
    if tk.at(k + 1) != "(" or not tk.is_word(k + 2):
        return None
    n = k + 3
    while tk.at(n)[:1].isalnum() or tk.at(n)[:1] == "_":
        n += 1
    stars = 0
    while tk.at(n + stars) == "*":
        stars += 1
    kind = " ".join(tk.text[tk.start[k + 2] : tk.end[n + stars - 2 if stars == 2 else n - 1]].split())
    n += stars
    if not 1 <= stars <= 2 or tk.at(n) != ")" or tk.at(n + 1) != "(":
        return None
    n += 2
    while tk.at(n) == "(":  # casts of the base
        n += 1
        while tk.at(n) not in ("(", ")", ""):
            n += 1
        if tk.at(n) != ")":
            return None
        n += 1
    fits = tk.is_word(n) and tk.at(n + 1) == "+" and tk.is_number(n + 2) and tk.at(n + 3) == ")"
    return (k, n + 3, n, n + 2, kind) if fits else None


def displaced(tk: Tokens) -> list[tuple[int, int, int, int, str]]:
    """``*(type *)(base + number)``: first and last token, base, number and type of each; no two overlap."""
    out, k = [], 0
    while k < len(tk):
        got = _displaced_at(tk, k) if tk.mark[k] == "*" else None
        if got:
            out.append(got)
        k = got[1] + 1 if got else k + 1
    return out


def indexed(tk: Tokens) -> list[tuple[int, int, int, int]]:
    """``base[number]``: first and last token, base and number."""
    return [(k, k + 3, k, k + 2) for k in range(len(tk) - 3) if tk.mark[k + 1] == "[" and tk.mark[k + 3] == "]" and tk.is_word(k) and tk.is_number(k + 2)]


def scalar_declarations(tk: Tokens) -> list[tuple[str, str, int, int]]:
    """``int *name`` and ``int name[4]``: name, type, and the places where it begins and ends."""
    out = []
    for k in range(len(tk) - 2):
        if tk.mark[k] in SCALARS and tk.apart(k + 1):
            if tk.mark[k + 1] == "*" and tk.is_word(k + 2):
                out.append((tk.mark[k + 2], tk.mark[k], tk.start[k], tk.end[k + 2]))
            elif tk.is_word(k + 1) and tk.at(k + 2) == "[" and tk.is_number(k + 3) and tk.at(k + 4) == "]":
                out.append((tk.mark[k + 1], tk.mark[k], tk.start[k], tk.end[k + 4]))
    return out


def is_written(tk: Tokens, last: int) -> bool:
    """Whether one = follows, and no second one."""
    return tk.at(last + 1) == "=" and not (tk.at(last + 2) == "=" and not tk.apart(last + 2))


def arguments(tk: Tokens, opened: int) -> list[tuple[int, int]]:
    """First token of each argument of a call that is not blank, and the one after its last."""
    out, first = [], opened + 1
    for k in [*(k for k in range(opened + 1, tk.mate[opened]) if tk.mark[k] == "," and tk.outer[k] == opened), tk.mate[opened]]:
        if first < k:
            out.append((first, k))
        first = k + 1
    return out


def enclosing_call(tk: Tokens, k: int) -> tuple[str, int, int]:
    """Name, argument and number of arguments of the innermost call round a token."""
    opened = tk.outer[k]
    while opened >= 0:
        if tk.mate[opened] >= 0 and tk.is_word(opened - 1) and tk.mark[opened - 1] not in KEYWORDS:
            args = arguments(tk, opened)
            return tk.mark[opened - 1], next((n for n, (a, b) in enumerate(args) if a <= k < b), -1), len(args)
        opened = tk.outer[opened]
    return "", -1, 0


def plain_arguments(tk: Tokens) -> list[tuple[int, str, str]]:
    """``(place, callee, name)`` of each call argument that is a variable, or its address, casts apart."""
    out = []
    for opened, mark in enumerate(tk.mark):
        if mark != "(" or tk.mate[opened] < 0 or not tk.is_word(opened - 1):
            continue
        for a, b in arguments(tk, opened):
            while a < b and tk.mark[a] == "(" and 0 <= tk.mate[a] < b and "(" not in tk.mark[a + 1 : tk.mate[a]]:
                a = tk.mate[a] + 1
            if a < b and tk.mark[a] == "&":
                a += 1
            if b - a == 1 and tk.is_word(a):
                out.append((tk.start[opened], tk.mark[opened - 1], tk.mark[a]))
    return out


def statement(text: str, place: int, most: int = 220) -> str:
    """The statement round a place, on one line: from behind the ; { or } before it to the next ; or the line's end."""
    begin = max(text.rfind(c, 0, place) for c in ";{}") + 1
    stop = text.find(";", place)
    if stop < 0:
        stop = text.find("\n", place)
    got = " ".join(text[begin : stop + 1 if stop >= 0 else len(text)].split())
    return got if len(got) <= most else got[: most - 3].rstrip() + "..."


# declarations, members and names


def declarations(tk: Tokens) -> list[tuple[str, int, bool]]:
    """Local declarations: name, number of stars, and whether brackets follow.

    One begins a line or a statement, is a run of words that does not begin
    with return or goto, then stars, a name, at most one pair of brackets, and
    ends before = or a semicolon.
    """
    out = []
    for k in range(len(tk)):
        if k and tk.mark[k - 1] not in (";", "{", "}") and "\n" not in tk.text[tk.end[k - 1] : tk.start[k]]:
            continue
        n = k
        while tk.is_word(n):
            n += 1
        words = n - k
        stars = 0
        while tk.at(n + stars) == "*":
            stars += 1
        if stars:
            name = n + stars
            if not words or not tk.apart(n) or not tk.is_word(name):
                continue
        else:
            name = n - 1
            if words < 2:
                continue
        if tk.mark[k] in ("return", "goto"):
            continue
        after, bracketed = name + 1, tk.at(name + 1) == "["
        if bracketed:
            while tk.at(after) not in ("]", ""):
                after += 1
            after += 1
        if tk.at(after) in (";", "="):
            out.append((tk.mark[name], stars, bracketed))
    return out


def parameters(text: str) -> list[str]:
    """Trimmed parts of a parameter list between commas at bracket depth 0; none for a lone void."""
    if text.strip() == "void":
        return []
    out, depth, begin = [], 0, 0
    for k, c in enumerate(text):
        if c == "," and not depth:
            out.append(text[begin:k])
            begin = k + 1
        depth = max(0, depth + (c in "([{") - (c in ")]}"))
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


def parameter_names(text: str) -> list[str]:
    """Names of the first definition's parameters, comments and literals blanked."""
    found = re.search(DEFINITION, text)
    names = []
    for p in parameters(found[4]) if found else []:
        marks = Tokens(p).mark
        if marks and marks[-1] == "]" and "[" in marks:
            marks = marks[: len(marks) - 1 - marks[::-1].index("[")]
        if marks and _WORD.match(marks[-1]):
            names.append(marks[-1])
    return names


def struct_variables(tk: Tokens) -> dict[str, str]:
    """Which struct each variable stands for: parameters, declarations, casts, and copies of those."""
    kinds: dict[str, str] = {}
    body = next((k for k, m in enumerate(tk.mark) if m == "{"), len(tk))
    round_ = [k for k in range(body) if tk.mark[k] in ("(", ")")]
    opened = next((k for k in round_ if tk.mark[k] == "("), None)
    closed = next((k for k in reversed(round_) if tk.mark[k] == ")"), None)
    if opened is not None and closed is not None and closed > opened:
        depth = 0
        for k in range(opened + 1, closed + 1):
            depth += (tk.mark[k] == "(") - (tk.mark[k] == ")" and k < closed)
            if k == closed or (tk.mark[k] == "," and not depth):
                n = k - 2  # the name stands last, its struct before the stars
                while tk.at(n) == "*":
                    n -= 1
                if n > opened and tk.is_word(k - 1) and tk.is_word(n) and tk.at(n - 1) == "struct":
                    kinds[tk.mark[k - 1]] = tk.mark[n]
    first = body if body < len(tk) else 0
    pointers, values, casts, copies = [], [], [], []
    for k in range(first, len(tk)):
        if tk.mark[k] == "struct" and tk.is_word(k + 1):
            n = k + 2
            while tk.at(n) == "*":
                n += 1
            if n > k + 2 and tk.is_word(n):
                pointers.append((tk.mark[n], tk.mark[k + 1]))
            elif n == k + 2 and tk.is_word(n) and tk.at(n + 1) != "*":
                values.append((tk.mark[n], tk.mark[k + 1]))
            if n > k + 2 and tk.at(n) == ")" and tk.at(k - 1) == "(" and tk.at(k - 2) == "=" and tk.is_word(k - 3):
                casts.append((tk.mark[k - 3], tk.mark[k + 1]))
        if tk.at(k + 1) == "=" and tk.at(k + 3) == ";" and tk.is_word(k) and tk.is_word(k + 2):
            copies.append((tk.mark[k], tk.mark[k + 2]))
    kinds.update(pointers)
    kinds.update(values)
    kinds.update(casts)
    known = -1
    while known < len(kinds):  # a pass that makes no variable known is the last, so text order counts
        known = len(kinds)
        for to, source in copies:
            if source in kinds:
                kinds[to] = kinds[source]
    return kinds


def member_uses(tk: Tokens, mark: str) -> list[int]:
    """The base's token of each ``base mark member``; a member is no base of the next one."""
    out, k = [], 0
    while k < len(tk) - 2:
        hit = tk.mark[k + 1] == mark and tk.is_word(k) and tk.is_word(k + 2)
        if hit:
            out.append(k)
        k += 3 if hit else 1
    return out


def balanced(tk: Tokens) -> bool:
    """Whether round, square and curly brackets pair off."""
    held: list[str] = []
    for m in tk.mark:
        if m in ("(", "[", "{"):
            held.append({"(": ")", "[": "]", "{": "}"}[m])
        elif m in (")", "]", "}") and (not held or held.pop() != m):
            return False
    return not held


def _value(tk: Tokens, a: int, b: int) -> list[str]:
    """The variables, or members of them (``base.member``), that an expression's tokens read; called names, casts' and members' own names are none."""
    out, k = [], a
    while k < b:
        if tk.is_word(k) and tk.at(k + 1) != "(" and tk.mark[k] not in KEYWORDS and tk.mark[k] not in SCALARS and not (tk.at(k - 1) == "(" and tk.at(k + 1) in ("*", ")") and tk.at(k + 2) in (")", "*", "(")):
            if tk.at(k + 1) in ("->", ".") and tk.is_word(k + 2):
                out.append(f"{tk.mark[k]}.{tk.mark[k + 2]}")
                k += 2
                while tk.at(k + 1) in ("->", ".") and tk.is_word(k + 2):
                    k += 2
            else:
                out.append(tk.mark[k])
        k += 1
    return out


def value_uses(text: str) -> list[tuple[int, str, str, str, int]]:
    """``(site, role, node, name, place)`` of a function's text without literals, as ``operators.flow.value_steps`` says."""
    tk = Tokens(text, literals=False)
    out = [(-1, "parameter", n, "", k) for k, n in enumerate(parameter_names(text))]
    body = next((k for k, m in enumerate(tk.mark) if m == "{"), len(tk))
    for k in range(body + 1, len(tk)):
        if tk.is_word(k) and tk.at(k + 1) in ("->", ".") and tk.is_word(k + 2) and tk.at(k - 1) not in ("->", "."):
            out.append((-1, "field", f"{tk.mark[k]}.{tk.mark[k + 2]}", tk.mark[k], -1))
        if tk.mark[k] == "(" and tk.mate[k] >= 0 and tk.is_word(k - 1) and tk.mark[k - 1] not in KEYWORDS and k - 1 > body:
            for place, (a, b) in enumerate(arguments(tk, k)):
                out += [(k, "argument", v, tk.mark[k - 1], place) for v in dict.fromkeys(_value(tk, a, b))]
        if tk.mark[k] == "=" and tk.at(k + 1) != "=" and tk.at(k - 1) not in ("=", "!", "<", ">") and tk.is_word(k - 1):
            member = tk.at(k - 2) in ("->", ".") and tk.is_word(k - 3)
            to = f"{tk.mark[k - 3]}.{tk.mark[k - 1]}" if member else tk.mark[k - 1]
            stop = next((n for n in range(k + 1, len(tk)) if tk.mark[n] in (";", "{", "}")), len(tk))
            n = k + 1
            while n < stop:
                opened = n + 1 if tk.is_word(n) and tk.at(n + 1) == "(" and tk.mate[n + 1] >= 0 and tk.mark[n] not in KEYWORDS else -1
                if opened >= 0:  # the call's value, not its arguments, goes into the variable
                    out.append((opened, "result", to, tk.mark[n], -1))
                    n = tk.mate[opened] + 1
                else:
                    end = next((m for m in range(n + 1, stop) if tk.is_word(m) and tk.at(m + 1) == "(" and tk.mark[m] not in KEYWORDS), stop)
                    out += [(-1, "copy", v, to, -1) for v in dict.fromkeys(_value(tk, n, end)) if v != to]
                    n = end
        if tk.mark[k] == "return":
            stop = next((n for n in range(k + 1, len(tk)) if tk.mark[n] in (";", "}")), len(tk))
            out += [(-1, "returned", v, "", -1) for v in dict.fromkeys(_value(tk, k + 1, stop))]
    return out
