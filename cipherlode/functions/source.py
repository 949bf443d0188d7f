"""What one source file says as written: its declarations, imports, calls and values. Which declaration a name means is for a join to find."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

from cipherlode.functions.lexer import Tokens, number, unescape

#: Conditionals within conditionals that are gone into.
NESTED = 16
#: Shapes over letters of tokens.
_DECLARATION = re.compile(r"(?<!\.)D(?=[i{\[])")
_IMPORT = re.compile(r"(?<!\.)I(?:(?P<default>i)(?P<comma>,)?)?(?:\*i(?P<all>i)|(?P<open>\{)[^{}]*\})?is|(?<!\.)Is")
_EXPORT = re.compile(r"(?<!\.)Xi?(?:\{[^{}]*\}|\*(?:i.)?)is")
_LOAD = re.compile(r"(?<!\.)[iI]\(s\)")
_HELPER = re.compile(r"[D,](i)=[(i)f]{0,7}R(i).{0,5}?q(i)", re.S)
_CALL = re.compile(r"(?<![.])i(?:\.i)*+\.?\(|(?<=\.)i(?:\.i)*+\.?\(")
_ASSIGNED = re.compile(r"(?<!\.)i(?==)")
#: Words of identifiers and prose: split at case changes and at anything but ASCII letters.
WORD = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+"
_WORD = re.compile(WORD)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def deciding_words(text: str, kinds: tuple[tuple[str, re.Pattern], ...]) -> list[tuple[str, str]]:
    """The first word of each kind in a text."""
    words = words_of(text)
    found = [(kind, next((w for w in words if pattern.search(w)), None)) for kind, pattern in kinds]
    return [(kind, w) for kind, w in found if w]


#: The same for identifiers, which come again from file to file.
_of_identifier = lru_cache(1 << 14)(deciding_words)


class Value(NamedTuple):
    """What an expression is as written. kind: string, number, null, boolean, object, array, function, name, choice (branches that may say the same) or other.

    at: an object's tokens; place: the token of a name; an object among branches has the text, or the code and place, of what its name is set to.
    """

    kind: str
    code: str = ""
    text: str | None = None
    number: float | int | None = None
    at: tuple[int, int] | None = None
    place: int | None = None
    branches: tuple[Value, ...] = ()


class Declared(NamedTuple):
    name: str | None
    kind: str
    index: int  # of the name, or of a pattern's opener
    value: tuple[int, int] | None
    block: int


class Source:
    def __init__(self, path: str, text: str):
        self.path, self.tokens = path, Tokens(text)
        self.letters = self.tokens.letters

    # values

    def literal(self, i: int) -> str:
        raw = self.tokens.word(i)
        closed = len(raw) > 1 and raw[-1] == raw[0]
        return unescape(raw[1 : len(raw) - closed])

    def value(self, s: int, e: int, nested: int = 0) -> Value:
        """What an expression is. nested: conditionals around it, of which NESTED are gone into."""
        t, letters = self.tokens, self.letters
        e = next((i for i in t.top(s, e) if i > s and letters[i] == "i" and t.word(i) in ("as", "satisfies")), e)
        while e - s > 1 and letters[s] == "(" and t.partner.get(s) == e - 1:
            s, e = s + 1, e - 1
        if e <= s:
            return Value("other")
        first = letters[s]
        if e - s == 1:
            if first in "st":
                return Value("string", text=self.literal(s))
            if first == "n":
                return Value("number", number=number(t.word(s)))
            if first == "i":
                name = t.word(s)
                return Value("null", "null") if name in ("null", "undefined") else Value("boolean", name) if name in ("true", "false") else Value("name", name, place=s)
        if e - s == 2 and first == "-" and letters[s + 1] == "n":
            return Value("number", number=-number(t.word(s + 1)))
        if first in "{[" and t.partner.get(s) == e - 1:
            return Value("object" if first == "{" else "array", at=(s + 1, e - 1))
        top = [(letters[i], i) for i in t.top(s, e)]
        if first == "F" or any(letter == "f" for letter, _ in top) or (first == "i" and letters[s + 1] == "F" and t.word(s) == "async"):
            return Value("function")
        cuts = [(letter, i) for letter, i in top if letter in "q:"]
        if cuts and nested < NESTED:
            return self._choice(s, e, cuts, nested) or Value("other", t.code(s, e))
        return Value("other", t.code(s, e))

    def _choice(self, s: int, e: int, cuts: list[tuple[str, int]], nested: int) -> Value | None:
        """A conditional, or a chain or tree of them: between its marks, what no question mark follows is a branch. Literals that all say the same are one."""
        if cuts[0][0] != "q" or 2 * sum(letter == "q" for letter, _ in cuts) != len(cuts):
            return None
        starts, found = [s, *(i + 1 for _, i in cuts)], []
        for start, (letter, end) in zip(starts, [*cuts, (":", e)], strict=True):
            if letter == ":":
                v = self.value(start, end, nested + 1)
                if v.kind == "object":
                    named = next((self.value(*at, nested + 1) for name, at in self._places(v).items() if name == "name"), Value("other"))
                    v = v._replace(code=named.code, text=named.text, place=named.place)
                if v.kind not in ("string", "number", "name", "object", "choice") or (v.kind == "object" and v.text is None and v.place is None):
                    return None
                found += v.branches or [v]
        said = {(v.kind, v.text, v.number) for v in found if v.place is None}
        if len(said) > 1:
            return None
        if all(v.place is None for v in found):
            return found[0]
        return Value("choice", self.tokens.code(s, e), branches=tuple(dict.fromkeys(found)))

    def _places(self, v: Value) -> dict[str, tuple[int, int]]:
        """Where an object's fields are set; computed names, spreads and methods are passed over, the last of a name counts."""
        t, found = self.tokens, {}
        for s, e in t.split(*v.at) if v.kind == "object" and v.at else ():
            if e > s and self.letters[s] in "iDIXFCROsn":
                name = self.literal(s) if self.letters[s] == "s" else t.word(s)
                if e - s > 2 and self.letters[s + 1] == ":":
                    found[name] = (s + 2, e)
                elif e - s == 1 and self.letters[s] == "i":
                    found[name] = (s, e)
        return found

    def fields(self, v: Value) -> Iterator[tuple[str, Value]]:
        """Names and values of an object."""
        for name, (s, e) in self._places(v).items():
            x = self.value(s, e)
            yield name, x if x.code or x.kind != "other" else x._replace(code=self.tokens.code(s, e))

    # declarations

    @cached_property
    def declared(self) -> list[Declared]:
        """Everything that const, let and var declare."""
        t, letters, out = self.tokens, self.letters, []
        for m in _DECLARATION.finditer(letters):
            kind, j = t.word(m.start()), m.end()
            while j < len(letters) and letters[j] in "i{[":
                k = j + 1 if letters[j] == "i" else t.partner.get(j, len(letters)) + 1
                k += letters[k : k + 1] == "!"
                if letters[k : k + 1] == ":":
                    k = self._after_type(k + 1)
                end, value = k, None
                if letters[k : k + 1] == "=":
                    end = t.expression(k + 1)
                    value = (k + 1, end)
                out.append(Declared(t.word(j) if letters[j] == "i" else None, kind, j, value, t.block(j)))
                if letters[end : end + 1] != ",":
                    break
                j = end + 1
        return out

    def _after_type(self, s: int) -> int:
        angle = 0
        for i in self.tokens.top(s, len(self.letters)):
            letter = self.letters[i]
            if letter in "<>":
                angle += len(self.tokens.word(i)) * (1 if letter == "<" else -1)
            if letter in "=;)]}e" or (letter == "," and angle <= 0) or (i > s and self.tokens.new_line(i) and self.letters[i - 1] != ":"):
                return i
        return len(self.letters)

    @cached_property
    def scoped(self) -> list[Declared]:
        """Names that are declared, each once in a block."""
        seen: dict[tuple[str, int], Declared] = {}
        for d in self.declared:
            if d.name:
                seen.setdefault((d.name, d.block), d)
        return list(seen.values())

    def scope(self, d: Declared) -> tuple[int, int]:
        """The tokens between which a declaration holds: from itself to its block's end; everywhere at the top level."""
        return (-1, len(self.letters)) if d.block == -1 else (d.index, self.tokens.partner.get(d.block, len(self.letters)))

    # imports

    @cached_property
    def _helpers(self) -> set[str]:
        """Names that load a module: require, and what a bundler writes for it."""
        word = self.tokens.word
        return {"require", "__require"} | {word(m.start(1)) for m in _HELPER.finditer(self.letters) if word(m.start(2) - 1) == "typeof" and word(m.start(2)) == word(m.start(3)) == "require"}

    @cached_property
    def imports(self) -> tuple[list[tuple[int, str]], dict[str, tuple[str, tuple[str, ...]]]]:
        """(sites: token and module; names: the module and the path of members that each local name is bound to, the last binding counts)."""
        t, letters, sites, bound = self.tokens, self.letters, [], []
        module = lambda i: self.literal(i).removeprefix("node:")
        for m in _IMPORT.finditer(letters):
            i, last = m.start(), m.end() - 1
            if letters[i + 1] != "s" and t.word(last - 1) != "from":
                continue
            if m["default"] and not m["comma"] and (m["all"] or m["open"]):  # import type { ... }
                continue
            sites.append((i, module(last)))
            pairs = [(t.word(m.start("default")), ())] if m["default"] else []
            pairs += [(t.word(m.start("all")), ())] if m["all"] else []
            if m["open"]:
                for s, e in t.split(m.start("open") + 1, t.partner.get(m.start("open"), m.start("open") + 1)):
                    names = [t.word(k) for k in range(s, e)]
                    names = names[1:] if len(names) in (2, 4) and names[0] == "type" else names
                    if len(names) == 1 or (len(names) == 3 and names[1] == "as"):
                        pairs.append((names[-1], () if names[0] == "default" else (names[0],)))
            bound += [(i, name, module(last), path) for name, path in pairs]
        for m in _EXPORT.finditer(letters):
            if t.word(m.end() - 2) == "from":
                sites.append((m.start(), module(m.end() - 1)))
        for m in _LOAD.finditer(letters):
            i = m.start()
            if letters[i] == "i" and t.word(i) not in self._helpers:
                continue
            name, k, path = module(i + 2), m.end(), []
            sites.append((i, name))
            while letters[k : k + 2] == ".i":
                path.append(t.word(k + 1))
                k += 2
            b = i - 1 - (i > 0 and t.word(i - 1) == "await")
            if letters[k : k + 1] in ("(", "[") or b < 1 or letters[b] != "=":
                continue
            if letters[b - 1] == "i" and letters[b - 2 : b - 1] != ".":
                bound.append((i, t.word(b - 1), name, tuple(path)))
            elif letters[b - 1] == "}" and b - 1 in t.partner:
                bound += [(i, local, name, (*path, key)) for local, key in self.pattern(t.partner[b - 1] + 1, b - 1)]
        return sorted(sites), {name: (module_, path) for _, name, module_, path in sorted(bound, key=lambda x: x[0])}

    def pattern(self, s: int, e: int) -> Iterator[tuple[str, str]]:
        """(local name, key) of the plain entries of { a, b: c, d = 1 }."""
        for a, z in self.tokens.split(s, e):
            shape = self.letters[a:z]
            if m := re.match(r"(i)(?::(i))?(?:=|\Z)", shape):
                yield self.tokens.word(a + (2 if m[2] else 0)), self.tokens.word(a)

    # calls

    def calls(self) -> Iterator[tuple[int, int, list[str], str | None, tuple[int, int] | None]]:
        """(callee's token, opener, chain, module that its root loads, bracketed root); a computed member before the chain shows as []."""
        t, letters = self.tokens, self.letters
        for m in _CALL.finditer(letters):
            s, opener = m.start(), m.end() - 1
            names = [k for k in range(s, opener) if letters[k] == "i"]
            if letters[s - 1 : s] != "." and len(names) == 1 and self._defines(s, opener):
                continue
            chain, root, group = [t.word(k) for k in names], None, None
            if s > 0 and letters[s - 1] == ".":
                a = t.partner.get(s - 2, -1) if letters[s - 2] == ")" else -1
                if a > 0 and letters[a + 1] == "s" and a + 2 == s - 2 and (letters[a - 1] == "I" or t.word(a - 1) in self._helpers):
                    root = self.literal(a + 1).removeprefix("node:")
                elif a >= 0:
                    group = (a, s - 1)
                else:
                    chain.insert(0, "[]")
            yield names[-1], opener, chain, root, group

    def _defines(self, name: int, opener: int) -> bool:
        """Whether name(...) { is a function or method, perhaps with a type before its body."""
        t, letters = self.tokens, self.letters
        close = t.partner.get(opener)
        before = letters[name - 1] if name else ";"
        if before == "F" or (before == "*" and name > 1 and letters[name - 2] == "F"):
            return True
        if close is None or before in "RO" or (before not in "{};,)*" and not before.isalpha()) or before in "fqouv":
            return False
        if letters[close + 1 : close + 2] != ":":
            return letters[close + 1 : close + 2] == "{"
        return next((letters[i] for i in t.top(close + 2, len(letters)) if letters[i] in "{;,f)="), "") == "{"

    # Web Crypto's names

    def mentions(self, s: int, e: int) -> bool:
        return any(self.letters[i] in "is" and "crypto" in self.tokens.word(i).lower() for i in range(s, e))

    @cached_property
    def subtle(self) -> set[str]:
        """Names that are set to a SubtleCrypto object: declared, taken from a pattern, assigned, or a parameter's default."""
        t, out = self.tokens, set()
        values = [(d.name, d.value) for d in self.declared if d.name and d.value]
        values += [(t.word(m.start()), (m.end() + 1, t.expression(m.end() + 1))) for m in _ASSIGNED.finditer(self.letters)]
        for name, (s, e) in values:
            if e - s > 2 and self.letters[e - 2] == "." and t.word(e - 1) == "subtle":
                a = t.partner.get(e - 3, e - 3)
                if s <= a and self.mentions(min(a, e - 3), e - 2):
                    out.add(name)
        for d in self.declared:
            if not d.name and d.value and self.letters[d.index] == "{" and self.mentions(*d.value):
                out |= {local for local, key in self.pattern(d.index + 1, t.partner.get(d.index, d.index + 1)) if key == "subtle"}
        return out

    # context

    def evidence(self, line: int) -> str:
        """A line, trimmed, 200 characters at most."""
        t = self.tokens
        a = t.lines[line - 1]
        text = t.text[a : t.lines[line] if line < len(t.lines) else len(t.text)].strip().strip("﻿")
        return text if len(text) <= 200 else text[:199] + "…"

    def words(self, lines: set[int], kinds: dict[str, re.Pattern]) -> Iterator[tuple[int, int, int, bool, str, str]]:
        """(first line, last line, place, of a comment, kind, word): of each line of code and each comment within these lines, the first word of each kind. Strings have none."""
        t, patterns = self.tokens, tuple(kinds.items())
        told: set[tuple[int, int, bool, str]] = set()
        for i, letter in enumerate(self.letters):
            if letter in "iDIXFCRO":
                word = t.word(i)
                for kind, w in _of_identifier(word, patterns) if len(word) <= 100 else deciding_words(word, patterns):
                    line = t.line(t.start[i])
                    if line in lines and (line, line, False, kind) not in told:
                        told.add((line, line, False, kind))
                        yield line, line, i, False, kind, w
        for a, z in t.comments:
            first, last = t.line(a), t.line(z - 1)
            if first in lines or last in lines or (last > first + 1 and any(k in lines for k in range(first, last))):
                for kind, w in deciding_words(t.text[a:z], patterns):
                    if (first, last, True, kind) not in told:
                        told.add((first, last, True, kind))
                        yield first, last, a, True, kind, w
