"""Tokens of JavaScript and TypeScript text. Each has a letter, so that shapes of code are patterns over letters."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

BREAK = re.compile("\r\n|[\n\r\u2028\u2029]")
#: Letters of words: declarations, import, export, function, heads of blocks, words before an expression, operators that are words. Others are i.
LETTERS = {
    "D": "const let var", "I": "import", "X": "export", "F": "function", "C": "if for while switch catch with",
    "R": "return typeof new await yield void delete case throw else do", "O": "in of instanceof",
}
_WORDS = {w: letter for letter, words in LETTERS.items() for w in words.split()}
#: Letters of punctuation; brackets and , ; : = . ! * - < > @ stand for themselves, what is left is o.
_MARKS = {"?.": ".", "?": "q", "=>": "f", "...": "v", "++": "u", "--": "u", ">>": ">", ">>>": ">"} | {c: c for c in "()[]{},;:=.!*-<>@"}
#: After these a slash divides, and a line may end a statement.
VALUES = "istnr)]}eu"

_NAME = r"[A-Za-z_$\u0080-\U0010FFFF][\w$\u0080-\U0010FFFF]*+"
_TOKEN = re.compile(
    rf"""[\s\ufeff]*+(?:
    (?P<word>\#?{_NAME})
  | (?P<string>'(?:[^'\\\n\r]++|\\(?:\r\n|[\s\S]))*+'?|"(?:[^"\\\n\r]++|\\(?:\r\n|[\s\S]))*+"?)
  | (?P<number>0[xX][\da-fA-F_]++n?|0[oO][0-7_]++n?|0[bB][01_]++n?|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?n?)
  | (?P<comment>//[^\n\r\u2028\u2029]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?)
  | (?P<slash>/=?)
  | (?P<tick>`)
  | (?P<mark>\?\.(?!\d)|\.\.\.|=>|\+\+|--|[=!]==?|[<>]=|>>>?=?|<<=?|\?\?=?|&&=?|\|\|=?|\*\*=?|[-+*%&|^]=|[()\[\]{{}},;:.=!*\-<>@?+%&|^~])
  | (?P<end>\Z)
  | (?P<other>[\s\S])
    )""",
    re.X,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]++|\\[^\n\r]|\[(?:[^\]\\\n\r]++|\\[^\n\r])*+\])++/[A-Za-z]*+")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(`|\$\{|\Z)")
_ESCAPE = re.compile(r"\\(?:x([\da-fA-F]{2})|u([\da-fA-F]{4})|u\{([\da-fA-F]{1,6})\}|(\r\n|[\s\S]))")
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Decimal digits of a number that is read exactly: more than a long has.
DIGITS = 20
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}


def unescape(body: str) -> str:
    """The text of a literal. Escaped surrogates that make a pair are one character, others U+FFFD."""
    if "\\" not in body:
        return body
    code = lambda h: chr(min(int(h, 16), 0x10FFFF))
    text = _ESCAPE.sub(lambda m: code(h) if (h := m[1] or m[2] or m[3]) else _ESCAPED.get(m[4], m[4]), body)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if _SURROGATE.search(text) else text


def number(raw: str) -> float | int:
    """A literal's number; of many digits an approximation, which may be infinite."""
    digits = raw.replace("_", "").removesuffix("n")
    if digits[:2].lower() in ("0x", "0o", "0b"):
        return int(digits, 0)
    return int(digits) if digits.isdigit() and len(digits) <= DIGITS else float(digits)


class Tokens:
    """letters: one a token; start and end: its place in text; comments: their places."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.comments = text, [], [], []
        self.letters = self._read()
        self.partner, self._at, self._block, self.outer = {}, [], [], {-1: None}
        self._brackets()
        self._lines: list[int] | None = None

    def _read(self) -> str:
        text, letters, start, end = self.text, [], self.start, self.end
        holes: list[int] = []  # braces that are open in each ${ of a template
        pos = int(text.startswith("\ufeff"))
        if text.startswith("#!", pos):
            pos = m.start() if (m := BREAK.search(text, pos)) else len(text)

        def template(a: int, at: int, whole: str, part: str) -> int:
            m = _TEMPLATE.match(text, at)
            if m[1] == "${":
                holes.append(0)
                letters.append(part)
            else:
                letters.append(whole)
            start.append(a)
            end.append(m.end())
            return m.end()

        while True:
            m = _TOKEN.match(text, pos)
            kind = m.lastgroup
            a, pos = m.span(kind)
            if kind == "word":
                letter = "i" if letters and letters[-1] == "." else _WORDS.get(text[a:pos], "i")
            elif kind == "mark":
                raw = text[a:pos]
                letter = _MARKS.get(raw, "o")
                if holes and letter in "{}":
                    if letter == "}" and not holes[-1]:
                        holes.pop()
                        pos = template(a, pos, "e", "m")
                        continue
                    holes[-1] += 1 if letter == "{" else -1
            elif kind == "comment":
                self.comments.append((a, pos))
                continue
            elif kind == "slash":
                letter = "o"
                if (not letters or letters[-1] not in "istnr)]eu") and (r := _REGEX.match(text, a)):
                    letter, pos = "r", r.end()
            elif kind == "tick":
                pos = template(a, pos, "t", "`")
                continue
            elif kind == "end":
                return "".join(letters)
            elif kind == "other":
                continue
            else:
                letter = kind[0]
            letters.append(letter)
            start.append(a)
            end.append(pos)

    def _brackets(self) -> None:
        """Partners of brackets, and which block each part of the text is in. A closer may leave a few open ones behind."""
        pairs = {")": "(", "]": "[", "}": "{", "e": "`"}
        open_, blocks = [], [-1]
        for m in re.finditer(r"[()\[\]{}`e]", self.letters):
            i, letter = m.start(), m[0]
            if letter not in pairs:
                open_.append(i)
                if letter in "{`":
                    self.outer[i] = blocks[-1]
                    blocks.append(i)
                    self._at.append(i)
                    self._block.append(i)
                continue
            back = next((k for k in range(1, min(4, len(open_)) + 1) if self.letters[open_[-k]] == pairs[letter]), 0)
            if back:
                opener = open_[-back]
                self.partner[opener], self.partner[i] = i, opener
                del open_[-back:]
                if letter in "}e" or blocks[-1] >= opener:
                    while blocks[-1] >= opener:
                        blocks.pop()
                    self._at.append(i)
                    self._block.append(blocks[-1])

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def code(self, s: int, e: int) -> str:
        """Source of tokens s..e-1 on one line, without comments."""
        out = []
        for i in range(s, e):
            if out and (self.letters[i - 1] in "iDIXFCROsnt" and self.letters[i] in "iDIXFCROsnt"):
                out.append(" ")
            out.append(self.word(i))
        return "".join(out)

    def block(self, i: int) -> int:
        """The innermost block around token i, by its opener; -1 for none."""
        k = bisect_right(self._at, i) - 1
        return self._block[k] if k >= 0 else -1

    def top(self, s: int, e: int) -> Iterator[int]:
        """Tokens of a range that are in no bracket opened there; the openers are among them."""
        while s < e:
            yield s
            s = max(s, self.partner.get(s, s)) + 1 if self.letters[s] in "([{`" else s + 1

    def split(self, s: int, e: int) -> list[tuple[int, int]]:
        """The parts of a range between commas."""
        cuts = [s - 1, *(i for i in self.top(s, e) if self.letters[i] == ","), e]
        return [(a + 1, z) for a, z in zip(cuts, cuts[1:], strict=False)]

    def new_line(self, i: int) -> bool:
        """Whether a statement ends between token i and the one before it, with no semicolon there."""
        before, now = self.letters[i - 1], self.letters[i]
        if before not in VALUES or now not in "isntr`DIXFCR{@u!":
            return False
        return bool(BREAK.search(self.text, self.end[i - 1], self.start[i])) and self.word(i) not in ("as", "satisfies")

    def expression(self, s: int) -> int:
        """Where an expression that starts at s ends."""
        for i in self.top(s, len(self.letters)):
            if self.letters[i] in ",;)]}e" or (i > s and self.new_line(i)):
                return i
        return len(self.letters)

    def place(self, i: int) -> tuple[int, int]:
        """Line and column of a token, from 1; columns count UTF-16 units."""
        a = self.start[i]
        line = self.line(a)
        lead = self.text[self.lines[line - 1] : a]
        return line, len(lead) + 1 + (0 if lead.isascii() else sum(c > "\uffff" for c in lead))

    @property
    def lines(self) -> list[int]:
        """Where each line starts."""
        if self._lines is None:
            self._lines = [0, *(m.end() for m in BREAK.finditer(self.text))]
        return self._lines

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)
