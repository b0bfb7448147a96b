"""Tokens of C and Java text: one left-to-right pass, then facts about lines, brackets and statements in arrays.

Comments are no tokens; their places are kept. Everything here takes time in proportion to the text."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property

SCAN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<string>"(?:\\.|[^"\\\n])*"?)
      | (?P<char>'(?:\\.|[^'\\\n])*'?)
      | (?P<word>[^\W\d]\w*)
      | (?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)
      | (?P<op>->|\+\+|--|&&|\|\||::|[<>=!+\-*/%&|^]=|[^\s\w])""",
    re.S | re.X,
)
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass
class Tokens:
    """kinds, texts, places (starts, ends) and lines of the tokens; comments as (start, end, number of tokens before)."""

    text: str
    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    comments: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for m in SCAN.finditer(self.text):
            kind = m.lastgroup
            if kind == "comment":
                self.comments.append((m.start(), m.end(), len(self.texts)))
                continue
            self.kinds.append(kind)
            self.texts.append(m[0])
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.lines.append(self.line_of(m.start()))

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def breaks(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    def line_of(self, place: int) -> int:
        return bisect_right(self.breaks, place - 1) + 1

    @cached_property
    def line_texts(self) -> list[str]:
        return self.text.split("\n")

    @cached_property
    def match(self) -> list[int]:
        """For each opening bracket its closing one, the number of tokens where it has none; -1 for other tokens.

        A closing brace also ends round and square brackets that were left open inside it."""
        found, stack, braces = [-1] * len(self), [], 0
        for i, t in enumerate(self.texts):
            if self.kinds[i] != "op":
                continue
            if t in OPENS:
                stack.append(i)
                found[i] = len(self)
                braces += t == "{"
            elif t == "}" and braces:
                while self.texts[stack[-1]] != "{":
                    found[stack.pop()] = i
                found[stack.pop()] = i
                braces -= 1
            elif t in CLOSES and stack and self.texts[stack[-1]] == CLOSES[t]:
                found[stack.pop()] = i
        return found

    @cached_property
    def first_of_line(self) -> list[int]:
        """The first token of each token's line."""
        found: list[int] = []
        for i, line in enumerate(self.lines):
            found.append(found[-1] if i and self.lines[i - 1] == line else i)
        return found

    @cached_property
    def code_until(self) -> list[int]:
        """By line number: the lines up to it that hold tokens."""
        held = [0] * (len(self.line_texts) + 1)
        for line in self.lines:
            held[line] = 1
        total = 0
        for i, x in enumerate(held):
            total += x
            held[i] = total
        return held

    def code_lines(self, first: int, last: int) -> int:
        last = min(last, len(self.line_texts))
        return max(0, self.code_until[last] - self.code_until[min(max(first - 1, 0), last)])

    @cached_property
    def directives(self) -> set[int]:
        """Lines of preprocessor directives; a backslash at its end carries a directive over to the next line."""
        found: set[int] = set()
        for i, t in enumerate(self.texts):
            if t != "#" or self.first_of_line[i] != i or self.lines[i] in found:
                continue
            line = self.lines[i]
            found.add(line)
            while line < len(self.line_texts) and self.line_texts[line - 1].rstrip().endswith("\\"):
                line += 1
                found.add(line)
        return found

    @cached_property
    def declares(self) -> list[bool]:
        """Do only words and stars stand before a token on its line, at least one word among them?"""
        found: list[bool] = []
        plain = words = False
        for i, kind in enumerate(self.kinds):
            if self.first_of_line[i] == i:
                plain, words = True, False
            found.append(plain and words)
            plain = plain and (kind == "word" or self.texts[i] == "*")
            words = words or kind == "word"
        return found
