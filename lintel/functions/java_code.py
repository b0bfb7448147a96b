"""Java declarations as rows, with what their bodies do, from tokens.

One pass over a file's tokens gives a row for each type, method, constructor and field, with its span of tokens and lines and
the place of the declaration around it (the innermost open one: declarations are opened and closed like brackets). Methods
carry counts of what stands in their bodies. What a class is made of comes from its methods' rows by grouped aggregation
(lintel.operators.structure); nothing here looks at a class as a whole.

Declarations are told apart by their heads, the tokens since the last ; or brace at the level of a type's body. A type's
reference is told from a variable's by a capital letter, as the rules do. Sources that don't parse give what can be read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.copies import ROWS, framed, remembered
from lintel.functions.tokens import Tokens
from lintel.session import prepare

# Words of the language that are no names.
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
KEYWORDS = MODIFIERS | frozenset(
    "assert boolean break byte case catch char class const continue do double else enum extends finally float for goto if implements import instanceof int interface long new package return short super switch this throw throws try void while true false null".split()
)
TYPES = ("class", "interface", "enum", "record")
LOOPS = frozenset(("for", "while", "do"))
NESTING = frozenset(("if", "for", "while", "do", "switch", "try", "synchronized"))
ACCESSOR = re.compile(r"(?:get|set|is)[A-Z_]")
ASSIGNS = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="))
COUNTS = (
    "statements", "local_vars", "branches", "loops", "switch_cases", "try", "catch", "returns", "throws", "assignments", "bool_ops", "lambdas", "object_creations", "method_calls", "max_chain", "max_nesting", "complexity",
    "own_calls", "foreign_calls", "foreign_accessor_calls", "calls_on_params", "calls_on_locals", "calls_on_fields", "calls_on_types", "own_field_access", "foreign_field_access", "static_refs",
)
COLUMNS = "id int, parent int, kind string, name string, first int, last int, line int, end_line int, parameters int, modifiers array<string>, annotations array<string>, extends int, implements int, has_body boolean, counts map<string,int>, targets map<string,int>, fields_used array<string>, types_used array<string>"


@dataclass
class Declaration:
    kind: str
    name: str
    first: int
    parent: int | None = None
    last: int = -1
    parameters: list[str] = field(default_factory=list)
    modifiers: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    extends: int = 0
    implements: int = 0
    body: tuple[int, int] | None = None


def balanced(t: Tokens, i: int) -> int:
    """The token behind a bracket's closing one."""
    return min(t.match[i] + 1, len(t))


def angle_end(t: Tokens, i: int, stop: int) -> int:
    """The token behind the > of a list of types that opens here."""
    depth = 0
    while i < stop:
        depth += (t.texts[i] == "<") - (t.texts[i] == ">")
        i += 1
        if not depth:
            break
    return i


def head(t: Tokens, i: int, stop: int) -> tuple[list[str], list[str], int]:
    """(modifiers, annotations, the token behind them) of a declaration that begins here."""
    modifiers, annotations = [], []
    while i < stop:
        if t.texts[i] == "@" and i + 1 < stop and t.texts[i + 1] != "interface":
            i += 1
            name = t.texts[i]
            while i + 2 < stop and t.texts[i + 1] == ".":
                i += 2
                name = t.texts[i]
            annotations.append(name)
            i = balanced(t, i + 1) if i + 1 < stop and t.texts[i + 1] == "(" else i + 1
        elif t.texts[i] in MODIFIERS:
            modifiers.append(t.texts[i])
            i += 1
        elif t.texts[i] == "<":
            i = angle_end(t, i, stop)
        else:
            break
    return modifiers, annotations, i


def listed(t: Tokens, first: int, stop: int) -> list[tuple[int, int]]:
    """The parts between commas outside of all brackets, angle brackets too."""
    parts, start, i, depth = [], first, first, 0
    while i < stop:
        x = t.texts[i]
        if x in ("(", "[", "{"):
            i = min(balanced(t, i), stop)
            continue
        depth += (x == "<") - (x == ">" and depth > 0)
        if x == "," and not depth:
            parts.append((start, i))
            start = i + 1
        i += 1
    return [p for p in [*parts, (start, stop)] if p[0] < p[1]]


def last_name(t: Tokens, first: int, stop: int) -> str:
    """The declared name of a parameter or a variable: the last word before sizes or a value."""
    name = ""
    for i in range(first, stop):
        if t.texts[i] in ("=", "["):
            break
        if t.kinds[i] == "word":
            name = t.texts[i]
    return name


def declarations(t: Tokens) -> list[Declaration]:
    """Types, methods, constructors and fields in order of their first token; the types' bodies are walked with a stack of their own."""
    found: list[Declaration] = []
    level: list[tuple[int | None, int, int]] = [(None, 0, len(t))]  # (type, next token, end) of the bodies that are open
    while level:
        owner, i, stop = level.pop()
        while i < stop:
            if t.texts[i] in (";", "}"):
                i += 1
                continue
            modifiers, annotations, at = head(t, i, stop)
            if at >= stop:
                break
            annotation_type = t.texts[at] == "@"
            word = t.texts[at + 1] if annotation_type and at + 1 < stop else t.texts[at]
            if word in TYPES and at + 1 < stop and (word != "record" or t.kinds[at + 1] == "word"):
                name_at = at + 1 + annotation_type
                open_ = name_at
                while open_ < stop and t.texts[open_] not in ("{", ";"):
                    open_ = balanced(t, open_) if t.texts[open_] == "(" else open_ + 1
                d = Declaration("annotation" if annotation_type else word, t.texts[name_at] if name_at < stop else "", i, owner, modifiers=modifiers, annotations=annotations)
                heads = t.texts[name_at:open_]
                for what in ("extends", "implements"):
                    if what in heads:
                        k = name_at + heads.index(what) + 1
                        ends = [name_at + heads.index(x) for x in ("extends", "implements", "permits") if x in heads and name_at + heads.index(x) >= k]
                        setattr(d, what, len(listed(t, k, min([*ends, open_]))))
                found.append(d)
                close = min(t.match[open_], len(t)) if open_ < stop and t.texts[open_] == "{" else open_
                d.last = min(close, len(t) - 1)
                if open_ < stop and t.texts[open_] == "{":
                    inner = open_ + 1
                    if word == "enum" and not annotation_type:  # constants come first, up to a semicolon
                        while inner < close and t.texts[inner] != ";":
                            inner = balanced(t, inner) if t.texts[inner] in ("(", "{") else inner + 1
                    d.body = (open_, close)
                    level.append((owner, close + 1, stop))
                    owner, i, stop = len(found) - 1, inner, close
                else:
                    i = open_ + 1
                continue
            i = member(t, i, at, stop, owner, modifiers, annotations, found)
    return found


def member(t: Tokens, first: int, at: int, stop: int, owner: int | None, modifiers: list[str], annotations: list[str], found: list[Declaration]) -> int:
    """Add the field, method or constructor whose type or name stands at `at`; gives the token behind it."""
    i, value = at, False
    while i < stop and t.texts[i] not in (";", "{"):
        if t.texts[i] == "=":
            value = True
        if t.texts[i] == "(" and not value:
            break
        i = balanced(t, i) if t.texts[i] in ("(", "[") else angle_end(t, i, stop) if t.texts[i] == "<" and not value else i + 1
        if value:
            while i < stop and t.texts[i] != ";":
                i = balanced(t, i) if t.texts[i] in ("(", "[", "{") else i + 1
    if i >= stop or i == at and t.texts[i] == ";":
        return i + 1
    own = owner is not None
    if t.texts[i] == "(" and t.kinds[i - 1] == "word":
        name, close = t.texts[i - 1], t.match[i]
        end = close + 1
        while end < stop and t.texts[end] not in ("{", ";"):
            end += 1
        constructor = i - 1 == at
        d = Declaration("constructor" if constructor else "method", name, first, owner, modifiers=modifiers, annotations=annotations)
        d.parameters = [last_name(t, a, b) for a, b in listed(t, i + 1, min(close, stop))]
        d.extends = int(not constructor and t.texts[at] == "void")
        body = end < stop and t.texts[end] == "{"
        d.body = (end, min(t.match[end], len(t))) if body else None
        d.last = min(d.body[1] if body else end, len(t) - 1)
        if own:
            found.append(d)
        return d.last + 1
    if t.texts[i] == "{":  # an initialiser
        return balanced(t, i)
    names = [last_name(t, a, b) for a, b in listed(t, at, i)]
    if own and t.kinds[at] == "word" and i > at + 1:
        for name in names:
            found.append(Declaration("field", name, first, owner, i, modifiers=modifiers, annotations=annotations))
    return i + 1


class Chain:
    """The dotted chain that the tokens are in: its first name, its length, and whether a call or an index stands in it."""

    def __init__(self) -> None:
        self.root, self.length, self.broken = "", 0, False

    def role(self, before: str) -> tuple[str, str]:
        """(role, root) of a name behind `before`: `this` for this.x, `chained` behind a call or an index, else the first name of its qualifier."""
        if before != ".":
            return "", ""
        if self.broken or self.root == "this" and self.length > 1:
            return "chained", ""
        return ("this", "this") if self.root == "this" else ("", self.root)

    def add(self, name: str, before: str, before_that: str) -> None:
        if before != ".":
            self.root, self.length, self.broken = name, 1, False
        else:
            self.length += 1

    def dot(self, before: str) -> None:
        self.broken = self.broken or before in (")", "]", "}")


def head_names(t: Tokens, x: str, open_: int) -> list[str]:
    """The names that the round brackets behind catch, try or for declare."""
    close, names, start = t.match[open_], [], open_ + 1
    if x == "catch":
        return [t.texts[close - 1]] if close < len(t) else []
    for i in range(open_ + 1, min(close + 1, len(t))):
        if t.texts[i] in (";", ":") or i == close:
            names += declared_locals(t, start, i)
            start = i + 1
            if x == "for":
                break
    return names


def lambda_names(t: Tokens, arrow: int, first: int) -> list[str]:
    """The parameters in front of an arrow."""
    i = arrow - 1
    if t.kinds[i] == "word":
        return [t.texts[i]]
    while i > first and t.texts[i] != "(":
        i -= 1
    return [n for a, b in listed(t, i + 1, arrow - 1) if (n := last_name(t, a, b))]


def body_counts(t: Tokens, d: Declaration, fields: set[str]) -> tuple[dict[str, int], dict[str, int], list[str]]:
    """(counts, uses of other objects by name, own fields used) of a method's body, in one pass over it."""
    counts = dict.fromkeys(COUNTS, 0) | {"complexity": 1}
    if d.body is None:
        return counts, {}, []
    first, last = d.body
    params, locals_ = set(d.parameters), set(d.parameters)
    calls: list[tuple[str, str, str]] = []
    refs: list[tuple[str, str, str]] = []
    blocks: list[tuple[bool, bool, int]] = []  # of the open braces: of a control statement? of do? round brackets around it
    depth = pending = brackets = 0  # pending: control statements whose block is to come
    closed_do, chain = False, Chain()
    statement, declared = first + 1, None  # where the statement began; the names it declares, once asked
    before, before_that = "{", ""

    def add(name: str, n: int = 1) -> None:
        counts[name] += n

    for i in range(first + 1, last):
        x, kind, after = t.texts[i], t.kinds[i], t.texts[i + 1] if i + 1 < last else ""
        if x in ("this", "super"):
            chain.add(x, before, before_that)
        elif kind == "word" and x in KEYWORDS:
            tail = x == "while" and before == "}" and closed_do
            if x in ("if", "catch") or x in LOOPS and not tail:
                add("complexity")
                add("branches" if x == "if" else "catch" if x == "catch" else "loops")
            elif x == "case":
                labels = len(listed(t, i + 1, case_end(t, i + 1, last)))
                for name in ("switch_cases", "branches", "complexity"):
                    add(name, labels)
            elif x in ("try", "return", "throw", "new"):
                add({"try": "try", "return": "returns", "throw": "throws", "new": "object_creations"}[x])
            if x in NESTING and not tail:
                pending += 1
                add("statements")
            elif x in ("catch", "finally") or x == "else" and after != "if":
                pending += 1
            if x in ("catch", "try", "for") and after == "(":
                names = head_names(t, x, i + 1)
                locals_.update(names)
                add("local_vars", len(names) * (x == "for"))
        elif kind == "word":
            if after == "(" and before != "new":
                calls.append((x, *chain.role(before)))
                counts["max_chain"] = max(counts["max_chain"], chain_length(t, i, last))
            elif before not in ("new", "@") and (i + 1 == len(t) or t.kinds[i + 1] != "word") and (after != "." or before == "." and chain.role(before)[0] == "this"):
                refs.append((x, *chain.role(before)))
            chain.add(x, before, before_that)
        elif x == ".":
            chain.dot(before)
        elif x in ("&&", "||"):
            add("bool_ops")
            add("complexity")
        elif x == "?" and before not in ("<", ","):
            add("branches")
            add("complexity")
        elif x == "->" and t.texts[statement] not in ("case", "default"):
            add("lambdas")
            locals_.update(lambda_names(t, i, first))
        elif x in ASSIGNS:
            if declared is None:
                declared = declared_locals(t, statement, i) if t.texts[statement] != "for" else declared_locals(t, statement + 2, i)
            add("assignments", int(x != "=" or not declared))
        elif x == "(":
            brackets += 1
        elif x == ")":
            brackets = max(0, brackets - 1)
        elif x == "{":
            if declared and t.texts[statement] != "for":  # a variable whose value holds a block
                locals_.update(declared)
                add("local_vars", len(declared))
            blocks.append((pending > 0, before == "do", brackets))
            depth, pending, brackets = depth + (pending > 0), max(0, pending - 1), 0
            counts["max_nesting"] = max(counts["max_nesting"], depth)
        elif x == "}":
            control, closed_do, brackets = blocks.pop() if blocks else (False, False, 0)
            depth -= control
        elif x == ";" and not brackets:
            counts["max_nesting"] = max(counts["max_nesting"], depth + pending)  # of a control statement without braces
            names = declared_locals(t, statement, i)
            locals_.update(names)
            add("local_vars", len(names))
            add("statements", int(i > statement and not names and t.texts[statement] != "while"))
            pending = 0
        if x in ("{", "}") or x == ";" and not brackets:
            statement, declared = i + 1, None
        before_that, before = before, x
    used, targets = classified(counts, calls, refs, params, locals_, fields)
    return counts, targets, sorted(used)


def classified(counts: dict[str, int], calls: list, refs: list, params: set[str], locals_: set[str], fields: set[str]) -> tuple[set[str], dict[str, int]]:
    """Count calls and members by whose they are; gives the own fields that are used and the uses of other objects. A name can be declared behind its use."""
    used: set[str] = set()
    targets: dict[str, int] = {}

    def add(name: str, n: int = 1) -> None:
        counts[name] += n

    for name, role, root in calls:
        add("method_calls")
        if role == "this" or not role and root in ("", "super"):
            add("own_calls")
            continue
        add("foreign_calls")
        add("foreign_accessor_calls", int(bool(ACCESSOR.match(name))))
        if role:
            continue
        if root in locals_:
            add("calls_on_params" if root in params else "calls_on_locals")
        elif root in fields:
            add("calls_on_fields")
            add("own_field_access")
            used.add(root)
        elif root[:1].isupper():
            add("calls_on_types")
            continue
        targets[root] = targets.get(root, 0) + 1
    for name, role, root in refs:
        if role == "this":
            add("own_field_access")
            used.add(name)
        elif role == "chained":
            add("foreign_field_access")
        elif not root:
            if name in fields and name not in locals_:
                add("own_field_access")
                used.add(name)
        elif root[:1].isupper():
            add("static_refs")
        else:
            add("foreign_field_access")
            targets[root] = targets.get(root, 0) + 1
            if root in fields and root not in locals_:
                used.add(root)
    return used, targets


def case_end(t: Tokens, i: int, last: int) -> int:
    while i < last and t.texts[i] not in (":", "->", ";", "{", "}", "case"):
        i += 1
    return i


def chain_length(t: Tokens, i: int, last: int) -> int:
    """Calls that are made one on the other's result, from the one at i on; a call in the middle of a chain is part of it."""
    if t.texts[i - 1] == "." and t.texts[i - 2] == ")":
        return 1
    n, close = 1, t.match[i + 1]
    while close + 3 < last and t.texts[close + 1] == "." and t.texts[close + 3] == "(":
        n, close = n + 1, t.match[close + 3]
    return n


def declared_locals(t: Tokens, first: int, stop: int) -> list[str]:
    """The names that a statement declares: `Type name`, with sizes, values and more names behind; none for other statements."""
    i = first
    while i < stop and (t.texts[i] == "final" or t.texts[i] == "@"):
        i += 2 if t.texts[i] == "@" else 1
    if i >= stop or t.kinds[i] != "word" or t.texts[i] in KEYWORDS - {"boolean", "byte", "char", "double", "float", "int", "long", "short"}:
        return []
    i += 1
    while i + 1 < stop and t.texts[i] == "." and t.kinds[i + 1] == "word":
        i += 2
    if i < stop and t.texts[i] == "<":
        i = angle_end(t, i, stop)
    while i < stop and t.texts[i] == "[":
        i = balanced(t, i)
    if i >= stop or t.kinds[i] != "word" or t.texts[i] in KEYWORDS or i + 1 < stop and t.texts[i + 1] not in ("=", ",", "[", ":"):
        return []
    return [n for a, b in listed(t, i, stop) if (n := last_name(t, a, b))]


def names_type(t: Tokens, i: int) -> bool:
    """A capitalised word that isn't a constant, an annotation, part of a longer name, or the owner of a static member."""
    x, behind = t.texts[i], t.texts[i + 1 : i + 3]
    if t.kinds[i] != "word" or not x[:1].isupper() or len(x) > 1 and x.isupper() or i and t.texts[i - 1] in (".", "@"):
        return False
    return behind[:1] != ["."] or behind[1:2] != [] and behind[1][:1].isupper() and not behind[1].isupper()


def rows_of(text: str) -> Iterator[tuple]:
    """A file's declarations, COLUMNS in order."""
    t = Tokens(text)
    found = declarations(t)
    fields: dict[int | None, set[str]] = {}
    for d in found:
        if d.kind == "field":
            fields.setdefault(d.parent, set()).add(d.name)
    variables, span, named = set().union(*fields.values()), None, set()
    for n, d in enumerate(found):
        counts, targets, used = body_counts(t, d, fields.get(d.parent, set())) if d.kind in ("method", "constructor") else (None, None, None)
        if d.kind in ("method", "constructor", "field") and span != (d.first, d.last):  # names that are declared together share a span
            span, named = (d.first, d.last), {t.texts[i] for i in range(d.first, d.last + 1) if names_type(t, i)} - variables
        types = sorted(named - {d.name}) if d.kind in ("method", "constructor", "field") else None
        yield n, d.parent, d.kind, d.name, d.first, d.last, t.lines[d.first], t.lines[d.last], len(d.parameters), d.modifiers, d.annotations, d.extends, d.implements, d.body is not None, counts, targets, used, types


NO_OPERATORS = frozenset(("(", ")", "[", "]", "{", "}", ";", ",", ".", "@", "::"))
LITERALS = frozenset(("true", "false", "null"))


def token_columns(text: str) -> tuple[list, ...]:
    """i, line, starts_line, identifier, operator, literal and text of a file's tokens, a list each; flags are truth values."""
    t = Tokens(text)
    words = [kind == "word" and x not in KEYWORDS for x, kind in zip(t.texts, t.kinds, strict=True)]
    operators = [kind == "op" and x not in NO_OPERATORS for x, kind in zip(t.texts, t.kinds, strict=True)]
    literals = [kind in ("number", "string", "char") or x in LITERALS for x, kind in zip(t.texts, t.kinds, strict=True)]
    places = list(range(len(t.texts)))
    return places, t.lines, [t.first_of_line[i] == i for i in places], words, operators, literals, t.texts


def by_file(files: DataFrame, make, columns: str, keep: list[str]) -> DataFrame:
    """Rows that make(text) gives for each Java file, with the columns to keep; a file that can't be read gives none."""
    prepare(files.sparkSession)
    names = [*keep, *[c.split()[0] for c in re.split(r", (?![a-z]+>)", columns)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = remembered(make)
        texts = (x for pdf in batches for x in pdf[[*keep, "__text"]].itertuples(index=False, name=None))
        yield from framed(([(*key, *r) for r in made(text or "")] for *key, text in texts), names)

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*keep, F.col("text").alias("__text")).mapInPandas(run, f"{kinds}, {columns}")


def java_declarations(files: DataFrame, keep: list[str]) -> DataFrame:
    """keep and COLUMNS for every declaration of Java files (keep..., text)."""
    return by_file(files, rows_of, COLUMNS, keep)


def java_tokens(files: DataFrame, keep: list[str]) -> DataFrame:
    """keep, i, line, starts_line, identifier, operator, literal and token for every token of Java files.

    A file has many tokens, so they are laid out by column."""
    prepare(files.sparkSession)
    kinds = {"i": "int32", "line": "int32", "starts_line": "int32", "identifier": "int32", "operator": "int32", "literal": "int32", "token": object}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owners, sizes, columns = [], [], [[] for _ in kinds]

            def frame() -> pd.DataFrame:
                keys = pdf[keep].iloc[np.repeat(owners, sizes)].reset_index(drop=True)
                return keys.assign(**{c: np.array(x, dtype=k) for (c, k), x in zip(kinds.items(), columns, strict=True)})

            for n, text in enumerate(pdf["__text"]):
                found = token_columns(text or "")
                owners.append(n)
                sizes.append(len(found[0]))
                for c, x in zip(columns, found, strict=True):
                    c += x
                if len(columns[0]) >= 16 * ROWS:
                    yield frame()
                    owners, sizes, columns = [], [], [[] for _ in kinds]
            if owners:
                yield frame()

    key = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*keep, F.col("text").alias("__text")).mapInPandas(run, f"{key}, i int, line int, starts_line int, identifier int, operator int, literal int, token string")
