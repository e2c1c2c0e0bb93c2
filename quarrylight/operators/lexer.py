"""Declarations of Go, Rust, Java, TypeScript and JavaScript texts by one pass over their tokens.

A text is cut into words and marks; comments and quoted texts go by. Brackets are paired with a stack, and a
second stack tells what each brace opens: a class, an object or a block. Every token is looked at a bounded
number of times, so the time is linear in the text, whatever it holds.
"""

from __future__ import annotations

import re

_WORD, _MARK = r"[A-Za-z_$#][\w$]*", r"=>|->|::|[(){}\[\]<>=;,:.*&|!?@]"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:.*?\*/|.*)"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"?'
#: Comments and quoted texts of a language; one that isn't closed reaches to the end of its line or of the text.
QUOTED = {
    "go": (_LINE, _BLOCK, _DOUBLE, r"`[^`]*`?", r"'(?:\\.|[^'\\\n])+'?"),
    "rust": (_LINE, _BLOCK, r'\bb?r(?P<h>#*)"(?:.*?"(?P=h)|.*)', _DOUBLE, r"'(?:\\.[^'\n]{0,8}|[^'\\\n])'"),
    "java": (_LINE, _BLOCK, r'"""(?:.*?"""|.*)', _DOUBLE, r"'(?:\\.|[^'\\\n])+'?"),
    "typescript": (_LINE, _BLOCK, _DOUBLE, r"'(?:\\.|[^'\\\n])*'?", r"`(?:\\.|[^`\\])*`?"),
}
QUOTED["javascript"] = QUOTED["typescript"]
_TOKENS = {k: re.compile("|".join((*v, f"(?P<word>{_WORD})", f"(?P<mark>{_MARK})")), re.S) for k, v in QUOTED.items()}
#: Words before a bracket that make it a statement or a call.
STATEMENTS = {"if", "for", "while", "switch", "catch", "return", "else", "new", "throw", "do", "try", "await", "yield", "case", "super", "this", "synchronized", "assert", "with", "function", "constructor"}
BEFORE_CALLS = {"new", "return", "throw", "else", "await", "case", "assert", "yield"}
MODIFIERS = {"public", "protected", "private"}
_STARTS = {"const", "let", "var", "function", "class", ";"}


class Tokens:
    """Words and marks with their places, and the partner of each bracket (itself if it has none)."""

    def __init__(self, text: str, language: str):
        self.text, self.at = [], []
        for m in _TOKENS[language].finditer(text):
            if m.lastgroup in ("word", "mark"):
                self.text.append(m.group())
                self.at.append(m.start())
        self.pair = list(range(len(self.text)))
        opened: list[int] = []
        closes = {")": "(", "]": "[", "}": "{", ">": "<"}
        for i, t in enumerate(self.text):
            if t in "([{<":
                opened.append(i)
            elif t in closes:
                while t != ">" and opened and self.text[opened[-1]] == "<":
                    opened.pop()  # a comparison
                if opened and self.text[opened[-1]] == closes[t]:
                    self.pair[opened.pop()] = i
            elif t == ";":
                while opened and self.text[opened[-1]] == "<":
                    opened.pop()
        self.open = list(range(len(self.text)))
        for i, k in enumerate(self.pair):
            if k > i:
                self.open[k] = i
        self.text += [""] * 4  # looking ahead needs no test

    def word(self, i: int) -> bool:
        return bool(self.text[i]) and (self.text[i][0].isalpha() or self.text[i][0] in "_$#")

    def past(self, i: int, *opening: str) -> int:
        """The token behind a bracket group at ``i``, ``i`` itself if none of ``opening`` stands there."""
        return self.pair[i] + 1 if self.text[i] in opening and self.pair[i] > i else i

    def __len__(self) -> int:
        return len(self.at)


def declarations(text: str, language: str) -> list[tuple[str, int]]:
    """(name, index) of what a text declares, by index."""
    t = Tokens(text, language)
    found = {"go": _go, "rust": _rust, "java": _java}.get(language, _script)(t)
    named = {t.at[i] + t.text[i].startswith("#"): t.text[i].lstrip("#") for i in found}
    return [(named[at], at) for at in sorted(named) if named[at]]


def _go(t: Tokens) -> list[int]:
    out, until = [], 0  # until: the end of a group of types
    for i in range(len(t)):
        if t.text[i] == "func":
            k = t.past(i + 1, "(")
            if t.word(k) and t.text[k + 1] in ("(", "["):
                out.append(k)
        elif t.text[i] == "type" and t.text[i + 1] == "(":
            until = t.pair[i + 1]
        elif t.text[i] == "type" and t.word(i + 1):
            out.append(i + 1)
        elif i < until and t.word(i) and t.text[t.past(i + 1, "[")] in ("struct", "interface"):
            out.append(i)
    return out


def _rust(t: Tokens) -> list[int]:
    out = []
    for i in range(len(t)):
        kind, name = t.text[i], i + 1
        if kind == "macro_rules" and t.text[i + 1] == "!" and t.word(i + 2):
            out.append(i + 2)
        elif kind in ("struct", "enum", "trait", "mod", "fn", "type") and t.word(name) and t.text[i - 1] != ".":
            out.append(name)
        elif kind == "union" and t.word(name) and t.text[t.past(name + 1, "<")] == "{":
            out.append(name)
    return out


def _scopes(t: Tokens, heads: set[str], objects: bool):
    """For each token the kind of brace that holds it: ``class``, ``enum``, ``object`` or ``block``; empty at the top."""
    held: list[str] = []
    bodies: dict[int, str] = {}
    for i in range(len(t)):
        x = t.text[i]
        yield i, held[-1] if held else ""
        if x in heads and t.text[i - 1] != "." and t.word(i + 1):
            k = t.past(i + 2, "<")
            while k < len(t) and t.text[k] not in heads and t.text[k] not in ("{", "}", ";", "="):
                k = max(t.past(k, "<", "(", "["), k + 1)
            bodies[k] = "enum" if x == "enum" else "class"
        elif x == "{":
            before = t.text[i - 1] if i else ""
            kind = "object" if objects and before in ("=", "(", ",", ":", "return", "[", "?") else "block"
            if before == ")" and not objects and _has_body(t, i, held[-1] if held else ""):
                kind = "class"
            held.append(bodies.get(i, kind))
        elif x == "}" and held:
            held.pop()


def _has_body(t: Tokens, i: int, scope: str) -> bool:
    """Whether the brace at ``i``, behind a bracket, is the body of a new object or of an enum's constant."""
    name = t.open[i - 1] - 1
    if name >= 0 and t.text[name] == ">":
        name = t.open[name] - 1
    first = t.text[name - 1] if name > 0 else ""
    return first == "new" or (scope == "enum" and first in (",", "{"))


def _java(t: Tokens) -> list[int]:
    out = []
    heads = {"class", "interface", "enum", "record"}
    for i, scope in _scopes(t, heads, False):
        x, before = t.text[i], t.text[i - 1] if i else ""
        if x in heads and before != "." and t.word(i + 1) and (x != "record" or t.text[i + 2] in ("(", "<")):
            out.append(i + 1)
        if not t.word(i) or x in STATEMENTS:
            continue
        typed = (t.word(i - 1) and before not in BEFORE_CALLS) or before in (">", "]") if i else False
        if t.text[i + 1] == "(" and scope in ("class", "enum") and typed:
            k = t.past(i + 1, "(")
            if t.text[k] == "throws":
                k += 1
                while t.word(k) or t.text[k] in (".", ","):
                    k += 1
            if t.text[k] == "{" or (t.text[k] == ";" and before not in MODIFIERS):
                out.append(i)
        elif t.text[i + 1] == "=" and typed:
            k = t.past(i + 2, "(")
            if t.text[k if k > i + 2 else k + 1] == "->" and (k > i + 2 or t.word(k)):
                out.append(i)
    return out


def _script(t: Tokens) -> list[int]:
    out = []
    for i, scope in _scopes(t, {"class", "interface"}, True):
        x, before = t.text[i], t.text[i - 1] if i else ""
        if before == ".":
            continue
        if x in ("class", "interface", "enum", "namespace") and t.word(i + 1) and t.text[i + 1] not in ("extends", "implements"):
            out.append(i + 1)
        elif x == "type" and t.word(i + 1) and t.text[t.past(i + 2, "<")] == "=":
            out.append(i + 1)
        elif x == "function":
            k = i + 2 if t.text[i + 1] == "*" else i + 1
            if t.word(k):
                out.append(k)
        elif x in ("const", "let", "var") and t.word(i + 1) and _holds_function(t, i + 2):
            out.append(i + 1)
        elif scope in ("class", "object") and t.word(i) and x not in STATEMENTS and before not in BEFORE_CALLS:
            k = t.past(i + 1, "<")
            if t.text[k] != "(" or t.pair[k] <= k:
                continue
            k = t.past(k, "(")
            if scope == "class" and t.text[k] == ":":
                k = _type_end(t, k + 1, ("{",))
            if t.text[k] == "{":
                out.append(i)
    return out


def _type_end(t: Tokens, i: int, stop: tuple[str, ...]) -> int:
    """Where a type that begins at ``i`` gives way to one of ``stop``; any other end of it ends the search too."""
    first = True
    while i < len(t) and t.text[i] not in _STARTS and t.text[i] not in (")", "}", ","):
        if t.text[i] in stop and not (first and t.text[i] == "{"):
            return i
        k = t.past(i, "(", "[", "{", "<")
        i, first = max(k, i + 1), False
    return i


def _holds_function(t: Tokens, i: int) -> bool:
    """Whether a variable, whose name ends before ``i``, is set to a function."""
    if t.text[i] == ":":
        i = _type_end(t, i + 1, ("=",))
    if t.text[i] != "=":
        return False
    i += 1
    if t.text[i] == "async":
        i += 1
    if t.text[i] == "function":
        return True
    k = t.past(t.past(i, "<"), "(")
    if k == t.past(i, "<"):
        return t.word(k) and t.text[k + 1] == "=>"
    if t.text[k] == ":":
        k = _type_end(t, k + 1, ("=>",))
    return t.text[k] == "=>"
