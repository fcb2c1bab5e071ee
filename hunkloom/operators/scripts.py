"""JavaScript and TypeScript declarations from tokens: a lexer with states, matched brackets, and a walk over statements.

The lexer knows texts, template literals with nested `${...}`, comments and regular expressions, so what they
hold never counts as code. Statements end at a semicolon, or at a line break where the next line can't go on with the
expression. Unclosed brackets reach to the end of the file; nothing is refused.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_LEX = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>'(?:\\[\s\S]|[^'\\\n])*'?|\"(?:\\[\s\S]|[^\"\\\n])*\"?)|(?P<word>[\w$#]+)|(?P<sign>=>|\.\.\.|[\s\S])")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|(?!\$\{)[^`\\])*(`|\$\{|\Z)")
#: Words after which a slash begins a regular expression.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "else", "do", "yield", "await"}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor"}
#: Signs that a line can't begin with as a new statement, or can't end with as a whole one.
_GOES_ON, _OPEN_END = set(".,?:=+-*/%&|^<>([`)]}") | {"=>"}, set(".,?:=+-*/%&|^<>([{!~") | {"=>"}
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


class Tokens:
    """Tokens of a source: `kind` (word, text, sign), `word`, `start`, `end`, and the index of each bracket's `mate`."""

    def __init__(self, source: str):
        self.source, self.kind, self.word, self.start, self.end, self.mate = source, [], [], [], [], {}
        self.breaks = [i for i, c in enumerate(source) if c == "\n"]
        at, open_, n = 0, [], len(source)
        self.balanced = True
        while at < n:
            m = _LEX.match(source, at)
            kind, end = m.lastgroup, m.end()
            if kind == "sign" and m[0] == "/" and self._value_may_follow() and (r := _REGEX.match(source, at)):
                kind, end = "text", r.end()
            elif kind == "sign" and m[0] == "`":
                kind, end = "text", self._template(at + 1, open_)
            elif kind == "sign" and m[0] == "}" and open_ and open_[-1] is None:  # the end of ${...}
                open_.pop()
                kind, end = "text", self._template(end, open_)
            if kind != "skip":
                word = source[at:end] if kind != "text" else ""
                if kind == "sign" and word in _CLOSERS:
                    open_.append(len(self.word))
                elif kind == "sign" and word in ")]}" and open_ and open_[-1] is not None:
                    if _CLOSERS[self.word[open_[-1]]] == word:
                        self.mate[open_.pop()] = len(self.word)
                    else:
                        self.balanced = False
                elif kind == "sign" and word in ")]}":
                    self.balanced = False
                for column, value in ((self.kind, kind), (self.word, word), (self.start, at), (self.end, end)):
                    column.append(value)
            at = max(end, at + 1)
        self.balanced = self.balanced and not open_

    def _template(self, at: int, open_: list) -> int:
        m = _TEMPLATE.match(self.source, at)
        if m[1] == "${":
            open_.append(None)
        return m.end()

    def _value_may_follow(self) -> bool:
        return not self.word or (self.kind[-1] == "word" and self.word[-1] in _BEFORE_VALUE) or (self.kind[-1] == "sign" and self.word[-1] not in ")]}")

    def __len__(self) -> int:
        return len(self.word)

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    def first(self, i: int) -> int:
        return self.line(self.start[i])

    def last(self, i: int) -> int:
        return self.line(max(self.end[min(i, len(self) - 1)] - 1, 0))

    def at(self, i: int, *words: str) -> bool:
        return i < len(self) and self.word[i] in words

    def is_word(self, i: int) -> bool:
        return i < len(self) and self.kind[i] == "word"

    def close(self, i: int) -> int:
        """The index of the bracket that closes the one at i."""
        return self.mate.get(i, len(self) - 1)

    def text(self, i: int, j: int) -> str:
        return self.source[self.start[i] : self.end[j]]

    def skip_generics(self, i: int) -> int:
        depth = 0
        while i < len(self) and (depth or self.at(i, "<")):
            depth += self.at(i, "<") - self.at(i, ">")
            i = self.close(i) + 1 if self.word[i] in _CLOSERS else i + 1
        return i

    def ends(self, i: int, stop: int, *also: str) -> int:
        """The index after the statement or expression that goes on at i: its semicolon, one of `also`, or a line that begins a new one."""
        while i < stop:
            if self.at(i, ";", *also):
                return i
            i = self.close(i) + 1 if self.kind[i] == "sign" and self.word[i] in _CLOSERS else i + 1
            if i < stop and self.first(i) > self.last(i - 1) and not (self.kind[i] == "sign" and self.word[i] in _GOES_ON) and not (self.kind[i - 1] == "sign" and self.word[i - 1] in _OPEN_END):
                return i
        return stop

    def body(self, i: int, stop: int) -> int | None:
        """The brace that opens a body after parameters or a class head; braces of types are passed by."""
        while i < stop and not self.at(i, ";"):
            if self.at(i, "{"):
                if not self.at(i - 1, ":", "|", "&", "=>", "<", ",", "="):
                    return i
            elif self.first(i) > self.last(i - 1) and self.is_word(i) and not self.at(i, "extends", "implements") and self.word[i - 1] not in _OPEN_END:
                return None
            i = self.close(i) + 1 if self.word[i] in _CLOSERS else i + 1
        return None

    def parameters(self, i: int, typed: bool) -> list[str]:
        """Texts of the parameters in the bracket at i: in JavaScript plain and rest ones, in TypeScript all."""
        stop, out, begin, depth = self.close(i), [], i + 1, 0
        i += 1
        while i <= stop:
            depth += typed and (self.at(i, "<") - self.at(i, ">"))
            if i == stop or (self.at(i, ",") and depth <= 0):
                if begin < i and (typed or self.at(begin, "...") or (begin == i - 1 and self.is_word(begin))):
                    out.append(self.text(begin, i - 1))
                begin = i + 1
            i = self.close(i) + 1 if i < stop and self.word[i] in _CLOSERS else i + 1
        return out


def declarations(source: str, typed: bool) -> tuple[list[dict], bool]:
    """What a script declares, and whether its brackets are balanced: imports, functions (also those held by variables), classes with methods, interfaces and type aliases of a script, in order.

    Each has name, kind, start_line, end_line, parameters, parent and is_exported. What stands within functions or blocks is not listed.
    """
    t, out = Tokens(source), []

    def add(name, kind, first, last, parameters=(), parent=None, exported=False):
        out.append({"name": name, "kind": kind, "start_line": t.first(first), "end_line": t.last(last), "parameters": list(parameters), "parent": parent, "is_exported": exported})

    def function(i, name, first, exported) -> int | None:
        """A function whose parameters or generics stand at i; the index after its body."""
        i = t.skip_generics(i)
        if not t.at(i, "("):
            return None
        open_ = t.body(t.close(i) + 1, len(t))
        if open_ is None:
            return None
        add(name, "function", first, t.close(open_), t.parameters(i, typed), None, exported)
        return t.close(open_) + 1

    def variable(i, stop, exported) -> int:
        """One declarator; the index after it."""
        value = i + 1
        while value < stop and not t.at(value, "=", ";", ",") and (t.first(value) == t.last(value - 1) or t.word[value] in _GOES_ON):
            value = t.skip_generics(value) if t.at(value, "<") else t.close(value) + 1 if t.word[value] in _CLOSERS else value + 1
        if not t.at(value, "="):
            return t.ends(value, stop, ",") if value < stop and not t.at(value, ";", ",") and t.first(value) == t.last(value - 1) else value
        head, found = value + 1 + t.at(value + 1, "async"), None
        if t.at(head, "function"):
            head += 1 + t.at(head + 1, "*")
            head = t.skip_generics(head + t.is_word(head))
            found = head if t.at(head, "(") else None
        else:
            head = t.skip_generics(head)
            arrow = t.close(head) + 1 if t.at(head, "(") else head + 1
            if t.at(head, "(") and t.at(arrow, ":"):  # a type of what is returned
                while arrow < stop and not t.at(arrow, "=>", ";"):
                    arrow = t.close(arrow) + 1 if t.word[arrow] in _CLOSERS else arrow + 1
            found = arrow if t.at(arrow, "=>") else None
        end = t.ends(value + 1 if found is None else found, stop, ",")
        if found is not None and t.is_word(i):
            add(t.word[i], "function", i, end - 1, t.parameters(head, typed) if t.at(head, "(") else (), None, exported)
        return end

    def members(i, stop, parent) -> None:
        while i < stop:
            while t.at(i, "@"):
                i += 2
                while t.at(i, "."):
                    i += 2
                i = t.close(i) + 1 if t.at(i, "(") else i
            first = i
            while i + 1 < stop and (t.word[i] in _MODIFIERS or t.at(i, "*")) and not t.at(i + 1, "(", "=", ";", ":", "<", "?"):
                i += 1
            name = t.word[i] if t.is_word(i) and not t.word[i].startswith("#") else None
            head = t.skip_generics(i + 1 + t.at(i + 1, "?"))
            if t.at(head, "(") and (open_ := t.body(t.close(head) + 1, stop)) is not None:
                if name is not None and t.at(i + 1, "(", "<", "?"):
                    add(name, "method", first, t.close(open_), t.parameters(head, typed), parent)
                i = t.close(open_) + 1
            else:
                i = t.close(i + 1) + 1 if t.at(i, "static") and t.at(i + 1, "{") else max(t.ends(i, stop), i + 1)
            i += t.at(i, ";")

    i, stop = 0, len(t)
    while i < stop:
        exported = t.at(i, "export")
        i += exported + (exported and t.at(i + 1, "default"))
        while t.at(i, "@"):
            i += 2
            while t.at(i, "."):
                i += 2
            i = t.close(i) + 1 if t.at(i, "(") else i
        exported, i = (True, i + 1) if t.at(i, "export") else (exported, i)
        first, then = i, None
        i += t.at(i, "async", "abstract") and t.at(i + 1, "function", "class")
        if t.at(i, "function"):
            name = i + 1 + t.at(i + 1, "*")
            then = function(name + 1, t.word[name], first, exported) if t.is_word(name) else None
        elif t.at(i, "class") and t.is_word(i + 1):
            if (open_ := t.body(i + 2, stop)) is not None:
                add(t.word[i + 1], "class", first, t.close(open_), (), None, exported)
                members(open_ + 1, t.close(open_), t.word[i + 1])
                then = t.close(open_) + 1
        elif t.at(i, "interface") and t.is_word(i + 1) and (open_ := t.body(i + 2, stop)) is not None:
            add(t.word[i + 1], "interface", first, t.close(open_), (), None, exported)
            then = t.close(open_) + 1
        elif t.at(i, "type") and t.is_word(i + 1) and t.at(t.skip_generics(i + 2), "="):
            then = t.ends(i, stop)
            add(t.word[i + 1], "type_alias", first, then if t.at(then, ";") else then - 1, (), None, exported)
        elif t.at(i, "import") and not t.at(i + 1, "(", "."):
            then = t.ends(i, stop)
            last = then if t.at(then, ";") else then - 1
            add(t.text(i, last), "import", i, last)
        elif t.at(i, "const", "let", "var") and not t.at(i + 1, "enum"):
            then = variable(i + 1, stop, exported)
            while t.at(then, ","):
                then = variable(then + 1, stop, exported)
        i = max(then if then is not None else t.ends(i, stop), i + 1 if then is None else then)
        i += t.at(i, ";")
    return out, t.balanced
