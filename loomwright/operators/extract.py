"""Function-level snippets of JavaScript sources, by a token scanner with bracket matching."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

MODULE_CHARACTERS = 4000
SCAN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<name>[#@]?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*|\.\d[\w]*)|(?P<sign>=>|\.\.\.|\?\.|===|!==|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|[-+*/%&|^<>=!]=|\+\+|--|[\s\S])",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
OPEN, CLOSE = "([{", ")]}"
# a slash after one of these begins a regular expression
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())
STATEMENT_WORDS = frozenset("if for while switch catch with return throw typeof new delete void in of do else function class const let var async await yield case default import export from extends super this".split())
SCHEMA = "path string, symbol string, start_line int, end_line int, code string, callees array<string>"


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    mate: int = -1


def scan(source: str) -> list[Token]:
    """Tokens without white space and comments; template literals are one token; brackets know their mates."""
    tokens: list[Token] = []
    stack: list[int] = []
    at = 0
    while at < len(source):
        char = source[at]
        last = tokens[-1] if tokens else None
        if char == "`":
            end = _template_end(source, at)
            tokens.append(Token("template", source[at:end], at, end))
            at = end
            continue
        if char == "/" and (last is None or last.text in BEFORE_REGEX or (last.kind == "sign" and last.text not in (")", "]", "}"))):
            found = REGEX.match(source, at)
            if found:
                tokens.append(Token("regex", found.group(), at, found.end()))
                at = found.end()
                continue
        found = SCAN.match(source, at)
        kind = found.lastgroup
        if kind not in ("space", "comment"):
            tokens.append(Token(kind, found.group(), at, found.end()))
            if tokens[-1].text in OPEN:
                stack.append(len(tokens) - 1)
            elif tokens[-1].text in CLOSE and stack:
                mate = stack.pop()
                tokens[-1].mate, tokens[mate].mate = mate, len(tokens) - 1
        at = found.end()
    for left in stack:
        tokens[left].mate = len(tokens) - 1
    return tokens


def _template_end(source: str, at: int) -> int:
    at += 1
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif source.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(source) and depth:
                if source[at] == "`":
                    at = _template_end(source, at)
                    continue
                depth += (source[at] == "{") - (source[at] == "}")
                at += 1
        else:
            at += 1
    return len(source)


class Extraction:
    """The snippets of one file; positions are places in the token list."""

    def __init__(self, path: str, source: str, module_characters: int | None = None) -> None:
        self.path, self.source, self.module_characters = path, source, module_characters
        self.tokens = scan(source)
        self.seen: Counter[str] = Counter()
        self.rows: list[tuple] = []

    def run(self) -> list[tuple]:
        self.visit(0, len(self.tokens), "")
        if not self.rows and self.source.strip():
            self.rows.append((self.path, "<module>", 1, self.source.count("\n") + 1, self.source[: self.module_characters], []))
        return self.rows

    def text(self, at: int) -> str:
        return self.tokens[at].text if 0 <= at < len(self.tokens) else ""

    def emit(self, name: str, first: int, last: int) -> None:
        """A snippet of the tokens first to last, both included."""
        self.seen[name] += 1
        symbol = name if self.seen[name] == 1 else f"{name}#{self.seen[name]}"
        start, end = self.tokens[first].start, self.tokens[last].end
        line = self.source.count("\n", 0, start) + 1
        code = self.source[start:end]
        self.rows.append((self.path, symbol, line, line + code.count("\n"), code, self.callees(first, last)))

    def callees(self, first: int, last: int) -> list[str]:
        """Names right before an argument list, sorted, once each; definitions and control words aren't
        calls, nor is what follows `new`."""
        names = set()
        for at in range(first + 1, last + 1):
            before = self.tokens[at - 1]
            if self.text(at) == "(" and before.kind == "name" and before.text not in STATEMENT_WORDS:
                defines = at - 2 >= 0 and self.text(at - 2) == "function" or self.text(at - 2) == "*" and self.text(at - 3) == "function"
                body = self.text(self.tokens[at].mate + 1) == "{"
                created = self.text(self.left_side(at, first) - 1) == "new"
                if not defines and not body and not created:
                    names.add(before.text)
        return sorted(names)

    def function_end(self, at: int) -> int:
        """The last token of the function value that begins at `at`; -1 if none does."""
        if self.text(at) == "async" and self.text(at + 1) not in ("=>", ",", ")", ";", "=", "."):
            at += 1
        if self.text(at) == "function":
            at += 1
            while self.text(at) not in ("(", ""):
                at += 1
            body = self.tokens[at].mate + 1 if at < len(self.tokens) else -1
            return self.tokens[body].mate if self.text(body) == "{" else -1
        if self.text(at) == "(":
            arrow = self.tokens[at].mate + 1
        elif at < len(self.tokens) and self.tokens[at].kind == "name":
            arrow = at + 1
        else:
            return -1
        if self.text(arrow) != "=>":
            return -1
        if self.text(arrow + 1) == "{":
            return self.tokens[arrow + 1].mate
        return self.expression_end(arrow + 1)

    def expression_end(self, at: int) -> int:
        """The last token before a comma, semicolon or closing bracket of this level, or a line that begins a statement."""
        last = at
        while at < len(self.tokens):
            token = self.tokens[at]
            if token.text in (",", ";") or token.text in CLOSE:
                return last
            if at > last and "\n" in self.source[self.tokens[last].end : token.start] and token.kind == "name" and (self.tokens[last].kind != "sign" or self.text(last) in CLOSE):
                return last
            last = token.mate if token.text in OPEN else at
            at = last + 1
        return last

    def statement_end(self, at: int) -> int:
        return at + 1 if self.text(at + 1) == ";" else at

    def left_side(self, equals: int, begin: int) -> int:
        """The first token of the member expression that ends before `equals`; `equals` itself if there is none."""
        at = equals
        while at > begin:
            before = self.tokens[at - 1]
            if before.text == "]" and before.mate >= begin:
                at = before.mate
            elif before.kind == "name" and before.text not in STATEMENT_WORDS - {"this", "super"}:
                at -= 1
                if self.text(at - 1) != ".":
                    return at
            elif before.text in (".", "?."):
                at -= 1
            else:
                return at
        return at

    def begins_statement(self, at: int, begin: int) -> bool:
        if at <= begin or self.text(at - 1) in (";", "{", "}", ":", "else", "=>"):
            return self.text(at - 1) != "=>"
        return "\n" in self.source[self.tokens[at - 1].end : self.tokens[at].start] and (self.tokens[at - 1].kind != "sign" or self.text(at - 1) in CLOSE)

    def visit(self, begin: int, end: int, scope: str) -> None:
        at = begin
        while at < end:
            at = self.step(at, begin, end, scope)

    def step(self, at: int, begin: int, end: int, scope: str) -> int:
        """Handle what begins at `at`; returns the place behind it."""
        text = self.text(at)
        after_dot = self.text(at - 1) in (".", "?.")
        if text in ("function", "async") and not after_dot and self.begins_statement(at, begin) or text in ("function", "async") and self.text(at - 1) in ("export", "default"):
            last = self.function_end(at)
            name_at = at + 1 + (text == "async")
            name_at += self.text(name_at) == "*"
            if last >= 0 and "function" in (text, self.text(at + 1)):
                self.emit(scope + (self.text(name_at) if self.text(name_at) != "(" else "<anonymous>"), at, last)
                return last + 1
        if text == "class" and not after_dot:
            return self.visit_class(at, scope)
        if text in ("const", "let", "var"):
            return self.visit_declaration(at, end, scope)
        if text == "=" and self.function_end(at + 1) >= 0:
            left = self.left_side(at, begin)
            if left < at:
                last = self.function_end(at + 1)
                stop = self.statement_end(last) if self.begins_statement(left, begin) else last
                self.emit(scope + self.source[self.tokens[left].start : self.tokens[at - 1].end], left, stop)
                return stop + 1
        if text == "(" and at > begin and self.tokens[at - 1].kind == "name":
            name, stop = self.definition_call(at, begin)
            if name:
                first = self.left_side(at, begin)
                self.emit(scope + name, first, stop)
                return stop + 1
        if text == ":" and self.text(at - 2) in ("{", ",") and self.function_end(at + 1) >= 0 and self.tokens[at - 1].kind in ("name", "string", "number"):
            last = self.function_end(at + 1)
            self.emit(scope + self.text(at - 1), at - 1, last)
            return last + 1
        if self.in_object(at) and (last := self.method_end(at)) >= 0:
            self.emit(scope + self.method_name(at), at, last)
            return last + 1
        return at + 1

    def visit_declaration(self, at: int, end: int, scope: str) -> int:
        """const x = function ...: the whole declaration is the snippet; a class value is looked into."""
        cursor = at + 1
        while cursor < end:
            if self.text(cursor) in OPEN and self.text(cursor):
                cursor = self.tokens[cursor].mate + 1
            else:
                cursor += 1
            if self.text(cursor) != "=":
                if self.text(cursor) == ",":
                    cursor += 1
                    continue
                return cursor if cursor > at + 1 else at + 1
            last = self.function_end(cursor + 1)
            if last >= 0:
                stop = last
                while self.text(stop + 1) == ",":
                    stop = self.expression_end(stop + 2)
                stop = self.statement_end(stop)
                self.emit(scope + self.text(cursor - 1), at, stop)
                return stop + 1
            if self.text(cursor + 1) == "class":
                return self.visit_class(cursor + 1, scope)
            stop = min(self.expression_end(cursor + 1), end - 1)
            inner = cursor + 1
            while inner <= stop:
                inner = self.step(inner, at, end, scope)
            if self.text(inner) != ",":
                return inner
            cursor = inner + 1
        return end

    def definition_call(self, at: int, begin: int) -> tuple[str, int]:
        """The name that a call statement with a function among its arguments defines, and the statement's last token."""
        close = self.tokens[at].mate
        first = self.left_side(at, begin)
        if close < 0 or not self.begins_statement(first, begin) or self.text(close + 1) in (".", "(", "[", "?."):
            return "", -1
        starts, cursor = [at + 1] if close > at + 1 else [], at + 1
        while cursor < close:
            if self.text(cursor) == ",":
                starts.append(cursor + 1)
            cursor = self.tokens[cursor].mate + 1 if self.text(cursor) in OPEN else cursor + 1
        functions = [s for s in starts if self.function_end(s) >= 0]
        if not functions:
            return "", -1
        stop = self.statement_end(close)
        if len(starts) >= 3 and self.tokens[starts[1]].kind == "string" and starts[2] - starts[1] == 2 and self.left_side(starts[1] - 1, at + 1) == starts[0]:
            return f"{self.source[self.tokens[starts[0]].start : self.tokens[starts[1] - 2].end]}.{self.text(starts[1]).strip(chr(39) + chr(34))}", stop
        name_at = functions[0] + 1 + (self.text(functions[0]) == "async")
        name_at += self.text(name_at) == "*"
        if "function" in (self.text(functions[0]), self.text(functions[0] + 1)) and self.text(name_at) not in ("(", "function"):
            return self.text(name_at), stop
        return "", -1

    def visit_class(self, at: int, scope: str) -> int:
        named = self.text(at + 1) not in ("{", "extends")
        name = self.text(at + 1) if named else "<class>"
        body = at + 1
        while body < len(self.tokens) and self.text(body) != "{":
            body = self.tokens[body].mate + 1 if self.text(body) in OPEN else body + 1
        if body >= len(self.tokens):
            return at + 1
        close, cursor = self.tokens[body].mate, body + 1
        while cursor < close:
            last = self.method_end(cursor)
            if last >= 0:
                self.emit(f"{scope}{name}.{self.method_name(cursor)}", cursor, last)
                cursor = last + 1
                continue
            field = cursor
            while field < close and self.text(field) != ";":
                if field > cursor and self.method_end(field) >= 0 and "\n" in self.source[self.tokens[field - 1].end : self.tokens[field].start]:
                    break
                field = self.tokens[field].mate + 1 if self.text(field) in OPEN else field + 1
            if self.text(field) == ";":
                field += 1
            self.visit(cursor, field, f"{scope}{name}.")
            cursor = max(field, cursor + 1)
        return close + 1

    def in_object(self, at: int) -> bool:
        return self.text(at - 1) == "," or self.text(at - 1) == "{" and self.text(at - 2) in ("=", "(", ":", ",", "return", "=>")

    def _method_parts(self, at: int) -> tuple[int, int]:
        """(place of the name, place of the parameters) of a method; the latter is -1 if none begins here."""
        name = at
        while self.text(name) in ("static", "async", "get", "set", "*") and self.text(name + 1) not in ("(", "=", ";", "", ",", ":", "}"):
            name += 1
        if name >= len(self.tokens):
            return name, -1
        after = self.tokens[name].mate + 1 if self.text(name) == "[" else name + 1
        fine = self.text(name) == "[" or self.tokens[name].kind in ("name", "string", "number")
        return name, after if fine and self.text(after) == "(" else -1

    def method_end(self, at: int) -> int:
        name, opening = self._method_parts(at)
        if opening < 0 or self.text(name) in ("if", "for", "while", "switch", "catch", "with", "function"):
            return -1
        body = self.tokens[opening].mate + 1
        return self.tokens[body].mate if self.text(body) == "{" else -1

    def method_name(self, at: int) -> str:
        name, _ = self._method_parts(at)
        return self.source[self.tokens[name].start : self.tokens[self.tokens[name].mate if self.text(name) == "[" else name].end]


def extract_functions(path: str, source: str, module_characters: int | None = MODULE_CHARACTERS) -> list[tuple]:
    """(path, symbol, start_line, end_line, code, callees) of one file, in order. Lines count from 1, both ends included.

    Functions in a snippet are not snippets of their own. A file without any, if not blank, is one `<module>` of its first
    module_characters characters, or of all with None. This is a scanner and no full parser: broken sources give what can be told apart.
    """
    return Extraction(path, source, module_characters).run()


def extract_snippets(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep..., path, symbol, start_line, end_line, code, callees) of files (keep..., path, source); NULL sources have none.

    A `<module>` has its whole file, so that content keys tell apart files that differ anywhere.
    """
    keep = keep or []
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*own, *row) for *own, path, source in batch.itertuples(index=False) if path is not None and source is not None for row in extract_functions(path, source.replace("\r\n", "\n"), None)]
            if not rows:
                continue
            yield pd.DataFrame(rows, columns=[*keep, "path", "symbol", "start_line", "end_line", "code", "callees"])

    return files.select(*keep, "path", "source").mapInPandas(run, ", ".join(filter(None, [kinds, SCHEMA])))
