"""A small tolerant JavaScript parser: enough structure to slice code around a string, not a validator.

Nodes carry a type, the range start:end of the source, their parent and children, and named fields. What can't be
parsed becomes an error node and parsing goes on, so every script gives a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

FUNCTIONS = {"function_declaration", "function_expression", "arrow_function", "method_definition"}

_SPACE = re.compile(r"(?:\s+|//[^\n\u2028\u2029]*|/\*.*?(?:\*/|$)|<!--[^\n]*)*", re.S)
_NAME = re.compile(r"[#@]?[\w$\u0080-\uffff]+")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "instanceof", "yield", "await"}
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_UNARY = {"!", "~", "+", "-", "typeof", "void", "delete"}


class Node:
    __slots__ = ("type", "start", "end", "children", "fields", "parent")

    def __init__(self, type_: str, start: int, end: int = 0) -> None:
        self.type, self.start, self.end = type_, start, end
        self.children: list[Node] = []
        self.fields: dict[str, Node] = {}
        self.parent: Node | None = None

    def add(self, child: Node, field: str | None = None) -> Node:
        child.parent = self
        self.children.append(child)
        if field:
            self.fields[field] = child
        return child

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in source order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def up(self) -> Iterator[Node]:
        """This node and those above it."""
        node: Node | None = self
        while node:
            yield node
            node = node.parent


def _template_end(src: str, at: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """The end of the template that begins at at, and the ranges of its substitutions."""
    inner, i = [], at + 1
    while i < end:
        c = src[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, inner
        elif c == "$" and src.startswith("${", i):
            depth, j = 1, i + 2
            while j < end and depth:
                d = src[j]
                if d == "`":
                    j = _template_end(src, j, end)[0]
                    continue
                if d in "'\"":
                    j = max(_STRING.match(src, j, end).end(), j + 1)
                    continue
                depth += (d == "{") - (d == "}")
                j += 1
            inner.append((i + 2, j - 1 if depth == 0 else j))
            i = j
        else:
            i += 1
    return end, inner


def _tokens(src: str, at: int, end: int) -> list[tuple[str, str, int, int, bool]]:
    """(kind, text, start, end, whether a line ended before it)."""
    out: list[tuple[str, str, int, int, bool]] = []
    while True:
        space = _SPACE.match(src, at, end)
        line = "\n" in space.group()
        at = space.end()
        if at >= end:
            out.append(("end", "", end, end, True))
            return out
        c = src[at]
        if c == "`":
            z = _template_end(src, at, end)[0]
            kind = "template"
        elif c in "'\"":
            z, kind = _STRING.match(src, at, end).end(), "string"
        elif c.isdigit() or (c == "." and at + 1 < end and src[at + 1].isdigit()):
            z, kind = _NUMBER.match(src, at, end).end(), "number"
        elif m := _NAME.match(src, at, end):
            z, kind = m.end(), "name"
        else:
            last = out[-1] if out else None
            value = last is not None and (last[0] in ("string", "number", "template", "regex") or (last[0] == "name" and last[1] not in _BEFORE_REGEX) or last[1] in (")", "]"))
            m = _REGEX.match(src, at, end) if c == "/" and not value else None
            if m:
                z, kind = m.end(), "regex"
            else:
                m = _PUNCT.match(src, at, end)
                z, kind = (m.end() if m else at + 1), "punct"
        z = max(z, at + 1)
        out.append((kind, src[at:z] if kind in ("name", "punct") else "", at, z, line))
        at = z


class Parser:
    def __init__(self, src: str, start: int = 0, end: int | None = None) -> None:
        self.src = src
        self.tokens = _tokens(src, start, len(src) if end is None else end)
        self.i = 0
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        """The closing token of each opening one."""
        pairs, open_ = {}, []
        closes = {")": "(", "]": "[", "}": "{"}
        for k, t in enumerate(self.tokens):
            if t[0] != "punct":
                continue
            if t[1] in "([{":
                open_.append(k)
            elif t[1] in closes:
                for d in range(len(open_) - 1, max(-1, len(open_) - 4), -1):
                    if self.tokens[open_[d]][1] == closes[t[1]]:
                        pairs[open_[d]] = k
                        del open_[d:]
                        break
        return pairs

    # tokens

    def at(self, *texts: str) -> bool:
        return self.tokens[self.i][0] in ("punct", "name") and self.tokens[self.i][1] in texts

    def ahead(self, n: int = 1) -> str:
        k = self.i + n
        return self.tokens[k][1] if k < len(self.tokens) else ""

    def take(self) -> tuple[str, str, int, int, bool]:
        t = self.tokens[self.i]
        if t[0] != "end":
            self.i += 1
        return t

    def skip(self, text: str) -> bool:
        if self.at(text):
            self.take()
            return True
        return False

    def kind(self) -> str:
        return self.tokens[self.i][0]

    def start(self) -> int:
        return self.tokens[self.i][2]

    def close(self, node: Node) -> Node:
        node.end = max(self.tokens[self.i - 1][3] if self.i else node.start, node.start)
        return node

    def leaf(self, type_: str) -> Node:
        t = self.take()
        return Node(type_, t[2], t[3])

    # statements

    def program(self) -> Node:
        root = Node("program", 0)
        while self.kind() != "end":
            self.step(root)
        root.end = self.tokens[-1][3]
        return root

    def step(self, parent: Node) -> None:
        """One statement into parent; always moves on."""
        before = self.i
        parent.add(self.statement())
        if self.i == before:
            parent.add(self.leaf("error"))

    def block(self, type_: str = "statement_block") -> Node:
        node = Node(type_, self.start())
        self.take()
        while self.kind() != "end" and not self.at("}"):
            self.step(node)
        self.skip("}")
        return self.close(node)

    def end_statement(self, node: Node) -> Node:
        self.skip(";")
        return self.close(node)

    def statement(self) -> Node:
        start, word = self.start(), self.tokens[self.i][1]
        if word == "{":
            return self.block()
        if word == ";":
            return self.leaf("empty_statement")
        if self.kind() == "name":
            if word == "function" or (word == "async" and self.ahead() == "function"):
                return self.function("function_declaration")
            if word == "class":
                return self.klass("class_declaration")
            if word in ("var", "const") or (word == "let" and (self.tokens[self.i + 1][0] == "name" or self.ahead() in ("[", "{"))):
                return self.end_statement(self.declaration())
            if word in ("if", "while", "with") and self.ahead() == "(":
                node = Node(f"{word}_statement", start)
                self.take()
                self.parenthesized(node)
                node.add(self.statement())
                if word == "if" and self.skip("else"):
                    node.add(self.statement())
                return self.close(node)
            if word == "for":
                return self.loop()
            if word == "do":
                node = Node("do_statement", start)
                self.take()
                node.add(self.statement())
                if self.skip("while") and self.at("("):
                    self.parenthesized(node)
                return self.end_statement(node)
            if word in ("return", "throw"):
                node = Node(f"{word}_statement", start)
                self.take()
                if not self.at(";", "}") and self.kind() != "end" and not self.tokens[self.i][4]:
                    node.add(self.expression())
                return self.end_statement(node)
            if word in ("break", "continue", "debugger"):
                node = Node(f"{word}_statement", start)
                self.take()
                if word != "debugger" and self.kind() == "name" and not self.tokens[self.i][4]:
                    node.add(self.leaf("statement_identifier"))
                return self.end_statement(node)
            if word == "try":
                return self.attempt()
            if word == "switch" and self.ahead() == "(":
                return self.switch()
            if word in ("import", "export") and self.ahead() not in ("(", "."):
                return self.module()
            if self.ahead() == ":" and word not in ("case", "default"):
                node = Node("labeled_statement", start)
                node.add(self.leaf("statement_identifier"))
                self.take()
                node.add(self.statement())
                return self.close(node)
        node = Node("expression_statement", start)
        node.add(self.expression())
        return self.end_statement(node)

    def parenthesized(self, into: Node) -> None:
        node = Node("parenthesized_expression", self.start())
        self.take()
        if not self.at(")"):
            node.add(self.expression())
        self.skip(")")
        into.add(self.close(node))

    def declaration(self, no_in: bool = False) -> Node:
        node = Node("variable_declaration" if self.at("var") else "lexical_declaration", self.start())
        node.add(self.leaf("keyword"))
        while self.kind() == "name" or self.at("[", "{"):
            one = Node("variable_declarator", self.start())
            one.add(self.pattern(), "name")
            if self.skip("="):
                one.add(self.assignment(no_in), "value")
            node.add(self.close(one))
            if not self.skip(","):
                break
        return self.close(node)

    def pattern(self) -> Node:
        return self.leaf("identifier") if self.kind() == "name" else self.primary()

    def loop(self) -> Node:
        node = Node("for_statement", self.start())
        self.take()
        self.skip("await")
        if self.skip("("):
            if self.at("var", "let", "const"):
                node.add(self.declaration(no_in=True))
            elif not self.at(";"):
                node.add(self.expression(no_in=True))
            if self.at("of", "in"):
                node.type = "for_in_statement"
                self.take()
                node.add(self.expression())
            else:
                for _ in range(2):
                    if self.skip(";") and not self.at(";", ")"):
                        node.add(self.expression())
            self.skip(")")
        node.add(self.statement())
        return self.close(node)

    def attempt(self) -> Node:
        node = Node("try_statement", self.start())
        self.take()
        if self.at("{"):
            node.add(self.block())
        while self.at("catch", "finally"):
            part = Node(f"{self.take()[1]}_clause", self.tokens[self.i - 1][2])
            if self.skip("("):
                part.add(self.pattern())
                self.skip(")")
            if self.at("{"):
                part.add(self.block())
            node.add(self.close(part))
        return self.close(node)

    def switch(self) -> Node:
        node = Node("switch_statement", self.start())
        self.take()
        self.parenthesized(node)
        if not self.at("{"):
            return self.close(node)
        body = Node("switch_body", self.start())
        self.take()
        while self.kind() != "end" and not self.at("}"):
            if self.at("case", "default"):
                case = Node("switch_case", self.start())
                if self.take()[1] == "case":
                    case.add(self.expression())
                self.skip(":")
                while self.kind() != "end" and not self.at("case", "default", "}"):
                    self.step(case)
                body.add(self.close(case))
            else:
                self.step(body)
        self.skip("}")
        node.add(self.close(body))
        return self.close(node)

    def module(self) -> Node:
        word = self.tokens[self.i][1]
        node = Node(f"{word}_statement", self.start())
        self.take()
        self.skip("default")
        if word == "export" and (self.at("function", "class", "var", "let", "const", "async")):
            node.add(self.statement())
            return self.close(node)
        if word == "export" and not self.at("{", "*"):
            node.add(self.expression())
            return self.end_statement(node)
        while self.kind() != "end" and not self.at(";") and not (self.tokens[self.i][4] and node.children):
            node.add(self.leaf("string" if self.kind() == "string" else "import_part"))
        return self.end_statement(node)

    # functions and classes

    def function(self, type_: str) -> Node:
        node = Node(type_, self.start())
        self.skip("async")
        self.skip("function")
        self.skip("*")
        if self.kind() == "name":
            node.add(self.leaf("identifier"), "name")
        return self.rest_of_function(node)

    def rest_of_function(self, node: Node) -> Node:
        if self.at("("):
            node.add(self.parameters())
        if self.at("{"):
            node.add(self.block(), "body")
        return self.close(node)

    def parameters(self) -> Node:
        node = Node("formal_parameters", self.start())
        self.take()
        while self.kind() != "end" and not self.at(")"):
            before = self.i
            self.skip("...")
            node.add(self.assignment())
            self.skip(",")
            if self.i == before:
                node.add(self.leaf("error"))
        self.skip(")")
        return self.close(node)

    def klass(self, type_: str) -> Node:
        node = Node(type_, self.start())
        self.take()
        if self.kind() == "name" and not self.at("extends"):
            node.add(self.leaf("identifier"), "name")
        if self.skip("extends"):
            node.add(self.unary())
        if self.at("{"):
            body = Node("class_body", self.start())
            self.take()
            while self.kind() != "end" and not self.at("}"):
                before = self.i
                if not self.skip(";"):
                    body.add(self.member(in_class=True))
                if self.i == before:
                    body.add(self.leaf("error"))
            self.skip("}")
            node.add(self.close(body))
        return self.close(node)

    def member(self, in_class: bool = False) -> Node:
        """A pair, method, field, shorthand or spread of an object or class."""
        start = self.start()
        if self.at("..."):
            node = Node("spread_element", start)
            self.take()
            node.add(self.assignment())
            return self.close(node)
        while self.at("static", "async", "get", "set", "*") and self.ahead() not in ("(", ":", ",", "}", "=", ";"):
            self.take()
            if self.at("{"):
                return self.block()
        if self.at("["):
            key = Node("computed_property_name", self.start())
            self.take()
            key.add(self.assignment())
            self.skip("]")
            self.close(key)
        else:
            key = self.leaf({"string": "string", "number": "number"}.get(self.kind(), "property_identifier"))
        if self.at("("):
            node = Node("method_definition", start)
            node.add(key, "name")
            return self.rest_of_function(node)
        if in_class:
            node = Node("field_definition", start)
            node.add(key, "property")
            if self.skip("="):
                node.add(self.assignment(), "value")
            return self.end_statement(node)
        if self.skip(":"):
            node = Node("pair", start)
            node.add(key, "key")
            node.add(self.assignment(), "value")
            return self.close(node)
        key.type = "shorthand_property_identifier" if key.type == "property_identifier" else key.type
        if self.at("="):
            node = Node("object_assignment_pattern", start)
            self.take()
            node.add(key)
            node.add(self.assignment())
            return self.close(node)
        return key

    # expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.at(","):
            return first
        node = Node("sequence_expression", first.start)
        node.add(first)
        while self.skip(","):
            node.add(self.assignment(no_in))
        return self.close(node)

    def is_arrow(self) -> bool:
        k = self.i + (self.at("async") and self.ahead() != "=>" and not self.tokens[self.i + 1][4])
        t = self.tokens[k]
        if t[0] == "name":
            return self.tokens[min(k + 1, len(self.tokens) - 1)][1] == "=>"
        end = self.match.get(k) if t[1] == "(" else None
        return end is not None and end + 1 < len(self.tokens) and self.tokens[end + 1][1] == "=>"

    def assignment(self, no_in: bool = False) -> Node:
        if (self.kind() == "name" or self.at("(")) and self.is_arrow():
            node = Node("arrow_function", self.start())
            if self.at("async") and self.ahead() != "=>":
                self.take()
            node.add(self.parameters() if self.at("(") else self.leaf("identifier"))
            self.skip("=>")
            node.add(self.block() if self.at("{") else self.assignment(no_in), "body")
            return self.close(node)
        if self.at("yield"):
            node = Node("yield_expression", self.start())
            self.take()
            self.skip("*")
            if not self.at(")", "]", "}", ",", ";", ":") and self.kind() != "end":
                node.add(self.assignment(no_in))
            return self.close(node)
        left = self.binary(0, no_in)
        if self.at("?"):
            node = Node("ternary_expression", left.start)
            node.add(left)
            self.take()
            node.add(self.assignment())
            self.skip(":")
            node.add(self.assignment(no_in))
            return self.close(node)
        if self.kind() == "punct" and self.at(*_ASSIGN):
            node = Node("assignment_expression" if self.take()[1] == "=" else "augmented_assignment_expression", left.start)
            node.add(left, "left")
            node.add(self.assignment(no_in), "right")
            return self.close(node)
        return left

    def binary(self, least: int, no_in: bool) -> Node:
        left = self.unary()
        while True:
            op = self.tokens[self.i][1] if self.kind() in ("punct", "name") else ""
            level = _BINARY.get(op, 0)
            if level <= least or (no_in and op == "in"):
                return left
            node = Node("binary_expression", left.start)
            node.add(left, "left")
            node.add(self.leaf("operator"), "operator")
            node.add(self.binary(level - (op == "**"), no_in), "right")
            left = self.close(node)

    def unary(self) -> Node:
        word = self.tokens[self.i][1] if self.kind() in ("punct", "name") else ""
        if word in _UNARY or word in ("++", "--", "await"):
            node = Node("await_expression" if word == "await" else "update_expression" if word in ("++", "--") else "unary_expression", self.start())
            self.take()
            node.add(self.unary())
            return self.close(node)
        node = self.postfix(self.new() if word == "new" else self.primary())
        if self.at("++", "--") and not self.tokens[self.i][4]:
            outer = Node("update_expression", node.start)
            outer.add(node)
            self.take()
            return self.close(outer)
        return node

    def new(self) -> Node:
        node = Node("new_expression", self.start())
        self.take()
        if self.skip("."):  # new.target
            self.take()
            return self.close(node)
        node.add(self.new() if self.at("new") else self.postfix(self.primary(), calls=False), "constructor")
        if self.at("("):
            node.add(self.arguments(), "arguments")
        return self.close(node)

    def arguments(self) -> Node:
        return self.items("arguments", ")")

    def items(self, type_: str, closer: str) -> Node:
        node = Node(type_, self.start())
        self.take()
        while self.kind() != "end" and not self.at(closer):
            before = self.i
            if self.at(","):
                self.take()
                continue
            if self.at("..."):
                spread = Node("spread_element", self.start())
                self.take()
                spread.add(self.assignment())
                node.add(self.close(spread))
            else:
                node.add(self.assignment())
            if self.i == before:
                if self.at(")", "]", "}"):
                    break
                node.add(self.leaf("error"))
        self.skip(closer)
        return self.close(node)

    def postfix(self, node: Node, calls: bool = True) -> Node:
        while True:
            if self.at(".", "?.") and not (self.at("?.") and self.ahead() in ("(", "[")):
                outer = Node("member_expression", node.start)
                self.take()
                outer.add(node, "object")
                if self.kind() == "name":
                    outer.add(self.leaf("property_identifier"), "property")
            elif self.at("[") or (self.at("?.") and self.ahead() == "["):
                outer = Node("subscript_expression", node.start)
                self.skip("?.")
                self.take()
                outer.add(node, "object")
                if not self.at("]"):
                    outer.add(self.expression(), "index")
                self.skip("]")
            elif calls and (self.at("(") or (self.at("?.") and self.ahead() == "(")):
                outer = Node("call_expression", node.start)
                self.skip("?.")
                outer.add(node, "function")
                outer.add(self.arguments(), "arguments")
            elif calls and self.kind() == "template":
                outer = Node("call_expression", node.start)
                outer.add(node, "function")
                outer.add(self.template(), "arguments")
            else:
                return node
            node = self.close(outer)

    def template(self) -> Node:
        node = self.leaf("template_string")
        for a, z in _template_end(self.src, node.start, node.end)[1]:
            inner = Node("template_substitution", a, z)
            for child in Parser(self.src, a, z).program().children:
                inner.add(child.children[0] if child.type == "expression_statement" and child.children else child)
            node.add(inner)
        return node

    def primary(self) -> Node:
        kind, word = self.kind(), self.tokens[self.i][1]
        if kind in ("string", "number", "regex"):
            return self.leaf(kind)
        if kind == "template":
            return self.template()
        if kind == "name":
            if word == "function" or (word == "async" and self.ahead() == "function"):
                return self.function("function_expression")
            if word == "class":
                return self.klass("class")
            return self.leaf(word if word in ("this", "super", "null", "true", "false", "undefined", "import") else "identifier")
        if word == "(":
            node = Node("parenthesized_expression", self.start())
            self.take()
            if not self.at(")"):
                node.add(self.expression())
            self.skip(")")
            return self.close(node)
        if word == "[":
            return self.items("array", "]")
        if word == "{":
            node = Node("object", self.start())
            self.take()
            while self.kind() != "end" and not self.at("}"):
                before = self.i
                if not self.skip(","):
                    node.add(self.member())
                if self.i == before:
                    node.add(self.leaf("error"))
            self.skip("}")
            return self.close(node)
        if kind == "end" or word in (")", "]", "}", ",", ";", ":"):
            return Node("error", self.start(), self.start())
        return self.leaf("error")


def parse(code: str) -> Node:
    return Parser(code).program()
