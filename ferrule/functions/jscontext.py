"""Slices of JavaScript around API paths: the function a path stands in, with constants filled in, and its callers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jsparse import FUNCTIONS, Node, parse

MAX_SLICE, MAX_LITERAL, MAX_SIBLINGS, MAX_DEPTH = 5000, 50_000, 500, 100
_AMBIENT = {"JSON", "Object", "concat", "console", "document", "require", "return", "window"}

CONTEXT = "api_path string, found boolean, wrapper_code string, caller_codes array<string>"


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def unquote(text: str) -> str | None:
    """The text of a string literal; a single character is none."""
    if len(text) < 2:
        return None
    if text[0] in "\"'`" and text[-1] == text[0]:
        text = text[1:-1]
        for escaped in "\"'\\":
            text = text.replace("\\" + escaped, escaped)
    return text


class Script:
    """A parsed script that folds constants and cuts slices."""

    def __init__(self, code: str) -> None:
        self.code = code
        self.root = parse(code)
        self._declared: dict[int, list[Node]] = {}

    def text(self, node: Node) -> str:
        return self.code[node.start : node.end]

    def declarations(self, scope: Node) -> list[Node]:
        """Declarations and assignments within a scope but not in functions inside it, in source order."""
        if id(scope) not in self._declared:
            found, stack = [], [scope]
            while stack:
                node = stack.pop()
                if node.type in ("variable_declaration", "lexical_declaration"):
                    found.append(node)
                    continue
                if node.type == "assignment_expression":
                    found.append(node)
                stack.extend(c for c in reversed(node.children) if c.type not in FUNCTIONS)
            self._declared[id(scope)] = found
        return self._declared[id(scope)]

    def value_of(self, name: str, use: Node) -> Node | None:
        """What name was first set to before its use, in the nearest scope that sets it."""
        for scope in use.up():
            if scope is use or (scope.type not in FUNCTIONS and scope.type != "program"):
                continue
            for d in self.declarations(scope):
                if d.start >= use.start:
                    break
                targets = [(d.fields.get("left"), d.fields.get("right"))] if d.type == "assignment_expression" else [(c.fields.get("name"), c.fields.get("value")) for c in d.children if c.type == "variable_declarator"]
                for left, right in targets:
                    if left is not None and right is not None and left.type == "identifier" and self.text(left) == name:
                        return right
        return None

    def element(self, container: Node | None, key: str | int) -> Node | None:
        """The value of a key of an object literal, or of an index of an array literal, of moderate size."""
        if container is None or _bytes(self.text(container)) > MAX_LITERAL:
            return None
        if isinstance(key, int):
            return container.children[key] if container.type == "array" and 0 <= key < len(container.children) else None
        if container.type == "object":
            for pair in container.children:
                if pair.type == "pair":
                    k = self.text(pair.fields["key"])
                    if (k[1:-1] if len(k) > 1 and k[0] in "\"'" else k) == key:
                        return pair.fields.get("value")
        return None

    def fold(self, node: Node | None, depth: int = 0) -> str | None:
        """The string that an expression comes to, if it is built from literals; None past a nesting that no constant has."""
        if node is None or depth > MAX_DEPTH:
            return None
        if node.type == "string":
            return unquote(self.text(node))
        if node.type == "binary_expression":
            if self.text(node.fields["operator"]) != "+":
                return None
            left = self.fold(node.fields["left"], depth + 1)
            right = None if left is None else self.fold(node.fields["right"], depth + 1)
            return None if right is None else left + right
        if node.type == "identifier":
            return self.fold(self.value_of(self.text(node), node), depth + 1)
        if node.type in ("member_expression", "subscript_expression"):
            owner, key = node.fields["object"], node.fields.get("property") or node.fields.get("index")
            if owner.type != "identifier" or key is None:
                return None
            if key.type == "property_identifier":
                name: str | int | None = self.text(key)
            elif key.type == "string":
                name = unquote(self.text(key))
            else:
                name = int(self.text(key)) if key.type == "number" and self.text(key).isdigit() else None
            return None if name is None else self.fold(self.element(self.value_of(self.text(owner), owner), name), depth + 1)
        return None

    def propagated(self, node: Node, target: Node) -> str:
        """node's code with names that are constants replaced by them, but for target and names that are being set."""
        out, at, stack = [], node.start, [node]
        while stack:
            n = stack.pop()
            whole = n.type in ("member_expression", "subscript_expression")
            if (whole or n.type == "identifier") and n is not target and not self._binds(n) and (value := self.fold(n)) is not None:
                out += [self.code[at : n.start], f'"{value}"']
                at = n.end
            elif not whole:
                stack.extend(reversed(n.children))
        return "".join([*out, self.code[at : node.end]])

    @staticmethod
    def _binds(n: Node) -> bool:
        p = n.parent
        return p is not None and ((p.type in ("variable_declarator", "function_declaration", "function_expression", "class_declaration") and p.fields.get("name") is n) or (p.type == "assignment_expression" and p.fields.get("left") is n) or p.type == "formal_parameters")

    def slice(self, hit: Node) -> str:
        """The function around a string if it is of moderate size, else its statement with the declarations it needs."""
        owner = next((n for n in hit.up() if n.type in FUNCTIONS), None)
        if owner is not None and _bytes(plain := self.text(owner)) <= MAX_SLICE:
            filled = self.propagated(owner, hit)
            return filled if _bytes(filled) <= MAX_SLICE else plain
        statement = next((n for n in hit.up() if n.type.endswith("statement") or n.type == "variable_declarator"), None)
        if statement is None:
            return self.text(hit)
        core = self.propagated(statement, hit)
        used = {self.text(n) for n in statement.walk() if n.type == "identifier"} - _AMBIENT
        needed, home, scope = [], statement, statement.parent
        if statement.type == "variable_declarator" and scope is not None:
            home = scope
            if scope.type == "variable_declaration":
                for d in scope.children:
                    if d.start >= statement.start:
                        break
                    if d.type == "variable_declarator" and self.text(d.fields["name"]) in used:
                        needed.append(f"{self.text(scope.children[0])} {self.text(d)};")
            scope = scope.parent
        for sibling in scope.children[:MAX_SIBLINGS] if scope is not None and used else []:
            if sibling.start >= home.start:
                break
            if sibling.type in ("variable_declaration", "lexical_declaration"):
                code = self.text(sibling)
                tight = code.replace(" ", "")
                if any(f" {v} " in code or f"{v}=" in tight for v in used):
                    needed.append(code)
        whole = "\n".join(needed) + "\n" + core
        return whole if _bytes(whole) <= MAX_SLICE else core

    def name_of(self, function: Node) -> str | None:
        if function.type == "function_declaration" and "name" in function.fields:
            return self.text(function.fields["name"])
        p = function.parent
        if p is not None and p.type in ("variable_declarator", "assignment_expression"):
            left = p.fields.get("name") or p.fields.get("left")
            return self.text(left) if left is not None else None
        return None

    def contexts(self, paths: list[str]) -> dict[str, tuple[str, list[str]]]:
        """Slice and callers of each path that stands in a string; of a string that holds several the first counts, of several strings the last."""
        hits: list[tuple[str, Node]] = []
        calls: dict[str, list[Node]] = {}
        for n in self.root.walk():
            if n.type == "string":
                text = self.text(n)
                if (path := next((p for p in paths if p in text), None)) is not None:
                    hits.append((path, n))
            elif n.type == "call_expression" and n.fields["function"].type == "identifier":
                calls.setdefault(self.text(n.fields["function"]), []).append(n)
        out: dict[str, tuple[str, list[str]]] = {}
        for path, hit in dict(hits).items():
            function = next((n for n in hit.up() if n.type in FUNCTIONS), None)
            name = self.name_of(function) if function is not None else None
            callers: dict[str, None] = {}
            for call in calls.get(name, []) if name else []:
                around = next((n for n in call.up() if n.type in FUNCTIONS), None) or next((n for n in call.up() if n.type.endswith("statement") or n.type == "variable_declarator"), None)
                if around is not None:
                    callers[self.text(around)] = None
            out[path] = self.slice(hit), list(callers)
        return out


def contexts(code: str | None, paths: list[str] | None) -> list[tuple[str, bool, str, list[str]]]:
    """(path, found, wrapper_code, caller_codes) for each path; found is false throughout for a script nested beyond reason."""
    paths = [p for p in dict.fromkeys(paths or []) if p]
    try:
        found = Script(code).contexts(paths) if code and paths else {}
    except RecursionError:
        found = {}
    return [(p, p in found, *found.get(p, ("", []))) for p in paths]


def api_contexts(scripts: DataFrame, key: str = "js_url", source: str = "source", paths: str = "api_paths") -> DataFrame:
    """key and CONTEXT for each API path of each script. One Arrow pass; scripts don't move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *c) for k, code, ps in zip(*(b.column(i).to_pylist() for i in range(3))) for c in contexts(code, ps)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())))], [key, "api_path", "found", "wrapper_code", "caller_codes"])

    return scripts.select(F.col(key).cast("string"), F.col(source).cast("string"), F.col(paths).cast("array<string>")).mapInArrow(run, f"{key} string, {CONTEXT}")
