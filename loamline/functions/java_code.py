"""What one Java source says about its methods, classes and imports, by a small recursive reader.

Statements become nodes (kind, kids); expressions only give what is counted: joins of conditions,
conditional expressions, uses of this.x, and the statements of lambdas and anonymous classes inside them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\')|(?P<word>[^\W\d]\w*|\$\w*)|(?P<number>\d[\w.]*)|(?P<sign>->|::|&&|\|\||\+\+|--|[<>=!+\-*/&|^%]=|\.\.\.|[^\w\s])',
    re.S,
)
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
TYPES = frozenset("class interface enum record".split())
LOOPS = frozenset({"for", "while", "do"})
NESTING = LOOPS | {"if", "try", "switch"}
DECISIONS = LOOPS | {"if", "catch", "ternary"}
ACCESSOR = re.compile(r"^(get|set|is)[A-Z]")


class Unreadable(Exception):
    pass


@dataclass
class Node:
    kind: str
    kids: list[Node] = field(default_factory=list)
    test: list[Node] = field(default_factory=list)
    then: Node | None = None
    other: Node | None = None
    name: str = ""

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += n.kids


@dataclass
class Member:
    kind: str  # method, constructor or field
    name: str
    first: int
    last: int
    body: Node | None
    count: int = 1


@dataclass
class Type:
    kind: str
    name: str
    line: int
    members: list[Member] = field(default_factory=list)
    components: int = 0


class Reader:
    def __init__(self, source: str):
        self.at, self.tokens, line, pos = 0, [], 1, 0
        while pos < len(source):
            m = TOKEN.match(source, pos)
            if not m:
                raise Unreadable(f"line {line}")
            if m.lastgroup != "skip":
                self.tokens.append((m.group(), m.lastgroup, line))
            line += m.group().count("\n")
            pos = m.end()
        self.tokens.append(("", "end", line))

    # --- tokens ---
    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)][0]

    def kind(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)][1]

    @property
    def line(self) -> int:
        return self.tokens[self.at][2]

    def take(self, text: str | None = None) -> str:
        now, kind, line = self.tokens[self.at]
        if kind == "end" or (text is not None and now != text):
            raise Unreadable(f"line {line}: {now!r} where {text!r} is due")
        self.at += 1
        return now

    def maybe(self, text: str) -> bool:
        if self.peek() == text and self.kind() != "text":
            self.at += 1
            return True
        return False

    # --- expressions ---
    def expression(self, ends: frozenset[str]) -> list[Node]:
        """Nodes inside, up to one of the ends at this level, which stays."""
        found, asked = [], 0
        while True:
            t, kind = self.peek(), self.kind()
            if kind == "end":
                raise Unreadable("end of text in an expression")
            if kind != "text":
                if t in ends and not (t == ":" and asked):
                    return found
                if t == ":" and asked:
                    asked -= 1
                if t in "([" and t:
                    self.take()
                    found += self.expression(frozenset(")" if t == "(" else "]"))
                    self.take(")" if t == "(" else "]")
                    if t == "(" and self.peek() == "{" and self._anonymous:
                        found.append(self.inner_type())
                    continue
                if t == "{":
                    found += self.braces()
                    continue
                if t in ")]}":
                    raise Unreadable(f"line {self.line}: {t}")
                if t == "->":
                    self.take()
                    if self.peek() == "{":
                        found.append(self.block())
                    continue
                if t == "switch":
                    found.append(self.switch())
                    continue
                if t in ("&&", "||"):
                    found.append(Node("join"))
                elif t == "?" and self.peek(1) not in (">", ",", "extends", "super"):
                    found.append(Node("ternary"))
                    asked += 1
                elif t == "this" and self.peek(1) == "." and self.kind(2) == "word" and self.peek(3) != "(":
                    found.append(Node("use", name=self.peek(2)))
            self.take()

    @property
    def _anonymous(self) -> bool:
        """Whether the parentheses just closed belong to ``new Name(...)``."""
        depth, k = 0, self.at - 1
        while k >= 0:
            depth += (self.tokens[k][0] == ")") - (self.tokens[k][0] == "(")
            if depth == 0:
                break
            k -= 1
        k -= 1
        while k >= 0 and (self.tokens[k][1] == "word" and self.tokens[k][0] != "new" or self.tokens[k][0] in (".", "<", ">", ",", "?")):
            k -= 1
        return k >= 0 and self.tokens[k][0] == "new"

    def braces(self) -> list[Node]:
        """An array's values."""
        self.take("{")
        found = self.expression(frozenset("}"))
        self.take("}")
        return found

    def inner_type(self) -> Node:
        """An anonymous or local type's methods, as one node."""
        holder = Type("class", "", self.line)
        self.body(holder)
        return Node("type", [m.body for m in holder.members if m.body])

    # --- statements ---
    def block(self) -> Node:
        self.take("{")
        kids = []
        while not self.maybe("}"):
            kids.append(self.statement())
        return Node("block", kids)

    def condition(self) -> list[Node]:
        self.take("(")
        found = self.expression(frozenset(")"))
        self.take(")")
        return found

    def statement(self) -> Node:
        t = self.peek()
        if self.kind() == "text":
            t = ""
        if t == "{":
            return self.block()
        if t == ";":
            self.take()
            return Node("empty")
        if t == "if":
            self.take()
            test, then = self.condition(), self.statement()
            other = self.statement() if self.maybe("else") else None
            return Node("if", [*test, then, *([other] if other else [])], test, then, other)
        if t == "while":
            self.take()
            test = self.condition()
            return Node("while", [*test, self.statement()], test)
        if t == "for":
            self.take()
            head = self.condition()
            return Node("for", [*head, self.statement()], head)
        if t == "do":
            self.take()
            body = self.statement()
            self.take("while")
            test = self.condition()
            self.take(";")
            return Node("do", [body, *test], test)
        if t == "try":
            self.take()
            kids = [Node("head", self.condition())] if self.peek() == "(" else []
            kids.append(self.block())
            while self.maybe("catch"):
                self.condition()
                kids.append(Node("catch", [self.block()]))
            if self.maybe("finally"):
                kids.append(Node("finally", [self.block()]))
            return Node("try", kids)
        if t == "switch":
            node = self.switch()
            if self.peek() in (".", ";"):
                node = Node("expression", [node, *self.expression(frozenset(";"))])
                self.take(";")
            return node
        if t == "synchronized" and self.peek(1) == "(":
            self.take()
            return Node("synchronized", [*self.condition(), self.block()])
        if self.kind() == "word" and self.peek(1) == ":" and self.peek(2) != ":":
            self.take()
            self.take()
            return Node("label", [self.statement()])
        if self.local_type():
            return self.type_in_block()
        kids = self.expression(frozenset(";"))
        self.take(";")
        return Node("expression", kids)

    def local_type(self) -> bool:
        k = 0
        while self.peek(k) in MODIFIERS:
            k += 1
        return self.peek(k) in TYPES and self.kind(k + 1) == "word" and self.peek(k + 2) in ("{", "(", "<", "extends", "implements", "permits") and not (self.peek(k) == "record" and self.peek(k + 2) in ("extends",))

    def type_in_block(self) -> Node:
        found = self.type()
        return Node("type", [m.body for m in found.members if m.body])

    def switch(self) -> Node:
        self.take("switch")
        kids = self.condition()
        self.take("{")
        while not self.maybe("}"):
            if self.peek() == "case" or (self.peek() == "default" and self.peek(1) in (":", "->")):
                if self.take() == "case":
                    kids += self.expression(frozenset({":", "->"}))
                if self.take() == "->":
                    kids.append(self.statement())
            else:
                kids.append(self.statement())
        return Node("switch", kids)

    # --- declarations ---
    def skip_pair(self, opening: str, closing: str) -> int:
        """Past a balanced pair; the number of commas at its first level, plus one if it isn't empty."""
        self.take(opening)
        depth, commas, angle, some = 1, 0, 0, False
        while depth:
            t = self.take()
            depth += (t == opening) - (t == closing)
            if depth == 1:
                angle += (t == "<") - (t == ">") if opening != "<" else 0
                commas += t == "," and not angle
            some = some or depth > 0
        return commas + 1 if some else 0

    def annotations(self) -> None:
        while self.peek() == "@" and self.peek(1) != "interface":
            self.take()
            self.take()
            while self.maybe("."):
                self.take()
            if self.peek() == "(":
                self.skip_pair("(", ")")

    def modifiers(self) -> None:
        while True:
            self.annotations()
            if self.peek() == "non" and self.peek(1) == "-":
                self.at += 3
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                self.take()
            elif self.peek() == "sealed":
                self.take()
            else:
                return

    def type(self) -> Type:
        first = self.line
        self.modifiers()
        if self.maybe("@"):
            self.take("interface")
            kind = "annotation"
        else:
            kind = self.take()
        if kind not in TYPES | {"annotation"} or self.kind() != "word":
            raise Unreadable(f"line {self.line}: a type is due")
        out = Type(kind, self.take(), first)
        if self.peek() == "<":
            self.skip_pair("<", ">")
        if kind == "record":
            out.components = self.skip_pair("(", ")")
        while self.peek() != "{":
            self.take()
        if kind == "enum":
            self.take("{")
            while self.peek() not in (";", "}"):
                if self.peek() == "(":
                    self.skip_pair("(", ")")
                elif self.peek() == "{":
                    self.skip_pair("{", "}")
                else:
                    self.take()
            # Members of an enum stand one level deeper and aren't looked at.
            if self.maybe(";"):
                self.members(Type("enum", "", first))
            else:
                self.take("}")
            return out
        self.body(out)
        return out

    def body(self, out: Type) -> None:
        self.take("{")
        self.members(out)

    def members(self, out: Type) -> None:
        while not self.maybe("}"):
            if self.maybe(";"):
                continue
            if self.peek() == "{" or (self.peek() == "static" and self.peek(1) == "{"):
                self.maybe("static")
                self.block()
                continue
            self.member(out)

    def member(self, out: Type) -> None:
        start, first = self.at, self.line
        self.modifiers()
        if self.peek() == "@" or (self.peek() in TYPES and self.kind(1) == "word" and self.peek(2) not in ("=", ";", ",") and not (self.peek() == "record" and self.peek(2) == "(" and self.peek(1) != "" and out.name == "")):
            self.at = start
            self.type()
            return
        if self.peek() == "<":
            self.skip_pair("<", ">")
        self.annotations()
        name = ""
        if self.kind() == "word" and self.peek() == out.name and self.peek(1) in ("(", "{"):
            kind, name = "constructor", self.take()
        else:
            kind = "method"
            while True:  # the type, then the name
                if self.peek() == "<":
                    self.skip_pair("<", ">")
                elif self.peek() == "[":
                    self.skip_pair("[", "]")
                elif self.peek() in (".", "?", "&", "...") or self.kind() == "word":
                    name = self.take() if self.kind() == "word" else (self.take(), name)[1]
                elif self.peek() == "@":
                    self.annotations()
                else:
                    break
            if not name:
                raise Unreadable(f"line {self.line}: a member is due")
        if kind == "constructor" and self.peek() == "{":
            self.block()  # a record's compact constructor isn't counted
            return
        if self.peek() == "(":
            self.skip_pair("(", ")")
            while self.peek() not in ("{", ";"):
                self.take()
            body = self.block() if self.peek() == "{" else None
            if body is None:
                self.take(";")
            out.members.append(Member(kind, name, first, self.tokens[self.at - 1][2], body))
            return
        count, inits = 1, []
        while not self.maybe(";"):
            if self.maybe(","):
                count += 1
                self.take()
            elif self.maybe("="):
                inits += self.expression(frozenset({",", ";"}))
            elif self.peek() == "[":
                self.skip_pair("[", "]")
            else:
                raise Unreadable(f"line {self.line}: {self.peek()!r} in a field")
        out.members.append(Member("field", name, first, self.tokens[self.at - 1][2], None, count))

    def unit(self) -> tuple[list[Type], list[str]]:
        types, imports = [], []
        while self.kind() != "end":
            if self.maybe(";"):
                continue
            start = self.at
            self.annotations()
            if self.peek() in ("package", "import"):
                which, path = self.take(), []
                while not self.maybe(";"):
                    path.append(self.take())
                if which == "import":
                    imports.append(path[-1])
                continue
            self.at = start
            types.append(self.type())
        return types, imports


def cyclomatic(body: Node | None) -> int:
    return 1 + sum(n.kind in DECISIONS or n.kind == "join" for n in body.walk()) if body else 1


def nesting(n: Node) -> int:
    deepest, stack = 0, [(n, 0)]
    while stack:
        node, depth = stack.pop()
        deepest = max(deepest, depth)
        stack += [(k, depth + (k.kind in NESTING)) for k in node.kids]
    return deepest


def joins(nodes: list[Node]) -> int:
    return sum(n.kind == "join" for top in nodes for n in top.walk())


def cognitive(n: Node, depth: int = 0) -> int:
    """What the node's kids cost; a node is only counted where it is a kid, so a branch that is a bare
    statement counts for what is inside it."""
    total, deeper = 0, depth + 1
    for k in n.kids:
        if k.kind == "if":
            total += deeper + joins(k.test) + cognitive(k.then, deeper)
            other = k.other
            while other is not None:
                total += 1
                if other.kind == "if":
                    total += joins(other.test) + cognitive(other.then, deeper)
                    other = other.other
                else:
                    total += cognitive(other, deeper)
                    other = None
        elif k.kind in LOOPS:
            total += deeper + (joins(k.test) if k.kind == "while" else 0) + cognitive(k, deeper)
        elif k.kind == "try":
            for part in k.kids:
                if part.kind == "catch":
                    total += deeper + cognitive(part, deeper)
                elif part.kind != "head":
                    total += cognitive(part, depth)
        elif k.kind == "switch":
            total += deeper + cognitive(k, deeper)
        else:
            total += cognitive(k, depth)
    return total


def has_logic(body: Node | None) -> bool:
    return body is not None and any(n.kind in NESTING for n in body.walk())


def count(body: Node | None, kind: str) -> int:
    return sum(n.kind == kind for n in body.walk()) if body else 0


def function_row(m: Member, owner: str) -> dict:
    return {
        "function_name": m.name,
        "class_name": owner,
        "line_number": m.first,
        "length": m.last - m.first + 1,
        "cyclomatic_complexity": cyclomatic(m.body),
        "max_nesting_depth": nesting(m.body) if m.body else 0,
        "branch_count": count(m.body, "if"),
        "exception_paths": count(m.body, "catch"),
        "cognitive_complexity": cognitive(Node("method", [m.body])) if m.body else 0,
    }


def class_row(t: Type) -> dict:
    from .python_code import shared_pairs

    methods = [m for m in t.members if m.kind != "field"]
    accessors = [m for m in methods if ACCESSOR.match(m.name) and not has_logic(m.body)]
    plain = [m for m in methods if m.kind == "method" and m not in accessors]
    joined, pairs = shared_pairs([{n.name for n in m.body.walk() if n.kind == "use"} if m.body else set() for m in plain])
    return {
        "class_name": t.name,
        "line_number": t.line,
        "field_count": t.components + sum(m.count for m in t.members if m.kind == "field"),
        "method_count": len(methods),
        "behavior_method_count": sum(has_logic(m.body) for m in plain),
        "candidate_count": len(plain),
        "dunder_method_count": 0,
        "property_count": len(accessors),
        "total_complexity": sum(cyclomatic(m.body) for m in methods),
        "joined_pairs": joined,
        "method_pairs": pairs,
    }


def read(source: str | None) -> dict | None:
    """functions, classes and imports, or None if it doesn't parse."""
    try:
        types, imports = Reader(source or "").unit()
        functions = [function_row(m, t.name) for t in types for m in t.members if m.kind != "field"]
        classes = [class_row(t) for t in types if t.kind in ("class", "record")]
    except (Unreadable, RecursionError):
        return None
    return {"functions": functions, "classes": classes, "imports": sorted(set(imports))}
