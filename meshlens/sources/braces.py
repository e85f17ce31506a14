"""Definitions, inheritance, decorators, imports and calls of files in languages with braces.

A file is cut into tokens first, so comments, strings and regular expressions hold no code; code
inside template literals is read. A stack of scopes then follows the brackets. This is no full
grammar: types are not resolved, macros are no calls, and a file with unbalanced brackets gives
what was read of it.
"""

from __future__ import annotations

import re

#: Words that stand before a bracket without being called. Fixed values of the languages.
_SCRIPT = frozenset("if for while switch catch return typeof await yield new delete void in of instanceof throw case do else with function super as let const var import async".split())
NOT_CALLED = {
    "typescript": _SCRIPT, "javascript": _SCRIPT,
    "go": frozenset("if for switch select return go defer range func case else var const type interface struct map chan import".split()),
    "java": frozenset("if for while switch catch return new throw case do else super this synchronized try assert instanceof".split()),
    "rust": frozenset("if for while loop match return in else fn let mut ref move as impl dyn where pub unsafe async await".split()),
}
#: Words after which a slash opens a regular expression. Fixed values of the language.
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else await yield".split())
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_SPACE = re.compile(r"[ \t\r\f\v]+")
_QUOTED = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*{q}?", re.S) for q in "'\""}
_CHAR = re.compile(r"'(?:[^'\\\n]|\\(?:u\{[0-9A-Fa-f]+\}|x..|.))'")
_RAW = re.compile(r'b?r(#*)"')
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
CLOSES = {"(": ")", "[": "]", "{": "}"}


def tokens(text: str, lang: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) with kind w(ord), s(tring), n(umber) or p(unctuation); => -> :: ?. are one token."""
    out: list[tuple[str, str, int]] = []
    script, rust, go = lang in ("typescript", "javascript"), lang == "rust", lang == "go"
    i, line, n, depth = 0, 1, len(text), []
    template = False  # inside a template literal's own text
    while i < n:
        if template:
            at = i
            while i < n and text[i] != "`" and not text.startswith("${", i):
                i += 2 if text[i] == "\\" else 1
            line += text.count("\n", at, i)
            template = False
            if text.startswith("${", i):
                depth.append(0)
                out.append(("p", "(", line))  # read as an argument
                i += 2
            else:
                i += 1
            continue
        c = text[i]
        if c == "\n":
            line, i = line + 1, i + 1
        elif m := _SPACE.match(text, i):
            i = m.end()
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            level, at = 1, i + 2
            while at < n and level:  # nested in one of the languages only
                if text.startswith("*/", at):
                    level, at = level - 1, at + 2
                elif rust and text.startswith("/*", at):
                    level, at = level + 1, at + 2
                else:
                    at += 1
            line += text.count("\n", i, at)
            i = at
        elif rust and (m := _RAW.match(text, i)):
            end = text.find('"' + m[1], m.end())
            end = n if end < 0 else end + 1 + len(m[1])
            out.append(("s", text[i:end], line))
            line += text.count("\n", i, end)
            i = end
        elif c == "`" and (script or go):
            if go:
                end = text.find("`", i + 1)
                end = n if end < 0 else end + 1
                out.append(("s", text[i:end], line))
                line += text.count("\n", i, end)
                i = end
            else:
                out.append(("s", "``", line))
                template, i = True, i + 1
        elif lang == "java" and text.startswith('"""', i):
            end = text.find('"""', i + 3)
            end = n if end < 0 else end + 3
            out.append(("s", text[i:end], line))
            line += text.count("\n", i, end)
            i = end
        elif c == "'" and rust:
            m = _CHAR.match(text, i)  # else a lifetime
            i = m.end() if m else i + 1
            if m:
                out.append(("s", m[0], line))
            elif w := _WORD.match(text, i):
                i = w.end()
        elif c in _QUOTED:
            m = _QUOTED[c].match(text, i)
            out.append(("s", m[0], line))
            line += m[0].count("\n")
            i = m.end()
        elif m := _WORD.match(text, i):
            out.append(("w", m[0], line))
            i = m.end()
        elif m := _NUMBER.match(text, i):
            out.append(("n", m[0], line))
            i = m.end()
        elif c == "/" and script and (not out or (out[-1][0] == "p" and out[-1][1] not in (")", "]", "}", "<")) or out[-1][1] in BEFORE_REGEX) and (m := _REGEX.match(text, i)):
            out.append(("s", m[0], line))
            i = m.end()
        elif c == "}" and depth and depth[-1] == 0:
            depth.pop()
            out.append(("p", ")", line))
            template, i = True, i + 1
        else:
            if depth and c in "{}":
                depth[-1] += 1 if c == "{" else -1
            two = text[i : i + 2] if text[i : i + 2] in ("=>", "->", "::", "?.") else c
            out.append(("p", two, line))
            i += len(two)
    return out


class _Reader:
    """One file's tokens and what was found; scopes hold (closing bracket, owner, whether a type's body)."""

    def __init__(self, lang: str, module: str, text: str):
        self.t, self.lang, self.module = tokens(text, lang), lang, module
        self.not_called = NOT_CALLED[lang]
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.scopes: list[tuple[str, str, bool]] = [("", module, False)]
        self.pending: tuple[str, bool] | None = None  # owner of the next body
        self.body_at = -1
        self.decorators: list[tuple[str, int]] = []
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        found, held = {}, []
        for i, (k, x, _) in enumerate(self.t):
            if k == "p" and x in CLOSES:
                held.append((CLOSES[x], i))
            elif k == "p" and x in ")]}" and held and held[-1][0] == x:
                found[held.pop()[1]] = i
        return found

    def at(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) and self.t[i][0] != "s" else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "w"

    def chain(self, i: int) -> tuple[str, int]:
        """The dotted name that starts at ``i`` and the place behind it."""
        name, i = self.t[i][1], i + 1
        while self.at(i) in (".", "::", "?.") and self.is_word(i + 1):
            name, i = name + ("::" if self.at(i) == "::" else ".") + self.at(i + 1), i + 2
        return name, i

    def angles(self, i: int) -> int:
        """The place behind type arguments at ``i``, or ``i`` where there are none."""
        if self.at(i) != "<":
            return i
        level, j = 0, i
        while j < len(self.t) and j < i + 400:
            x = self.at(j)
            if x == "<":
                level += 1
            elif x == ">":
                level -= 1
                if not level:
                    return j + 1
            elif x in (";", ")", "}"):
                return i
            elif x in ("(", "[", "{"):
                j = self.match.get(j, j)
            j += 1
        return i

    def define(self, kind: str, name: str, owner: str, line: int) -> str:
        here = f"{owner}.{name}"
        self.nodes.append((kind, name, here, line))
        self.edges.append((owner, here, "defines", line))
        self.edges += [(here, d, "uses_decorator", at) for d, at in self.decorators]
        self.decorators = []
        return here

    def body(self, i: int, here: str, a_type: bool, stop: str = ";") -> None:
        """The next brace from ``i`` on, at this depth and before ``stop``, opens the body of ``here``; those of types don't. A header has 2,000 tokens at most."""
        end = min(len(self.t), i + 2_000)
        while i < end:
            x = self.at(i)
            if x == "<" or (x == "{" and self.at(i - 1) in (":", "|", "&", "=>")):
                i = max(self.angles(i), self.match.get(i, i) + 1)
                continue
            if x == "{":
                self.pending, self.body_at = (here, a_type), i
                return
            if x and x in stop + ")}":
                return
            i = self.match.get(i, i) + 1 if x in ("(", "[") else i + 1

    def parents(self, i: int, here: str) -> None:
        """extends and implements up to the body."""
        kind, end = None, min(len(self.t), i + 2_000)
        while i < end and self.at(i) not in ("{", ";"):
            x = self.at(i)
            if x in ("extends", "implements"):
                kind, i = x, i + 1
            elif x == "<":
                i = max(self.angles(i), i + 1)
            elif x == "(":
                i = self.match.get(i, i) + 1
            elif kind and self.is_word(i):
                name, after = self.chain(i)
                self.edges.append((here, name, kind, self.t[i][2]))
                i = after
            else:
                i += 1

    def read(self) -> tuple[list[tuple], list[tuple]]:
        i = 0
        while i < len(self.t):
            kind, x, line = self.t[i]
            if kind == "p" and x in CLOSES:
                owner, a_type = self.scopes[-1][1], False
                if self.pending and i == self.body_at:
                    (owner, a_type), self.pending = self.pending, None
                self.scopes.append((CLOSES[x], owner, a_type))
                i += 1
            elif kind == "p" and x in ")]}":
                if len(self.scopes) > 1 and self.scopes[-1][0] == x:
                    self.scopes.pop()
                i += 1
            elif kind == "w" or x in ("@", "#"):
                i = getattr(self, "_" + {"javascript": "script", "typescript": "script"}.get(self.lang, self.lang))(i)
            else:
                i += 1
        return self.nodes, self.edges

    def decorator(self, i: int, name_at: int) -> int:
        name, after = self.chain(name_at)
        self.decorators.append((name, self.t[i][2]))
        return self.match.get(after, after) + 1 if self.at(after) == "(" else after

    def call(self, i: int) -> int:
        """A call's edge, if the name at ``i`` is called; the place behind the name."""
        name, after = self.chain(i)
        behind = self.angles(after + 1 if self.at(after) == "::" and self.at(after + 1) == "<" else after)
        behind += self.at(behind) == "?."
        if self.at(behind) == "(" and name not in self.not_called:
            self.edges.append((self.scopes[-1][1], name, "calls", self.t[i][2]))
        return after

    def _script(self, i: int) -> int:
        x, line, owner = self.t[i][1], self.t[i][2], self.scopes[-1][1]
        if x == "@" and self.is_word(i + 1):
            return self.decorator(i, i + 1)
        if x in ("class", "interface", "enum") and self.is_word(i + 1) and self.at(i - 1) != ".":
            here = self.define("class" if x == "class" else "type", self.at(i + 1), owner, line)
            self.parents(i + 2, here)
            if x != "class":  # signatures and values
                while i < len(self.t) and self.at(i) not in ("{", ";"):
                    i += 1
                return self.match.get(i, i) + 1
            self.body(i + 2, here, True)
            while i < len(self.t) and self.at(i) not in ("{", ";") and i != self.body_at:
                i += 1
            return i
        if x == "type" and self.is_word(i + 1) and self.at(self.angles(i + 2)) == "=":
            self.define("type", self.at(i + 1), owner, line)
            return i + 2
        if x == "function":
            i += 2 if self.at(i + 1) == "*" else 1
            if self.is_word(i):
                here = self.define("function", self.at(i), owner, line)
                self.body(i + 1, here, False)
                return i + 1
            return i
        if x in ("const", "let", "var") and self.is_word(i + 1):
            return self._assigned(i + 1, owner, line)
        if self.scopes[-1][2]:  # a class body: members
            after = self.angles(i + 1)
            if self.at(after) == "(" and (end := self.match.get(after)) is not None and self.at(i - 1) not in (".", "=", "new"):
                here = self.define("function", x, owner, line)
                self.body(end + 1, here, False)
                return after
            if self.at(i + 1) in ("=", ":", ";", "?", "!"):
                kept, self.decorators = self.decorators, []  # a field's decorators belong to no function
                after = self._assigned(i, owner, line)
                self.decorators = [] if after > i else kept
                return after
            return i + 1
        return self.call(i)

    def _assigned(self, i: int, owner: str, line: int) -> int:
        """A name given a function or an arrow is a function."""
        j = i + 1
        if self.at(j) == ":":
            while j < len(self.t) and self.at(j) not in ("=", ";") and self.t[j][2] == line:
                j = self.match.get(j, j) + 1
        if self.at(j) != "=":
            return i + 1
        j += 2 if self.at(j + 1) == "async" else 1
        if self.at(j) == "function":
            here = self.define("function", self.at(i), owner, line)
            self.body(j + 1, here, False)
            return j + 1
        params = self.angles(j)
        end = self.match.get(params, -2) + 1 if self.at(params) == "(" else params + 1 if self.is_word(params) else -1
        if end < 1:
            return i + 1
        arrow = end
        if self.at(arrow) == ":":  # a type of what is returned
            while arrow < len(self.t) and self.at(arrow) not in ("=>", ";", "="):
                arrow = self.match.get(arrow, arrow) + 1
        if self.at(arrow) != "=>":
            return i + 1
        here = self.define("function", self.at(i), owner, line)
        if self.at(arrow + 1) in ("{", "("):
            self.pending, self.body_at = (here, False), arrow + 1
        elif self.is_word(arrow + 1):
            name, after = self.chain(arrow + 1)
            if self.at(self.angles(after)) == "(" and name not in self.not_called:
                self.edges.append((here, name, "calls", self.t[arrow + 1][2]))
                return after
        return params if self.at(params) == "(" else arrow + 1

    def _java(self, i: int) -> int:
        x, line, owner = self.t[i][1], self.t[i][2], self.scopes[-1][1]
        if x == "#":
            return i + 1
        if x == "@" and self.is_word(i + 1) and self.at(i + 1) != "interface":
            return self.decorator(i, i + 1)
        if x in ("package", "import") and len(self.scopes) == 1:
            j, parts = i + 1 + (self.at(i + 1) == "static"), []
            while j < len(self.t) and self.at(j) != ";":
                parts.append(self.at(j))
                j += 1
            if x == "import":
                self.edges.append((self.module, "".join(parts), "imports", line))
            self.decorators = []
            return j
        if x in ("class", "interface", "enum", "record") and self.is_word(i + 1) and self.at(i - 1) != ".":
            here = self.define("type" if x in ("interface", "enum") else "class", self.at(i + 1), owner, line)
            self.parents(i + 2, here)
            self.body(i + 2, here, True)
            return self.body_at if self.pending and self.body_at > i else i + 2
        if self.scopes[-1][2]:
            before, name = self.at(i - 1), owner.rsplit(".", 1)[-1]
            typed = (self.is_word(i - 1) and before != "new") or before in (">", "]") or x == name
            if self.at(i + 1) == "(" and typed and (end := self.match.get(i + 1)) is not None and self.at(end + 1) in ("{", ";", "throws", "default"):
                here = self.define("function", x, owner, line)
                self.body(end + 1, here, False)
                return end + 1
            if self.at(i + 1) in ("=", ";"):
                self.decorators = []
            if before in ("{", "}", ",", ";") and self.at(i + 1) == "(":  # a constant of an enumeration
                return i + 1
        return self.call(i)

    def _go(self, i: int) -> int:
        x, line, owner = self.t[i][1], self.t[i][2], self.scopes[-1][1]
        if len(self.scopes) == 1:
            if x == "import":
                end = self.match.get(i + 1, i + 1) if self.at(i + 1) == "(" else i + 2 if self.is_word(i + 1) or self.at(i + 1) in (".", "_") else i + 1
                for k, s, at in self.t[i : end + 1]:
                    if k == "s":
                        self.edges.append((self.module, s.strip("\"`"), "imports", at))
                return end + 1
            if x == "func":
                on = self.module
                if self.at(i + 1) == "(":
                    end = self.match.get(i + 1, i + 1)
                    named = [j for j in range(i + 2, end) if self.is_word(j) and self.at(j + 1) in (")", "[")]
                    on, i = f"{owner}.{self.at(named[0])}" if named else owner, end
                if self.is_word(i + 1):
                    here = self.define("function", self.at(i + 1), on, line)
                    j = i + 2
                    while j < len(self.t) and self.at(j) != "{" and self.at(j) != "func":
                        # the types of an inline interface or struct are no body
                        j = self.match.get(j + 1, j + 1) + 1 if self.at(j) in ("interface", "struct") else self.match.get(j, j) + 1
                    if self.at(j) == "{":
                        self.pending, self.body_at = (here, False), j
                    return j
                return i + 1
        if x == "type" and self.is_word(i + 1) and self.at(i - 1) != ".":
            j = i + 2
            while j < len(self.t) and self.t[j][2] == line and self.at(j) not in ("struct", "interface"):
                j += 1
            here = self.define("class" if self.at(j) == "struct" else "type", self.at(i + 1), owner, line)
            if self.at(j) in ("struct", "interface") and self.at(j + 1) == "{":
                end = self.match.get(j + 1, j + 1)
                for k in range(j + 2, end):  # embedded types stand alone on their lines
                    if self.is_word(k) and self.t[k - 1][2] < self.t[k][2]:
                        name, after = self.chain(k)
                        if after <= end and self.t[after][2] > self.t[k][2]:
                            self.edges.append((here, name, "extends", self.t[k][2]))
                return end + 1
            return j
        return self.call(i)

    def _rust(self, i: int) -> int:
        x, line, owner = self.t[i][1], self.t[i][2], self.scopes[-1][1]
        if x == "@":
            return i + 1
        if x == "#":
            j = i + 1 + (self.at(i + 1) == "!")
            if self.at(j) == "[" and self.is_word(j + 1):
                if j == i + 1:
                    self.decorators.append((self.chain(j + 1)[0], line))
                return self.match.get(j, j) + 1
            return i + 1
        if x == "use":
            end = i
            while end < len(self.t) and self.at(end) != ";":
                end += 1
            self.edges += [(owner, name, "imports", line) for name in _used(["".join(f" {s} " if s == "as" else s for _, s, _ in self.t[i + 1 : end])])]
            self.decorators = []
            return end
        if x == "fn" and self.is_word(i + 1):
            here = self.define("function", self.at(i + 1), owner, line)
            self.body(i + 2, here, False)
            return self.body_at if self.pending and self.body_at > i else i + 2
        if x in ("struct", "enum", "union", "trait", "mod") and self.is_word(i + 1) and self.at(i - 1) not in (".", "::"):
            name = self.at(i + 1)
            if x == "mod":
                self.decorators = []
                self.body(i + 2, f"{owner}.{name}", False)
                return i + 2
            here = self.define("type" if x in ("trait", "enum") else "class", name, owner, line)
            if x == "trait":
                j = self.angles(i + 2)
                while self.at(j) in (":", "+") and self.is_word(j + 1):
                    name, j = self.chain(j + 1)
                    self.edges.append((here, name, "extends", line))
                    j = self.angles(j)
                self.body(i + 2, here, True)
                return j
            j = i + 2
            while j < len(self.t) and self.at(j) not in ("{", ";", "("):
                j += 1
            return self.match.get(j, j) + 1  # fields hold no calls
        if x == "impl" and self.scopes[-1][0] in ("", "}") and (i == 0 or self.at(i - 1) in (";", "}", "{", "]", "unsafe")):
            names, j = [], self.angles(i + 1)
            while j < len(self.t) and self.at(j) not in ("{", ";", "where"):
                if self.is_word(j) and self.at(j) not in ("for", "dyn", "mut"):
                    name, j = self.chain(j)
                    names.append(name)
                    j = self.angles(j)
                else:
                    j = max(self.angles(j), j + 1)
            if names:
                here = f"{owner}.{names[-1].rsplit('::', 1)[-1]}"
                if len(names) > 1:
                    self.edges.append((here, names[0], "implements", line))
                self.body(j, here, True)
            self.decorators = []
            return j
        return self.call(i)


def _used(paths: list[str]) -> list[str]:
    """Full paths of an import with groups: a::{b, c::{d}} is a::b and a::c::d."""
    out = []
    while paths:
        p = paths.pop(0)
        if (at := p.find("{")) < 0:
            out.append(p.split(" as ")[0].strip())
            continue
        level, start, inner = 0, at + 1, []
        for i in range(at, len(p)):
            level += {"{": 1, "}": -1}.get(p[i], 0)
            if level == 0 or (level == 1 and p[i] == ","):
                inner.append(p[start:i])
                start = i + 1
            if level == 0:
                break
        paths = [p[:at] + x for x in inner if x] + paths
    return [x.removesuffix("::self") for x in out]


def symbols(lang: str, path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Nodes (kind, name, qualified name, line) and edges (source, target, kind, line) of one file."""
    return _Reader(lang, re.sub(r"\.[^./]+$", "", path), text).read()
