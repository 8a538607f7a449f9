"""From tokens to observations: where an environment is read, and by which keys.

One pass assigns every token its scope and every name its declaration; a second looks at each place
where an environment object stands and at what is done with it. Expressions are parsed only where
a key or an initialiser needs it.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from graphaxis.operators.extract import domains as D
from graphaxis.operators.extract.lexer import Token, lex

MAX_KEYS, MAX_DEPTH = 100, 32
# Member names whose values a caller controls, and global objects with an environment.
USER_MEMBERS = {"query", "body", "params", "route", "webhook"}
ENV_GLOBALS = {"process", "Bun", "Deno"}
USER_GLOBALS = {("process", "argv"), ("process", "stdin"), ("Bun", "argv"), ("Deno", "args")}
ENUMERATORS = {"keys", "values", "entries", "assign"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_END = Token("end", "", 1 << 60, 1 << 60)


@dataclass
class Observation:
    at: int
    end: int
    domain: D.Domain
    exact: bool


@dataclass
class Scope:
    parent: Scope | None
    names: dict[str, Binding] = field(default_factory=dict)


@dataclass
class Binding:
    kind: str
    value: int | None = None
    user: bool = False


class Scanner:
    def __init__(self, text: str, max_keys: int = MAX_KEYS):
        lexed, _ = lex(text)
        self.text, self.tokens, self.max_keys = text, lexed.tokens, max_keys
        self.failed = bool(lexed.problems)
        self.match: dict[int, int] = {}
        self.scope_at: list[Scope] = []
        self.found: dict[tuple[str, int, int], Observation] = {}
        self._pair()
        self._declare()

    def tok(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else _END

    def is_mark(self, i: int, *texts: str) -> bool:
        t = self.tok(i)
        return t.kind == "mark" and t.text in texts

    # -- structure --------------------------------------------------------------------------

    def _pair(self) -> None:
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE:
                if not stack or _OPEN[self.tokens[stack[-1]].text] != t.text:
                    self.failed = True
                    continue
                o = stack.pop()
                self.match[o], self.match[i] = i, o
        self.failed |= bool(stack)
        for i, t in enumerate(self.tokens):  # an operator that wants a value before a semicolon
            if t.kind == "mark" and t.text in ("=", "+", "=>", "&&", "||") and self.is_mark(i + 1, ";", ")", "]"):
                self.failed = True

    def _exported(self) -> set[str]:
        names: set[str] = set()
        for i, t in enumerate(self.tokens):
            if t.kind != "name" or t.text != "export":
                continue
            if self.is_mark(i + 1, "{"):
                names |= {self.tok(k).text for k in range(i + 2, self.match.get(i + 1, i + 2)) if self.tok(k).kind == "name" and self.tok(k - 1).text in ("{", ",")}
            elif self.tok(i + 1).text == "default" and self.tok(i + 2).kind == "name" and self.tok(i + 2).text not in ("function", "async", "class"):
                names.add(self.tok(i + 2).text)
        return names

    def _declare(self) -> None:
        top = Scope(None)
        current, closing = top, []
        exported = self._exported()
        pending: dict[int, list[tuple[str, Binding]]] = {}
        for i, t in enumerate(self.tokens):
            while closing and closing[-1][0] < i:
                current = closing.pop()[1]
            if self.is_mark(i, "{") and i in self.match:
                closing.append((self.match[i], current))
                current = Scope(current)
                for name, b in pending.pop(i, []):
                    current.names[name] = b
            elif i in pending:  # the body of an arrow function without braces
                stop = self._expression_end(i)
                closing.append((stop - 1, current))
                current = Scope(current)
                for name, b in pending.pop(i):
                    current.names[name] = b
            self.scope_at.append(current)
            if t.kind != "name":
                if t.text == "=>" and t.kind == "mark":
                    self._arrow(i, exported, pending)
                continue
            if self.is_mark(i - 1, ".", "?."):
                continue
            if t.text in ("const", "let", "var"):
                self._variables(i, current)
            elif t.text == "function":
                self._function(i, current, exported, pending)
            elif t.text in ("class", "enum", "namespace") and self.tok(i + 1).kind == "name":
                current.names.setdefault(self.tok(i + 1).text, Binding(t.text))
            elif t.text == "import" and not self.is_mark(i + 1, ".", "("):
                k = i + 1
                while self.tok(k).kind not in ("string", "end") and not self.is_mark(k, ";"):
                    if self.tok(k).kind == "name" and self.tok(k).text not in ("from", "as", "type") and self.tok(k + 1).text != "as":
                        current.names.setdefault(self.tok(k).text, Binding("import"))
                    k += 1
            elif t.text == "catch" and self.is_mark(i + 1, "(") and self.tok(i + 2).kind == "name":
                pending.setdefault(self.match.get(i + 1, i) + 1, []).append((self.tok(i + 2).text, Binding("let")))

    def _variables(self, i: int, scope: Scope) -> None:
        kind, k = self.tok(i).text, i + 1
        while True:
            if self.is_mark(k, "{", "[") and k in self.match:
                for name in self._pattern_names(k, self.match[k]):
                    scope.names[name] = Binding("let")
                k = self.match[k] + 1
            elif self.tok(k).kind == "name":
                name, k = self.tok(k).text, k + 1
                if self.is_mark(k, "!"):
                    k += 1
                if self.is_mark(k, ":"):
                    k = self._type_end(k + 1)
                scope.names[name] = Binding(kind, k + 1 if self.is_mark(k, "=") else None)
            else:
                return
            if self.is_mark(k, ":"):
                k = self._type_end(k + 1)
            if self.is_mark(k, "="):
                k = self._expression_end(k + 1)
            if not self.is_mark(k, ","):
                return
            k += 1

    def _pattern_names(self, a: int, b: int) -> list[str]:
        out = []
        for k in range(a + 1, b):
            t = self.tok(k)
            if t.kind == "name" and not self.is_mark(k + 1, ":") and self.tok(k - 1).text in ("{", "[", ",", ":", "..."):
                out.append(t.text)
        return out

    def _function(self, i: int, scope: Scope, exported: set[str], pending: dict) -> None:
        k = i + 1 + self.is_mark(i + 1, "*")
        name = self.tok(k).text if self.tok(k).kind == "name" else ""
        k += bool(name)
        if name:
            scope.names.setdefault(name, Binding("function"))
        if self.is_mark(k, "<"):
            while k < len(self.tokens) and not self.is_mark(k, "("):
                k += 1
        if not self.is_mark(k, "(") or k not in self.match:
            return
        before = {self.tok(i - 1).text, self.tok(i - 2).text, self.tok(i - 3).text}
        user = name in exported or "export" in before
        body = self.match[k] + 1
        while body < len(self.tokens) and not self.is_mark(body, "{", ";"):
            body += 1
        pending.setdefault(body, []).extend((p, Binding("parameter", user=user)) for p in self._parameters(k))

    def _parameters(self, k: int) -> list[str]:
        end, out, at = self.match[k], [], k + 1
        while at < end:
            if self.is_mark(at, "..."):
                at += 1
            if self.is_mark(at, "{", "[") and at in self.match:
                out += self._pattern_names(at, self.match[at])
                at = self.match[at] + 1
            elif self.tok(at).kind == "name":
                out.append(self.tok(at).text)
                at += 1
            while at < end and not self.is_mark(at, ","):
                at = self.match[at] + 1 if self.is_mark(at, *_OPEN) and at in self.match else at + 1
            at += 1
        return out

    def _arrow(self, i: int, exported: set[str], pending: dict) -> None:
        k = i - 1
        if self.is_mark(k, ")") and k in self.match:
            start, names = self.match[k], self._parameters(self.match[k])
        elif self.tok(k).kind == "name":
            start, names = k, [self.tok(k).text]
        else:
            return
        owner, b = "", start - 1 - (self.tok(start - 1).text == "async")
        exporting = self.tok(b).text == "default" and self.tok(b - 1).text == "export"
        if self.is_mark(b, "=") and self.tok(b - 1).kind == "name":
            owner, exporting = self.tok(b - 1).text, self.tok(b - 3).text == "export"
        user = exporting or (owner != "" and owner in exported)
        pending.setdefault(i + 1, []).extend((n, Binding("parameter", user=user)) for n in names)

    def _type_end(self, k: int) -> int:
        while k < len(self.tokens) and not self.is_mark(k, "=", ";", ",", ")"):
            k = self.match[k] + 1 if self.is_mark(k, *_OPEN) and k in self.match else k + 1
        return k

    def _expression_end(self, k: int) -> int:
        last = k
        while k < len(self.tokens):
            t = self.tok(k)
            if t.kind == "mark" and t.text in (",", ";", ")", "]", "}"):
                return k
            if k > last and t.kind == "name" and t.text in ("const", "let", "var", "function", "export", "return", "if", "for", "import", "class") and "\n" in self.text[self.tok(k - 1).end : t.at]:
                return k
            k = self.match[k] + 1 if t.kind == "mark" and t.text in _OPEN and k in self.match else k + 1
        return k

    def lookup(self, name: str, i: int) -> Binding | None:
        scope = self.scope_at[i] if 0 <= i < len(self.scope_at) else None
        while scope is not None:
            if name in scope.names:
                return scope.names[name]
            scope = scope.parent
        return None

    # -- expressions ------------------------------------------------------------------------

    def env_end(self, i: int, depth: int = 0) -> int | None:
        """Where the environment object that begins at ``i`` ends; parens and casts seen through."""
        if depth > MAX_DEPTH:
            return None
        t, end = self.tok(i), None
        if self.is_mark(i, "(") and i in self.match:
            inner = self.env_end(i + 1, depth + 1)
            if inner is not None and (inner == self.match[i] or self.tok(inner).text in ("as", "satisfies")):
                end = self.match[i] + 1
        elif self.is_mark(i, "<"):  # <Type>expression
            k = i + 1
            while self.tok(k).kind == "name" or self.is_mark(k, ".", "|", "[", "]"):
                k += 1
            end = self.env_end(k + 1, depth + 1) if self.is_mark(k, ">") else None
        elif t.kind == "name" and not self.is_mark(i - 1, ".", "?."):
            if t.text in ENV_GLOBALS and self.lookup(t.text, i) is None:
                end = self._member(i + 1, "env")
            elif t.text == "import" and self._member(i + 1, "meta"):
                end = self._member(self._member(i + 1, "meta"), "env")
            else:
                b = self.lookup(t.text, i)
                if b is not None and b.kind == "const" and b.value is not None and b.value != i and self._is_env(b.value, depth + 1):
                    end = i + 1
        while end is not None and self.is_mark(end, "!") and not self.is_mark(end + 1, "="):
            end += 1
        return end

    def _is_env(self, k: int, depth: int) -> bool:
        end = self.env_end(k, depth)
        return end is not None and (end == self._expression_end(k) or self.tok(end).text in ("as", "satisfies"))

    def _member(self, k: int | None, name: str) -> int | None:
        if k is None:
            return None
        if self.is_mark(k, ".", "?.") and self.tok(k + 1).text == name and self.tok(k + 1).kind == "name":
            return k + 2
        at = k + self.is_mark(k, "?.")
        if self.is_mark(at, "[") and self.tok(at + 1).kind == "string" and self.tok(at + 1).text == name and self.is_mark(at + 2, "]"):
            return at + 3
        return None

    def value(self, i: int, end: int, depth: int = 0) -> D.Domain:
        """The key domain of the expression between two tokens."""
        if depth > MAX_DEPTH or i >= end:
            return D.unbounded()
        marks = self._top_level(i, end)
        for k, text in marks:
            if text == "?" and self._colon(marks, k) is not None:
                colon = self._colon(marks, k)
                return D.union([self.value(k + 1, colon, depth + 1), self.value(colon + 1, end, depth + 1)], self.max_keys)
        for k, text in reversed(marks):
            if text == "+" and k > i:
                return D.concat(self.value(i, k, depth + 1), self.value(k + 1, end, depth + 1), self.max_keys)
        for k, text in marks:
            if text in ("as", "satisfies") and k > i:
                return self.value(i, k, depth + 1)
        if self.is_mark(end - 1, "!"):
            return self.value(i, end - 1, depth + 1)
        if self.is_mark(i, "(") and self.match.get(i) == end - 1:
            return self.value(i + 1, end - 1, depth + 1)
        t = self.tok(i)
        if end == i + 1:
            if t.kind == "string":
                return D.finite(t.text)
            if t.kind == "template":
                return self._template(t, i, depth)
            if t.kind == "name":
                return self._named(t.text, i, depth)
            return D.unbounded()
        looked = self._map_lookup(i, end, depth)
        if looked is not None:
            return looked
        user = self._user_controlled(i, end, depth)
        return D.unbounded("user-controlled", D.USER) if user else D.unbounded()

    def _top_level(self, i: int, end: int) -> list[tuple[int, str]]:
        out, k = [], i
        while k < end:
            t = self.tok(k)
            if t.kind == "mark" and t.text in _OPEN and k in self.match:
                k = self.match[k] + 1
                continue
            if t.kind == "mark" or t.kind == "name" and t.text in ("as", "satisfies"):
                out.append((k, t.text))
            k += 1
        return out

    def _colon(self, marks: list[tuple[int, str]], k: int) -> int | None:
        nested = 0
        for at, text in marks:
            if at <= k:
                continue
            nested += text == "?"
            if text == ":":
                if not nested:
                    return at
                nested -= 1
        return None

    def _named(self, name: str, i: int, depth: int) -> D.Domain:
        b = self.lookup(name, i)
        if b is None:
            return D.unbounded()
        if b.user:
            return D.unbounded("user-controlled", D.USER)
        if b.kind == "const" and b.value is not None:
            got = self.value(b.value, self._expression_end(b.value), depth + 1)
            return D.Domain(**{**got.__dict__, "literal": False})
        if b.kind in ("let", "var") and b.value is not None and self._user_controlled(b.value, self._expression_end(b.value), depth + 1):
            return D.unbounded("user-controlled", D.USER)
        return D.unbounded()

    def _template(self, t: Token, i: int, depth: int) -> D.Domain:
        out = D.finite(t.texts[0])
        for text, tokens in zip(t.texts[1:], t.inner):
            part = Inner(self, tokens, i).value(0, len(tokens), depth + 1)
            out = D.concat(D.concat(out, part, self.max_keys), D.finite(text), self.max_keys) if text else D.concat(out, part, self.max_keys)
        return out

    def _map_lookup(self, i: int, end: int, depth: int) -> D.Domain | None:
        """A constant object of strings, indexed."""
        if self.tok(i).kind != "name":
            return None
        b = self.lookup(self.tok(i).text, i)
        if b is None or b.kind != "const" or b.value is None or not self.is_mark(b.value, "{") or b.value not in self.match:
            return None
        entries = self._entries(b.value, depth)
        if entries is None:
            return None
        k = i + 1
        if self.is_mark(k, ".", "?.") and self.tok(k + 1).kind == "name" and end == k + 2:
            index = D.finite(self.tok(k + 1).text)
        else:
            k += self.is_mark(k, "?.")
            if not self.is_mark(k, "[") or self.match.get(k) != end - 1:
                return None
            index = self.value(k + 1, end - 1, depth + 1)
        if index.kind == "finite" and all(x in entries for x in index.keys):
            picked = D.union([entries[x] for x in index.keys], self.max_keys)
            return D.Domain(**{**picked.__dict__, "origin": D.worse(picked.origin, index.origin), "direct": picked.direct and index.direct, "literal": False})
        every = D.union(list(entries.values()), self.max_keys)
        origin = D.worse(every.origin, D.USER if index.origin == D.USER else D.OPAQUE)
        return D.Domain(**{**every.__dict__, "origin": origin, "direct": False, "literal": False})

    def _entries(self, brace: int, depth: int) -> dict[str, D.Domain] | None:
        out: dict[str, D.Domain] = {}
        k, stop = brace + 1, self.match[brace]
        while k < stop:
            name = self.tok(k)
            if name.kind not in ("name", "string", "number") or not self.is_mark(k + 1, ":"):
                return None
            end = min(self._expression_end(k + 2), stop)
            value = self.value(k + 2, end, depth + 1)
            if value.kind != "finite":
                return None
            out[name.text] = value
            k = end + 1
        return out or None

    def _user_controlled(self, i: int, end: int, depth: int) -> bool:
        for k in range(i, end):
            t = self.tok(k)
            if t.kind == "template" and any(Inner(self, x, i)._user_controlled(0, len(x), depth + 1) for x in t.inner if depth < MAX_DEPTH):
                return True
            if t.kind != "name":
                continue
            if self.is_mark(k - 1, ".", "?."):
                if t.text in USER_MEMBERS or (self.tok(k - 2).text, t.text) in USER_GLOBALS and self.lookup(self.tok(k - 2).text, k) is None:
                    return True
                continue
            b = self.lookup(t.text, k)
            if b is not None and (b.user or depth < MAX_DEPTH and b.kind == "const" and b.value is not None and not i <= b.value < end and self._user_controlled(b.value, self._expression_end(b.value), depth + 1)):
                return True
        return False

    # -- reads ------------------------------------------------------------------------------

    def run(self) -> list[Observation]:
        i = 0
        for i in range(len(self.tokens)):
            t = self.tok(i)
            if t.kind == "template":
                for tokens in t.inner:
                    Inner(self, tokens, i).reads()
            if t.kind == "name" and not (self.is_mark(i + 1, ":") and self.tok(i - 1).text in ("{", ",")):
                end = self.env_end(i)
                if end is not None and not self._declares(i):
                    self._read(i, end)
        return sorted(self.found.values(), key=lambda o: (o.at, o.end))

    def reads(self) -> None:
        self.run()

    def _declares(self, i: int) -> bool:
        return self.tok(i - 1).text in ("const", "let", "var") or self.is_mark(i + 1, "=") and not self.is_mark(i - 1, "(", "=")

    def emit(self, at: int, end: int, domain: D.Domain) -> None:
        exact = domain.kind == "finite" and domain.direct and len(domain.keys) == 1
        self.found.setdefault(("exact" if exact else "dynamic", at, end), Observation(at, end, domain, exact))

    def _read(self, i: int, end: int) -> None:
        start = i
        while self.is_mark(start - 1, "(") and start - 1 in self.match and (self.match[start - 1] == end or self.tok(end).text in ("as", "satisfies") and self.match[start - 1] > end) and not self._calls(start - 1):
            end = self.match[start - 1] + 1
            start -= 1
            while self.is_mark(end, "!") and not self.is_mark(end + 1, "="):
                end += 1
        at = self.tok(start).at
        if self.is_mark(end, ".", "?.") and self.tok(end + 1).kind == "name":
            name = self.tok(end + 1).text
            if self.is_mark(end + 2, "(") and end + 2 in self.match and name in ("get", "toObject", "has"):
                close = self.match[end + 2]
                if name == "get":
                    self.emit(at, self.tok(close).end, self.value(end + 3, min(self._expression_end(end + 3), close)))
                elif name == "toObject":
                    self.emit(at, self.tok(close).end, D.unbounded())
                return
            self.emit(at, self.tok(end + 1).end, D.finite(name))
            return
        k = end + self.is_mark(end, "?.")
        if self.is_mark(k, "[") and k in self.match:
            self.emit(at, self.tok(self.match[k]).end, self.value(k + 1, self.match[k]))
            return
        self._escape(start, end, at)

    def _calls(self, k: int) -> bool:
        before = self.tok(k - 1)
        return before.kind == "name" and before.text not in ("return", "typeof", "await", "in", "of", "case", "yield", "void") or self.is_mark(k - 1, ")", "]")

    def _escape(self, start: int, end: int, at: int) -> None:
        before, stop = self.tok(start - 1), self.tok(end - 1).end
        if before.text == "=" and before.kind == "mark":
            if self.is_mark(start - 2, "}") and start - 2 in self.match and self.tok(self.match[start - 2] - 1).text in ("const", "let", "var"):
                self._destructure(self.match[start - 2], start - 2)
                return
            name, word = self.tok(start - 2), self.tok(start - 3).text
            if name.kind == "name" and word == "const":
                return  # an alias; its uses count
            self.emit(at, stop, D.unbounded())
        elif before.text in ("return", "...", "in", "of", "default", "=>", "(", ",", ":", "?", "||", "??", "&&", "{"):
            self.emit(at, stop, D.unbounded())

    def _destructure(self, brace: int, close: int) -> None:
        k = brace + 1
        while k < close:
            t = self.tok(k)
            if self.is_mark(k, "..."):
                self.emit(t.at, self.tok(k + 1).end, D.unbounded())
                k += 2
            elif self.is_mark(k, "[") and k in self.match:
                self.emit(t.at, self.tok(self.match[k]).end, self.value(k + 1, self.match[k]))
                k = self.match[k] + 1
            elif t.kind in ("name", "string"):
                self.emit(t.at, t.end, D.finite(t.text))
                k += 1
            while k < close and not self.is_mark(k, ","):
                k = self.match[k] + 1 if self.is_mark(k, *_OPEN) and k in self.match else k + 1
            k += 1


class Inner(Scanner):
    """The tokens of a template's expression, seen from where the template stands."""

    def __init__(self, outer: Scanner, tokens: list[Token], at: int):
        self.text, self.tokens, self.max_keys, self.failed = outer.text, tokens, outer.max_keys, False
        self.match, self.found, self.outer, self.at = {}, outer.found, outer, at
        self.scope_at = [outer.scope_at[at] if at < len(outer.scope_at) else Scope(None)] * (len(tokens) + 1)
        self._pair()

    def value(self, i: int, end: int, depth: int = 0) -> D.Domain:
        return super().value(i, end, depth)

    def _named(self, name: str, i: int, depth: int) -> D.Domain:
        return self.outer._named(name, self.at, depth)

    def _map_lookup(self, i: int, end: int, depth: int) -> D.Domain | None:
        return None


def observe(text: str, max_keys: int = MAX_KEYS) -> tuple[list[Observation], bool]:
    """Observations in order of place, and whether the text looked malformed."""
    scanner = Scanner(text, max_keys)
    return scanner.run(), scanner.failed


def line_starts(text: str) -> list[int]:
    return [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]


def position(starts: list[int], at: int) -> tuple[int, int]:
    line = bisect_right(starts, at) - 1
    return line, at - starts[line]
