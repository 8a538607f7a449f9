"""A tolerant tokenizer for JavaScript and TypeScript, JSX included."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|#[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_MARK = re.compile(r"\.\.\.|=>|===|!==|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|\?\.(?!\d)|==|!=|<=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|.", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
#: After one of these a slash begins a regular expression.
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "+", "-", "*", "%", "~", "^", "<", ">", "=>", "&&", "||", "??", "==", "===", "!=", "!==", "..."}
_WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "await", "yield"}


@dataclass
class Token:
    """``kind``: name, string, number, template, regex, mark or end."""

    kind: str
    text: str
    at: int
    end: int
    #: Of a template: its cooked texts and, between them, the tokens of each expression.
    texts: list[str] = field(default_factory=list)
    inner: list[list[Token]] = field(default_factory=list)


@dataclass
class Lexed:
    tokens: list[Token]
    problems: list[int]


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "ux" and len(x) > 1:
            return chr(int(x.strip("ux{}"), 16))
        return _ESCAPES.get(x, x)

    return re.sub(r"\\(u\{[\da-fA-F]{1,6}\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|.)", one, body, flags=re.S)


def lex(text: str, at: int = 0, closing: str | None = None) -> tuple[Lexed, int]:
    """Tokens from ``at`` to the end, or to an unmatched ``closing`` brace; and where it ended."""
    out: list[Token] = []
    problems: list[int] = []
    depth, n = 0, len(text)
    while at < n:
        c = text[at]
        if c.isspace() or c == "﻿":
            at += 1
            continue
        if text.startswith("//", at) or (at == 0 and text.startswith("#!")):
            stop = text.find("\n", at)
            at = n if stop < 0 else stop
            continue
        if text.startswith("/*", at):
            stop = text.find("*/", at + 2)
            if stop < 0:
                problems.append(at)
            at = n if stop < 0 else stop + 2
            continue
        if c in "\"'":
            m = re.compile(r"(?:[^\\\n" + c + r"]|\\.)*" + c, re.S).match(text, at + 1)
            if m:
                out.append(Token("string", unescape(text[at + 1 : m.end() - 1]), at, m.end()))
                at = m.end()
            else:  # an apostrophe of JSX text, or an unterminated string
                problems.append(at)
                out.append(Token("mark", c, at, at + 1))
                at += 1
            continue
        if c == "`":
            token, at, bad = _template(text, at)
            out.append(token)
            problems += bad
            continue
        if m := _NAME.match(text, at):
            out.append(Token("name", m.group(), at, m.end()))
            at = m.end()
            continue
        if (c.isdigit() or (c == "." and at + 1 < n and text[at + 1].isdigit())) and (m := _NUMBER.match(text, at)):
            out.append(Token("number", m.group(), at, m.end()))
            at = m.end()
            continue
        if c == "/" and (not out or out[-1].text in _BEFORE_REGEX and out[-1].kind == "mark" or out[-1].kind == "name" and out[-1].text in _WORDS_BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            out.append(Token("regex", m.group(), at, m.end()))
            at = m.end()
            continue
        if closing and c == closing and not depth:
            return Lexed(out, problems), at
        depth += (c == "{") - (c == "}")
        m = _MARK.match(text, at)
        out.append(Token("mark", m.group(), at, m.end()))
        at = m.end()
    if closing:
        problems.append(n)
    return Lexed(out, problems), at


def _template(text: str, at: int) -> tuple[Token, int, list[int]]:
    token, start, problems = Token("template", "", at, at), at, []
    at += 1
    begin = at
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            token.texts.append(unescape(text[begin:at]))
            token.end = at + 1
            return token, at + 1, problems
        elif text.startswith("${", at):
            token.texts.append(unescape(text[begin:at]))
            inside, at = lex(text, at + 2, "}")
            token.inner.append(inside.tokens)
            problems += inside.problems
            at += 1
            begin = at
        else:
            at += 1
    token.texts.append(unescape(text[begin:]))
    token.end = len(text)
    return token, len(text), [*problems, start]
