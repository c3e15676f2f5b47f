"""Token classes of source texts, by language.

One compiled pattern per language finds tokens, skips comments and blanks, and gives anything else as ``ERR``; a
worker keeps the class of every spelling it has seen. The rest is numpy over all texts of a batch in a row: bracket
depth, Python's line structure, and the few classes that depend on a neighbour (a name behind ``const``, a keyword
behind a dot). Whole texts are read, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: What a token is to the checks of nesting and statements; 0 is nothing, BROKEN a pair that no grammar permits.
OPENS, CLOSES, SEMICOLON, HEAD, COLON, LINE, COMMA, END, BROKEN = range(1, 10)

#: Languages by file extension.
LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "java": "java", "py": "python", "cs": "csharp", "gradle": "groovy", "json": "json"}
CODES = {name: k for k, name in enumerate(["javascript", "typescript", "java", "python", "csharp", "groovy", "json"])}

# The reserved words of each language, and words that are reserved in some places only.
_JS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield await enum null true false"
_PRE = "async get set static type declare readonly abstract namespace module keyof public private protected override accessor interface infer asserts unique"
_MID = "of as from is satisfies implements"
_JAVA = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
_CS = "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
_PY = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
_GROOVY = "abstract as assert boolean break byte case catch char class const continue def default do double else enum extends final finally float for if implements import in instanceof int interface long new null package private protected public return short static super switch this throw throws trait transient true false try void volatile while"

_WORD = r"[A-Za-z_$\u0080-\U0010FFFF][\w$]*"
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?:[fFdDlLmMn]|[uU][lL]?|[lL][uU]|[gG])?(?![\w$])"
_CONFLICT = r"^(?:<{7}|>{7}|={7}|\|{7})(?=\s|\Z)"
_C_SKIP = r"[ \t\f\v\r ﻿]+|//[^\n]*|/\*[\s\S]*?\*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_HOLE = r"\$\{(?:[^{}`'\"]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')*\}"
_TEMPLATE = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|{_HOLE})*`"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};\n])|(?<=[=(,:\[!&|?{};>] )|(?<=return )|(?<=typeof )|(?<=case ))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_MARKS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|->|::|[-+*/%&|^!~<>=?:;,.(){}\[\]@]"
_C_MARKS = r"\.\.\.|<<=|==|!=|<=|&&|\|\||\?\?=?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|=>|->|::|\.\.|[-+*/%&|^!~<>=?:;,.(){}\[\]@]"
_G_MARKS = r"\.\.\.|<=>|\*\*|===|==~|=~|==|!=|<=|>=|&&|\|\||\?\.|\?:|\*\.|\.&|\+\+|--|\+=|-=|\*=|/=|%=|->|::|\.\.<?|[-+*/%&|^!~<>=?:;,.(){}\[\]@]"
_PY_STRING = r"(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_PY_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:(?:[1-9][\d_]*|0[0_]*)(?:\.[\d_]*)?|\d[\d_]*\.[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?)(?![\w])"
_PY_MARKS = r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%&|^~<>=:;,.(){}\[\]@]"


def _pattern(*parts: str, skip: str) -> re.Pattern:
    return re.compile(f"{skip}|({'|'.join((_CONFLICT, *parts))}|[\\s\\S])", re.M)


PATTERNS = {
    "javascript": (_TEMPLATE, _DQ, _SQ, _NUMBER, "#?" + _WORD, _REGEX, _MARKS, r"\n\s*"),
    "java": (r'"""[ \t]*\n(?:[^\\]|\\[\s\S])*?"""', _DQ, r"'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'", _NUMBER, _WORD, _C_MARKS),
    "csharp": (r'\$*"""[\s\S]*?"""', r'(?:\$@|@\$|@)"(?:[^"]|"")*"', r"\$\"(?:[^\"\\\n{}]|\\.|\{\{|\}\}|\{(?:[^{}\"\n]|\"(?:[^\"\\\n]|\\.)*\")*\})*\"", _DQ, r"'(?:[^'\\\n]|\\u[\da-fA-F]{4}|\\x[\da-fA-F]{1,4}|\\.)'", _NUMBER, "@?" + _WORD, _C_MARKS),
    "groovy": (r'"""(?:[^\\]|\\[\s\S])*?"""', r"'''(?:[^\\]|\\[\s\S])*?'''", _DQ, _SQ, r"(?:(?<=[=(,~])|(?<=[=(,~] ))/(?![*/])(?:[^/\\\n]|\\.)+/", _NUMBER, _WORD, _G_MARKS, r"\n\s*"),
    "python": (_PY_STRING, _PY_NUMBER, r"[^\W\d]\w*", _PY_MARKS, r"\n[ \t\f]*(?=[^\s#]|\Z)"),
    "json": (r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*"', r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", r"[A-Za-z]+", r"[{}\[\]:,]"),
}
PATTERNS["typescript"] = PATTERNS["javascript"]
SKIPS = {
    "javascript": rf"\A#![^\n]*|{_C_SKIP}",
    "java": rf"\s+|{_C_SKIP}",
    "csharp": rf"^[ \t]*#(?:region|endregion|if|else|elif|endif|define|undef|pragma|nullable|warning|error|line)\b[^\n]*|\s+|{_C_SKIP}",
    "groovy": rf"\A#![^\n]*|{_C_SKIP}",
    "python": r"[ \t\f\r﻿]+|\\\r?\n|#[^\n]*|\n(?=[ \t\f\r]*(?:#|\n))",
    "json": r"[ \t\r\n]+",
}
SKIPS["typescript"] = SKIPS["javascript"]
_RESERVED = {"javascript": _JS, "typescript": _JS, "java": _JAVA, "csharp": _CS, "groovy": _GROOVY, "python": _PY, "json": "true false null"}
_PY_HEADS = ("if", "while", "for", "def", "class", "with", "try", "else", "elif", "finally", "except")
OPEN, CLOSE = "([{", ")]}"


_DEEP_HOLE = re.compile(r"\$\{[^}]*[`{]")
_CODE_PART = re.compile(rf"{_DQ}|{_SQ}|//[^\n]*|/\*[\s\S]*?\*/|{_REGEX}|([`{{}}])")
_TEMPLATE_PART = re.compile(r"\\[\s\S]|(`|\$\{)")


def plain_templates(text: str) -> str:
    """A script in which template literals whose holes hold braces or literals of their own have blanks in place of them,
    at any depth. The length stays; a literal that isn't closed stays as it is."""
    if not _DEEP_HOLE.search(text):
        return text
    out, last, at = [], 0, 0
    while m := _CODE_PART.search(text, at):
        at = m.end()
        if m[1] != "`":
            continue
        open_, end = ["`"], at
        while open_ and (m := (_TEMPLATE_PART if open_[-1] == "`" else _CODE_PART).search(text, end)):
            end = m.end()
            if m[1] == open_[-1]:
                open_.pop()
            elif m[1]:
                open_.append("`" if m[1] == "`" else "}")
        if open_:
            break
        out += [text[last:at], re.sub(r"[`$\\]", " ", text[at : end - 1])]
        last, at = end - 1, end
    return "".join([*out, text[last:]])


@dataclass(frozen=True)
class Lexer:
    """The pattern of a language, the numbers of its token classes, and the classes of spellings seen."""

    language: str
    pattern: re.Pattern
    number: dict[str, int]
    seen: dict[str, int]


def _names() -> list[str]:
    marks = re.findall(r"\S+", ">>>= ... === !== **= <<= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << >> -> :: - + * / % & | ^ ! ~ < > = ? : ; , . ( ) { } [ ] @ .. ..< <=> ==~ =~ ?: *. .& //= >>= := @= //")
    words = sorted({w for text in (*_RESERVED.values(), _PRE, _MID) for w in text.split()} | {"match"})
    return ["BOF", "EOF", "ERR", "CONFLICT", "id", "num", "str", "re", "pre", "mid", "cid", "iid", "key", "NL", "IN", "OUT", "BAD", *marks, *words]


@lru_cache(maxsize=1)
def classes() -> dict[str, int]:
    """Number of each token class, shared by all languages."""
    return {name: k for k, name in enumerate(dict.fromkeys(_names()))}


@lru_cache(maxsize=None)
def lexer(language: str) -> Lexer:
    number = classes()
    seen = {w: number[w] for w in _RESERVED[language].split()}
    if language in ("javascript", "typescript"):
        seen |= {w: number["pre"] for w in _PRE.split()} | {w: number["mid"] for w in _MID.split()}
    if language == "java":
        seen |= {w: number["pre"] for w in ("module", "open")}
    return Lexer(language, _pattern(*PATTERNS[language], skip=SKIPS[language]), number, seen)


def _class_of(token: str, lx: Lexer) -> int:
    n, c = lx.number, token[0]
    if len(token) > 6 and token[:7] in ("<<<<<<<", ">>>>>>>", "=======", "|||||||"):
        return n["CONFLICT"]
    if token.startswith("\n"):
        return n["NL"]
    if token in n and not (c.isalpha() or c == "_"):
        return n[token]
    if token[-1] in "\"'`" and (len(token) > 1):
        return n["str"]
    if c.isdigit() or c in ".-" and len(token) > 1:
        return n["num"]
    if c == "/" and len(token) > 2:
        return n["re"]
    if c.isalpha() or c in "_$" or c in "#@" and len(token) > 1 or ord(c) > 0x2FFF and c.isalpha():
        if lx.language == "json" or not token.lstrip("#@").replace("$", "_").isidentifier():
            return n["ERR"]
        return n["id"]
    return n["ERR"]


def _python_lines(code: np.ndarray, tokens: list[str], depth: np.ndarray, first: np.ndarray, n: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Drops line ends inside brackets and marks the others by what the indentation does. Returns codes and kept."""
    code = code.copy()
    nl = code == n["NL"]
    kept = ~(nl & (depth > 0))
    stack: list[int] = [0]
    for k in np.flatnonzero((nl & kept) | first).tolist():
        if first[k]:
            stack = [0]
            if not nl[k]:
                continue
        width = len(tokens[k].expandtabs(8)) - 1
        if width == stack[-1]:
            continue
        if width > stack[-1]:
            stack.append(width)
            code[k] = n["IN"]
        else:
            while width < stack[-1]:
                stack.pop()
            code[k] = n["OUT"] if width == stack[-1] else n["BAD"]
    return code, kept


def lex(texts: list[str], language: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token classes of all texts in a row with ``BOF`` and ``EOF`` around each; the text's number; the bracket depth
    before the token; and whether a line ends between the token and the one before."""
    lx = lexer(language)
    n, seen, find = lx.number, lx.seen, lx.pattern.findall
    tokens: list[str] = []
    counts = np.empty(len(texts), np.int64)
    python, script = language == "python", language in ("javascript", "typescript")
    for k, text in enumerate(texts):
        text = text.replace("\r\n", "\n")
        if script and "`" in text:
            text = plain_templates(text)
        got = [t for t in find("\n" + text.strip("\n") + "\n" if python else text) if t]
        counts[k] = len(got)
        tokens += got
    for t in set(tokens).difference(seen):
        seen[t] = _class_of(t, lx)
    code = np.fromiter(map(seen.__getitem__, tokens), np.int16, len(tokens))
    if len(seen) > 500_000:
        lexer.cache_clear()
    doc = np.repeat(np.arange(len(texts)), counts)
    start = np.cumsum(counts) - counts
    opening, closing = np.isin(code, [n[c] for c in OPEN]), np.isin(code, [n[c] for c in CLOSE])
    step = np.cumsum(opening.astype(np.int32) - closing)
    base = np.concatenate([[0], step])[np.repeat(start, counts)] if len(code) else step
    depth = step - opening + closing - base
    newline = np.zeros(len(code), bool)
    nl = code == n["NL"]
    if python:
        first = np.zeros(len(code), bool)
        first[start[counts > 0]] = True
        code, kept = _python_lines(code, tokens, depth, first, n)
        lines = np.isin(code, [n["NL"], n["IN"], n["OUT"], n["BAD"]]) & kept
        head = np.concatenate([[0], np.cumsum(lines)])[:-1]
        code = _python_context(code[kept], lines[kept], head[kept] + lines[kept], depth[kept], n)
        doc, depth = doc[kept], depth[kept]
        newline = np.zeros(len(code), bool)
    elif nl.any():
        newline[1:] = nl[:-1]
        kept = ~nl
        code, doc, depth, newline = code[kept], doc[kept], depth[kept], newline[kept]
    if language in ("javascript", "typescript"):
        code = _script_context(code, doc, n)
    elif language == "json":
        behind = np.concatenate([code[1:] == n[":"], [False]])[: len(code)]
        code = np.where((code == n["str"]) & behind, n["key"], code)
    elif language == "java":
        # ``module`` and ``open`` are words of their own at the head of a file only
        opens = np.zeros(len(code), bool)
        opens[(np.cumsum(np.bincount(doc, minlength=len(texts))) - np.bincount(doc, minlength=len(texts)))[np.bincount(doc, minlength=len(texts)) > 0]] = True
        opens |= (_before(code) == n["pre"]) & np.concatenate([[False], opens[:-1]])[: len(code)]
        code = np.where((code == n["pre"]) & ~opens, n["id"], code)
    elif language == "csharp":
        dotted = np.concatenate([[False], code[:-1] == n["."]])[: len(code)]
        # a reserved word behind a dot, and ``override`` where a name stands, count as names
        after = np.concatenate([code[1:], np.zeros(1, code.dtype)])[: len(code)]
        named = (code == n["override"]) & np.isin(after, [n[c] for c in ", ) = . ; ( [ + - * / < > == != += -= ++ -- :".split()])
        code = np.where(dotted & (code >= n["abstract"]) | named, n["id"], code)
    # BOF and EOF
    counts = np.bincount(doc, minlength=len(texts))
    at = np.cumsum(counts) - counts
    where = np.concatenate([at, at + counts])
    values = np.concatenate([np.full(len(texts), n["BOF"]), np.full(len(texts), n["EOF"])])
    order = np.lexsort((values, np.concatenate([np.arange(len(texts))] * 2)))
    where, values = where[order], values[order]
    code = np.insert(code, where, values)
    doc = np.insert(doc, where, np.repeat(np.arange(len(texts)), 2))
    depth = np.insert(depth, where, 0)
    newline = np.insert(newline, where, values == n["EOF"])
    return code, doc, depth, newline


def _before(code: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate([np.zeros(min(k, len(code)), code.dtype), code[:-k]]) if len(code) else code


def _script_context(code: np.ndarray, doc: np.ndarray, n: dict[str, int]) -> np.ndarray:
    prev = _before(code)
    after = np.concatenate([code[1:], np.zeros(1, code.dtype)])[: len(code)]
    word = code >= n["abstract"]
    named = np.isin(prev, [n["."], n["?."]]) | (after == n[":"]) & ~np.isin(code, [n["default"], n["true"], n["false"], n["null"], n["this"], n["super"]]) & np.isin(prev, [n["{"], n[","]])
    code = np.where(word & named, n["id"], code)
    code = np.where(np.isin(code, [n["pre"], n["mid"]]) & np.isin(prev, [n["."], n["?."]]), n["id"], code)
    plain = np.isin(code, [n["id"], n["pre"], n["mid"]])
    code = np.where(plain & (prev == n["const"]), n["cid"], code)
    code = np.where(plain & (prev == n["@"]), n["key"], code)
    return np.where(plain & (prev == n["import"]) & (after != n["{"]), n["iid"], code)


def _python_context(code: np.ndarray, line_end: np.ndarray, line: np.ndarray, depth: np.ndarray, n: dict[str, int]) -> np.ndarray:
    """In lines that import, ``=`` and brackets of other kinds are errors."""
    prev = _before(code)
    opens = np.isin(prev, [n["NL"], n["IN"], n["OUT"], n["BAD"], n[";"], n[":"]])
    imports = np.isin(code, [n["import"], n["from"]]) & opens & (depth == 0)
    flagged = np.zeros(int(line.max()) + 2 if len(line) else 1, bool)
    flagged[line[imports]] = True
    odd = flagged[line] & np.isin(code, [n["="], n["{"], n["["], n["str"], n["num"]]) if len(line) else np.zeros(0, bool)
    return np.where(odd, n["ERR"], code)


def roles(code: np.ndarray, doc: np.ndarray, language: str) -> np.ndarray:
    """The role of each token of ``lex``'s result."""
    n = classes()
    role = np.zeros(len(code), np.int64)
    role[np.isin(code, [n[c] for c in OPEN])] = OPENS
    role[np.isin(code, [n[c] for c in CLOSE])] = CLOSES
    role[code == n["EOF"]] = END
    if language == "json":
        role[code == n[":"]] = COLON
        role[code == n[","]] = COMMA
    elif language == "python":
        lines = np.isin(code, [n["NL"], n["IN"], n["OUT"], n["BAD"]])
        head = np.isin(code, [n[w] for w in (*_PY_HEADS, "raise")]) & np.isin(_before(code), [n["NL"], n["IN"], n["OUT"], n["async"]])
        role[lines] = LINE
        role[code == n[":"]] = COLON
        role[head] = HEAD
        # commas matter only in lines that raise or except
        line = np.cumsum(lines)
        flagged = np.zeros(int(line[-1]) + 1 if len(line) else 1, bool)
        flagged[line[head & np.isin(code, [n["raise"], n["except"]])]] = True
        role[(code == n[","]) & flagged[line]] = COMMA
    else:
        role[code == n[";"]] = SEMICOLON
    return role


def known(paths: Iterable[str | None]) -> list[str | None]:
    """Language of each path's extension, or None."""
    return [LANGUAGES.get(p.rsplit(".", 1)[-1].lower()) if p and "." in p else None for p in paths]
