"""TypeScript and JavaScript files to nodes and raw edges, in one pass.

A file becomes a stream of tokens without comments, strings and the text of
templates, and each bracket knows its partner. Declarations are read from that
stream; jumping over brackets makes the work linear in the size of the file,
however deep it is nested (a function's calls are looked at once for each
function around it).

Callees are dotted names: what is called on the result of another call
(``a(b).c()``) names no node and gives no edge of its own.
"""

from __future__ import annotations

import bisect
import posixpath
import re
from collections.abc import Collection, Iterator

from codeweft.sources.emit import Parsed, entity_id, module_id, module_name

#: Fixed value: what an import without extension may stand for, in order.
CANDIDATES = ("", ".jsx", ".js", ".tsx", ".ts", "/index.jsx", "/index.js", "/index.tsx", "/index.ts")
#: Fixed value: files whose ``<Name`` is markup; in others it casts a type.
MARKUP = (".tsx", ".jsx", ".js")

_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)
    |'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'?|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"?
    |[A-Za-z_$\u0080-\U0010ffff][\w$]*|\d[\w.]*|=>|\?\.(?!\d)|\.\.\.|[\s\S]""",
    re.VERBOSE,
)
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*(?:`|\$\{|\\?\Z)")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "${": "}"}
#: Words behind which an expression begins, so ``/`` opens a regular expression.
_OPERATORS = frozenset("return typeof case in of do else void delete throw new instanceof await yield".split())
#: Words that stand before a bracket without calling anything.
_NOT_CALLED = frozenset("async if for while switch catch function return typeof new await constructor with of in case throw void delete yield do else".split())
#: Between two of these, or beside one, a type or an expression goes on.
_GOES_ON = frozenset("= => | & , . ?. ? : < ( [ { + - * / % ! ~ extends keyof typeof is infer readonly new in".split())
_STATEMENT = frozenset([";", "{", "}", ")", "export", "default", "declare", "else", "do"])


class Tokens:
    """Texts and places of a file's tokens, and the partner of each bracket
    (its own place for one that has none)."""

    def __init__(self, text: str) -> None:
        self.source = text
        self.texts: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.partner: list[int] = []
        opened: list[int] = []
        at, size, match = 0, len(text), _TOKEN.match

        def template(start: int) -> int:
            """The place behind the next part of a template."""
            end = _TEMPLATE.match(text, start).end()
            if text.startswith("${", end - 2) and end - 2 >= start:
                opened.append(len(self.texts))
                self._add("${", end - 2, end)
            else:
                self._add("`", max(start, end - 1), end)
            return end

        while at < size:
            first = text[at]
            if first == "`":
                at = template(at + 1)
                continue
            if first == "/" and not text.startswith(("//", "/*"), at) and self._expects_value():
                found = _REGEX.match(text, at)
                if found:
                    self._add("/re/", at, found.end())
                    at = found.end()
                    continue
            end = match(text, at).end()
            if first in "'\"":
                self._add("'", at, end)
            elif not (first.isspace() or text.startswith(("//", "/*"), at)):
                word = text[at:end]
                place = len(self.texts)
                self._add(word, at, end)
                if word in _PAIRS:
                    opened.append(place)
                elif word in (")", "]", "}") and opened and _PAIRS[self.texts[opened[-1]]] == word:
                    other = opened.pop()
                    self.partner[other], self.partner[place] = place, other
                    if self.texts[other] == "${":
                        at = template(end)
                        continue
            at = end
        for place in opened:  # never closed: up to the end of the file
            self.partner[place] = len(self.texts) - 1

    def _add(self, word: str, start: int, end: int) -> None:
        self.partner.append(len(self.texts))
        self.texts.append(word)
        self.starts.append(start)
        self.ends.append(end)

    def _expects_value(self) -> bool:
        last = self.texts[-1] if self.texts else ";"
        return last in _OPERATORS or not (last in (")", "]", "'", "`", "/re/") or _NAME.match(last) or last[0].isdigit())

    def __len__(self) -> int:
        return len(self.texts)

    def get(self, k: int) -> str:
        return self.texts[k] if 0 <= k < len(self.texts) else ""

    def is_name(self, k: int) -> bool:
        return bool(_NAME.match(self.get(k)))

    def after(self, k: int) -> int:
        """The place behind the token at ``k`` and all that it opens."""
        return max(k, self.partner[k]) + 1

    def newline_before(self, k: int) -> bool:
        return k < len(self) and "\n" in self.source[self.ends[k - 1] : self.starts[k]]

    def text(self, first: int, behind: int) -> str:
        return self.source[self.starts[first] : self.ends[min(behind, len(self)) - 1]]

    def generics(self, k: int) -> int:
        """The place behind ``<...>`` if it begins at ``k``, else ``k``."""
        if self.get(k) != "<":
            return k
        depth = 0
        while k < len(self):
            word = self.texts[k]
            depth += (word == "<") - (word == ">")
            k = self.after(k)
            if depth == 0 or word == ";":
                break
        return k

    def type_end(self, k: int) -> int:
        """The place behind a type that begins at ``k``. An arrow belongs to it
        behind brackets only: behind anything else it opens a function's body."""
        operand = False
        while k < len(self):
            word = self.texts[k]
            if word == "=>" and operand and self.texts[k - 1] != ")":
                return k
            if word in _GOES_ON and word not in ("(", "[", "{", "<", ",", "=", ":", "?"):
                operand, k = False, k + 1
            elif word in ("(", "[", "{"):
                if operand and word == "{" or operand and word == "(":
                    return k
                operand, k = True, self.after(k)
            elif word == "<":
                operand, k = True, self.generics(k)
            elif word in ("'", "`") or word[0].isdigit() or _NAME.match(word):
                if operand and self.texts[k - 1] not in ("asserts", "unique", "abstract"):
                    return k
                operand, k = True, k + 1
            else:
                return k
        return k

    def statement_end(self, k: int) -> int:
        """The place behind a statement that goes on from ``k``: up to a
        semicolon, or to the end of a line that ends it."""
        while k < len(self):
            word = self.texts[k]
            if word == ";":
                return k + 1
            if word in (")", "]", "}"):
                return k
            if self.newline_before(k) and self.texts[k - 1] not in _GOES_ON and word not in _GOES_ON:
                return k
            k = self.generics(k) if word == "<" else self.after(k)
        return k


def _target(specifier: str, file: str) -> list[str]:
    path = posixpath.normpath(posixpath.join(posixpath.dirname(file), specifier))
    return [path + s for s in CANDIDATES]


def _declares(t: Tokens, k: int) -> bool:
    """Whether the word at ``k`` begins a statement."""
    last = k - 1
    if t.get(last) == "async":
        last -= 1
    return last < 0 or t.texts[last] in _STATEMENT or (t.newline_before(last + 1) and t.texts[last] not in _GOES_ON and t.texts[last] not in _OPERATORS)


def _block(t: Tokens, k: int) -> int:
    """The place of the block of a class or interface whose name ends before
    ``k``; the file's end if it has none."""
    while k < len(t) and t.texts[k] not in ("{", ";"):
        k = t.generics(k) if t.texts[k] == "<" else t.after(k)
    return k if t.get(k) == "{" else len(t)


def _function_value(t: Tokens, k: int) -> int:
    """The place behind an arrow function or function expression that begins
    at ``k``, else ``k``."""
    begin = k
    if t.get(k) == "async" and not t.newline_before(k + 1):
        k += 1
    if t.get(k) == "function":
        k += 1
        if t.get(k) == "*":  # a generator is another kind of value
            return begin
        k += t.is_name(k)
        k = t.generics(k)
        if t.get(k) != "(":
            return begin
        k = t.after(k)
        k = t.type_end(k + 1) if t.get(k) == ":" else k
        return t.after(k) if t.get(k) == "{" else begin
    k = t.generics(k)
    if t.get(k) == "(":
        k = t.after(k)
        k = t.type_end(k + 1) if t.get(k) == ":" else k
    elif t.is_name(k):
        k += 1
    if t.get(k) != "=>":
        return begin
    if t.get(k + 1) == "{":
        return t.after(k + 1)
    # An expression ends with its statement, or before a comma.
    k += 1
    while k < len(t) and t.texts[k] not in (";", ",", ")", "]", "}") and not (t.newline_before(k) and t.texts[k - 1] not in _GOES_ON and t.texts[k] not in _GOES_ON):
        k = t.after(k)
    return k


def _callees(t: Tokens, begin: int, end: int) -> Iterator[str]:
    """Dotted names that are called between two places."""
    for k in range(begin, end):
        if t.texts[k] != "(":
            continue
        last = k - 1
        if t.get(last) == ">":  # type arguments
            depth, back = 0, last
            while back > last - 64 and back >= begin:
                depth += (t.texts[back] == ">") - (t.texts[back] == "<")
                if depth == 0:
                    break
                back -= 1
            last = back - 1 if depth == 0 else last
        if t.get(last) == "?.":
            last -= 1
        if last < begin or not t.is_name(last):
            continue
        first = last
        while first - 2 >= begin and t.texts[first - 1] in (".", "?.") and t.is_name(first - 2):
            first -= 2
        if t.get(first - 1) in (".", "?.", "new", "function", "*") or t.texts[first] in _NOT_CALLED or first == last and t.texts[last] in _NOT_CALLED:
            continue
        behind = t.after(k)
        if first == last and t.get(behind) == "{" and not t.newline_before(behind):
            continue  # a method's head
        yield ".".join(t.texts[first : last + 1 : 2])


def _tags(t: Tokens, begin: int, end: int) -> Iterator[str]:
    """Capitalised tags that are opened between two places."""
    for k in range(begin, end - 1):
        if t.texts[k] != "<" or not t.texts[k + 1][0].isupper() or t.starts[k + 1] != t.ends[k]:
            continue
        before = t.source[t.starts[k] - 1 : t.starts[k]]
        last = k + 1
        while t.get(last + 1) == "." and t.is_name(last + 2):
            last += 2
        behind = t.source[t.ends[last] : t.ends[last] + 1]
        if not (before.isalnum() or before in ("_", "$", ")", "]")) and (behind.isspace() or behind in ("/", ">")):
            yield "".join(t.texts[k + 1 : last + 1])


def scan(file: str, text: str, file_hash: str | None = None, extended: bool = False) -> Parsed:
    """Nodes and edges of one file; imports are lookups. ``extended`` adds
    DEFINES_TYPE (module to interface or alias) and USES_TYPE (function to a
    type it names)."""
    out = Parsed(file)
    module = out.node("Module", module_id(file), module_name(file), line=1, file_hash=file_hash)
    t = Tokens(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda k: bisect.bisect_left(breaks, t.starts[k]) + 1
    contained = lambda label, name, k, end: out.edge(module, out.node(label, entity_id(file, name), name, line=line(k), source_code=t.text(k, end)), "CONTAINS")
    types: list[str] = []
    classes: list[tuple[str, int, int]] = []
    declared: list[tuple[str, int, int]] = []
    bound: list[tuple[str, int, int, int]] = []
    for k, word in enumerate(t.texts):
        name = t.get(k + 1)
        if word == "import" and t.get(k - 1) != "." and name not in ("(", "."):
            at = k + 1
            while at < len(t) and t.texts[at] not in ("'", ";", "import", "="):
                at = t.after(at)
            specifier = t.text(at, at + 1).strip("'\"") if t.get(at) == "'" else ""
            if specifier.startswith("."):
                out.edge(module, None, "IMPORTS", [(out.lookup(_target(specifier, file)), "module::", "")])
        elif word == "interface" and t.is_name(k + 1) and t.get(k - 1) not in (".", "?."):
            end = _block(t, k + 2)
            if t.get(end) == "{":
                types.append(name)
                contained("Class", name, k, t.after(end))
        elif word == "type" and t.is_name(k + 1) and t.get(k - 1) not in (".", "?."):
            at = t.generics(k + 2)
            if t.get(at) == "=":
                types.append(name)
                contained("Class", name, k, t.statement_end(at + 1))
        elif word == "class" and t.is_name(k + 1) and name != "extends" and t.get(k - 1) not in (".", "?."):
            end = _block(t, k + 2)
            if t.get(end) == "{":
                classes.append((name, k, t.after(end)))
        elif word == "function" and t.is_name(k + 1) and _declares(t, k):
            end = _function_value(t, k)
            if end > k:
                declared.append((name, k - (t.get(k - 1) == "async"), end))
        elif word in ("const", "let", "var") and t.get(k - 1) not in (".", "?."):
            at = k
            while at == k or t.get(at) == ",":  # each declarator of the statement
                begin = at + 1
                at = t.after(begin) if begin < len(t) else begin
                at = at + 1 if t.get(at) == "!" else at
                at = t.type_end(at + 1) if t.get(at) == ":" else at
                if t.get(at) != "=":
                    continue
                end = _function_value(t, at + 1)
                if end > at + 1 and t.is_name(begin):
                    bound.append((t.texts[begin], begin, at + 1, end))
                    at = end
                    continue
                at += 1
                while at < len(t) and t.texts[at] not in (",", ";", ")", "]", "}") and not (t.newline_before(at) and t.texts[at - 1] not in _GOES_ON and t.texts[at] not in _GOES_ON):
                    if t.texts[at] in ("const", "let", "var", "function", "class"):
                        break
                    at = t.after(at)
    if extended:
        for name in types:
            out.edge(module, entity_id(file, name), "DEFINES_TYPE")
    for name, k, end in classes:
        contained("Class", name, k, end)
    seen = {n["id"] for n in out.nodes}
    for name, k, value, end in [(n, k, k, end) for n, k, end in declared] + bound:
        ident = entity_id(file, name)
        if ident not in seen:
            seen.add(ident)
            contained("Function", name, k, end)
        for callee in _callees(t, value, end):
            out.edge(ident, f"ts_call::{callee}", "CALLS", raw_callee=callee)
        for tag in _tags(t, value, end) if file.endswith(MARKUP) else ():
            out.edge(ident, f"ts_call::{tag}", "CALLS", raw_callee=tag, is_jsx_component="true")
        if extended:
            named = set(t.texts[k:end])
            for kind in types:
                if kind in named:
                    out.edge(ident, entity_id(file, kind), "USES_TYPE")
    return out


def parse(file: str, text: str, known: Collection[str], file_hash: str | None = None, extended: bool = False) -> Parsed:
    """``scan`` with imports settled; ``known`` holds all files of the
    repository."""
    return scan(file, text, file_hash, extended).settled(known)
