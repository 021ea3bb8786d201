"""Code as tables: symbols and relations of source files, their docs, keys and concepts.

A scanner of its own reads seven languages: comments and strings are blanked, declarations found by their heads, and
their ends by matching braces, or by indentation. It reads what is declared, not what a compiler would accept.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmesh.runtime import ship

# fixed values: languages by extension
EXTENSIONS = {
    "rs": "Rust", "py": "Python", "go": "Go", "cs": "C#", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript",
    "c": "C++", "cc": "C++", "cpp": "C++", "cxx": "C++", "h": "C++", "hh": "C++", "hpp": "C++",
}
#: Relations of one kind that a file gives at most.
MAX_SITES = 10_000
CONTAINERS = ("class", "struct", "enum", "interface", "trait", "impl", "mod", "namespace")
_KEYWORDS = frozenset("if for while switch match return catch sizeof using lock foreach when fixed unsafe function fn def func class new await typeof delete throw import type const var package elif else do try with assert print_ in not and or lambda yield super".split())
_PATH = r"[A-Za-z_]\w*(?:(?:::|->|\.)[A-Za-z_]\w*)*"
#: Comments, strings and character literals, by language; what :func:`_literals` does not read by itself.
_SPANS = {
    "Python": r"(?i:(?<!\w)[rbuf]{0,2})(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|#[^\n]*",
    "Rust": r"//[^\n]*|/\*|b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:u\{[^}]*\}|.)|[^'\\\n])'",
    "Go": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.[^'\n]*|[^'\\\n])'",
    "C#": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\$?@\$?\"(?:\"\"|[^\"])*\"?|\"\"\".*?(?:\"\"\"|\Z)|\$?\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.[^'\n]*|[^'\\\n])'|^[ \t]*#[^\n]*",
    "C++": r"//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|R\"(?P<h>[^()\\\s]{0,16})\(.*?\)(?P=h)\"|\"(?:\\.|[^\"\\\n])*\"?|(?<![0-9A-Fa-f])'(?:\\.[^'\n]*|[^'\\\n])'",
    "TypeScript": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`|/(?=[^/*\n])",
}
_SPANS["JavaScript"] = _SPANS["TypeScript"]
#: A slash after one of these starts a regular expression, elsewhere it divides.
_REGEX_AFTER = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await))\s*$")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_ROUND = re.compile(r"[()\[\]]")
_BODY = r"(?<![\w.>])(?P<n>[#~]?[A-Za-z_$][\w$]*)\s*(?:<[^<>(){};]*>\s*)?\([^()]*\)\s*[^{};()=]*(?=\{)"
#: A body after a parameter list and, in a constructor, its members' first values.
_CPP_BODY = r"(?<![\w.>])(?P<n>~?[A-Za-z_]\w*|operator\s*[^\s\w(]{1,3})\s*\([^()]*\)\s*(?:[^{};()=,:]|::|\([^()]*\))*(?::(?!:)\s*[\w:<>]+\s*(?:\([^()]*\)|\{[^{}]*\})(?:\s*,\s*[\w:<>]+\s*(?:\([^()]*\)|\{[^{}]*\}))*\s*)?(?=\{)"

#: Modifiers, a type that is no keyword of a statement, and a name, which an interface may stand before.
_CS_HEAD = (
    r"(?:\b(?:public|internal|private|protected|static|async|override|virtual|abstract|sealed|extern|partial|new|unsafe|readonly|required)\s+)*"
    r"(?<![\w.])(?!(?:public|internal|private|protected|static|async|override|virtual|abstract|sealed|extern|partial|unsafe|readonly|required|return|await|throw|else|in|yield|case|using|goto|is|as|not|and|or|when|new|out|ref|var|where|event|delegate|class|struct|enum|interface|namespace|record|get|set|init|operator|implicit|explicit)\b)"
    r"[A-Za-z_][\w.]*(?:\s*<[^(){};=]*?>)?(?:\[[\], ]*\]|\?)*\s+(?:[A-Za-z_][\w.]*\.)?(?P<n>[A-Za-z_]\w*)\s*"
)

#: (kind, head) of declarations, by language; a ``fn`` inside a container is a method.
_HEADS: dict[str, list[tuple[str, str]]] = {
    "Rust": [
        ("fn", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|default)\s+|extern\s+\"?\s*\"?\s*)*\bfn\s+(?P<n>\w+)"),
        *((k, rf"(?:pub(?:\([^)]*\))?\s+)?\b{w}\s+(?P<n>\w+)") for k, w in (("struct", "struct"), ("enum", "enum"), ("trait", "(?:unsafe\\s+)?trait"), ("mod", "mod"), ("type", "type"), ("const", "const(?!\\s+fn)"), ("var", "static(?:\\s+mut)?"))),
        ("impl", r"\bimpl\b(?:\s*<[^{};]*?>(?=\s))?\s+(?P<n>[A-Za-z_]\w*)"),
        ("macro", r"\bmacro_rules!\s*(?P<n>\w+)"),
    ],
    "Go": [("fn", r"^func\s+(?P<n>\w+)"), ("method", r"^func\s*\([^)]*\)\s*(?P<n>\w+)\s*(?:\[[^\]]*\]\s*)?\("), ("type", r"\btype\s+(?P<n>\w+)"), ("const", r"\bconst\s+(?P<n>\w+)"), ("var", r"\bvar\s+(?P<n>\w+)")],
    "TypeScript": [
        ("fn", r"(?:export\s+(?:default\s+)?)?(?:async\s+)?\bfunction\s*\*?\s*(?P<n>\w+)"),
        *((k, rf"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?\b{w}\s+(?P<n>\w+)") for k, w in (("class", "class"), ("interface", "interface"), ("enum", "enum"), ("type", "type"), ("var", "(?<!\\()(?:const(?!\\s+enum\\b)|let)"))),
        ("method", _BODY),
    ],
    "C#": [*((k, rf"(?:\b(?:public|internal|private|protected|static|abstract|sealed|partial)\s+)*\b{w}\s+(?P<n>[\w.]+)") for k, w in (("class", "class"), ("struct", "struct"), ("enum", "enum"), ("interface", "interface"), ("namespace", "namespace"))), ("method", _CS_HEAD + r"(?:<[^<>(){};]*>\s*)?\([^()]*\)\s*(?:where\b[^{};=]*)?(?=\{|=>|;)"), ("property", _CS_HEAD + r"(?=\{\s*(?:\[[^\]]*\]\s*)?(?:(?:public|private|protected|internal)\s+)*(?:get|set|init)\b|=>)")],
    "C++": [("macro", r"#\s*define\s+(?P<n>\w+)"), *((k, rf"{w}\s+(?P<n>\w+)(?=[^;(){{}}]*\{{)") for k, w in (("class", "(?<!enum )\\bclass"), ("struct", "(?<!enum )\\bstruct"), ("enum", "\\benum(?:\\s+(?:class|struct))?"), ("namespace", "\\bnamespace"))), ("type", r"\btypedef\b[^;{}]*?(?P<n>\w+)\s*(?=;)"), ("fn", _CPP_BODY)],
    "Python": [
        ("fn", r"(?:async\s+)?\bdef\s+(?P<n>\w+)"),
        ("class", r"\bclass\s+(?P<n>\w+)"),
        ("decorated", r"(?:^[ \t]*@[\w.]+(?:\s*\([^()]*\))?[^\n]*\n(?:[ \t]*\n)*)+[ \t]*(?:(?:async\s+)?def|class)\s+(?P<n>\w+)"),
    ],
}
_HEADS["JavaScript"] = _HEADS["TypeScript"]
#: (relation, form) with groups t (target) and s (source, where the form names it).
_IMPORTS = {
    "Rust": r"\buse\s+(?P<t>[^;]+?)\s*;", "Python": r"^[ \t]*(?:from\s+(?P<t>[\w.]+)\s+import\b|import\s+(?P<u>[\w.]+))", "Go": None, "C#": r"\busing\s+(?P<t>[\w.]+)\s*;", "C++": r"#\s*include\s*(?P<t><[^>\n]+>|\"[^\"\n]+\")",
    "TypeScript": r"\bimport\b(?:[^;'\"]*?\bfrom\b)?\s*(?P<t>'[^'\n]*'|\"[^\"\n]*\")",
}
_IMPORTS["JavaScript"] = _IMPORTS["TypeScript"]
_BASES = {
    "Rust": [("inherits", r"\btrait\s+(?P<s>\w+)(?:<[^{]*?>)?\s*:\s*(?P<t>[^{]+?)\s*(?=\{|where)"), ("implements", r"\bimpl\b(?:\s*<[^{};]*?>(?=\s))?\s+(?P<t>[\w:]+(?:<[^{}]*?>)?)\s+for\s+(?P<s>[\w:]+)")],
    "Python": [("inherits", r"\bclass\s+(?P<s>\w+)\s*\((?P<t>[^()]*)\)")],
    "TypeScript": [("inherits", r"\b(?:class|interface)\s+(?P<s>\w+)(?:<[^{]*?>)?\s+extends\s+(?P<t>[^{]+?)\s*(?=\{|\bimplements\b)"), ("implements", r"\bclass\s+(?P<s>\w+)[^{]*?\bimplements\s+(?P<t>[^{]+?)\s*(?=\{)")],
    "C#": [("inherits", r"\b(?:class|struct|interface)\s+(?P<s>\w+)(?:<[^{]*?>)?\s*:\s*(?P<t>[^{]+?)\s*(?=\{|\bwhere\b)")],
    "C++": [("inherits", r"\b(?:class|struct)\s+(?P<s>\w+)\s*(?:final\s*)?:(?!:)\s*(?P<t>[^{;]+?)\s*(?=\{)")],
    "Go": [],
}
_BASES["JavaScript"] = _BASES["TypeScript"]


@cache
def _compiled(form: str) -> re.Pattern:
    return re.compile(form, re.S | re.M)


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get((path or "").rpartition(".")[2].lower())


def _literals(source: str, language: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, comment?) of comments, strings and literals in order: nested comments, raw strings, templates, regular expressions."""
    form, at = _compiled(_SPANS[language]), 0
    while m := form.search(source, at):
        start, at = m.span()
        if m[0] == "/*":  # comments nest
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(source, at)):
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
            at = at if not depth else len(source)
        elif m[0] == "`":
            at = _template_end(source, at)
        elif m[0] == "/":
            found = _REGEX.match(source, start) if _REGEX_AFTER.search(source, max(0, start - 40), start) else None
            if not found:
                continue
            at = found.end()
        elif at == start:
            at += 1
            continue
        yield start, at, m[0].startswith(("//", "/*")) or language == "Python" and m[0].startswith("#")


def _template_end(source: str, at: int) -> int:
    """The end of a template string whose inside starts at ``at``; what it holds in braces may hold templates."""
    braces: list[int] = []
    for m in re.compile(r"\\.|`|\$\{|[{}]", re.S).finditer(source, at):
        if m[0] == "`":
            if braces and braces[-1] >= 0:  # a template in a template's braces
                braces.append(-1)
            elif braces:
                braces.pop()
            else:
                return m.end()
        elif m[0] == "${":
            braces.append(0)
        elif braces and braces[-1] >= 0 and m[0] in "{}":
            if m[0] == "{":
                braces[-1] += 1
            elif braces[-1]:
                braces[-1] -= 1
            else:
                braces.pop()
    return len(source)


def _blank(source: str, literals: list[tuple[int, int, bool]], comments: bool = False) -> str:
    """``source`` with comments, and unless ``comments`` strings, as blanks; places and lines stay."""
    out, at = [], 0
    for start, end, comment in literals:
        if comment or not comments:
            out += [source[at:start], "\n".join(" " * len(line) for line in source[start:end].split("\n"))]
            at = end
    return "".join([*out, source[at:]])


_LONG_BLANK = re.compile(r"[ \t\n]{16,}")


class _Squeezed:
    """Code with its long blanks cut short, since a file of comments is blanks for the most part, and places of the whole for places in it.

    What a form can tell apart stays: how a blank starts and ends, and whether it has no line's end, one or more.
    """

    def __init__(self, code: str):
        self.whole, out, at, size = code, [], 0, 0
        self.starts, self.shifts = [], [0]
        for m in _LONG_BLANK.finditer(code):
            lines = m[0].split("\n")
            short = lines[0][:1] + "\n" * min(len(lines) - 1, 2) + lines[-1][-4:]
            out += [code[at : m.start()], short]
            self.starts.append(size + m.start() - at)
            size, at = self.starts[-1] + len(short), m.end()
            self.shifts.append(at - size)
        self.code = "".join([*out, code[at:]])

    def at(self, place: int) -> int:
        return place + self.shifts[bisect_left(self.starts, place)]

    def find(self, form: str) -> Iterator[tuple[int, int, re.Match]]:
        """(start, end, match) of what is found; white space before it is not counted."""
        for m in _compiled(form).finditer(self.code):
            yield self.at(m.end() - len(m[0].lstrip())), self.at(m.end()), m

    def group(self, m: re.Match, name: str) -> str:
        """A group of a match as it stands in the whole."""
        return self.whole[self.at(m.start(name)) : self.at(m.end(name))]


def _flat(code: str) -> str:
    """``code`` with what stands in round or square brackets inside round ones as blanks, so that a head's parameters have none."""
    out, at, depth = [], 0, 0
    for m in _ROUND.finditer(code):
        if m[0] in "([":
            if depth == 1 and m[0] in "([":
                out.append(code[at : m.start()])
                at = m.start()
            depth += 1 if m[0] == "(" or depth else 0
        elif depth:
            depth -= 1
            if depth == 1:
                out.append(re.sub(r"[^\n]", " ", code[at : m.end()]))
                at = m.end()
    return "".join([*out, code[at:]])


def _braces(code: str) -> dict[int, int]:
    """The closing brace of each opening one."""
    open_, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def _end(code: str, at: int, pairs: dict[int, int]) -> int:
    """The end of a declaration whose head ends at ``at``: its closing brace, or the first semicolon or line's end before one."""
    arrow = code.startswith("=>", at)
    while m := _compiled(r"[{;]").search(code, at):
        if m[0] == ";":
            return m.end()
        at = pairs.get(m.start(), len(code.rstrip()) - 1) + 1
        if not arrow:  # what stands behind an arrow ends with a semicolon
            return at
    return len(code.rstrip())


def _indented_end(lines: list[str], row: int) -> int:
    """The last row of a block whose head is at ``row``."""
    depth, last = len(lines[row]) - len(lines[row].lstrip()), row
    head_open = True  # a head may go on over lines until its colon
    for k in range(row + 1, len(lines)):
        bare = lines[k].strip()
        if not bare:
            continue
        if head_open and lines[k - 1].rstrip().endswith(":"):
            head_open = False
        if len(lines[k]) - len(lines[k].lstrip()) <= depth and not (head_open and bare[0] in ")]}"):
            break
        last = k
    return last


class _Source:
    """One file: its blanked code, and lines and bytes of places."""

    def __init__(self, source: str, language: str):
        self.text, self.language, self.literals = source, language, list(_literals(source, language))
        self.code = _blank(source, self.literals)
        self.flat = _flat(self.code)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.ascii = source.isascii()
        self.line_bytes = [0] if self.ascii else [0, *accumulate(len(source[a:b].encode()) for a, b in zip(self.starts, self.starts[1:], strict=False))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        row = self.line(at) - 1
        return self.line_bytes[row] + len(self.text[self.starts[row] : at].encode())

    def symbols(self) -> list[dict]:
        pairs = self.braces() if self.language != "Python" else {}
        lines = self.code.split("\n")
        found: dict[int, dict] = {}
        flat = _Squeezed(self.flat)
        for kind, form in _HEADS[self.language]:
            for start, stop, m in flat.find(form):
                at = flat.at(m.start("n"))
                place = at if kind != "decorated" else -at - 1
                if place in found or m["n"] in _KEYWORDS:
                    continue
                row = self.line(start)
                if self.language == "Python":
                    last = _indented_end(lines, self.line(at) - 1)
                    end = self.starts[last] + len(lines[last].rstrip())
                elif kind == "macro" and self.language == "C++":
                    while row < len(self.starts) and self.text.endswith("\\\n", 0, self.starts[row]):
                        row += 1
                    end = self.starts[row] - 1 if row < len(self.starts) else len(self.text)
                else:
                    end = _end(self.code, stop, pairs)
                found[place] = {"name": m["n"], "kind": "fn" if kind == "decorated" else kind, "at": at, "start": start, "end": end, "decorated": kind == "decorated"}
        if self.language == "Go":
            self._grouped(found)
        out = sorted(found.values(), key=lambda x: (x["start"], -x["end"]))
        open_: list[dict] = []
        for x in out:
            while open_ and open_[-1]["end"] <= x["start"]:
                open_.pop()
            # the innermost declaration around is the parent, whatever its kind
            x["parent"], x["inside"] = (open_[-1]["name"], open_[-1]["kind"]) if open_ else (None, None)
            if open_ and x["kind"] == "fn" and not x.get("decorated") and self.language in ("Rust", "Python", "C++"):
                x["kind"] = "method"
            open_.append(x)
        # a body in braces after a call-like head is a method only where a container holds it
        return [x for x in out if not (x["kind"] in ("method", "property") and self.language in ("TypeScript", "JavaScript", "C#") and x["inside"] not in CONTAINERS)]

    def _grouped(self, found: dict[int, dict]) -> None:
        """Go's declarations in round brackets: the first name of each line."""
        for m in _compiled(r"\b(const|var|type)\s*\(").finditer(self.code):
            depth = 1
            for n in _compiled(r"[(){}\[\]]|(?:(?<=\n)|(?<=\())[ \t]*([A-Za-z_]\w*)").finditer(self.code, m.end() - 1):
                if n.start() < m.end() and not n[1]:
                    continue
                if n[1]:
                    if depth == 1 and n.start(1) not in found:
                        end = self.code.find("\n", n.end())
                        opened = self.code.find("{", n.end(), end if end >= 0 else len(self.code)) if m[1] == "type" else -1
                        stop = self.braces().get(opened, opened) + 1 if opened >= 0 else end if end >= 0 else len(self.code)
                        found[n.start(1)] = {"name": n[1], "kind": m[1], "at": n.start(1), "start": n.start(1), "end": stop}
                elif n[0] in "({[":
                    depth += 1
                else:
                    depth -= 1
                    if not depth:
                        break

    def braces(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = _braces(self.code)
        return self._pairs

    def relations(self, symbols: list[dict]) -> list[tuple[str, str | None, str, int]]:
        """(relation, source symbol, target, place), each once."""
        names = {x["at"] for x in symbols}
        out: dict[tuple, None] = {}

        cuts, inner = _owners(symbols)

        def owner(at: int) -> str | None:
            k = bisect_right(cuts, at) - 1
            return inner[k] if k >= 0 else None

        raw, code = _Squeezed(_blank(self.text, self.literals, comments=True)), _Squeezed(self.code)
        imports = _IMPORTS[self.language]
        if self.language == "Go":
            blocks = re.finditer(r"\bimport\s*(?:\(([^)]*)\)|((?:\w+\s+)?\"[^\"\n]*\"))", raw.whole)
            sites = [(m.start(0), t) for m in blocks for t in re.findall(r"\"[^\"\n]*\"", m[1] or m[2])]
        else:
            sites = [(at, raw.group(m, "t" if m["t"] is not None else "u")) for at, _, m in raw.find(imports)]
            if self.language == "Python":  # an import starts where its line does
                sites = [(self.starts[self.line(at) - 1], target) for at, target in sites]
        for at, target in sites[:MAX_SITES]:
            out["imports", owner(at), target.strip(), at] = None
        for relation, form in _BASES[self.language]:
            for at, _, m in islice(code.find(form), MAX_SITES):
                for t in re.split(r"[,+](?![^<]*>)", code.group(m, "t")):
                    base = re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", t.strip())
                    if base and "=" not in base and not base.startswith("'"):
                        # a C# base list does not tell interfaces from classes; their names do, until symbols are resolved
                        kind = "implements" if self.language == "C#" and re.match(r"I[A-Z]", base.rpartition(".")[2]) else relation
                        out[kind, m["s"], base, at] = None
        count = 0
        for at, _, m in code.find(rf"(?P<t>{_PATH})\s*(?:::<[^<>()]*>)?\("):
            last = m["t"].replace("->", ".").replace("::", ".").rpartition(".")[2]
            if last in _KEYWORDS or last == "void" or at in names or self.code[at - 1 : at] == "#":
                continue
            before = re.search(r"(\w+)\s*$", self.code[max(0, at - 24) : at])
            if before and before[1] in ("fn", "def", "func", "function", "class", "struct"):
                continue
            count += 1
            if count > MAX_SITES:
                break
            out["calls", owner(at), m["t"], at] = None
        return list(out)


def _owners(symbols: list[dict]) -> tuple[list[int], list[str | None]]:
    """Places where the innermost symbol changes, and its name from there on."""
    cuts, names, open_ = [], [], []

    def cut(at: int) -> None:
        cuts.append(at)
        names.append(open_[-1]["name"] if open_ else None)

    for x in sorted(symbols, key=lambda x: (x["start"], -x["end"])):
        while open_ and open_[-1]["end"] <= x["start"]:
            end = open_.pop()["end"]
            cut(end)
        open_.append(x)
        cut(x["start"])
    while open_:
        cut(open_.pop()["end"])
    return cuts, names


def _doc_above(text: str, start: int) -> str | None:
    """The comment lines right above a declaration, blank lines between it and them left out."""
    found: list[str] = []
    stop = text.rfind("\n", 0, start)
    while stop >= 0:
        begin = text.rfind("\n", 0, stop) + 1
        bare, stop = text[begin:stop].strip(), begin - 1
        if not bare and not found:
            continue
        m = re.match(r"///|//!|//|#|\*", bare)
        if not m:
            break
        found.append(bare[m.end() :].strip())
    joined = "\n".join(reversed(found))
    return joined if joined.strip() else None


def _lines(text: str, at: int, end: int) -> Iterator[str]:
    while at <= end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        yield text[at:stop]
        at = stop + 1


def _signature(text: str, start: int, end: int) -> str | None:
    """The head of a declaration: at most five lines, to the one that opens or ends it."""
    kept = []
    for line in islice(_lines(text, start, end), 5):
        kept.append(line.rstrip())
        if kept[-1].endswith(("{", ":", ";")):
            break
    joined = "\n".join(kept)
    return joined if joined.strip() else None


def _exported(x: dict, s: _Source) -> bool:
    rest = (line.lstrip() for line in _lines(s.text, x["start"], len(s.text)))
    head = next((line for line in rest if line and not line.startswith(("#", "//"))), "")
    if s.language == "Rust":
        return head.startswith(("pub ", "pub("))
    if s.language == "Go":
        return x["name"][:1].isupper()
    if s.language == "Python":
        return not x["name"].startswith("_") and x["parent"] is None
    if s.language in ("TypeScript", "JavaScript"):
        return head.startswith("export") or " export " in head
    return "public" in head if s.language == "C#" else x["parent"] is None


SYMBOL = "path string, language string, name string, kind string, parent string, start_line int, end_line int, start_byte int, end_byte int, exported boolean, doc string, signature string"
RELATION = "path string, language string, relation string, source_symbol string, target string, line int, byte int"


def _over(sources: DataFrame, schema: str, rows_of) -> DataFrame:
    """``rows_of`` (path, source object) over the files of a known language, in Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                language = language_of(path)
                if language is not None and source is not None:
                    rows += rows_of(path, _Source(source, language))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ship(sources.sparkSession)
    return sources.select("path", "source").mapInArrow(run, schema)


def _symbol_rows(path: str, s: _Source) -> list[tuple]:
    out = []
    for x in s.symbols():
        place = (s.line(x["start"]), s.line(max(x["start"], x["end"] - 1)), s.byte(x["start"]), s.byte(x["end"]))
        out.append((path, s.language, x["name"], x["kind"], x["parent"], *place, _exported(x, s), _doc_above(s.text, x["start"]), _signature(s.text, x["start"], x["end"])))
    return out


def _relation_rows(path: str, s: _Source) -> list[tuple]:
    return [(path, s.language, relation, source, target, s.line(at), s.byte(at)) for relation, source, target, at in s.relations(s.symbols())]


def symbols(sources: DataFrame) -> DataFrame:
    """Declarations of ``sources`` (path, source), with stable_key, docs and signatures; files of other languages and null sources have none."""
    return stable_keys(_over(sources, SYMBOL, _symbol_rows))


def relations(sources: DataFrame) -> DataFrame:
    """Imports, calls, inherits and implements of ``sources`` (path, source), each site and target once."""
    return _over(sources, RELATION, _relation_rows)


def stable_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with stable_key: parent, name and kind; the n-th repeat in a file, by start_byte, has ``~n`` at its end."""
    base = F.concat(F.coalesce(F.concat("parent", F.lit("::")), F.lit("")), "name", F.lit(":"), "kind")
    again = F.row_number().over(Window.partitionBy("path", "__base").orderBy("start_byte")) - 1
    out = rows.withColumn("__base", base).withColumn("__again", again)
    return out.withColumn("stable_key", F.concat("__base", F.when(F.col("__again") > 0, F.concat(F.lit("~"), F.col("__again").cast("string"))).otherwise(""))).drop("__base", "__again")


def symbols_of(rows: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """The symbols of one file, in its order, of one kind if it is given."""
    out = rows.where(F.col("path") == path)
    return (out if kind is None else out.where(F.col("kind") == kind)).orderBy("start_byte")


def symbol_source(sources: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """path, shown: the first symbol of that name in each file, as lines with their numbers."""
    first = rows.where(F.col("name") == name).groupBy("path").agg(F.min(F.struct("start_byte", "start_line", "end_line")).alias("s")).select("path", "s.start_line", "s.end_line")
    cut = sources.join(first, "path").withColumn("lines", F.split("source", "\r?\n", -1))
    numbered = F.transform(F.sequence("start_line", F.least("end_line", F.size("lines"))), lambda k: F.format_string("%5d | %s", k, F.get("lines", k - 1)))
    return cut.select("path", F.array_join(numbered, "\n").alias("shown"))


# fixed values: folders of tests and fixtures
TEST_FOLDERS = ["tests", "test", "testdata", "fixtures", "__tests__", "__fixtures__", "__mocks__", "node_modules"]


def is_knowledge(path: Column) -> Column:
    """Is a file one that tells how a project works: not in a folder of tests, and not a test by its name?"""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "")
    test = stem.rlike("(_test|\\.test|\\.spec|_spec)$") | stem.startswith("test_") | (stem == "conftest")
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, TEST_FOLDERS))) & ~test


def symbol_concept(path: Column, key: Column) -> Column:
    """Id of a symbol's concept: its key as a path's part, with eight digits of its hash."""
    slug = F.regexp_replace(F.regexp_replace(key, "[^A-Za-z0-9._-]", "-"), "^-+|-+$", "")
    return F.concat(F.lit("code/"), path, F.lit("/"), slug, F.lit("-"), F.left(F.sha2(key, 256), F.lit(8)), F.lit(".md"))


def file_concept(path: Column) -> Column:
    return F.concat(F.lit("code/"), path, F.lit(".md"))


def concepts(sources: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """id, kind, title, body, tags of modules and exported symbols: what a file is about, declares, imports and calls.

    Files that are not knowledge, and symbols of inline tests, have none.
    """
    kept = rows.where(is_knowledge(F.col("path")))
    public = kept.where(F.col("exported") & ~F.col("stable_key").rlike("^tests?::|::tests::"))
    line = F.concat(F.lit("- `"), "name", F.lit("` ("), "kind", F.lit(") line "), F.col("start_line").cast("string"))
    declared = public.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_byte", line.alias("l")))), lambda x: x["l"]), "\n").alias("declared"))
    imported = links.where("relation = 'imports'").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "target"))), "\n").alias("imported"))
    head = F.array_join(F.transform(F.filter(F.split(F.regexp_extract("source", "(?s)^\\s*((?:\\s*//[!/][^\\n]*\\n)+)", 1), "\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(F.regexp_replace(x, "^\\s*//[!/]", ""))), "\n")
    files = sources.where(is_knowledge(F.col("path")) & F.lower(F.regexp_extract("path", "\\.([^.]*)$", 1)).isin(list(EXTENSIONS))).select("path", head.alias("head"))
    joined = files.join(declared, "path", "left").join(imported, "path", "left")
    section = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"## {name}\n\n"), F.col(c)))
    module = joined.select(
        file_concept(F.col("path")).alias("id"), F.lit("module").alias("kind"), F.col("path").alias("title"),
        F.concat_ws("\n\n", F.when(F.col("head") != "", F.col("head")), section("Declares", "declared"), section("Imports", "imported")).alias("body"), F.array(F.lit("code"), F.lit("module")).alias("tags"),
    )
    own = links.where("relation = 'calls'").groupBy("path", F.col("source_symbol").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "target"))), "\n").alias("calls"))
    symbol = public.join(own, ["path", "name"], "left").select(
        symbol_concept(F.col("path"), F.col("stable_key")).alias("id"), F.lit("symbol").alias("kind"), F.col("name").alias("title"),
        F.concat_ws("\n\n", "doc", F.concat(F.lit("```\n"), "signature", F.lit("\n```")), section("Calls", "calls")).alias("body"), F.array(F.lit("code"), F.col("kind")).alias("tags"),
    )
    return module.unionByName(symbol)


def index_stats(before: DataFrame, now: DataFrame) -> DataFrame:
    """seen, indexed, skipped, removed of a scan: files (path, hash) that are new or changed, unchanged, or gone."""
    both = before.select("path", F.col("hash").alias("a")).join(now.select("path", F.col("hash").alias("b")), "path", "full")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return both.agg(
        count(F.col("b").isNotNull()).alias("seen"), count(F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("indexed"), count(F.col("b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))).alias("skipped"),
        count(F.col("b").isNull()).alias("removed"),
    )


def build_symbol_index(sources: DataFrame, stored: DataFrame, stored_symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) after a scan of ``sources`` (path, source): only files whose hash is new or changed are read again.

    ``stored`` has path and hash, ``stored_symbols`` what :func:`symbols` gave for them. Files that are gone lose their symbols.
    """
    now = sources.select("path", F.sha2(F.coalesce("source", F.lit("")), 256).alias("hash"))
    same = now.join(stored, ["path", "hash"], "left_semi").select("path")
    fresh = symbols(sources.join(same, "path", "left_anti"))
    return now, stored_symbols.join(same, "path", "left_semi").select(*fresh.columns).unionByName(fresh)
