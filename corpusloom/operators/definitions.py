"""Outline of source files: one chunk per function, method or container.

A file is read once, in the task that holds its row: comments and strings are
hidden, then a stack of brackets (or of indentation) cuts the text into heads, the
signatures, and bodies. A head is text between two separators of the language, on
as many lines as it takes; the rules say which heads are definitions. What stands
inside a function is no chunk of its own. Nothing is shuffled.

Known limits: macros that change the syntax, and regular expression literals with
braces in unusual places. Out-of-line ``A::m`` has no name, as it has none in the
index that this replaces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.exprs import explode_rows
from corpusloom.operators.chunking import fallback_array


@dataclass(frozen=True)
class Rule:
    """How the head of one kind of definition looks in one language.

    ``pattern`` captures the definition from its first character (``d``) and its
    name (``name``, or ``cls`` for a receiver). ``emit`` is off for containers
    that only lend their name, ``header`` keeps a container's text up to its body.
    ``body`` demands a body, ``bare`` the lack of one. ``inside`` names the block
    that must be right around it: a class or a literal.
    """

    symbol_type: str
    pattern: str
    container: bool = False
    emit: bool = True
    header: bool = True
    body: bool = True
    inside: bool = False
    own_name: bool = False


_NOT_CALLS = (
    r"(?!(?:if|for|while|switch|catch|return|else|do|try|with|new|delete|throw|case|typedef|enum|union|"
    r"using|namespace|function|sizeof|synchronized|await|typeof|class|struct|static_assert|default)\b)"
)
_ARGS = r"(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?"
_ANNOTATED = rf"(?:@[A-Za-z_][\w.]*{_ARGS}\s*)*"
_TEMPLATE = r"(?:template\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>\s*)*"
_LABELS = r"(?:(?:public|private|protected)\s*:\s*)*"
_ATTRIBUTED = r"(?:#!?\[[^\]]*\]\s*)*"
_EXPORT = r"(?:(?:export|default|declare)\s+)*"
_GENERIC = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_JAVA_MODS = (
    rf"(?:@(?!interface)[A-Za-z_][\w.]*{_ARGS}\s*|(?:public|protected|private|static|final|abstract|"
    r"synchronized|native|default|strictfp|sealed|non-sealed)\s+)*"
)
_JS_MODS = r"(?:(?:static|async|get|set)\s+|\*\s*)*"
_TS_MODS = r"(?:(?:public|protected|private|static|async|get|set|override|readonly)\s+|\*\s*)*"
# Everything before the first parenthesis that is not a statement; a name only
# where it is no part of a qualified one.
_C_FUNCTION = (
    rf"{_LABELS}{_TEMPLATE}(?:extern\s+\"+\s*)?(?P<d>{_NOT_CALLS}"
    r"(?:[\w:<>,*&~\[\]\s]*[\s*&>])?(?:~?(?P<name>(?!operator\b)\w+)|[\w:~]+|[\w:]*operator[^(]+(?:\(\))?)\s*\(.*)"
)
_C_RECORD = r"\s+(?:alignas\([^)]*\)\s*)?(?:\w+::)*(?P<name>\w+)(?:\s*<[^;{}()]*>)?(?:\s+final)?\s*(?::[^;()=]*)?)"

_JS = (
    Rule("class", rf"{_ANNOTATED}{_EXPORT}{_ANNOTATED}(?P<d>class\s+(?P<name>[\w$]+).*)", container=True),
    Rule("function", rf"{_EXPORT}(?P<d>(?:async\s+)?function\s+(?P<name>[\w$]+)\s*[(<].*)"),
)
_JS_METHOD = Rule(
    "method",
    rf"{_ANNOTATED}(?P<d>{_NOT_CALLS}{_JS_MODS}(?:(?P<name>#?[\w$]+)|\[[^\]]*\]|\"+)\s*\(.*\))",
    inside=True,
)
_TS = (
    *_JS,
    Rule("interface", rf"{_EXPORT}(?P<d>interface\s+(?P<name>[\w$]+).*)", container=True),
    Rule(
        "method",
        rf"{_ANNOTATED}(?P<d>{_NOT_CALLS}{_TS_MODS}(?:(?P<name>#?[\w$]+)|\[[^\]]*\]|\"+)\s*(?:<.*>)?\s*\(.*\)"
        r"\s*(?::.*)?)",
        inside=True,
    ),
)

RULES: dict[str, tuple[Rule, ...]] = {
    "python": (
        Rule("class", r"(?P<d>class\s+(?P<name>\w+))", container=True),
        Rule("function", r"(?P<d>(?:async\s+)?def\s+(?P<name>\w+))"),
    ),
    "go": (
        Rule("type", r"(?P<d>type\s+(?P<name>\w+).*)", container=True, header=False, body=False),
        Rule("type", r"(?P<d>(?P<name>\w+)\s+(?:struct|interface))", container=True, header=False, inside=True),
        Rule("method", r"(?P<d>func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<cls>\w+)[^)]*\)\s*(?P<name>\w+).*)"),
        Rule("function", r"(?P<d>func\s+(?P<name>\w+).*)"),
    ),
    "javascript": (*_JS, _JS_METHOD),
    "typescript": _TS,
    "tsx": _TS,
    "java": (
        Rule("class", rf"(?P<d>{_JAVA_MODS}class\s+(?P<name>\w+).*)", container=True),
        Rule("interface", rf"(?P<d>{_JAVA_MODS}interface\s+(?P<name>\w+).*)", container=True),
        Rule(
            "method",
            rf"(?P<d>{_JAVA_MODS}(?:<(?:[^<>]|<[^<>]*>)*>\s*)?{_NOT_CALLS}(?!record\b)[\w.]+"
            r"(?:\s*<(?:[^<>=]|<(?:[^<>=]|<[^<>=]*>)*>)*>)?(?:\s*\[\s*\])*\s+(?P<name>\w+)\s*\(.*)",
            body=False,
        ),
        Rule("method", rf"(?P<d>{_JAVA_MODS}(?P<name>\w+)\s*\(.*)", own_name=True),
    ),
    "rust": (
        Rule("struct", rf"{_ATTRIBUTED}(?P<d>{_PUB}struct\s+(?P<name>\w+).*)", container=True, body=False),
        Rule("enum", rf"{_ATTRIBUTED}(?P<d>{_PUB}enum\s+(?P<name>\w+).*)", container=True, header=False),
        Rule("trait", rf"{_ATTRIBUTED}(?P<d>{_PUB}(?:unsafe\s+)?trait\s+(?P<name>\w+).*)", container=True),
        Rule(
            "impl",
            rf"{_ATTRIBUTED}(?P<d>(?:unsafe\s+)?impl(?:\s*{_GENERIC})?\s+"
            rf"(?:(?:[\w:]+::\w+(?:\s*{_GENERIC})?|\w+\s*{_GENERIC})\s+for\s+)?(?P<name>\w+).*)",
            container=True,
            emit=False,
        ),
        Rule(
            "function",
            rf"{_ATTRIBUTED}(?P<d>(?:(?:pub(?:\([^)]*\))?|const|async|unsafe|default|extern(?:\s+\"+)?)\s+)*"
            r"fn\s+(?P<name>\w+).*)",
        ),
    ),
    "c": (
        Rule("struct", rf"(?:(?:typedef|static|const)\s+)*(?P<d>struct{_C_RECORD}", container=True),
        Rule("function", _C_FUNCTION),
    ),
    "cpp": (
        Rule("class", rf"{_LABELS}{_TEMPLATE}(?P<d>class{_C_RECORD}", container=True),
        Rule("struct", rf"{_LABELS}{_TEMPLATE}(?:typedef\s+)?(?P<d>struct{_C_RECORD}", container=True),
        Rule("function", _C_FUNCTION),
    ),
    "ruby": (
        Rule("class", r"(?P<d>class\s+(?P<name>[A-Z]\w*))", container=True),
        Rule("method", r"(?P<d>def\s+(?P<name>[A-Za-z_]\w*[?!=]?(?![\w.])|[-+*/%<>=!~^&|\[\]]+))"),
    ),
}
SUPPORTED_LANGUAGES = tuple(sorted(RULES))
INDENTED = ("python", "ruby")
_COMPILED = {k: [(r, re.compile(r.pattern, re.DOTALL)) for r in v] for k, v in RULES.items()}

# --- hiding comments and strings -----------------------------------------

_SLASH = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"
_DIRECTIVE = r"^[ \t]*\#(?:[^\n\\]|\\[\s\S])*"
_TEXT_BLOCK = r'"""[\s\S]*?(?:"""|\Z)'
_HIDDEN = {
    "python": rf"\#[^\n]*|{_TEXT_BLOCK}|" + r"'''[\s\S]*?(?:'''|\Z)|" + _QUOTED,
    "ruby": r"^=begin\b[\s\S]*?(?:^=end\b|\Z)|\#[^\n]*|" + _QUOTED,
    "go": _SLASH + r"|`[^`]*`|" + _QUOTED,
    "rust": _SLASH + r'|r(?P<r>\#*)"[\s\S]*?(?:"(?P=r)|\Z)|"(?:\\[\s\S]|[^"\\])*"|' + r"'(?:\\.[^']*|[^'\\])'",
    "java": _SLASH + "|" + _TEXT_BLOCK + "|" + _QUOTED,
    "js": _SLASH + r"|`(?:\\[\s\S]|[^`\\])*`|" + _QUOTED
    + r"|(?<=[(,=:\[!&|?;{}])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/",
    "c": _DIRECTIVE + "|" + _SLASH + "|" + _QUOTED,
    "cpp": _DIRECTIVE + "|" + _SLASH + r'|R"(?P<r>[^(\s]*)\([\s\S]*?(?:\)(?P=r)"|\Z)|' + _QUOTED,
}
_STYLE = {"javascript": "js", "typescript": "js", "tsx": "js"}
_MASKS = {k: re.compile(v, re.MULTILINE) for k, v in _HIDDEN.items()}
# Stands for the later lines of a string, whose indentation means nothing.
_CONTINUED = "\x01"


def _hide(match: re.Match) -> str:
    """Same length and line breaks: blanks for comments, quotes for strings."""
    text = match.group()
    comment = text.lstrip().startswith(("#", "//", "/*", "=begin"))
    fill, later = (" ", " ") if comment else ('"', _CONTINUED)
    first, *rest = text.split("\n")
    return "\n".join([fill * len(first), *(later * len(line) for line in rest)])


def masked(text: str, language: str) -> str:
    return _MASKS[_STYLE.get(language, language)].sub(_hide, text)


# --- the scan ---------------------------------------------------------------


@dataclass
class _Unit:
    """A definition found: where it starts, its body begins, and it ends."""

    rule: Rule
    name: str | None
    class_name: str | None
    nested: bool
    start: int
    body: int
    end: int = -1


@dataclass
class _Block:
    """An open bracket. ``head`` is where the next head in it starts."""

    bracket: str
    head: int
    unit: _Unit | None = None
    literal: bool = False
    quiet: bool = False
    owner: _Unit | None = None
    type_name: str | None = None
    members: bool = False


_CLOSE = {")": "(", "]": "[", "}": "{"}
_STRUCTURE = re.compile(r"[{}()\[\];,\n]")
_TYPE_NAME = re.compile(r"\b(?:class|enum|record|interface|struct)\s+(\w+)")
_GOES_ON = re.compile(r"\s*(?:[{.,?:=&|<>)\]*/+-]|(?:extends|implements|throws|where)\b)")
# A brace after one of these opens a value, not a body.
_VALUE_AFTER = {"rust": "=([", **dict.fromkeys(("javascript", "typescript", "tsx"), "=([,:?<|&")}
_BY_LINES = ("go", "javascript", "typescript", "tsx")


@dataclass
class _Scan:
    code: str
    language: str
    units: list[_Unit] = field(default_factory=list)

    def rule_of(self, start: int, end: int, block: _Block, body: bool) -> _Unit | None:
        head = self.code[start:end]
        cut = len(head) - len(head.lstrip())
        head = head.strip()
        if not head or block.quiet:
            return None
        for rule, pattern in _COMPILED[self.language]:
            if (rule.body and not body) or (rule.inside and not block.members):
                continue
            found = pattern.fullmatch(head)
            if not found or (rule.own_name and found["name"] != block.type_name):
                continue
            groups = found.groupdict()
            owner = block.owner
            return _Unit(
                rule,
                groups["name"],
                groups.get("cls") or (owner.name if owner else None),
                owner is not None,
                start + cut + found.start("d"),
                end,
            )
        return None

    def opened(self, at: int, block: _Block) -> _Block:
        """The block that a brace opens, with the definition it is the body of."""
        head = self.code[block.head : at].rstrip()
        last = head[-1:]
        literal = (last and last in _VALUE_AFTER.get(self.language, "=([,")) or head.endswith("return")
        if self.language == "go":
            literal |= bool(re.match(r"\s*func\b.*\b(?:struct|interface)$", head, re.DOTALL))
        elif self.language == "cpp" and (last.isalnum() or last in ("_", ">")):
            # A member set to a value in braces, before a constructor's body.
            literal |= bool(re.search(r"\)\s*(?:noexcept\s*)?:(?!:)[^?]*$", head))
        elif self.language == "rust" and re.search(r"!\s*\w*$", head):
            return _Block("{", at + 1, quiet=True, literal=True)
        inner = _Block("{", at + 1, literal=literal, quiet=block.quiet, owner=block.owner)
        inner.members = literal and self.language in _BY_LINES[1:]
        if not literal and block.bracket == "{":
            unit = self.rule_of(block.head, at, block, True)
            kind = _TYPE_NAME.search(head)
            inner.type_name = kind[1] if kind else None
            if unit:
                self.units.append(unit)
                inner.unit = unit
                if unit.rule.container:
                    inner.owner, inner.members, inner.type_name = unit, self.language != "go", unit.name
                else:
                    inner.quiet = True
            elif self.language == "java" and re.search(r"\benum\b", head):
                inner.literal = True
        return inner

    def ended(self, at: int, end: int, block: _Block) -> None:
        """A statement without a body ends before ``at``."""
        unit = self.rule_of(block.head, at, block, False)
        if unit and not unit.rule.body:
            unit.end = unit.body = len(self.code[:at].rstrip()) if end == at else end
            self.units.append(unit)

    def braces(self) -> list[_Unit]:
        code, by_lines = self.code, self.language in _BY_LINES
        stack = [_Block("{", 0)]
        for match in _STRUCTURE.finditer(code):
            at, char, top = match.start(), match.group(), stack[-1]
            if char == "{":
                stack.append(self.opened(at, top))
            elif char in "([":
                inner = _Block(char, at + 1, quiet=top.quiet, owner=top.owner)
                if self.language == "go" and char == "(" and code[top.head : at].strip() == "type":
                    inner.bracket, inner.members, inner.literal = "{", True, True
                stack.append(inner)
            elif char in _CLOSE:
                opens = _CLOSE[char]
                depth = len(stack) - 1
                grouped = stack[-1].members and stack[-1].bracket == "{" and char == ")"
                while depth > 0 and stack[depth].bracket != opens and not grouped:
                    depth -= 1
                if depth <= 0 or (char != "}" and not grouped and depth != len(stack) - 1):
                    continue
                closed = stack[depth]
                if grouped:
                    self.ended(at, at, closed)
                del stack[depth:]
                if closed.unit:
                    closed.unit.end = at + 1
                top = stack[-1]
                if (char == "}" and top.bracket == "{" and not (closed.literal and closed.unit is None)) or grouped:
                    top.head = at + 1
            elif top.bracket == "{":
                if char == ";" or (char == "," and top.literal):
                    if char == ";":
                        self.ended(at, at + 1, top)
                    top.head = at + 1
                elif char == "\n" and by_lines and not self.goes_on(top.head, at):
                    self.ended(at, at, top)
                    top.head = at + 1
        last = len(code.rstrip())
        if stack[-1].bracket == "{":
            self.ended(len(code), len(code), stack[-1])
        for unit in self.units:
            if unit.end < 0:
                unit.end = last
        return self.units

    def goes_on(self, start: int, at: int) -> bool:
        """Whether a statement goes on after a line break."""
        if self.language == "go":
            return False
        before = self.code[start:at].rstrip()
        return not before or before[-1] in ",([=+-*&|?.:<" or bool(_GOES_ON.match(self.code, at + 1))

    def indented(self) -> list[_Unit]:
        ruby = self.language == "ruby"
        stack: list[tuple[int, _Unit]] = []
        depth, at, filled, goes_on = 0, 0, 0, False
        for line in self.code.split("\n"):
            text = line.strip()
            first = at + len(line) - len(line.lstrip())
            if text and not text.startswith(_CONTINUED) and depth == 0 and not goes_on:
                indent = first - at
                while stack and indent <= stack[-1][0]:
                    unit = stack.pop()[1]
                    own = ruby and indent == unit_indent(unit, self.code) and re.match(r"end\b", text)
                    unit.end = at + len(line.rstrip()) if own else filled
                owner = next((u for _, u in reversed(stack) if u.rule.container), None)
                inside = any(not u.rule.container for _, u in stack)
                for rule, pattern in [] if inside else _COMPILED[self.language]:
                    found = pattern.match(text)
                    if found:
                        unit = _Unit(rule, found["name"], owner.name if owner else None, owner is not None, first, 0)
                        unit.body = self.body_of(first, at + len(line))
                        self.units.append(unit)
                        if ruby and re.search(r"(?:;|\s)end$|^def\b[^=]*\)\s*=\s|^def\s+\w+\s+=\s", text):
                            unit.end = at + len(line.rstrip())
                        else:
                            stack.append((indent, unit))
                        break
            if text:
                filled = at + len(line.rstrip())
            if not ruby:
                depth = max(0, depth + sum((c in "([{") - (c in ")]}") for c in text))
                goes_on = text.endswith("\\")
            at += len(line) + 1
        for _, unit in stack:
            unit.end = filled
        return self.units

    def body_of(self, start: int, line_end: int) -> int:
        """Where the header of a definition ends."""
        if self.language == "ruby":
            return line_end
        depth = 0
        for match in re.finditer(r"[()\[\]{}:]", self.code[start:]):
            depth += (match[0] in "([{") - (match[0] in ")]}")
            if match[0] == ":" and depth == 0:
                return start + match.end()
        return line_end


def unit_indent(unit: _Unit, code: str) -> int:
    return unit.start - (code.rfind("\n", 0, unit.start) + 1)


def outline(text: str, language: str) -> list[tuple]:
    """``(name, type, class, start line, end line, content)`` of every
    definition that is emitted, in the order of the text."""
    scan = _Scan(masked(text, language), language)
    units = scan.indented() if language in INDENTED else scan.braces()
    breaks = [m.start() for m in re.finditer("\n", text)]
    out = []
    for unit in sorted(units, key=lambda u: u.start):
        if not unit.rule.emit:
            continue
        end = unit.body if unit.rule.container and unit.rule.header else unit.end
        content = text[unit.start : end]
        kind = "method" if unit.nested and not unit.rule.container else unit.rule.symbol_type
        out.append(
            (
                unit.name,
                kind,
                unit.class_name,
                bisect_right(breaks, unit.start) + 1,
                bisect_right(breaks, max(unit.start, unit.end - 1)) + 1,
                content.rstrip() if unit.rule.container or language in INDENTED else content,
            )
        )
    return out


# --- files to chunks --------------------------------------------------------


def check_languages(languages: Iterable[str]) -> None:
    for language in languages:
        if language not in RULES:
            raise ValueError(f"Unsupported code chunking language: {language}")


# Characters of the files that a task holds before it hands their chunks on.
BATCH = 1 << 22
_SCHEMA = pa.schema(
    [("path", pa.string()), ("language", pa.string()), ("symbol_name", pa.string()), ("symbol_type", pa.string())]
    + [("class_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())]
    + [("error", pa.string())]
)
_DDL = (
    "path string, language string, symbol_name string, symbol_type string, class_name string, "
    "start_line int, end_line int, content string, error string"
)


def scanned(files: DataFrame) -> DataFrame:
    """The definitions of ``path, language, content`` files as rows. A file
    without any keeps its row and text, with null ``symbol_type``; one that cannot
    be read has an ``error``, so that nothing is lost on the way."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch_of(rows):
            columns = zip(zip(*rows, strict=True), _SCHEMA, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=_SCHEMA)

        for batch in batches:
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, error = [], None
                if language not in RULES:
                    error = f"unsupported language: {language}"
                elif content is None:
                    error = "no content"
                else:
                    try:
                        found = outline(content, language)
                    except (IndexError, RecursionError, ValueError) as e:
                        error = f"not readable: {e}"
                rows += [(path, language, *x, None) for x in found] or [
                    (path, language, None, None, None, None, None, content, error)
                ]
                size += len(content or "") + 100 * len(found)
                if size > BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return files.select(*[F.col(c).cast("string").alias(c) for c in ("path", "language", "content")]).mapInArrow(
        scan, _DDL
    )


def definition_outline(files: DataFrame) -> DataFrame:
    """``path, language, symbol_name, symbol_type, class_name, start_line,
    end_line`` of every definition, without its text."""
    return scanned(files).where("symbol_type is not null").drop("content", "error")


_CHUNK_FIELDS = ("symbol_name", "symbol_type", "class_name", "start_line", "end_line")


def unsupported_files(files: DataFrame, language_col: str = "language") -> DataFrame:
    """The rows that ``code_chunks`` has no rules for, null languages included:
    to be quarantined or chunked as text, not lost."""
    known = F.coalesce(F.col(language_col).isin(*SUPPORTED_LANGUAGES), F.lit(False))
    return files.where(~known)


def chunks_and_errors(files: DataFrame, size: int = 1500, overlap: int = 100, fallback: bool = True) -> DataFrame:
    """Chunks of files, and one row with an ``error`` for each that has none
    because it cannot be read: ``source, language, symbol_name, symbol_type,
    class_name, start_line, end_line, content, error``.

    A file with definitions gives one chunk for each. Others fall back to a
    whole-file or block chunks; blank ones give nothing. No shuffle.
    """
    null = F.lit(None)
    as_is = F.array(F.struct(*_CHUNK_FIELDS, "content"))
    rest = F.transform(
        fallback_array(F.col("content"), size, overlap),
        lambda c: F.struct(
            null.cast("string").alias("symbol_name"),
            c["symbol_type"].alias("symbol_type"),
            null.cast("string").alias("class_name"),
            c["start_line"].alias("start_line"),
            c["end_line"].alias("end_line"),
            c["chunk"].alias("content"),
        ),
    )
    done = F.when(F.col("symbol_type").isNotNull() | F.col("error").isNotNull(), as_is)
    chunks = done.otherwise(rest) if fallback else done
    return explode_rows(scanned(files), chunks, "_c", keep=["path", "language", "error"]).select(
        F.col("path").alias("source"), "language", "_c.*", "error"
    )


def code_chunks(files: DataFrame, size: int = 1500, overlap: int = 100, fallback: bool = True) -> DataFrame:
    """The chunks of ``chunks_and_errors`` alone."""
    return chunks_and_errors(files, size, overlap, fallback).where("error is null").drop("error")


def quarantined_files(files: DataFrame) -> DataFrame:
    """``source, language, content, error`` of the files that give no chunks
    because they cannot be read."""
    return (
        chunks_and_errors(files).where("error is not null").select("source", "language", "content", "error")
    )


def definition_chunks(files: DataFrame) -> DataFrame:
    """Only the definitions, without the fallback."""
    return code_chunks(files, fallback=False)
