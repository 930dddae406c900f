"""Types of C# and Java source text with what belongs to them, from one linear pass over a file.

Comments and literals are masked at the same length, so braces and words within them do not count; each brace then has its
partner from one stack, whatever the layout. A type's body leaves out the types declared within it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.batches import pieces

#: Comments; raw, verbatim and plain strings; characters.
_HIDDEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""+.*?(?:"""+|\Z)|(?:@\$?|\$@)"(?:[^"]|"")*+"?|\$?"(?:[^"\\\n]|\\.)*+"?|\'(?:[^\'\\\n]|\\.)*+\'?', re.S)
_MODIFIERS = r"(?:(?:public|internal|private|protected|abstract|sealed|partial|static|readonly|ref|unsafe|file|new)\s+){0,8}"
_TYPE = re.compile(rf"(?<![\w.@]){_MODIFIERS}\b(record\s+(?:class|struct)|class|record|struct|interface)\s+(?!where\b)(\w+)")
_STOP = re.compile(r"[{};()]")
_SPLIT = re.compile(r"[<>(),\[\]]")
SCHEMA = "path string, pos int, kind string, name string, listed array<string>, begin int, stop int, depth int, body string, outline string"


def masked(text: str) -> tuple[str, str]:
    """(text with comments as blanks, the same with literals as x); both as long as text."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    clean, mask, at = [], [], 0
    for m in _HIDDEN.finditer(text):
        comment = m[0].startswith(("//", "/*"))
        plain = text[at : m.start()]
        clean += (plain, blank(m[0]) if comment else m[0])
        mask += (plain, blank(m[0]) if comment else "x" * len(m[0]))
        at = m.end()
    return "".join([*clean, text[at:]]), "".join([*mask, text[at:]])


def listed(head: str) -> list[str]:
    """The bases of a head, commas within <>, () and [] not counted, without blanks."""
    out, depth, start = [], 0, 0
    for m in _SPLIT.finditer(head):
        c = m[0]
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            out.append(head[start : m.start()])
            start = m.end()
    return [x for x in (re.sub(r"\s+", "", y) for y in [*out, head[start:]]) if x]


def _bases(head: str) -> str:
    """What stands behind the first colon outside parentheses, up to constraints."""
    depth = 0
    for i, c in enumerate(head):
        depth += (c in "(<") - (c in ")>")
        if c == ":" and depth == 0:
            return re.split(r"\bwhere\b", head[i + 1 :])[0]
    return ""


def types_of(text: str) -> list[tuple]:
    """(kind, name, bases, begin, stop, depth, body, outline) of each type, in order; body is None without braces, outline is
    the body with literals as x."""
    clean, mask = masked(text)
    partner, stack, depth_at = {}, [], {}
    for m in re.finditer(r"[{}]", mask):
        if m[0] == "{":
            depth_at[m.start()] = len(stack)
            stack.append(m.start())
        elif stack:
            partner[stack.pop()] = m.start()
    found = []
    heads = list(_TYPE.finditer(mask))
    for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(mask)]):
        depth = 0
        for s in _STOP.finditer(mask, m.end(), after):
            depth += (s[0] == "(") - (s[0] == ")")
            if s[0] in "{};" and depth <= 0:
                break
        else:
            continue
        if s[0] == "}":
            continue
        head, begin = _bases(mask[m.end() : s.start()]), s.start() + 1
        stop = partner.get(s.start(), len(mask)) if s[0] == "{" else None
        found.append((m[1].split()[0], m[2], listed(head), m.start(), begin, stop, depth_at.get(s.start(), 0)))
    out, starts = [], [f[3] for f in found]
    for k, (kind, name, bases, start, begin, stop, depth) in enumerate(found):
        body = outline = None
        if stop is not None:
            pieces, at, child = [], begin, k + 1
            while child < len(found) and found[child][3] < stop:
                _, _, _, other, own, end, _ = found[child]
                pieces.append((at, other))
                at = own if end is None else end + 1
                child = max(child + 1, bisect_left(starts, at))  # past what is declared within the child
            pieces.append((at, stop))
            body, outline = ("".join(t[a:b] for a, b in pieces) for t in (clean, mask))
        out.append((kind, name, bases, begin, stop if stop is not None else begin, depth, body, outline))
    return out


def _carried(piece: pa.RecordBatch, rows: list[int], names: tuple[str, ...]) -> list[pa.Array]:
    """The columns names of piece, once for each place in rows."""
    at = pa.array(rows, pa.int32())
    return [piece.column(n).take(at) for n in names]


def _more(files: DataFrame, suffix: str, schema: str, more: dict[str, Column]) -> tuple[DataFrame, str]:
    """(path, text and more of the files of a suffix, schema with the columns of more)."""
    chosen = files.where(F.col("path").endswith(suffix)).select("path", "text", *[c.alias(n) for n, c in more.items()])
    return chosen, ", ".join([schema, *(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema[2:])])


def types(files: DataFrame, **more: Column) -> DataFrame:
    """(path, pos, kind, name, listed, begin, stop, depth, body, outline) of the types in .cs files; null texts have none.
    more: further columns of the rows of files, such as a file's namespace, that each of its types gets."""
    chosen, schema = _more(files, ".cs", SCHEMA, more)
    carried = tuple(more)
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows, of = [], []
            for n, (p, text) in enumerate(zip(piece.column("path").to_pylist(), piece.column("text").to_pylist())):
                found = types_of(text or "")
                rows += [(p, i, *t) for i, t in enumerate(found)]
                of += [n] * len(found)
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), *_carried(piece, of, carried)], [*names, *carried])

    return chosen.mapInArrow(run, schema)


# ---- Java

_JAVA_TOKEN = re.compile(r"[{}();]|(?<![\w.@])(class|interface|enum|record)\s+(\w+)")
_MEMBER_TOKEN = re.compile(r"[;={}()]")
_NOTE = re.compile(r"\s*@[\w.]+\s*")
_WORD_AT_END = re.compile(r"(\w+)\s*\Z")
_ACCESS = re.compile(r"\s*(?:(?:private|protected|public)\s+)(?:(?:final|transient|volatile)\s+){0,3}")
JAVA_SCHEMA = "path string, pos int, kind string, name string, notes string, parents array<string>, interfaces array<string>, depth int, outline string, fields array<struct<notes: string, type: string, name: string>>"


def _closed(text: str, at: int) -> int:
    """The place after the parenthesis that closes the one at at; the end where none does."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _java_field(clean: str, mask: str) -> tuple[str, str, str] | None:
    """(notes, type, name) of the text of a member up to its ; or =, or None."""
    at = 0
    while m := _NOTE.match(mask, at):
        at = m.end()
        if at < len(mask) and mask[at] == "(":
            at = _closed(mask, at)
    access = _ACCESS.match(mask, at)
    bare = mask.rstrip()
    name = _WORD_AT_END.search(mask, max(at, *(bare.rfind(c) for c in " \n\t>]")))
    if not access or not name or name.start() <= access.end():
        return None
    kind = re.sub(r"\s+", " ", mask[access.end() : name.start()].strip())
    if not kind or kind.startswith("static ") or not re.fullmatch(r"[\w<>\[\], .?]+", kind):
        return None
    return clean[:at].strip(), kind, name[1]


def _java_fields(clean: str, mask: str) -> list[tuple[str, str, str]]:
    """The fields of a body that leaves out its inner types: what ends in ; or = outside parentheses and braces."""
    out, start, parens, braces, value = [], 0, 0, 0, False
    for m in _MEMBER_TOKEN.finditer(mask):
        c = m[0]
        if c in "()":
            parens = max(0, parens + (1 if c == "(" else -1))
        elif parens:
            continue
        elif c in "{}":
            braces = max(0, braces + (1 if c == "{" else -1))
            if c == "}" and braces == 0 and not value:
                start = m.end()
        elif braces == 0 and c == "=" and not value:
            out.append(_java_field(clean[start : m.start()], mask[start : m.start()]))
            value = True
        elif braces == 0 and c == ";":
            if not value:
                out.append(_java_field(clean[start : m.start()], mask[start : m.start()]))
            start, value = m.end(), False
    return [f for f in out if f]


def java_types_of(text: str) -> list[tuple]:
    """(kind, name, notes, parents, interfaces, depth, outline, fields) of each type with a body, in order. notes are the
    annotations and modifiers before it; braces within parentheses belong to annotations and do not open scopes. Declarations
    of annotations are none."""
    clean, mask = masked(text)
    found, stack, parens, since, head = [], [], 0, 0, None
    for m in _JAVA_TOKEN.finditer(mask):
        c = m[0]
        if c in "()":
            parens = max(0, parens + (1 if c == "(" else -1))
        elif parens:
            continue
        elif c in "{};":
            if c == "{":
                if head:
                    found.append([*head, m.start(), len(mask), len(stack), m.end()])
                stack.append(len(found) - 1 if head else -1)
            elif c == "}" and stack:
                k = stack.pop()
                if k >= 0:
                    found[k][5] = m.start()
            head, since = None, m.end()
        elif not head:
            head = (m[1], m[2], clean[since : m.start()].strip(), (since, m.end()))
    out, starts = [], [f[3][0] for f in found]
    for k, (kind, name, notes, (_, name_end), brace, stop, depth, begin) in enumerate(found):
        line = mask[name_end:brace]
        parents, interfaces = [], []
        parts = re.split(r"\b(extends|implements)\b", _without_parameters(line))
        for word, rest in zip(parts[1::2], parts[2::2]):
            (interfaces if word == "implements" else parents).extend(listed(rest))
        pieces, at, child = [], begin, k + 1
        while child < len(found) and found[child][3][0] < stop:
            pieces.append((at, found[child][3][0]))
            at = found[child][5] + 1
            child = max(child + 1, bisect_left(starts, at))  # past what is declared within the child
        pieces.append((at, max(at, stop)))
        body, outline = ("".join(t[a:b] for a, b in pieces) for t in (clean, mask))
        out.append((kind, name, notes, parents, interfaces, depth, outline, _java_fields(body, outline)))
    return out


def _without_parameters(head: str) -> str:
    """A head without the type parameters or components right after its name."""
    text, depth = head.lstrip(), 0
    if text[:1] not in ("<", "("):
        return text
    for m in re.finditer(r"[<>()]", text):
        depth += 1 if m[0] in "<(" else -1
        if depth == 0:
            return _without_parameters(text[m.end() :]) if text[0] == "<" else text[m.end() :]
    return ""


def java_types(files: DataFrame, **more: Column) -> DataFrame:
    """The types in .java files with the columns of JAVA_SCHEMA, and more as in types(); null texts have none."""
    chosen, schema = _more(files, ".java", JAVA_SCHEMA, more)
    carried = tuple(more)
    field = pa.struct([("notes", pa.string()), ("type", pa.string()), ("name", pa.string())])
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.list_(field)]
    names = "path pos kind name notes parents interfaces depth outline fields".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows, of = [], []
            for n, (p, text) in enumerate(zip(piece.column("path").to_pylist(), piece.column("text").to_pylist())):
                for i, (*t, fields) in enumerate(java_types_of(text or "")):
                    rows.append((p, i, *t, [dict(zip(("notes", "type", "name"), f)) for f in fields]))
                    of.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), *_carried(piece, of, carried)], [*names, *carried])

    return chosen.mapInArrow(run, schema)
