"""SQL DDL text to catalog rows: tables, columns, keys, indexes, views, procedures, triggers.

One Arrow-batched pass cuts a script into statements with their lines, the bodies of tables into clauses (commas and
parentheses nest). It looks at a copy in which comments are gone and quoted text and names are masked, so that neither
keywords nor parentheses count within them. All catalog rows are built-in expressions over these short rows; write them once
(cut) where several are wanted. Times go with the length of a script.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.scalar import column_risk, normalize_sql_type
from metaloom.operators.batches import pieces
from metaloom.sources.scratch import cut

IDENT = r"(?:\[[^\]]+\]|`[^`]+`|\"[^\"]+\"|\w+)"
NAME = rf"(?:({IDENT})\s*\.\s*)?({IDENT})"
KEPT_VIEW = 2000


def bare(name: Column) -> Column:
    """An identifier without its quoting."""
    return F.regexp_replace(F.trim(name), r"^[\[`\"]|[\]`\"]$", "")


def names(listing: Column) -> Column:
    """The identifiers of a comma-separated list without ASC and DESC, empty ones dropped."""
    return F.filter(F.transform(F.split(listing, ","), lambda x: bare(F.regexp_replace(x, r"(?i)\s+(?:ASC|DESC)\s*$", ""))), lambda x: x != "")


def without_comments(text: Column) -> Column:
    """Block comments turned into a space, line comments dropped, outside quoted text."""
    parts = F.regexp_extract_all(text, F.lit(r"""(?s)'[^']*'|"[^"]*"|`[^`]*`|\[[^\]]*\]|--[^\n]*|/\*.*?\*/|[^'"`\[/-]+|."""), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("--"), "").when(x.startswith("/*") & (F.length(x) > 3), " ").otherwise(x)), "")


def scripts(spark, path: str, pattern: str = "*.sql") -> DataFrame:
    """(source_file, text) of the script files below a folder."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))


_MARK = re.compile(r"""['"`\[]|--|/\*""")
_CLOSE = {"'": "'", '"': '"', "`": "`", "[": "]", "/*": "*/", "--": "\n"}


def masked(text: str) -> tuple[str, str, list[int], list[int]]:
    """(text without comments, the same with quoted text and names as x, places in it and the places in text that they come
    from). An opening mark that nothing closes is a character like any other."""
    clean, mask, here, there, lost = [], [], [0], [0], set()
    size = at = pos = 0
    while m := _MARK.search(text, pos):
        opening, start = m[0], m.start()
        close = _CLOSE[opening]
        end = -1 if opening in lost else text.find(close, m.end())
        if end < 0 and opening != "--":
            lost.add(opening)
            pos = m.end()
            continue
        plain = text[at:start]
        if opening == "--":
            end, inside, hidden = len(text) if end < 0 else end, "", ""
        elif opening == "/*":
            end, inside, hidden = end + 2, " ", " "
        else:
            end += 1
            inside, hidden = text[start:end], opening + "x" * (end - start - 2) + close
        clean += (plain, inside)
        mask += (plain, hidden)
        size += len(plain) + len(inside)
        here.append(size)
        there.append(end)
        at = pos = end
    return "".join([*clean, text[at:]]), "".join([*mask, text[at:]]), here, there


def closing(mask: str, at: int) -> int:
    """Where the parenthesis opened at a place closes; -1 if nowhere."""
    depth = 0
    for m in _PARENTHESES.finditer(mask, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.start()
    return -1


def clauses(mask: str, start: int, end: int) -> list[tuple[int, int]]:
    """The stretches between commas outside parentheses; blank ones dropped."""
    out, depth = [], 0
    for m in _SEPARATORS.finditer(mask, start, end):
        c = m[0]
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append((start, m.start()))
            start = m.end()
    return [(a, b) for a, b in [*out, (start, end)] if mask[a:b].strip()]


_PARENTHESES, _SEPARATORS = re.compile(r"[()]"), re.compile(r"[(),]")
_HEAD = re.compile(r"\b(?:CREATE|ALTER)\s", re.I)
_OR = r"(?:OR\s+(?:ALTER|REPLACE)\s+)?"
_EVENT, _TIMING = r"(?:INSERT|UPDATE|DELETE)(?:\s*(?:,|\bOR\b)\s*(?:INSERT|UPDATE|DELETE))*", r"(?:AFTER|BEFORE|INSTEAD\s+OF|FOR)"
_FORMS = {
    "create": re.compile(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\(", re.I),
    "alter": re.compile(rf"ALTER\s+TABLE\s+(?:ONLY\s+)?{NAME}\s+(?:WITH\s+(?:NO)?CHECK\s+)?ADD\s+", re.I),
    "index": re.compile(rf"CREATE\s+(?:UNIQUE\s+)?(?:CLUSTERED\s+|NONCLUSTERED\s+|FULLTEXT\s+|SPATIAL\s+)?INDEX\s+(?P<own>{IDENT})\s+ON\s+{NAME}\s*\([^)]*\)", re.I),
    "view": re.compile(rf"CREATE\s+{_OR}VIEW\s+{NAME}\s+(?:\([^)]*\)\s+)?AS\s+", re.I),
    "trigger_on": re.compile(rf"CREATE\s+{_OR}TRIGGER\s+(?:{IDENT}\s*\.\s*)?(?P<own>{IDENT})\s+ON\s+{NAME}\s+{_TIMING}\s+{_EVENT}", re.I),
    "trigger_for": re.compile(rf"CREATE\s+{_OR}TRIGGER\s+(?:{IDENT}\s*\.\s*)?(?P<own>{IDENT})\s+{_TIMING}\s+{_EVENT}\s+ON\s+{NAME}", re.I),
    "procedure": re.compile(rf"CREATE\s+{_OR}(?:DEFINER\s*=\s*\S+\s+)?(?P<own>PROC(?:EDURE)?|FUNCTION)\s+{NAME}", re.I),
}
#: Where the statement ends that a form begins.
_STOPS = {"alter": re.compile(r";|\bGO\b|\bALTER\s+TABLE\b|\bCREATE\b", re.I), "view": re.compile(r"\bGO\b|\bCREATE\b", re.I), "procedure": re.compile(r"\bGO\b\s*\n|\bGO\b\s*\Z|\bCREATE\s", re.I)}
_KINDS = ((re.compile(r"^PRIMARY\s+KEY", re.I), "pk"), (re.compile(r"^(?:FULLTEXT\s+|SPATIAL\s+)?(?:KEY|INDEX)\b", re.I), "index"), (re.compile(r"^UNIQUE", re.I), "unique"), (re.compile(r"^FOREIGN\s+KEY", re.I), "fk"), (re.compile(r"^CHECK", re.I), "check"))
_CONSTRAINT = re.compile(rf"^CONSTRAINT\s+({IDENT})\s+", re.I)


def _plain(name: str | None, default: str) -> str:
    return name.strip("[]`\"") if name else default


def _statements(text: str, default_schema: str) -> Iterator[tuple]:
    """(origin, schema, table, line, position, kind, constraint, clause) of each clause of a table and each other statement."""
    clean, mask, here, there = masked(text)
    newlines = [m.start() for m in re.finditer("\n", text)]
    for head in _HEAD.finditer(mask):
        for origin, form in _FORMS.items():
            if m := form.match(mask, head.start()):
                break
        else:
            continue
        at = bisect_right(here, m.start()) - 1
        line = bisect_right(newlines, there[at] + m.start() - here[at]) + 1
        groups = m.re.groups
        named = [clean[slice(*m.span(g))] if m.span(g)[0] >= 0 else None for g in range(1, groups + 1)]
        own = _plain(clean[slice(*m.span("own"))], "") if "own" in m.re.groupindex else ""
        schema, name = [n for g, n in enumerate(named, 1) if g != m.re.groupindex.get("own")][:2]
        where = (origin.split("_")[0], _plain(schema, default_schema), _plain(name, ""), line)
        end = m.end()
        if origin == "create":
            end = closing(mask, m.end() - 1)
        elif origin in _STOPS:
            stop = _STOPS[origin].search(mask, m.end())
            end = stop.start() if stop else len(mask)
        if origin in ("create", "alter"):
            for pos, (a, b) in enumerate(clauses(mask, m.end(), end) if end >= 0 else ()):
                clause = clean[a:b].strip()
                constraint = _CONSTRAINT.match(clause)
                rest = clause[constraint.end() :] if constraint else clause
                kind = next((k for p, k in _KINDS if p.match(rest)), "column")
                yield (*where, pos, kind, _plain(constraint[1], "") if constraint else "", rest)
        else:
            yield (*where, 0, "statement", own, clean[m.end() : end] if origin in _STOPS else clean[m.start() : end])


def statements(texts: DataFrame, default_schema: str = "dbo") -> DataFrame:
    """(source_file, origin, schema, tbl, line, pos, kind, constraint, clause): a row for
    each clause of every CREATE TABLE and ALTER TABLE ... ADD of (source_file, text), and for each index, view, trigger and
    procedure (kind statement, constraint its own name). line is that of the statement in the script."""
    names_ = ["source_file", "origin", "schema", "tbl", "line", "pos", "kind", "constraint", "clause"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in pieces(batches):
            rows = [(f, *r) for f, t in zip(batch.column("source_file").to_pylist(), batch.column("text").to_pylist()) for r in _statements(t or "", default_schema)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names_)

    schema = "source_file string, origin string, schema string, tbl string, line int, pos int, kind string, constraint string, clause string"
    return texts.select("source_file", "text").mapInArrow(run, schema)


def table_clauses(texts: DataFrame, default_schema: str = "dbo") -> DataFrame:
    """The clauses of tables among statements()."""
    return statements(texts, default_schema).where("origin IN ('create', 'alter')")


def _of(df: DataFrame, origin: str) -> DataFrame:
    """The statements of an origin; df holds statements, or scripts to be cut into them."""
    return (df if "clause" in df.columns else statements(df)).where(F.col("origin") == origin)


def constraints(parts: DataFrame) -> DataFrame:
    """(source_file, schema, tbl, kind, name, cols, check) of PRIMARY KEY, UNIQUE and CHECK clauses of both statements."""
    listed = names(F.regexp_extract("clause", r"\(([^)]*)\)", 1))
    check = F.trim(F.regexp_extract("clause", r"(?is)^CHECK\s*\((.*)\)\s*$", 1))
    return parts.where("kind IN ('pk', 'unique', 'check')").select("source_file", "schema", "tbl", "kind", F.col("constraint").alias("name"), F.when(F.col("kind") != "check", F.array_join(listed, ",")).otherwise("").alias("cols"), check.alias("check"))


def key_columns(parts: DataFrame) -> DataFrame:
    """(source_file, schema, tbl, kind, n, p, col) of PRIMARY KEY and UNIQUE clauses; n columns in all."""
    keys = constraints(parts).where("kind <> 'check'").withColumn("c", F.split("cols", ","))
    return keys.select("source_file", "schema", "tbl", "kind", F.size("c").alias("n"), F.posexplode("c").alias("p", "col"))


_TYPE_ENDS = r"(?=\s*(?:\bNOT\s+NULL\b|\bNULL\b|\bDEFAULT\b|\bIDENTITY\b|\bAUTO_INCREMENT\b|\bSERIAL\b|\bCONSTRAINT\b|\bPRIMARY\s+KEY\b|\bUNIQUE\b|\bREFERENCES\b|\bCHECK\b|\bGENERATED\b|\bCOLLATE\b|\bCOMMENT\b|$))"


def columns(parts: DataFrame, indexes: DataFrame | None = None) -> DataFrame:
    """Name, type, length, precision, scale, flags and default of each column of CREATE TABLE; the ordinal
    counts columns only. Keys of table clauses and of ALTER TABLE mark their columns; so do the columns of indexes
    (source_file, schema, tbl, cols) for is_indexed. All go by script, schema and table."""
    c = parts.where("kind = 'column' AND origin = 'create'")
    raw = F.regexp_replace(F.regexp_extract("clause", rf"(?is)^{IDENT}\s+([\[\"`]?\w[\w ]*?[\]\"`]?(?:\s*\(\s*[\w, ]*\))?){_TYPE_ENDS}", 1), r"[\[\]\"`]", "")
    raw = F.trim(F.regexp_replace(raw, r"\s+", " "))
    norm = normalize_sql_type(raw)
    first, second = (F.regexp_extract(raw, r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", k) for k in (1, 2))
    number = lambda x: F.nullif(x, F.lit("")).cast("int")
    has = lambda p: F.col("clause").rlike("(?i)" + p)
    w = Window.partitionBy("source_file", "schema", "tbl").orderBy("pos")
    out = c.select(
        "source_file", "schema", "tbl", F.row_number().over(w).alias("ordinal"), bare(F.regexp_extract("clause", rf"^({IDENT})", 1)).alias("name"), raw.alias("raw_type"), norm.alias("norm_type"),
        F.when(norm.isin("string", "bytes"), number(first)).alias("max_length"), F.when(norm == "decimal", number(first)).alias("precision"), F.when(norm == "decimal", number(second)).alias("scale"),
        (~has(r"\bNOT\s+NULL\b")).alias("is_nullable"), has(r"\bPRIMARY\s+KEY\b").alias("own_pk"), has(r"\bUNIQUE\b").alias("own_unique"),
        has(r"\bIDENTITY\b|\bAUTO_INCREMENT\b|\bSERIAL\b|\bGENERATED\s+(?:ALWAYS|BY\s+DEFAULT)").alias("is_identity"),
        F.trim(F.regexp_extract("clause", r"(?i)\bDEFAULT\s+(\((?:[^()]|\([^()]*\))*\)|'[^']*'|[\w.]+(?:\(\))?)", 1)).alias("default_value"),
    ).withColumns({"ordinal": F.col("ordinal") - 1, "risk": column_risk(F.col("name"))})
    keys = key_columns(parts).groupBy("source_file", "schema", F.lower("tbl").alias("t"), F.col("col").alias("name")).agg(F.bool_or(F.col("kind") == "pk").alias("k_pk"), F.bool_or((F.col("kind") == "unique") & (F.col("n") == 1)).alias("k_unique"))
    out = out.withColumn("t", F.lower("tbl")).join(keys, ["source_file", "schema", "t", "name"], "left")
    yes = lambda *cs: sum((F.coalesce(F.col(x), F.lit(False)).cast("int") for x in cs), F.lit(0)) > 0
    out = out.withColumns({"is_pk": yes("own_pk", "k_pk"), "is_unique": yes("own_unique", "k_unique")})
    if indexes is None:
        indexed = out.withColumn("is_indexed", F.col("is_pk"))
    else:
        listed = indexes.select("source_file", "schema", F.lower("tbl").alias("t"), F.explode(F.split("cols", ",")).alias("name")).distinct().withColumn("i", F.lit(True))
        indexed = out.join(listed, ["source_file", "schema", "t", "name"], "left").withColumn("is_indexed", yes("is_pk", "i"))
    return indexed.drop("t", "own_pk", "own_unique", "k_pk", "k_unique", "i")


def foreign_keys(parts: DataFrame) -> DataFrame:
    """Name, tbl, cols, ref_tbl, ref_cols, on_delete and on_update of clauses, inline REFERENCES and ALTER TABLE."""
    c = parts.where("kind = 'fk' OR (kind = 'column' AND origin = 'create' AND clause RLIKE '(?i)\\\\bREFERENCES\\\\b')")
    inline = bare(F.regexp_extract("clause", rf"^({IDENT})", 1))
    listed = F.array_join(names(F.regexp_extract("clause", r"(?i)FOREIGN\s+KEY\s*\(([^)]*)\)", 1)), ",")
    ref = bare(F.regexp_extract("clause", rf"(?i)REFERENCES\s+{NAME}", 2))
    ref_cols = F.array_join(names(F.regexp_extract("clause", rf"(?i)REFERENCES\s+{NAME}\s*\(([^)]*)\)", 3)), ",")

    def action(event: str) -> Column:
        found = F.upper(F.regexp_replace(F.regexp_extract("clause", rf"(?i)ON\s+{event}\s+(CASCADE|SET\s+NULL|SET\s+DEFAULT|RESTRICT|NO\s+ACTION)", 1), r"\s+", " "))
        return F.when(found == "", "NO ACTION").otherwise(found)

    return c.select("source_file", "schema", "tbl", F.when(F.col("kind") == "fk", F.col("constraint")).otherwise("").alias("name"), F.when(listed == "", inline).otherwise(listed).alias("cols"), ref.alias("ref_tbl"), ref_cols.alias("ref_cols"), action("DELETE").alias("on_delete"), action("UPDATE").alias("on_update"))


def indexes(texts: DataFrame) -> DataFrame:
    """CREATE INDEX: schema, idx, tbl, cols, is_unique."""
    listed = names(F.regexp_extract("clause", r"\(([^)]*)\)\s*$", 1))
    return _of(texts, "index").select("source_file", "schema", F.col("constraint").alias("idx"), "tbl", F.array_join(listed, ",").alias("cols"), F.col("clause").rlike(r"(?i)^CREATE\s+UNIQUE\b").alias("is_unique"))


def sources(body: Column) -> Column:
    """The sorted names after FROM and JOIN, #temporary ones left out."""
    read = F.transform(F.regexp_extract_all(body, F.lit(rf"(?i)\b(?:FROM|JOIN)\s+{NAME}"), F.lit(2)), bare)
    return F.array_sort(F.array_distinct(F.filter(read, lambda x: ~F.upper(x).isin("SELECT", "WHERE"))))


def views(texts: DataFrame) -> DataFrame:
    """Schema, view, definition (KEPT_VIEW characters) and the tables that it reads."""
    text = F.regexp_replace("clause", r"^\s+|\s+$", "")
    return _of(texts, "view").select("source_file", "schema", F.col("tbl").alias("view"), F.substring(text, 1, KEPT_VIEW).alias("definition"), F.array_join(sources(F.col("clause")), ",").alias("sources"))


def triggers(texts: DataFrame) -> DataFrame:
    """Both orders, ON table AFTER event and AFTER event ON table."""
    found = rf"(?i)\s({_TIMING})\s+({_EVENT})(?:\s+ON\s|\s*$)"
    events = F.regexp_replace(F.regexp_extract("clause", found, 2), r"(?i)\s*(?:,|\bOR\b)\s*", ",")
    timing = F.upper(F.regexp_replace(F.regexp_extract("clause", found, 1), r"\s+", " "))
    return _of(texts, "trigger").select("source_file", F.col("constraint").alias("trg"), "tbl", timing.alias("timing"), F.array_join(F.array_sort(F.split(F.upper(events), ",")), ",").alias("events"))


def procedures(texts: DataFrame) -> DataFrame:
    """Schema, name, kind and body of CREATE [OR ALTER | OR REPLACE] PROCEDURE and FUNCTION, up to a line's GO or the
    next CREATE."""
    kind = F.when(F.upper("constraint").startswith("PROC"), "PROCEDURE").otherwise("FUNCTION")
    return _of(texts, "procedure").select("source_file", "schema", F.col("tbl").alias("proc"), kind.alias("proc_type"), F.col("clause").alias("body"))


#: What a body says before its statements: the parentheses that it begins with, or all up to AS, BEGIN or RETURNS outside of
#: quoted text and names (AS may follow a parameter's name). Possessive, as a repeated choice that Java may go back on takes stack.
_LISTED = r"(?is)^\s*\((?:[^()']++|'[^']*+'|\((?:[^()']++|'[^']*+')*+\))*+\)"
_BEFORE = r"""(?is)^(?:'[^']*+'|"[^"]*+"|`[^`]*+`|\[[^\]]*+\]|@\w++\s++AS\b|@\w++|(?!(?:AS|BEGIN|RETURNS)\b)\w++|\W)*+"""


def parameters(procs: DataFrame) -> DataFrame:
    """Parameters that a body declares before its statements, however long: @name type [= default] [OUTPUT], or without
    any of these [IN | OUT | INOUT] name type of the first parentheses. pos, name, raw_type, direction, default_value, after
    the columns of procs but for the body."""
    listed = F.regexp_extract("body", _LISTED, 0)
    head = F.when(listed != "", listed).otherwise(F.regexp_extract("body", _BEFORE, 0))

    def zipped(text: Column, pattern: str, **groups: int) -> Column:
        return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()])

    marked = zipped(head, r"(?i)(@\w+)\s+(\w+(?:\s*\([^)]*\))?)(?:\s*=\s*('[^']*'|[^,\n)\s]+))?\s*(OUTPUT|OUT|READONLY)?\s*(?=[,\n)]|\bAS\b|$)", name=1, type=2, default=3, way=4)
    plain = zipped(F.regexp_extract(listed, r"(?s)^\s*\((.*)\)$", 1), r"(?i)(?:^|,)\s*(?:(IN|OUT|INOUT)\s+)?(\w+)\s+(\w+(?:\s*\([^)]*\))?)\s*()(?=,|$)", way=1, name=2, type=3, default=4)
    order = ("name", "type", "default", "way")
    even = lambda a: F.transform(a, lambda x: F.struct(*[x.getField(n).alias(n) for n in order]))
    own = [c for c in procs.columns if c != "body"]
    rows = procs.select(*own, F.posexplode(F.when(F.size(marked) > 0, even(marked)).otherwise(even(plain))).alias("pos", "x"))
    way = F.upper(F.coalesce("x.way", F.lit("")))
    return rows.select(*own, "pos", F.col("x.name").alias("name"), F.lower("x.type").alias("raw_type"), F.when(way.isin("OUTPUT", "OUT"), "OUT").when(way == "INOUT", "INOUT").otherwise("IN").alias("direction"), F.coalesce("x.default", F.lit("")).alias("default_value"))


def summary(texts: DataFrame) -> DataFrame:
    """(kind, n): how many objects of each kind the scripts define."""
    parts = cut(statements(texts))
    each = [
        parts.where("origin = 'create'").select("source_file", "schema", "tbl").distinct().select(F.lit("table").alias("kind")),
        parts.where("origin = 'create' AND kind = 'column'").select(F.lit("column")),
        constraints(parts).select(F.lit("constraint")),
        foreign_keys(parts).select(F.lit("foreign_key")),
        indexes(parts).select(F.lit("index")),
        views(parts).select(F.lit("view")),
        procedures(parts).select(F.lower("proc_type")),
        triggers(parts).select(F.lit("trigger")),
    ]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
