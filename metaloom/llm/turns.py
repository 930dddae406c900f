"""Conversation structure repair: a rank-compressed dynamic program over macro edits.

A conversation is to read `(s?(ua)+)?` by its roles' initials. Each row is kept (0), given the role its place asks for (2)
or deleted (3, which blank and duplicate rows have to be); empty user or assistant turns may be inserted (2 each) anywhere;
rows that stay although truncated cost 1 more. An audit writes the edits K, R, D, I in order; of the cheapest ones the
least by ASCII counts.

**Macro edits.** A run of inserts and the edit of the next row are one macro edit, coded I..ID, I..IK or I..IR. These codes
are prefix-free and put in ASCII order, so audits of the same rows compare like their sequences of codes, and no audit of
one state is that of another. Runs of over two inserts lead back to a state that they left, at a cost. A layer (the rows so
far) keeps four states (nothing yet, system, user, assistant last), each with its cost and the *rank* of its audit among
the layer's; a step compares (cost, rank, code), never strings. Parent pointers give the audit back at the end. Costs
relative to the layer's least, ranks and row kinds have few combinations, so steps are remembered.

**Long conversations.** Rows are put in order over all partitions by range and cut into blocks of BLOCK rows, whatever
their conversations. A conversation within a block is done there. A piece of one that reaches a block's edge gives, for
each state before it, costs and ranks of the states after it; such tables combine associatively, FAN at a time, until one
is left for each conversation; then each piece learns the states it begins and ends with, back down the same way. No task
holds more than BLOCK rows or FAN tables; only the final digest of a conversation over several blocks, which is one
sequential hash, is a stream of its pieces through one task.

Order and awkward rows: turns in order, null first; equal turns by role, then by the text's beginning, then by its hash.
Null roles and texts count as one space, as do a null conv_id and turn in the damage. Equal rows are counted before they
are dealt out and drawn apart again in their place. A null conv_id is a conversation like any other. Conversations of
which no row is left give zeros, an empty audit and the hash of an empty string. Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.shared import cut, workspace

#: Rows of a block and tables combined at a time.
BLOCK_BITS, FAN_BITS = 12, 8
#: Copies of an equal row that travel as one.
COPIES = 512
START, SYSTEM, USER, ASSISTANT = range(4)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NONE = 1 << 40
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What follows a state when a user or assistant turn is due.
DUE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: Codes of macro edits in ASCII order; a code's number is its place.
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: The inserts that end a conversation in each state; nothing at all is a right conversation too.
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
BLANK_CLASS = "[^\\x20\\x09-\\x0D]"

State = tuple  # of four (cost, rank)


def moves(initial: str, forced: bool, truncated: bool) -> list[tuple[int, int, int, int]]:
    """(code, state before, state after, cost) of each macro edit that a row allows."""
    found = []
    for before in range(4):
        state = before
        for inserts in range(3):
            if inserts:
                state = DUE[state]
            cost = INSERT * inserts
            found.append((CODES.index("I" * inserts + "D"), before, state, cost + DELETE))
            if not forced:
                cost += TRUNCATED * truncated
                due = DUE[state]
                found.append((CODES.index("I" * inserts + "R"), before, due, cost + REROLE))
                if initial == "s" and state == START:
                    found.append((CODES.index("I" * inserts + "K"), before, SYSTEM, cost))
                elif initial == ("u" if due == USER else "a"):
                    found.append((CODES.index("I" * inserts + "K"), before, due, cost))
    return found


class Layers:
    """Steps of the program, remembered by (states with their relative costs and ranks, kind of row)."""

    def __init__(self) -> None:
        self.moves: dict = {}
        self.seen: dict = {}

    def step(self, now: State, kind: tuple[str, bool, bool]) -> tuple[State, int, tuple]:
        """(states after a row less their least cost, that cost, for each state its (state before, code))."""
        key = (now, kind)
        out = self.seen.get(key)
        if out is not None:
            return out
        if kind not in self.moves:
            self.moves[kind] = moves(*kind)
        best: list = [None] * 4
        for code, before, after, cost in self.moves[kind]:
            c, rank = now[before]
            if c < NONE:
                found = (c + cost, rank, code, before)
                if best[after] is None or found < best[after]:
                    best[after] = found
        least = min(b[0] for b in best if b)
        order = sorted(b[1:3] for b in best if b)
        after = tuple((b[0] - least, order.index(b[1:3])) if b else (NONE, 0) for b in best)
        out = self.seen[key] = (after, least, tuple((b[3], b[2]) if b else None for b in best))
        return out

    def run(self, rows: list[tuple[str, bool, bool]], begin: int) -> tuple[State, list[tuple]]:
        """(states after all rows, with full costs; parent pointers of each layer), from one state."""
        now, base, back = tuple((0, 0) if s == begin else (NONE, 0) for s in range(4)), 0, []
        for kind in rows:
            now, least, parents = self.step(now, kind)
            base += least
            back.append(parents)
        return tuple((c + base, r) if c < NONE else (c, r) for c, r in now), back


def last_state(states: State) -> tuple[int, int]:
    """(the state with the cheapest end, the whole cost); ties by audit."""
    best = min((c + INSERT * len(ENDS[s]), r, ENDS[s], s) for s, (c, r) in enumerate(states) if c < NONE)
    return best[3], best[0]


def trail(back: list[tuple], end: int) -> list[str]:
    """The macro edits' codes along parent pointers."""
    codes = []
    for parents in reversed(back):
        end, code = parents[end]
        codes.append(CODES[code])
    return codes[::-1]


def written(rows: list[tuple[str, str]], codes: list[str], begin: int, tail: str = "") -> tuple[str, list[str]]:
    """(audit, repaired `role:text` lines) of rows with (role, text)."""
    lines, state = [], begin

    def insert(n: int) -> None:
        nonlocal state
        for _ in range(n):
            state = DUE[state]
            lines.append(ROLE[state] + ":")

    for (role, text), code in zip(rows, codes):
        insert(len(code) - 1)
        if code[-1] == "R":
            state = DUE[state]
            lines.append(f"{ROLE[state]}:{text}")
        elif code[-1] == "K":
            state = SYSTEM if role[0] == "s" and state == START else DUE[state]
            lines.append(f"{role}:{text}")
    insert(len(tail))
    return "".join(codes) + tail, lines


def joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of two tables of (cost, rank), 4 * state before + state after, the table of both in a row. Ranks compare the audits
    from one state before."""
    out = []
    for s in range(4):
        best: list = [None] * 4
        for m in range(4):
            c, r = a[4 * s + m]
            if c < NONE:
                for e in range(4):
                    d, q = b[4 * m + e]
                    if d < NONE and (best[e] is None or (c + d, r, q) < best[e]):
                        best[e] = (c + d, r, q)
        order = sorted(x[1:] for x in best if x)
        out += [(x[0], order.index(x[1:])) if x else (NONE, 0) for x in best]
    return out


def through(begin: int, tables: list[list[tuple[int, int]]], end: int) -> list[tuple[int, int]]:
    """(state before, state after) of each of the tables in a row, on the best way between two states."""
    now, back = [(0, 0) if s == begin else (NONE, 0) for s in range(4)], []
    for t in tables:
        best: list = [None] * 4
        for m, (c, r) in enumerate(now):
            if c < NONE:
                for e in range(4):
                    d, q = t[4 * m + e]
                    if d < NONE and (best[e] is None or (c + d, r, q, m) < best[e]):
                        best[e] = (c + d, r, q, m)
        order = sorted(x[1:3] for x in best if x)
        now = [(x[0], order.index(x[1:3])) if x else (NONE, 0) for x in best]
        back.append([x and x[3] for x in best])
    found = []
    for parents in reversed(back):
        found.append((parents[end], end))
        end = parents[end]
    return found[::-1]


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with the stated damage: conv_id, turn, role, text, copies; dropped rows have no copies, but keep their
    conversation's place."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn with their places over all partitions; a conversation without any row has one with
    gone = true. Equal rows are counted, then drawn apart."""
    here = F.col("copies") > 0
    only = lambda c: F.when(here, F.col(c)).alias(c)
    counted = rows.select("conv_id", only("turn"), only("role"), only("text"), "copies").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(0L, copies - 1) div {COPIES}"))).alias("piece"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("role").isNotNull(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(32)), F.left("text", F.lit(32)), F.xxhash64("role", "text"), F.col("piece")]
    dealt = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys)
    size = F.least(F.lit(COPIES), F.greatest(F.lit(1), F.col("copies") - F.col("piece") * COPIES)).cast("int")
    return dealt.select("conv_id", "turn", "role", "text", F.col("role").isNull().alias("gone"), F.explode(F.array_repeat(F.lit(0), size)).alias("_")).drop("_").withColumn("place", F.monotonically_increasing_id())


PIECE = "conv_id long, block long, costs array<long>, ranks array<int>"


def _pieces(rows: list[dict]) -> Iterator[tuple[int | None, list[dict], bool]]:
    """(conv_id, its rows, whether it is whole for certain) of a block's rows in order."""
    starts = [i for i in range(len(rows)) if not i or rows[i]["conv_id"] != rows[i - 1]["conv_id"]]
    for i, j in zip(starts, [*starts[1:], len(rows)]):
        yield rows[i]["conv_id"], rows[i:j], i > 0 and j < len(rows)


def _block(left: pa.Table, right: pa.Table) -> tuple[list[dict], dict[int | None, tuple[int, int]]]:
    """(a block's rows in order with first and kind, states before and after each piece at its edges)."""
    rows = sorted(left.to_pylist(), key=lambda r: r["place"])
    other = right.to_pylist()
    first = {r["place"] for r in other if r["place"] is not None}
    for r in rows:
        r["first"] = r["place"] in first
        r["kind"] = (r["initial"], r["blank"] or not r["first"], r["truncated"])
    return rows, {r["conv_id"]: (r["begin"], r["finish"]) for r in other if r["place"] is None}


def _edge_tables(left: pa.Table, right: pa.Table) -> pa.Table:
    """The tables of the pieces that reach a block's edges."""
    rows, _ = _block(left, right)
    layers, out = Layers(), []
    for conv, part, whole in _pieces(rows):
        if not whole:
            kinds = [r["kind"] for r in part if not r["gone"]]
            flat = [x for s in range(4) for x in layers.run(kinds, s)[0]]
            out.append({"conv_id": conv, "block": part[0]["block"], "costs": [c for c, _ in flat], "ranks": [r for _, r in flat]})
    return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))]))


def _table(r: dict) -> list[tuple[int, int]]:
    return list(zip(r["costs"], r["ranks"]))


def _combine(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    now = _table(rows[0])
    for r in rows[1:]:
        now = joined(now, _table(r))
    out = {"conv_id": rows[0]["conv_id"], "block": rows[0]["block"] >> FAN_BITS, "costs": [c for c, _ in now], "ranks": [r for _, r in now]}
    return pa.Table.from_pylist([out], group.schema)


WAY = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("begin", pa.int32()), ("finish", pa.int32())])


def _descend(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = sorted(left.to_pylist(), key=lambda r: r["block"])
    if not rows:
        return WAY.empty_table()
    way = right.to_pylist()[0]
    found = through(way["begin"], [_table(r) for r in rows], way["finish"])
    return pa.Table.from_pylist([{"conv_id": r["conv_id"], "block": r["block"], "begin": a, "finish": b} for r, (a, b) in zip(rows, found)], WAY)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        out = [{"conv_id": r["conv_id"], "block": r["block"], "begin": START, "finish": last_state(tuple(_table(r)[:4]))[0]} for r in rows]
        yield from pa.Table.from_pylist(out, WAY).to_batches()


def _ways(edges: DataFrame) -> DataFrame:
    """conv_id, block, begin, finish: the states before and after each piece, by combining tables up and going back down."""
    levels, top = [edges], edges
    while True:
        many = top.groupBy("conv_id").count().where("count > 1").limit(1).count()
        if not many:
            break
        top = cut(top.groupBy("conv_id", F.expr(f"shiftright(block, {FAN_BITS})").alias("up")).applyInArrow(_combine, PIECE), "tables")
        levels.append(top)
    way = "conv_id long, block long, begin int, finish int"
    known = top.mapInArrow(_ends, way)
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.expr(f"shiftright(block, {FAN_BITS})"))
        known = cut(below.groupBy("conv_id", "up").cogroup(known.withColumnRenamed("block", "up").groupBy("conv_id", "up")).applyInArrow(_descend, way), "ways")
    return known


PART = "conv_id long, block long, whole boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, front string, back string, cost long, audit string, lines long, repaired string"
PART_FIELDS = [f.strip().split(" ") for f in PART.split(",")]
LEGAL = {"su", "ua", "au"}


def _repaired(left: pa.Table, right: pa.Table) -> pa.Table:
    """A row for each conversation or piece of one in a block; repaired is a whole one's digest, a piece's text."""
    rows, ways = _block(left, right)
    layers, out = Layers(), []
    for conv, part, whole in _pieces(rows):
        live = [r for r in part if not r["gone"]]
        kinds = [r["kind"] for r in live]
        begin, finish = (START, None) if whole else ways[conv]
        states, back = layers.run(kinds, begin)
        cost = states[finish][0] if finish is not None else 0
        if finish is None:
            finish, cost = last_state(states)
        audit, lines = written([(r["role"], r["text"]) for r in live], trail(back, finish), begin, ENDS[finish] if whole else "")
        turns = [r["turn"] for r in live if r["turn"] is not None]
        fault = lambda r: "blank" if r["blank"] else "duplicate" if not r["first"] else "truncated" if r["truncated"] else ""
        faults = [fault(r) for r in live]
        initials = [r["initial"] for r in live]
        text = "\n".join(lines)
        out.append({
            "conv_id": conv, "block": part[0]["block"], "whole": whole, "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
            "turns": len(set(turns)), **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "front": initials[0] if live else None, "back": initials[-1] if live else None, "cost": cost, "audit": audit, "lines": len(lines),
            "repaired": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if whole else text,
        })
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.Table.from_pylist(out, pa.schema([(n, kinds[t]) for n, t in PART_FIELDS]))


FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, finish int"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by conversation and block, streamed: sums, the audit and the digest of each conversation."""
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64() if t == "long" else pa.string()) for n, t in (f.strip().split(" ") for f in FOUND.split(","))])
    now: dict | None = None

    def done() -> dict:
        end = ENDS[now["finish"]]
        state = now["finish"]
        for _ in end:
            state = DUE[state]
            add(ROLE[state] + ":")
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
        return {"conv_id": now["conv_id"], "gaps": gaps, **{k: now[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": now["cost"] + INSERT * len(end), "audit": "".join(now["audit"]) + end, "repaired_sha256": now["hash"].hexdigest(), "finish": now["finish"]}

    def add(text: str) -> None:
        now["hash"].update((("\n" if now["lines"] else "") + text).encode("utf-8", "surrogatepass"))
        now["lines"] += 1

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != now["conv_id"]:
                if now is not None:
                    out.append(done())
                now = {"conv_id": r["conv_id"], "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "back": None, "cost": 0, "audit": [], "lines": 0, "hash": hashlib.sha256()}
            if r["low"] is not None:
                now["turns"] += r["turns"] - (now["high"] is not None and now["high"] == r["low"])
                now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
            for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                now[k] += r[k]
            if r["front"] is not None:
                now["illegal"] += now["back"] is not None and now["back"] + r["front"] not in LEGAL
                now["back"] = r["back"]
            now["audit"].append(r["audit"])
            now["finish"] = r["finish"]
            if r["lines"]:
                add(r["repaired"])
        if out:
            yield from pa.Table.from_pylist(out, schema).to_batches()
    if now is not None:
        yield from pa.Table.from_pylist([done()], schema).to_batches()


def repair(rows: DataFrame) -> DataFrame:
    """Of rows (conv_id, turn, role, text, copies): a row per conv_id with gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256."""
    block = F.expr(f"shiftright(place, {BLOCK_BITS})").alias("block")
    by_block = lambda df: df.groupBy("block")
    text = F.col("text")
    last = F.regexp_extract("text", f"(?s)({BLANK_CLASS})[\\x20\\x09-\\x0D]*\\z", 1)
    light = [
        "conv_id", "place", block, "gone", F.coalesce(F.left("role", F.lit(1)), F.lit("")).alias("initial"),
        F.coalesce(~text.rlike(BLANK_CLASS), F.lit(True)).alias("blank"), F.coalesce(~last.isin(".", "!", "?"), F.lit(False)).alias("truncated"),
    ]
    with workspace(rows.sparkSession):
        ordered = cut(_ordered(rows), "turns")
        firsts = ordered.where("NOT gone").groupBy("conv_id", "role", F.sha2(text.cast("binary"), 256).alias("digest")).agg(F.min("place").alias("place"))
        none = [F.lit(None).cast(t).alias(n) for n, t in (("conv_id", "long"), ("begin", "int"), ("finish", "int"))]
        firsts = cut(firsts.select("place", block, *none), "firsts")
        edges = cut(by_block(ordered.select(*light)).cogroup(by_block(firsts)).applyInArrow(_edge_tables, PIECE), "tables")
        ways = cut(_ways(edges), "ways", stays=True)
        known = firsts.unionByName(ways.select(F.lit(None).cast("long").alias("place"), "block", "conv_id", "begin", "finish"))
        parts = cut(by_block(ordered.select(*light, "turn", "role", "text")).cogroup(by_block(known)).applyInArrow(_repaired, PART), "repaired", stays=True)
    columns = [c.split(" ")[0] for c in FOUND.split(", ")][:-1]
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    whole = parts.where("whole").withColumns({"gaps": gaps, "repaired_sha256": F.col("repaired")}).select(*columns)
    theirs = ways.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "finish")
    pieces = parts.where("NOT whole").join(theirs, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    cross = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_assemble, FOUND).select(*columns)
    return whole.unionByName(cross)


def repair_report(turns: DataFrame) -> DataFrame:
    """repair() of conversations with the stated damage."""
    return repair(damaged(turns))
