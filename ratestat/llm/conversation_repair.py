"""Conversation structure repair by weighted CYK parsing of turn intervals.

A good conversation's role initials read ``(s?(ua)+)?``.  The grammar that
repairs a damaged one is in Chomsky normal form: its nonterminals are the
pairs [p, q] of states of that pattern, [p, q] deriving what leads from p to
q, its binary rules [p, r] -> [p, q] [q, r], its terminal rules the edits of
one turn (Keep, Rerole, Delete).  A chart cell of an interval of turns holds,
for each nonterminal, the least (cost, audit); cells are closed under Insert,
which derives from no turn at all, on both sides.  Intervals are combined
bottom-up by length: 1, 2, 4 and so on.  Because the nonterminals of a split
compose whatever its place, every split of an interval gives the same cell,
and one split an interval is enough: n - 1 combinations for n turns.  Two
audits of one cell and cost never are one the other's beginning (the rest
would be inserts, which cost), so the least of a whole is made of the least of
its parts.

The turns are sorted by range partitioning, so one long conversation is dealt
over many tasks.  A task closes the conversations that lie wholly inside it.
Of the others it leaves segments of at most ``SEGMENT`` turns; their cells are
combined 64 at a time, and the conversation's audit is then handed back to its
segments, which write their repaired lines.  Only the final digest, sequential
by its nature, streams a conversation's lines through one task.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratestat.llm.common import prepare, staged
from ratestat.operators.common import join_null_safe

SEGMENT = 1024
SEGMENT_CHARS = 1 << 22
FAN = 64
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
START, SYSTEM, ASKED, ANSWERED = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
ACCEPTED = (START, ANSWERED)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
STATES = range(4)
#: Binary rules [p, r] -> [p, q] [q, r], by the left child.
RULES = [((p, q), (q, r), (p, r)) for p in STATES for q in STATES for r in STATES]


def join_cells(left: dict, right: dict) -> dict:
    """The cell of two neighbouring intervals."""
    out: dict = {}
    for one, two, whole in RULES:
        a, b = left.get(one), right.get(two)
        if a is not None and b is not None:
            found = (a[0] + b[0], a[1] + b[1])
            if whole not in out or found < out[whole]:
                out[whole] = found
    return out


def _insertions() -> dict:
    """The cell of no turn: the insertion closure."""
    one = {(p, p): (0, "") for p in STATES}
    one |= {(p, q): (INSERT, "I") for (p, letter), q in STEPS.items() if letter in NAMES}
    cell = one
    while (longer := join_cells(cell, one)) != cell:
        cell = longer
    return cell


NOTHING = _insertions()


@functools.lru_cache(maxsize=64)
def turn_cell(symbol: str) -> dict:
    """The closed cell of one turn.  ``d`` must be deleted; else the symbol is
    the role's initial (``x``: any other), a capital one of a truncated turn."""
    edits = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != "d":
        more = UNFINISHED if symbol.isupper() else 0
        for (p, letter), q in STEPS.items():
            options = [(more, "K")] if letter == symbol.lower() else []
            options += [(REROLE + more, "R")] if letter in NAMES else []
            for found in options:
                edits[p, q] = min(found, edits.get((p, q), found))
    return join_cells(join_cells(NOTHING, edits), NOTHING)


def chart(symbols: str) -> dict:
    """The cell of an interval of turns, from those of its aligned halves."""
    if len(symbols) <= 8:
        return _short_chart(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return join_cells(chart(symbols[:half]), chart(symbols[half:]))


@functools.lru_cache(maxsize=50_000)
def _short_chart(symbols: str) -> dict:
    if len(symbols) < 2:
        return turn_cell(symbols) if symbols else NOTHING
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return join_cells(_short_chart(symbols[:half]), _short_chart(symbols[half:]))


def best(cell: dict) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(cell[START, q] for q in ACCEPTED if (START, q) in cell)


def _state(done: int, odd: bool) -> int:
    """The state after ``done`` kept or inserted turns; an odd number in all
    begins with a system turn."""
    if done == 0:
        return START
    if odd and done == 1:
        return SYSTEM
    return ASKED if (done - odd) % 2 else ANSWERED


def repaired_lines(audit: str, turns, done: int, odd: bool):
    """``role:text`` of each turn that a piece of an audit leaves; ``turns``
    gives (role, text) for every edit but inserts, and ``done`` turns went
    before."""
    turns = iter(turns)
    for edit in audit:
        turn = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        role = turn[0]
        if edit != "K":
            role = NAMES["a" if _state(done, odd) == ASKED else "u"]
        done += 1
        yield f"{role}:{turn[1]}"


def _odd(audit: str) -> bool:
    return (len(audit) - audit.count("D")) % 2 == 1


_CELLS = pa.list_(pa.struct([("p", pa.int8()), ("q", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))
_CELLS_SQL = "array<struct<p: tinyint, q: tinyint, cost: bigint, audit: string>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_INNER = ["first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal", "n_rows"]


def _pack_cell(cell: dict) -> list:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]


def _unpack_cell(cells: list) -> dict:
    return {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cells}


class _Segment:
    """Neighbouring turns of one conversation, read in order."""

    def __init__(self):
        self.symbols, self.turns, self.chars, self.initials = [], [], 0, ["", ""]
        self.first_turn = self.last_turn = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, text, copies, first, blank, ended):
        if not copies:
            return
        initial = role[:1] or " "
        letter = initial if initial in "sua" else "x"
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        repeats = copies - 1 if first else copies
        if blank:
            self.blank += copies
        else:
            self.duplicate += repeats
            self.truncated += bool(first and not ended)
        sound = first and not blank
        self.symbols.append(("" if not sound else letter if ended else letter.upper()) + "d" * (copies - sound))
        self.illegal += copies - 1 + bool(self.initials[1] and self.initials[1] + letter not in LEGAL)
        self.initials = [self.initials[0] or letter, letter]
        self.turns += [(role, text)] * sound + [("", "")] * (copies - sound)
        self.chars += len(text) if sound else 0

    def full(self, size):
        return len(self.turns) >= size or self.chars >= SEGMENT_CHARS

    def gaps(self):
        return self.last_turn - self.first_turn + 1 - self.n_turns if self.n_turns else 0

    def row(self, conv_id, place, rows_before, whole):
        symbols = "".join(self.symbols)
        cell = chart(symbols)
        out = {"conv_id": conv_id, "task": place[0], "place": place[1], "rows_before": rows_before, "whole": whole,
               "n_rows": len(symbols), "gaps": self.gaps(), "first_turn": self.first_turn, "last_turn": self.last_turn,
               "n_turns": self.n_turns, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
               "illegal": self.illegal, "first_initial": self.initials[0], "last_initial": self.initials[1]}
        if whole:
            cost, audit = best(cell)
            lines = "\n".join(repaired_lines(audit, self.turns, 0, _odd(audit)))
            return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}
        return out | {"cells": _pack_cell(cell), "turns": [{"role": r, "text": t} for r, t in self.turns]}


def _segment_schema(id_type) -> pa.Schema:
    longs = ["task", "place", "rows_before", "n_rows", "gaps", "first_turn", "last_turn", "n_turns", "blank", "duplicate",
             "truncated", "illegal", "cost"]
    return pa.schema([("conv_id", id_type), ("whole", pa.bool_()), *[(c, pa.int64()) for c in longs],
                      *[(c, pa.string()) for c in ("first_initial", "last_initial", "audit", "repaired_sha256")],
                      ("cells", _CELLS), ("turns", _TURNS)])


def _segment_sql(id_sql) -> str:
    longs = "task place rows_before n_rows gaps first_turn last_turn n_turns blank duplicate truncated illegal cost".split()
    texts = "first_initial last_initial audit repaired_sha256".split()
    return (f"conv_id {id_sql}, whole boolean, " + ", ".join(f"{c} bigint" for c in longs) + ", "
            + ", ".join(f"{c} string" for c in texts) + f", cells {_CELLS_SQL}, turns array<struct<role: string, text: string>>")


def _segments(size):
    """Sorted turns to segments.  A conversation at the task's edge may go on
    in the neighbouring task; all others are whole."""
    def emit(batches):
        task = TaskContext.get().partitionId()
        current, segment, place, before, at_edge, schema, out = None, None, 0, 0, True, None, []

        def close(conv_id, last):
            whole = place == 0 and last and not at_edge
            out.append(segment.row(conv_id, (task, place), before, whole))

        for batch in batches:
            if schema is None:
                schema = _segment_schema(batch.schema.field("conv_id").type)
            for row in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "text", "copies", "first", "blank", "ended"))):
                if segment is None or row[0] != current:
                    if segment is not None:
                        close(current, True)
                        at_edge = False
                    current, segment, place, before = row[0], _Segment(), 0, 0
                elif segment.full(size):
                    close(current, False)
                    before, place, segment = before + len(segment.turns), place + 1, _Segment()
                segment.add(*row[1:])
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if segment is not None:
            at_edge = True
            close(current, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return emit


def _combined(table: pa.Table) -> pa.Table:
    """Up to ``FAN`` neighbouring segments to one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    cells = [_unpack_cell(r["cells"]) for r in rows]
    while len(cells) > 1:
        cells = [join_cells(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    out = {"conv_id": rows[0]["conv_id"], "at": rows[0]["at"] // FAN, "cells": _pack_cell(cells[0]),
           "first_turn": None, "last_turn": None, "first_initial": "", "last_initial": ""}
    out |= {c: sum(r[c] for r in rows) for c in ("n_turns", "blank", "duplicate", "truncated", "illegal", "n_rows")}
    for r in rows:
        if r["first_turn"] is not None:
            out["n_turns"] -= out["last_turn"] == r["first_turn"]
            out["first_turn"] = r["first_turn"] if out["first_turn"] is None else out["first_turn"]
            out["last_turn"] = r["last_turn"]
        if r["first_initial"]:
            out["illegal"] += bool(out["last_initial"] and out["last_initial"] + r["first_initial"] not in LEGAL)
            out["first_initial"] = out["first_initial"] or r["first_initial"]
            out["last_initial"] = r["last_initial"]
    return pa.Table.from_pylist([out], table.schema)


def _decided(batches):
    """Whole conversations' cells to their cost, audit and counts."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, audit = best(_unpack_cell(r["cells"]))
            gaps = r["last_turn"] - r["first_turn"] + 1 - r["n_turns"] if r["n_turns"] else 0
            out.append({c: r[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")}
                       | {"gaps": gaps, "cost": cost, "audit": audit})
        schema = pa.schema([batch.schema.field("conv_id"), *[(c, pa.int64()) for c in (*_COUNTS, "cost")],
                            ("audit", pa.string())])
        yield pa.RecordBatch.from_pylist(out, schema)


def _pieces(batches):
    """A conversation's audit cut at its segments' edges; inserts between two
    segments go to the later one, those at the end to the last."""
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("at", pa.int64()), ("piece", pa.string()),
                            ("done", pa.int64()), ("odd", pa.bool_())])
        for r in batch.to_pylist():
            audit, start, done, odd = r["audit"], 0, 0, _odd(r["audit"])
            segments = sorted(r["segments"], key=lambda s: s["at"])
            for i, s in enumerate(segments):
                end, left = start, s["n_rows"]
                while left:
                    left -= audit[end] != "I"
                    end += 1
                end = len(audit) if i + 1 == len(segments) else end
                piece = audit[start:end]
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "at": s["at"], "piece": piece, "done": done,
                                                   "odd": odd}], schema)
                start, done = end, done + len(piece) - piece.count("D")


def _written(batches):
    """Segments with their piece of the audit to their repaired lines."""
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("at", pa.int64()), ("lines", pa.string())])
        out = []
        for r in batch.to_pylist():
            lines = list(repaired_lines(r["piece"], [(t["role"], t["text"]) for t in r["turns"]], r["done"], r["odd"]))
            out.append({"conv_id": r["conv_id"], "at": r["at"], "lines": "\n".join(lines) if lines else None})
        yield pa.RecordBatch.from_pylist(out, schema)


def _digests(batches):
    """Sorted lines to one digest a conversation, read as a stream."""
    current, digest, empty, schema = None, None, True, None
    for batch in batches:
        out = []
        schema = pa.schema([batch.schema.field("conv_id"), ("repaired_sha256", pa.string())])
        for conv_id, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if digest is None or conv_id != current:
                if digest is not None:
                    out.append({"conv_id": current, "repaired_sha256": digest.hexdigest()})
                current, digest, empty = conv_id, hashlib.sha256(), True
            if lines is not None:
                digest.update(("" if empty else "\n").encode() + lines.encode())
                empty = False
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": digest.hexdigest()}], schema)


def _turns(conversations: DataFrame, copies) -> DataFrame:
    """One row for equal rows of a conversation: how often it stands there,
    whether its role and text are met for the first time, blank, ended."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                                copies.cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = staged(rows.withColumn("digest", F.unhex(F.sha2("text", 256))), "turns")
    seen = (rows.where("copies > 0").groupBy("conv_id", "role", "digest")
            .agg(F.min(F.struct("turn")).alias("least"), F.count(F.lit(1)).alias("met")).where("met > 1").drop("met"))
    joined = join_null_safe(rows, seen, ["conv_id", "role", "digest"], "left")
    return joined.select("conv_id", "turn", "role", "digest", "text", "copies",
                         (F.col("least").isNull() | F.col("turn").eqNullSafe(F.col("least.turn"))).alias("first"),
                         (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                         F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"))


def repair_conversations(conversations: DataFrame, copies=None, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), one row per ``conv_id``, from rows with the columns
    conv_id, turn, role and text.

    A conversation's rows are taken by turn, null turns first; rows of one
    turn by role and then by the text's digest.  Each row's first fault
    counts: blank, duplicate (role and text met earlier), truncated.  The
    cheapest edits (Keep 0, Rerole 1, Delete 2, Insert 5, a truncated row left
    in 5 more; blank and duplicate ones must go) make the role initials read
    ``(s?(ua)+)?``; of equal ones the ASCII-least audit is taken.

    ``copies`` (a column, 1 if not given) says how often a row stands in its
    conversation; 0 only names the conversation, which without any row has
    zeros, an empty audit and the empty digest.  A null or empty role has the
    initial of no role, a null role or text is one space, null ``conv_id`` is
    a conversation too, repeated rows are duplicates.  ``turn`` must be a
    whole number; ``conv_id`` keeps its type.  Other columns are not read.  An
    empty table gives none.  An audit is one string, so a conversation may
    have up to 2**31 edits.
    """
    prepare(conversations)
    rows = _turns(conversations, F.lit(1) if copies is None else copies)
    id_sql = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "digest"]
    parsed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
                    .mapInArrow(_segments(segment), _segment_sql(id_sql)), "segments")
    columns = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
    whole = parsed.where("whole").select(*columns)

    # Number the segments of the others and combine their cells.
    parts = parsed.where("not whole").groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("conv_id", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = join_null_safe(parsed.where("not whole"), offset, ["conv_id", "task"]).withColumn(
        "at", F.col("offset") + F.col("place"))
    placed = staged(placed.select("conv_id", "at", *_INNER, "first_initial", "last_initial", "cells", "turns"), "placed")
    cells, most = placed.drop("turns"), placed.agg(F.max("at")).collect()[0][0] or 0
    first = True
    while most or first:
        cells = staged(cells.groupBy("conv_id", F.floor(F.col("at") / FAN).alias("of")).applyInArrow(
            _combined, cells.schema), "combined")
        most, first = most // FAN, False
    decided = staged(cells.mapInArrow(_decided, f"conv_id {id_sql}, " + ", ".join(
        f"{c} long" for c in (*_COUNTS, "cost")) + ", audit string"), "decided")

    # Hand each audit back to its segments.
    plan = placed.groupBy("conv_id").agg(F.collect_list(F.struct("at", "n_rows")).alias("segments"))
    pieces = join_null_safe(plan, decided.select("conv_id", "audit"), ["conv_id"]).mapInArrow(
        _pieces, f"conv_id {id_sql}, at long, piece string, done long, odd boolean")
    lines = join_null_safe(placed.select("conv_id", "at", "turns"), pieces, ["conv_id", "at"]).mapInArrow(
        _written, f"conv_id {id_sql}, at long, lines string")
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(
        _digests, f"conv_id {id_sql}, repaired_sha256 string")
    rest = join_null_safe(decided, digests, ["conv_id"]).select(*columns)
    return whole.unionByName(rest)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with the planted faults and their ``copies``: by crc32 of
    ``conv_id:turn`` (null: one space) modulo 20, 0 drops a row, 1 empties
    its text, 2 removes its ``.!?``, 3 repeats it, 4 sets its role to user."""
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
                                text.alias("text"), copies.cast("long").alias("copies"))


def op12_conversation_repair(spark, sf_dir):
    """Every conversation, damaged and repaired."""
    from ratestat.sources.tables import read_table
    rows = damage(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return repair_conversations(rows, F.col("copies"))


def _sql() -> str:
    """The same repair as a forward pass in SQL: four states a turn, each with
    its least (cost, audit) and the lines so far."""
    def moves(old, keep):
        """Options that lead into each state by the row's edits."""
        options = {q: [f"CASE WHEN {old}[{q + 1}] IS NOT NULL THEN {{'c': {old}[{q + 1}].c + {DELETE}, "
                       f"'a': {old}[{q + 1}].a || 'D', 't': {old}[{q + 1}].t}} END"] for q in STATES}
        for (p, letter), q in STEPS.items():
            was = f"{old}[{p + 1}]"
            line = f"CASE WHEN regexp_matches({was}.a, '[KRI]') THEN {was}.t || chr(10) ELSE '' END"
            options[q].append(f"CASE WHEN NOT {keep}.gone AND {was} IS NOT NULL AND {keep}.i = '{letter}' THEN "
                              f"{{'c': {was}.c + {keep}.more, 'a': {was}.a || 'K', 't': {line} || {keep}.role || ':' || {keep}.text}} END")
            if letter in NAMES:
                options[q].append(f"CASE WHEN NOT {keep}.gone AND {was} IS NOT NULL THEN {{'c': {was}.c + {keep}.more + {REROLE}, "
                                  f"'a': {was}.a || 'R', 't': {line} || '{NAMES[letter]}:' || {keep}.text}} END")
        return "[" + ", ".join(f"list_min(list_filter([{', '.join(options[q])}], lambda o: o IS NOT NULL))" for q in STATES) + "]"

    def inserted(old):
        options = {q: [f"{old}[{q + 1}]"] for q in STATES}
        for (p, letter), q in STEPS.items():
            if letter in NAMES:
                was = f"{old}[{p + 1}]"
                line = f"CASE WHEN regexp_matches({was}.a, '[KRI]') THEN {was}.t || chr(10) ELSE '' END"
                options[q].append(f"CASE WHEN {was} IS NOT NULL THEN {{'c': {was}.c + {INSERT}, 'a': {was}.a || 'I', "
                                  f"'t': {line} || '{NAMES[letter]}:'}} END")
        return "[" + ", ".join(f"list_min(list_filter([{', '.join(options[q])}], lambda o: o IS NOT NULL))" for q in STATES) + "]"

    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda h, b: list_reduce(range(8), lambda y, bit: xor(y >> 1, 3988292384 * (y & 1)), xor(h, b)), 4294967295), 4294967295) % 20 AS kind
  FROM conversations
), x AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, 0 AS copy
  FROM k WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text, 1 FROM k WHERE kind = 3
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM x
), f AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open_end,
         CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS i
  FROM o
), r AS (
  SELECT conv_id, pos, turn, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND open_end AS truncated, i,
         coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au'), false) AS illegal,
         {{'gone': blank OR again, 'more': CASE WHEN open_end THEN {UNFINISHED} ELSE 0 END, 'i': i, 'role': role, 'text': text}} AS e
  FROM f
), start AS (SELECT [{{'c': 0, 'a': '', 't': ''}}, NULL, NULL, NULL] AS v),
one AS (SELECT {inserted('v')} AS v FROM start), two AS (SELECT {inserted('v')} AS v FROM one),
p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, v FROM k, two
  UNION ALL
  SELECT conv_id, pos, {inserted('v')} AS v FROM (
    SELECT conv_id, pos, {inserted('v')} AS v FROM (
      SELECT p.conv_id, r.pos, {moves('p.v', 'r.e')} AS v
      FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = p.pos + 1))
), z AS (
  SELECT conv_id, list_min(list_filter([v[1], v[4]], lambda o: o IS NOT NULL)) AS w
  FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM r GROUP BY conv_id
)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(w.c AS BIGINT) AS cost, w.a AS audit, sha256(w.t) AS repaired_sha256
FROM z LEFT JOIN s ON z.conv_id IS NOT DISTINCT FROM s.conv_id
"""


SQL = _sql()
