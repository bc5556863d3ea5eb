"""Conversation repair against a full chart over all splits and edge rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from ratestat.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, symbols string, at long, cells string"
VALID = re.compile(r"(s?(ua)+)?")


def all_splits(symbols):
    """The chart with every split of every interval."""
    n = len(symbols)
    cells = {(i, i + 1): repair.turn_cell(s) for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = {}
            for k in range(i + 1, i + length):
                for nonterminal, found in repair.join_cells(cells[i, k], cells[k, i + length]).items():
                    cell[nonterminal] = min(found, cell.get(nonterminal, found))
            cells[i, i + length] = cell
    return cells[0, n] if n else repair.NOTHING


def every_edit(symbols, inserts=2):
    """(cost, audit) by trying all edits with up to ``inserts`` inserts."""
    found = []
    choices = [[("D", "", 2)] if s == "d" else
               [("D", "", 2), ("K", s.lower(), 5 * s.isupper()), ("R", "u", 1 + 5 * s.isupper()), ("R", "a", 1 + 5 * s.isupper())]
               for s in symbols]
    for edits in itertools.product(*choices):
        for k in range(inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(symbols) + 1), k):
                for letters in itertools.product("ua", repeat=k):
                    audit, out = "", ""
                    for i in range(len(symbols) + 1):
                        for p, letter in zip(places, letters):
                            if p == i:
                                audit, out = audit + "I", out + letter
                        if i < len(symbols):
                            audit, out = audit + edits[i][0], out + edits[i][1]
                    if VALID.fullmatch(out):
                        found.append((sum(e[2] for e in edits) + 5 * k, audit))
    return min(found)


def test_chart_equals_all_splits_and_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        symbols = "".join(rng.choice("suaxdSUAX") for _ in range(rng.randint(0, 14)))
        assert repair.chart(symbols) == all_splits(symbols)
        short = symbols[:4]
        assert repair.best(repair.chart(short)) == every_edit(short)


def slow_repair(rows):
    """conv_id -> result, from (conv_id, turn, role, text) rows in any order."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, blank, duplicate, truncated = set(), "", 0, 0, 0
        for _, role, text in mine:
            core = re.sub(r"[\x20\x09-\x0D]", "", text)
            letter = role[0] if role[:1] and role[0] in "sua" else "x"
            if not core:
                blank, letter = blank + 1, "d"
            elif (role, text) in seen:
                duplicate, letter = duplicate + 1, "d"
            elif core[-1] not in ".!?":
                truncated, letter = truncated + 1, letter.upper()
            seen.add((role, text))
            symbols += letter
        initials = [r[:1] or " " for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = repair.best(all_splits(symbols))
        outputs, at, lines = len(audit) - audit.count("D"), 0, []
        roles = (["system"] if outputs % 2 else []) + ["user", "assistant"] * (outputs // 2)
        for edit in audit:
            role, text = ("", "") if edit == "I" else mine[at][1:]
            at += edit != "I"
            if edit != "D":
                lines.append((role if edit == "K" else roles[len(lines)]) + ":" + text)
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "", None, " \t\n", "Done.\x0c ", "naïve… 语言.", f"own {conv} {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [rows[5], rows[5], rows[9]]
    rows += [(99, t // 2, rng.choice(["user", "assistant"]), f"line {t % 40}" + rng.choice([".", ""])) for t in range(120)]
    return rows + [(98, 0, "user", "long " * 30000 + "."), (98, 1, "assistant", "Fine.")]


def results(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("segment,parts", [(1024, 3), (2, 5)])
def test_repair_matches_brute_force(spark, segment, parts):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    got = repair.repair_conversations(frame, segment=segment)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert results(got) == slow_repair(rows)


def test_one_long_conversation_is_dealt_over_tasks(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"turn {t}" + rng.choice([".", ".", ""])) for t in range(900)]
    rows += [(c, 0, "user", "Hi.") for c in range(5)]
    before = repair.FAN
    repair.FAN = 4
    try:
        got = results(repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"),
                                                  segment=8))
    finally:
        repair.FAN = before
    symbols = "".join(r[2][0] if r[3][-1] == "." else r[2][0].upper() for r in rows[:900])
    assert got[7][5:7] == repair.best(repair.chart(symbols))
    assert got[0][5:7] == (2, "D")


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}. End") for c in range(30) for t in range(4)]
    rows += [(c, 0, "user", "Only.") for c in range(100, 160)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = []
    for c, t, role, text in rows:
        show = [" " if v is None else v for v in (c, t, role, text)]
        kind = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else show[2],
                   "" if kind == 1 else re.sub("[.!?]", "", show[3]) if kind == 2 else show[3])
            damaged += [row] * (2 if kind == 3 else 1)
    want = slow_repair(damaged)
    lost = {r[0] for r in rows} - set(want)
    assert lost
    want |= {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost}
    got = repair.damage(frame)
    assert results(repair.repair_conversations(got, got["copies"])) == want


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(nothing).count() == 0
