"""Repair of conversations against a plain search over all edit scripts."""
import hashlib
import random
import re
import zlib

import pytest

from parcelwise.llm import op11_chat_repair as op

SCHEMA = "conv_id long, turn long, role string, text string, row string, n string, body string, costs string"
FOLLOWS = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
STAYS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_turn = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(conv_turn.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def script(rows, kinds):
    """The least (cost, letters) and its rows, for every state, from the last row back."""
    behind = None
    for i in range(len(rows), -1, -1):
        here = []
        for q in range(4):
            found = [(10 ** 9, "", ())]
            if i == len(rows):
                found += [(0, "", ())] * (q in (0, 3))
            else:
                (role, text), late = rows[i], 3 * (kinds[i] == "truncated")
                cost, letters, made = behind[q]
                found.append((cost + 4, "D" + letters, made))
                if kinds[i] not in ("blank", "duplicate"):
                    if (q, role[:1]) in STAYS:
                        cost, letters, made = behind[STAYS[q, role[:1]]]
                        found.append((cost + late, "K" + letters, ((role, text), made)))
                    given, to = FOLLOWS[q]
                    cost, letters, made = behind[to]
                    found.append((cost + 3 + late, "R" + letters, ((given, text), made)))
            here.append(min(found, key=lambda f: f[:2]))
        for _ in range(4):
            for q, (given, to) in FOLLOWS.items():
                cost, letters, made = here[to]
                here[q] = min(here[q], (cost + 3, "I" + letters, ((given, ""), made)), key=lambda f: f[:2])
        behind = here
    return behind[0]


def plain(rows, ids):
    """The contract, row by row."""
    groups = {i: [] for i in ids}
    for conv, *rest in rows:
        groups[conv].append(rest)
    found = {}
    for conv, chat in groups.items():
        chat.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds, seen = [], set()
        for _, role, text in chat:
            bare = text.rstrip(op.WHITE_CHARS)
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in chat if t is not None]
        cost, audit, made = script([r[1:] for r in chat], kinds)
        lines = []
        while made:
            (role, text), made = made
            lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(chat, chat[1:], strict=False))
        found[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def rows_of(df):
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]


def result(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[f] for f in FIGURES) for r in rows}


def chats():
    r, rows = random.Random(7), []
    for conv in range(60):
        for turn in range(r.randrange(1, 14)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "And then", "  \n", "", None, "Is it?\n", "é漢 …", f"Row {turn}.", "long " * 3000 + "end."])
            rows.append((conv, turn * r.choice([1, 1, 2]), role, text))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, "user", "First.")]
    rows += [(70, None, "user", "A."), (70, None, "assistant", "B."), (70, None, None, None)]
    rows += [(71, 5, "user", "Again.")] * 40 + [(72, 3, "system", "Alone.")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in chats()], SCHEMA)


def test_damage(table):
    assert sorted(rows_of(op.damaged(table)), key=repr) == sorted(damage(rows_of(table)), key=repr)


@pytest.mark.parametrize("hurt", [False, True])
def test_equals_plain_search(table, hurt):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows_of(table)]
    rows = damage(rows_of(table)) if hurt else rows
    ids = {r[0] for r in rows}
    assert result(op.repair(op.damaged(table) if hurt else table)) == plain(rows, ids)


def test_one_long_conversation_over_ranges(spark):
    """A conversation that is most of the table and lies in all ranges; a row that is repeated thousands of times."""
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Yes.", "Maybe", f"{t}."])) for t in range(900)]
    rows += [(0, 0, "user", "Hi."), (0, 1, "assistant", "Ho."), (2, 0, "user", "Bye.")] + [(1, 77, "user", "Same.")] * 2500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(op.repair(df)) == plain(rows, {0, 1, 2})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_blocks_and_pieces_equal_plain_search():
    r, t = random.Random(5), op.Tables()
    names = {0: "", 1: "system", 2: "user", 3: "assistant", 4: "tool"}
    for _ in range(3000):
        symbols = bytes(r.choices(range(op.FILL), k=r.randrange(1, 15)))
        cuts = sorted(r.sample(range(len(symbols) + 1), min(3, len(symbols))))
        parts = [p for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True) if (p := symbols[a:b])]
        cost, ahead, marks = op.chain([t.matrix(p) for p in parts])
        letters, state = "", 0
        for part, entry, marked in zip(parts, ahead, marks, strict=True):
            way, state = t.trace(part, entry, marked)[state]
            letters += way
        letters += "I" * (op.ENDS[state] // op.INSERT)
        gone = [s in (op.GONE, op.AGAIN) for s in symbols]
        rows = [("x" if g else names[(s - 1) // 2 + 1], "") for s, g in zip(symbols, gone, strict=True)]
        kinds = ["blank" if g else "truncated" if not s % 2 else "" for s, g in zip(symbols, gone, strict=True)]
        assert (cost, op._public(letters)) == script(rows, kinds)[:2]


def test_query(spark, table, tmp_path):
    for name, df in (("full", table), ("none", table.limit(0))):
        df.write.parquet(str(tmp_path / name / "conversations.parquet"))
    assert op.query(spark, str(tmp_path / "none")).count() == 0
    assert result(op.query(spark, str(tmp_path / "full"))) == plain(damage(rows_of(table)), {r[0] for r in chats()})


def test_whole_sample(spark):
    sf = "/root/testdata/sf0.001"
    rows = rows_of(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert result(op.query(spark, sf)) == plain(damage(rows), {r[0] for r in rows})
