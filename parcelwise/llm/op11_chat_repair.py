"""Repair of conversation structure at the least edit cost, by Four-Russians block tables.

A conversation's rows, by turn, should have roles `(system? (user assistant)+)?`. Each row is kept, given the role that fits or
deleted, and empty rows may be put in anywhere; the cheapest such script is wanted, of equal ones the least by the letters
D, I, K, R. Rows without a word and rows that repeat an earlier one must go, rows that stop without an end mark cost more.

What matters of a row is one of a few symbols. The costs of having reached the four states of the grammar differ by small numbers
only, as a state far behind another can never win, so there are few cost vectors once their least entry is taken off. A table
holds, for each of them and each block of `BLOCK` symbols, the vector behind the block; a conversation is read a block at a time.
The script is found by expanding the blocks from the last to the first, which marks the states on some cheapest path, and by
walking forward along marked states with the least letter.

Sorted rows are dealt by ranges, and a conversation is cut wherever a range or `PIECE` rows end. Each piece gives its least costs
between all states, those of a conversation's pieces are chained (16 numbers a piece), and then each piece traces its own part.
So a conversation of any length is spread over tasks. Texts are moved once, to be hashed in order, as a stream.

Defined results: null role or text counts as one space; a null turn comes first; rows of one turn go by role, the text's first
`HEAD` characters and its SHA-256. A null conv_id is a conversation of its own. Roles go by their first letter, an empty role and
others than s, u, a fit nowhere. Extra columns are not looked at. A conversation without rows left has zeros and empty strings'
values; an empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .common import table

NAME = "op11_chat_repair"
ORACLE_SQL = None  # a least path with ties by its letters; tests compare with a search over all scripts
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE_CHARS = " \t\n\x0b\x0c\r"
#: Symbols in a block of the table, rows in a piece of a conversation, characters of a text that order rows of one turn.
BLOCK = 4
PIECE = 1 << 16
HEAD = 40
#: Symbols of a row: it must go; a further copy of the row before; 1 + 2 * role + truncated; 10 fills a block up.
GONE, AGAIN, FILL = 0, 9, 10
ROLES = "sua"
FAR = 1 << 50
#: States: nothing yet, after the system row, after a user row, after an assistant row. From each, the next row put in or given a
#: role is a user row (state 2), or an assistant row (state 3) after a user row.
NEXT = (2, 2, 3, 2)
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
ENDS = (0, 6, 3, 0)  # the cost of rows put in at the end, by state


def _settle(v: list[int]) -> list[int]:
    """Costs with rows put in, and without states that cannot win: one after "nothing yet" by a system row saves at most a deletion."""
    v = list(v)
    for _ in range(3):
        for q in range(4):
            v[NEXT[q]] = min(v[NEXT[q]], v[q] + INSERT)
    if v[0] > v[3] + DELETE:
        v[0] = FAR
    if v[1] > v[3]:
        v[1] = FAR
    return [min(x, FAR) for x in v]


def _edges(symbol: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of a row's edits; a kept row's letter is its role's, a further copy's deletion is d."""
    found = [("d" if symbol == AGAIN else "D", q, q, DELETE) for q in range(4)]
    if symbol not in (GONE, AGAIN):
        role, late = divmod(symbol - 1, 2)
        found += [(ROLES[role], q, KEPT[q, role], late * TRUNCATED) for q in range(4) if (q, role) in KEPT]
        found += [("R", q, NEXT[q], RE_ROLE + late * TRUNCATED) for q in range(4)]
    return found


class Tables:
    """All cost vectors and their steps by a symbol and by a block."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self._number: dict[tuple[int, ...], int] = {}
        self.start = [self.number(_settle([0 if p == q else FAR for p in range(4)])) for q in range(4)]
        steps, at = [], 0
        while at < len(self.vectors):
            v, row = self.vectors[at], []
            for symbol in range(FILL):
                to = [FAR] * 4
                for _, p, q, cost in _edges(symbol):
                    to[q] = min(to[q], v[p] + cost)
                to = _settle(to)
                row.append((min(to), self.number(to)))
            steps.append([*row, (0, at)])
            at += 1
        one = np.array(steps)
        self.step_cost, self.step_to = one[..., 0].tolist(), one[..., 1].tolist()
        cost, to, size = one[..., 0], one[..., 1], FILL + 1
        for _ in range(BLOCK - 1):
            cost = (cost[:, :, None] + one[..., 0][to]).reshape(len(one), -1)
            to = one[..., 1][to].reshape(len(one), -1)
        self.block_cost, self.block_to = cost.astype(np.int32), to.astype(np.int32)
        self._weights = size ** np.arange(BLOCK - 1, -1, -1)

    def number(self, v: list[int]) -> int:
        """The number of a vector less its least entry."""
        low = min(v)
        key = tuple(FAR if x >= FAR else x - low for x in v)
        if key not in self._number:
            self._number[key] = len(self.vectors)
            self.vectors.append(key)
        return self._number[key]

    def blocks(self, symbols: bytes) -> list[int]:
        filled = np.full(-(-len(symbols) // BLOCK) * BLOCK, FILL, np.int64)
        filled[:len(symbols)] = np.frombuffer(symbols, np.uint8)
        return (filled.reshape(-1, BLOCK) @ self._weights).tolist()

    def through(self, at: int, blocks: list[int]) -> tuple[int, list[int]]:
        """The cost taken off on the way, and the vectors before each block and behind the last."""
        seen, cost = [at], 0
        for b in blocks:
            cost += int(self.block_cost[at, b])
            at = int(self.block_to[at, b])
            seen.append(at)
        return cost, seen

    def matrix(self, symbols: bytes) -> list[int]:
        """Least cost from each state to each (row by row)."""
        blocks, found = self.blocks(symbols), []
        for q in range(4):
            cost, seen = self.through(self.start[q], blocks)
            found += [FAR if x >= FAR else x + cost for x in self.vectors[seen[-1]]]
        return found

    @cache  # noqa: B019 (one table a process)
    def back(self, at: int, symbol: int, marked: int) -> tuple[int, tuple]:
        """Of the states in `marked` behind a row: the states before it that are on a cheapest path, and from each its least way."""
        here, there, off = self.vectors[at], self.vectors[self.step_to[at][symbol]], self.step_cost[at][symbol]
        ways: dict[int, tuple[str, int]] = {}
        for letter, p, q, cost in _edges(symbol):
            if marked >> q & 1 and here[p] < FAR and here[p] + cost == off + there[q]:
                if p not in ways or "DIKR".index(_public(letter)) < "DIKR".index(_public(ways[p][0])):
                    ways[p] = letter, q
        direct = {p for p in ways}
        puts = {}
        for _ in range(3):  # rows put in before it
            for p in range(4):
                q = NEXT[p]
                if here[p] < FAR and here[p] + INSERT == here[q] and (q in ways or q in puts):
                    puts[p] = q

        def way(p: int) -> tuple[str, int]:
            if p in direct and (p not in puts or _public(ways[p][0]) == "D"):
                return ways[p]
            letters, q = way(puts[p])
            return "I" + letters, q

        before = sum(1 << p for p in direct | set(puts))
        return before, tuple(way(p) if before >> p & 1 else None for p in range(4))

    def trace(self, symbols: bytes, entry: list[int], marked: int) -> dict[int, tuple[str, int]]:
        """From each state before the piece on a cheapest path: the letters of its edits and the state behind."""
        blocks = self.blocks(symbols)
        _, seen = self.through(self.number(_settle(entry)), blocks)
        ways: list[tuple] = [()] * len(symbols)
        for b in range(len(blocks) - 1, -1, -1):
            low, at, inside = b * BLOCK, seen[b], []
            for s in symbols[low:low + BLOCK]:
                inside.append((at, s))
                at = self.step_to[at][s]
            for i in range(len(inside) - 1, -1, -1):
                marked, ways[low + i] = self.back(*inside[i], marked)
        found = {}
        for q in range(4):
            if marked >> q & 1:
                letters, at = [], q
                for way in ways:
                    piece, at = way[at]
                    letters.append(piece)
                found[q] = "".join(letters), at
        return found


def _public(letters: str) -> str:
    return letters.translate(_PUBLIC)


_PUBLIC = str.maketrans("dsua", "DKKK")


@cache
def tables() -> Tables:
    return Tables()


def chain(matrices: list[list[int]]) -> tuple[int, list[list[int]], list[int]]:
    """From the matrices of a conversation's pieces: the least cost, the costs before each piece and the states behind it on a cheapest path."""
    ahead = [_settle([0, FAR, FAR, FAR])]
    for m in matrices:
        ahead.append(_settle([min(ahead[-1][p] + m[4 * p + q] for p in range(4)) for q in range(4)]))
    back = [list(ENDS)]
    for m in reversed(matrices):
        back.append([min(m[4 * p + q] + back[-1][q] for q in range(4)) for p in range(4)])
    back.reverse()
    total = min(a + b for a, b in zip(ahead[-1], ENDS, strict=True))
    marks = [sum(1 << q for q in range(4) if a[q] < FAR and a[q] + b[q] == total) for a, b in zip(ahead[1:], back[1:], strict=True)]
    return total, ahead[:-1], marks


def _streamed(df: DataFrame, schema: T.StructType, make: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """make's rows from each partition's rows, in their order, a few at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held, size = to_arrow_schema(schema), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

        for row in make(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(held) >= 4096 or size > 1 << 23:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return df.mapInArrow(run, schema)


def _key(conversations: DataFrame, ddl: str) -> T.StructType:
    """A schema of conv_id, as it is, and the columns of `ddl`."""
    return T.StructType([T.StructField("conv_id", conversations.schema["conv_id"].dataType)] + T.StructType.fromDDL(ddl).fields)


def rows_of(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, dealt by a checksum of conversation and turn."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows_of(conversations).withColumn("_fault", fault).filter("_fault != 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_fault")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_fault", "_copy")


def _body(text: str) -> list[Column]:
    return [F.left(text, F.lit(HEAD)).alias("head"), F.unhex(F.sha2(text, 256)).alias("body")]


_ORDER = ["conv_id", "turn", "role", "head", "body"]


def faulted(rows: DataFrame) -> DataFrame:
    """One row for equal rows (`n` of them), with `fault` of the first: 3 blank, 2 duplicate, 1 truncated, 0 none. Without texts."""
    bare = F.rtrim("text", F.lit(WHITE_CHARS))
    state = F.when(bare == "", 3).when(F.instr(F.lit(".!?"), F.right(bare, F.lit(1))) == 0, 1).otherwise(0)
    equal = rows.select("conv_id", "turn", "role", *_body("text"), state.alias("own")).groupBy(*_ORDER).agg(F.count("*").alias("n"), F.max("own").alias("own"))
    equal = cut_lineage(equal)
    moment = F.struct(F.col("turn").isNotNull(), "turn")
    first = equal.groupBy("conv_id", "role", "body").agg(F.min(moment).alias("first")).alias("f")
    e = equal.alias("e")
    met = e.join(first, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.role") == F.col("f.role")) & (F.col("e.body") == F.col("f.body")))
    seen = ~F.struct(F.col("e.turn").isNotNull(), F.col("e.turn")).eqNullSafe(F.col("f.first"))
    return met.select("e.*", F.when(F.col("own") == 3, 3).when(seen, 2).otherwise(F.col("own")).alias("fault")).drop("own")


def _pieces(ordered: DataFrame) -> DataFrame:
    """Pieces of conversations in each range: symbols, least costs, first and last role letters, illegal neighbours inside."""
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, symbols, first, last, illegal, at, no, began = None, bytearray(), "", "", 0, 0, 0, None

        def piece() -> tuple:
            return (now, began, at, no, bytes(symbols), tables().matrix(bytes(symbols)), first, last, illegal)

        for conv, row, role, n, fault in rows:
            letter = role[:1] or " "
            if symbols and conv != now:
                yield piece()
                symbols, no = bytearray(), no + 1
            now = conv
            code = GONE if fault >= 2 else 1 + 2 * (ROLES.index(letter) if letter in ROLES else 3) + fault
            left = n
            while left:
                if len(symbols) >= PIECE:
                    yield piece()
                    symbols, no = bytearray(), no + 1
                if not symbols:
                    began, at, first, last, illegal = row, row + (left < n), letter, "", 0
                take = min(left, PIECE - len(symbols))
                illegal += take - 1 + (last != "" and last + letter not in ("su", "ua", "au"))
                symbols += bytes([AGAIN if left < n else code]) + bytes([AGAIN]) * (take - 1)
                last, left = letter, left - take
        if symbols:
            yield piece()

    schema = _key(ordered, "began long, at long, no long, symbols binary, costs array<long>, first string, last string, illegal long")
    return _streamed(ordered.select("conv_id", "row", "role", "n", "fault"), schema, make)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its rows) of sorted rows whose first field is the conversation."""
    return groupby(rows, key=lambda r: r[0])


def _bounds(pieces: DataFrame) -> DataFrame:
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in _grouped(rows):
            group = list(group)  # 16 numbers for each PIECE rows
            total, ahead, marks = chain([g[3] for g in group])
            last = ""
            for i, (_, began, no, _, first, end, illegal) in enumerate(group):
                across = last != "" and last + first not in ("su", "ua", "au")
                yield conv, began, no, ahead[i], marks[i], illegal + across, total, i == len(group) - 1
                last = end

    schema = _key(pieces, "began long, no long, entry array<long>, marked long, illegal long, cost long, is_last boolean")
    return _streamed(_by_conversation(pieces.select("conv_id", "began", "no", "costs", "first", "last", "illegal"), "began", "no"), schema, make)


def _traced(pieces: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each piece with its letters from each state that a cheapest path may bring."""
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, began, no, at, symbols, entry, marked, illegal, cost, is_last in rows:
            ways = tables().trace(symbols, entry, marked)
            yield conv, began, no, at, list(ways), [w[0] for w in ways.values()], [w[1] for w in ways.values()], illegal, cost, is_last

    both = pieces.select("began", "no", "conv_id", "at", "symbols").join(bounds.drop("conv_id"), ["began", "no"])
    both = both.select("conv_id", "began", "no", "at", "symbols", "entry", "marked", "illegal", "cost", "is_last")
    schema = _key(pieces, "began long, no long, at long, states array<int>, letters array<string>, ends array<int>, illegal long, cost long, is_last boolean")
    return _streamed(both, schema, make)


def _chosen(traced: DataFrame) -> DataFrame:
    """Each piece with the letters of the script and the state before it."""
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in _grouped(rows):
            state = 0
            for _, began, no, at, states, letters, ends, illegal, cost, is_last in group:
                i = states.index(state)
                end = "I" * (ENDS[ends[i]] // INSERT) if is_last else ""
                yield conv, began, no, at, state, letters[i] + end, illegal, cost
                state = ends[i]

    schema = _key(traced, "began long, no long, at long, state int, letters string, illegal long, cost long")
    return _streamed(_by_conversation(traced, "began", "no"), schema, make)


def _lines(chosen: DataFrame) -> DataFrame:
    """Rows that stay: by row number the role given (null: its own) and the roles of rows put in before, and after the last."""
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in _grouped(rows):
            held, puts = None, ""
            for _, _, _, at, state, letters in group:
                for letter in letters:
                    if letter in "IR":
                        role, state = ("a" if state == 2 else "u"), NEXT[state]
                    elif letter in ROLES:
                        state = ROLES.index(letter) + 1
                    if letter == "I":
                        puts += role
                    elif letter in "Rsua":
                        if held:
                            yield (*held, "")
                        held, puts = (at, puts, role if letter == "R" else None), ""
                    at += letter not in "Id"
            if held:
                yield (*held, puts)

    parts = chosen.select("conv_id", "began", "no", "at", "state", "letters")
    return _streamed(_by_conversation(parts, "began", "no"), T.StructType.fromDDL("row long, before string, given string, after string"), make)


def _hashes(ordered: DataFrame, lines: DataFrame, rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired rows: lines and texts meet in order, as a stream."""
    given = ordered.select(*_ORDER, "row").join(lines, "row").drop("row")
    texts = rows.filter(F.rtrim("text", F.lit(WHITE_CHARS)) != "").select("conv_id", "turn", "role", *_body("text"), "text")
    names = {"u": "user", "a": "assistant"}
    both = given.unionByName(texts, allowMissingColumns=True)
    both = _by_conversation(both, *_ORDER[1:], F.col("text").isNotNull()).select("conv_id", "turn", "role", "body", "text", "before", "given", "after")

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in _grouped(rows):
            hashed, line, begun = hashlib.sha256(), None, False

            def put(role: str, text: str) -> None:
                nonlocal begun
                hashed.update(f"{chr(10) * begun}{role}:{text}".encode("utf-8", "replace"))
                begun = True

            for _, turn, role, body, text, before, given, after in group:
                if text is None:
                    line = (turn, role, body), before, given, after
                elif line and line[0] == (turn, role, body):
                    for r in line[1]:
                        put(names[r], "")
                    put(names.get(line[2], role), text)
                    for r in line[3]:
                        put(names[r], "")
                    line = None
            yield conv, hashed.hexdigest()

    return _streamed(both, _key(rows, "repaired_sha256 string"), make)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text): its faults, the cheapest script and a hash of the repaired rows."""
    rows = rows_of(rows)
    found = faulted(rows)
    ordered = found.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("row", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    of = lambda k: F.sum(F.when(F.col("fault") == k, 1).otherwise(0))
    spare = F.sum(F.when(F.col("fault") != 3, F.col("n") - 1).otherwise(0))  # copies of a row are duplicates
    blank = F.sum(F.when(F.col("fault") == 3, F.col("n")).otherwise(0))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = ordered.groupBy("conv_id").agg(gaps.cast("bigint").alias("gaps"), blank.alias("blank"), (of(2) + spare).alias("duplicate"), of(1).alias("truncated"))
    pieces = cut_lineage(_pieces(ordered))
    chosen = cut_lineage(_chosen(_traced(pieces, _bounds(pieces))))

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in _grouped(rows):
            letters, illegal, cost = [], 0, 0
            for _, _, _, part, bad, cost in group:
                letters.append(_public(part))
                illegal += bad
            yield conv, illegal, cost, "".join(letters)

    scripts = _by_conversation(chosen.select("conv_id", "began", "no", "letters", "illegal", "cost"), "began", "no")
    scripts = _streamed(scripts, _key(rows, "illegal long, cost long, audit string"), make)
    hashes = _hashes(ordered, _lines(chosen), rows)
    return _together([counts, scripts, hashes])


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _together(parts: list[DataFrame]) -> DataFrame:
    """Parts with different columns for the same conversations as one row each; what no part has is zero or empty."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return both.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in FIGURES],
                                       *[F.coalesce(F.max(c), F.lit(v)).alias(c) for c, v in empty.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repaired = repair(damaged(conversations))
    return _together([repaired, conversations.select("conv_id").distinct()])
