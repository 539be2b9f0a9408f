"""Damage conversations by a fixed rule, then repair each with the cheapest edits.

A conversation of n rows is a graph of (n + 1) layers of four states: what was written
last is nothing, a system turn, a user turn or an assistant turn. A row's arcs lead
to the next layer (delete, keep, give another role), an insertion's arcs stay in the
layer. Costs are small integers, so Dial's bucket queue settles the distances to the
end from the last layer backwards; then a walk from the start takes at each node the
arc of the least letter that is tight (its cost is the difference of the distances).
From a node each letter leads to one node, so the walk gives the least audit.

Scale: rows are dealt by ranges of (conversation, turn, role, text), so a conversation
with a third of all rows is spread over many tasks, and within a task it is cut into
pieces of bounded size. A conversation that lies in one piece, as nearly all do, is
finished where it is sorted. The others go on in pieces: each piece's distances between
its first and last layer are a 4 x 4 matrix; a conversation's few matrices are folded
from its end (min-plus), which gives the distances at the pieces' borders; the pieces are
walked each by itself, from all four states; the walks are chained. Only the hash of a
whole conversation is sequential: it streams over the pieces in order and holds one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ramus.llm.shared import Safe
from ramus.operators.storage import Tables

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space, and what ends a sentence.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Text of a piece.
PIECE_BYTES = 4 << 20
# Faults and kinds of roles, packed as 4 * kind + fault.
NONE, BLANK, DUPLICATE, TRUNC = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
# States: nothing written, system, user or assistant written last.
START, S, U, A = range(4)
#: The state after what has to come next: a user's turn, after that an assistant's.
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
FAR = 1 << 60
#: Distances to the end from the states behind the last row, and the insertions that they stand for.
GOAL, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
STATS = ("blank", "duplicate", "truncated", "illegal")


def _kept(state: int, kind: int) -> int | None:
    """The state after a row that keeps its role, if it may stand there."""
    if kind == SYSTEM:
        return S if state == START else None
    if kind in (USER, ASSISTANT):
        after = U if kind == USER else A
        return after if NEXT[state] == after else None
    return None


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """Letter, state before, state after and cost of a row's edits."""
    kind, fault = divmod(code, 4)
    out = [("D", x, x, DELETE) for x in range(4)]
    if fault in (NONE, TRUNC):
        more = TRUNCATED if fault == TRUNC else 0
        out += [("K", x, y, KEEP + more) for x in range(4) if (y := _kept(x, kind)) is not None]
        out += [("R", x, NEXT[x], REROLE + more) for x in range(4)]
    return out


#: For each code: of each state after, (state before, cost); of each state before, the letters in order with (letter, state after, cost).
_INTO = [[[(x, c) for _, x, y, c in _arcs(code) if y == to] for to in range(4)] for code in range(16)]
_FROM = [[sorted((letter, y, c) for letter, x, y, c in _arcs(code) if x == of) for of in range(4)] for code in range(16)]
_INSERTED = [[x for x in range(4) if NEXT[x] == to] for to in range(4)]
#: Buckets of the queue: more than the largest cost and the largest gap between distances at the last layer.
BUCKETS = 32


def distances(codes: bytes, end: Iterable[int]) -> list[list[int]]:
    """Distances to the end from each layer's states, by Dial's buckets. ``end``: those of the last layer."""
    n = len(codes)
    found = [[FAR] * 4 for _ in range(n + 1)]
    found[n] = list(end)
    least = min(found[n])
    buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(BUCKETS)]
    waiting = 0
    for state, d in enumerate(found[n]):
        if d < FAR:
            if d - least >= BUCKETS - 8:
                raise ValueError("distances at the last layer lie too far apart")
            buckets[d % BUCKETS].append((d, n, state))
            waiting += 1
    now = least
    while waiting:
        here = buckets[now % BUCKETS]
        while here:
            d, i, state = here.pop()
            waiting -= 1
            if d > found[i][state]:
                continue
            if i:
                row = found[i - 1]
                for x, c in _INTO[codes[i - 1]][state]:
                    if d + c < row[x]:
                        row[x] = d + c
                        buckets[(d + c) % BUCKETS].append((d + c, i - 1, x))
                        waiting += 1
            if i < n:
                row = found[i]
                for x in _INSERTED[state]:
                    if d + INSERT < row[x]:
                        row[x] = d + INSERT
                        buckets[(d + INSERT) % BUCKETS].append((d + INSERT, i, x))
                        waiting += 1
        now += 1
    return found


def walk(codes: bytes, found: list[list[int]], state: int) -> tuple[str, int]:
    """The least letters along tight arcs from ``state`` before the first row, and the state behind the last."""
    out, i = [], 0
    while i < len(codes):
        d = found[i][state]
        inserted = d == INSERT + found[i][NEXT[state]]
        for letter, y, c in _FROM[codes[i]][state]:
            if letter > "I" and inserted:
                out.append("I")
                state = NEXT[state]
                break
            if d == c + found[i + 1][y]:
                out.append(letter)
                i, state = i + 1, y
                break
        else:
            if not inserted:
                raise AssertionError("no tight arc")
            out.append("I")
            state = NEXT[state]
    return "".join(out), state


def matrix(codes: bytes) -> list[int]:
    """Distances from each state before the first row to each behind the last, row by row."""
    columns = [distances(codes, [0 if y == to else FAR for y in range(4)])[0] for to in range(4)]
    return [columns[y][x] for x in range(4) for y in range(4)]


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> Iterator[str]:
    """The lines that are left or put in, and the states along the way."""
    row = 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield f"{ROLE[state]}:"
            continue
        if letter == "R":
            state = NEXT[state]
            yield f"{ROLE[state]}:{texts[row]}"
        elif letter == "K":
            state = {"s": S, "u": U, "a": A}[roles[row][0]]
            yield f"{roles[row]}:{texts[row]}"
        row += 1


class _Hash:
    """SHA-256 of lines joined by line feeds."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, lines: Iterable[str]) -> None:
        for line in lines:
            self.sha.update(("\n" + line if self.any else line).encode())
            self.any = True


class _Piece:
    def __init__(self, conv: object, at: int):
        self.conv, self.at, self.size = conv, at, 0
        self.codes, self.turns, self.roles, self.texts = bytearray(), [], [], []

    def stats(self) -> dict:
        faults, kinds = [c & 3 for c in self.codes], [c >> 2 for c in self.codes]
        told = [t for t in self.turns if t is not None]
        return {
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNC), "illegal": sum(p not in LEGAL for p in zip(kinds, kinds[1:])),
            "first_kind": kinds[0], "last_kind": kinds[-1], "lo": min(told, default=None), "hi": max(told, default=None), "n_turns": len(set(told)),
        }


_LIGHT = "at long, whole boolean, blank long, duplicate long, truncated long, illegal long, first_kind int, last_kind int, lo long, hi long, n_turns long"
_PIECES = _LIGHT + ", codes binary, matrix array<long>, roles array<string>, texts array<string>, cost long, audit string, repaired_sha256 string"


def _table(conv: DataType, rest: str) -> StructType:
    return StructType([StructField("conv", conv), *StructType.fromDDL(rest).fields])


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "")
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            yield from batch.slice(a, 1024).to_pylist()


def _cut(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[dict]:
    """The sorted rows of a task as pieces; those that are whole conversations are repaired at once."""
    from pyspark import TaskContext

    base, row_no = TaskContext.get().partitionId() << 33, 0
    piece, before, first, inner = None, None, True, False

    def out(last: bool) -> dict:
        row = {"conv": piece.conv, "at": piece.at, "whole": inner and not last, **piece.stats()}
        codes = bytes(piece.codes)
        if row["whole"]:
            found = distances(codes, GOAL)
            audit, state = walk(codes, found, START)
            audit += TAIL[state]
            sha = _Hash()
            sha.add(repaired(piece.roles, piece.texts, audit, START))
            return row | {"cost": found[0][START], "audit": audit, "repaired_sha256": sha.sha.hexdigest()}
        return row | {"codes": codes, "matrix": matrix(codes), "roles": piece.roles, "texts": piece.texts}

    for row in _rows(batches):
        conv, code = row["conv"], row["code"]
        # Rows that are alike in all are neighbours and in one task; those after the first are duplicates.
        own = (conv, row["turn"], row["role"], row["text"])
        if own == before and code & 3 != BLANK:
            code = code & ~3 | DUPLICATE
        new = piece is None or conv != piece.conv
        if new or piece.size >= piece_bytes:
            if piece is not None:
                if not new:
                    inner = False
                yield out(False)
                first = False
            # Begun inside the task's range: no other task has an earlier part.
            inner = new and not first
            piece = _Piece(conv, base + row_no)
        piece.codes.append(code)
        piece.turns.append(row["turn"])
        piece.roles.append(row["role"])
        piece.texts.append(row["text"])
        piece.size += len(row["text"]) + 64
        before, row_no = own, row_no + 1
    if piece is not None:
        yield out(True)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    return groupby(_rows(batches), key=lambda r: r["conv"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """From the matrices of a conversation's pieces: the distances behind each piece, and the sums of the conversation."""
    for conv, pieces in _by_conversation(batches):
        pieces = list(pieces)
        behind, ends = list(GOAL), []
        for p in reversed(pieces):
            ends.append(behind)
            m = p["matrix"]
            behind = [min(min(m[4 * x + y] + behind[y] for y in range(4)), FAR) for x in range(4)]
        total = {k: sum(p[k] for p in pieces) for k in STATS}
        total["illegal"] += sum((p["last_kind"], q["first_kind"]) not in LEGAL for p, q in zip(pieces, pieces[1:]))
        lo, hi = (min((p["lo"] for p in pieces if p["lo"] is not None), default=None), max((p["hi"] for p in pieces if p["hi"] is not None), default=None))
        told = [p for p in pieces if p["lo"] is not None]
        # Turns ascend, so pieces share one turn at most.
        turns = sum(p["n_turns"] for p in told) - sum(p["hi"] == q["lo"] for p, q in zip(told, told[1:]))
        for k, (p, end) in enumerate(zip(pieces, reversed(ends))):
            yield {"conv": conv, "at": p["at"], "behind": end, "first": k == 0, "last": k == len(pieces) - 1} | (total | {"lo": lo, "hi": hi, "n_turns": turns, "cost": behind[START]} if k == 0 else {})


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each piece's letters from each state in which it may begin, and the state behind it."""
    for p in _rows(batches):
        found = distances(p["codes"], p["behind"])
        ways = [walk(p["codes"], found, x) if x == START or not p["first"] else ("", x) for x in range(4)]
        yield {"conv": p["conv"], "at": p["at"], "last": p["last"], "ways": [w[0] for w in ways], "ends": [w[1] for w in ways]}


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A conversation's hash and audit: letters and texts of its pieces arrive in turn."""
    for conv, rows in _by_conversation(batches):
        state, begun, sha, audit, letters = START, START, _Hash(), [], ""
        for r in rows:
            if r["ways"] is not None:
                begun, letters, state = state, r["ways"][state], r["ends"][state]
                letters += TAIL[state] if r["last"] else ""
                audit.append(letters)
            else:
                sha.add(repaired(r["roles"], r["texts"], letters, begun))
        yield {"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.sha.hexdigest()}


def damaged(rows: DataFrame, share: int = 20) -> DataFrame:
    """conv, turn, role, text after the damage that the crc32 of conversation and turn decides."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(at("conv"), F.lit(":"), at("turn")).cast("binary")) % share
    marked = rows.select("conv", "turn", at("role").alias("role"), at("text").alias("text"), k.alias("_k")).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role"))
    hurt = marked.select("conv", "turn", role.alias("role"), text.alias("text"), "_k")
    return hurt.withColumn("_n", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv", "turn", "role", "text")


def _code() -> Column:
    """4 * kind of role + first fault; duplicates of one turn are told later."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    kind = F.lit(OTHER)
    for initial, k in (("s", SYSTEM), ("u", USER), ("a", ASSISTANT)):
        kind = F.when(F.substring("role", 1, 1) == initial, F.lit(k)).otherwise(kind)
    again = F.col("turn").isNotNull() & F.coalesce(F.col("_null") | (F.col("turn") > F.col("_least")), F.lit(False))
    fault = F.when(last == "", F.lit(BLANK)).when(again, F.lit(DUPLICATE)).when(~last.isin(*STOPS), F.lit(TRUNC)).otherwise(F.lit(NONE))
    return (kind * 4 + fault).cast("int")


def conversation_repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", share: int = 20, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per conversation of the input: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Null roles and texts read as one space; a null turn or conversation prints as one space
    where damage is decided, null turns come first, and a null conversation is one like
    the others. Rows of one turn go by role and text (after the damage), so any order of
    the input gives the same result; rows alike in all are duplicates but for the first.
    A role other than those that begin with s, u or a (an empty one too) can't be kept.
    A conversation without rows after the damage has zeros, an empty audit and the empty
    string's hash. An empty table gives no rows. Other columns aren't read and may have any
    names. Texts and conversations of any length are taken whole; ``piece_bytes`` bounds
    what a task holds of a conversation and doesn't change results. Gaps beyond 64 bits
    count as the largest long.
    """
    t = Safe(conversations)
    rows = t.rows.select(t.col(conv_col).alias("conv"), t.col(turn_col).cast("long").alias("turn"), t.col(role_col).cast("string").alias("role"), t.col(text_col).cast("string").alias("text"))
    conv = rows.schema["conv"].dataType
    store = Tables(conversations.sparkSession, "conversations")
    hurt = damaged(rows, share)
    # Only roles and texts that a conversation has more than once, with their first turn.
    first = hurt.groupBy("conv", "role", "text").agg(F.count("*").alias("_n"), F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_least")).filter("_n > 1")
    first = first.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("text").alias("_text"), "_null", "_least")
    same = hurt["conv"].eqNullSafe(first["_conv"]) & (hurt["role"] == first["_role"]) & (hurt["text"] == first["_text"])
    coded = hurt.join(first, same, "left").select("conv", "turn", "role", "text", _code().alias("code"))
    order = ["conv", "turn", "role", "text"]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    arrow = lambda schema: _arrow(schema)
    schema = _table(conv, _PIECES)
    pieces = store.put("pieces", dealt.mapInArrow(lambda b, s=arrow(schema): _batches(_cut(b, piece_bytes), s), schema))
    done = pieces.filter("whole")
    parts = pieces.filter("NOT whole")
    in_order = lambda df, *by: df.repartition("conv").sortWithinPartitions("conv", *by)
    folds = _table(conv, "at long, behind array<long>, first boolean, last boolean, blank long, duplicate long, truncated long, illegal long, lo long, hi long, n_turns long, cost long")
    light = parts.select("conv", "at", "matrix", "blank", "duplicate", "truncated", "illegal", "first_kind", "last_kind", "lo", "hi", "n_turns")
    folded = store.put("folded", in_order(light, "at").mapInArrow(lambda b, s=arrow(folds): _batches(_folded(b), s), folds))
    # ``at`` tells pieces apart.
    borders = parts.select("conv", "at", "codes").join(folded.select("at", "behind", "first", "last"), "at")
    ways = _table(conv, "at long, last boolean, ways array<string>, ends array<int>")
    walked = borders.mapInArrow(lambda b, s=arrow(ways): _batches(_walked(b), s), ways)
    none = lambda **c: {k: F.lit(None).cast(v) for k, v in c.items()}
    letters = walked.withColumns({"step": F.lit(0), **none(roles="array<string>", texts="array<string>")})
    lines = parts.select("conv", "at", "roles", "texts").withColumns({"step": F.lit(1), **none(last="boolean", ways="array<string>", ends="array<int>")})
    chains = _table(conv, "audit string, repaired_sha256 string")
    both = in_order(letters.unionByName(lines), "at", "step")
    chained = both.mapInArrow(lambda b, s=arrow(chains): _batches(_chained(b), s), chains)
    stats = [*STATS, "lo", "hi", "n_turns", "cost"]
    sums = folded.filter("first").select(F.col("conv").alias("_c"), *stats)
    joined = chained.join(sums, chained["conv"].eqNullSafe(sums["_c"])).select("conv", *stats, "audit", "repaired_sha256")
    found = done.select("conv", *stats, "audit", "repaired_sha256").unionByName(joined).withColumnRenamed("conv", "_conv")
    every = rows.select("conv").distinct()
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gap, most = wide("hi") - wide("lo") + 1 - wide("n_turns"), (1 << 63) - 1
    gaps = F.when(gap >= F.lit(most), F.lit(most)).otherwise(gap.cast("long"))
    zero = lambda c, name: F.coalesce(c, F.lit(0).cast("long")).alias(name)
    text = lambda c, other: F.coalesce(c, F.lit(other)).alias(c)
    out = every.join(found, every["conv"].eqNullSafe(found["_conv"]), "left")
    return out.select(F.col("conv").alias("conv_id"), zero(gaps, "gaps"), *(zero(F.col(c), c) for c in (*STATS, "cost")), text("audit", ""), text("repaired_sha256", hashlib.sha256(b"").hexdigest()))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
