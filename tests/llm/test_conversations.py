"""Repaired conversations against a search that holds all cheapest edits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ramus.llm.conversation_repair import FAR, GOAL, conversation_repair, distances, matrix, walk

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def best(rows, faults):
    """Least (cost, audit) and its lines, layer by layer, by the pattern of the roles written so far."""
    legal = re.compile(r"s?(ua)*u?")
    ways = {"": (0, "", [])}

    def better(table, key, way):
        if key not in table or way[:2] < table[key][:2]:
            table[key] = way

    def short(roles):
        # What matters of the roles so far: whether nothing, s alone, or what came last.
        return roles if roles in ("", "s") else roles[-1]

    def inserted(table):
        out = {}
        for key, way in table.items():
            better(out, key, way)
            for _ in range(3):
                own = "u" if key != "u" else "a"
                way = (way[0] + 5, way[1] + "I", way[2] + [{"u": "user:", "a": "assistant:"}[own]])
                key = own
                better(out, key, way)
        return out

    for (role, text), fault in zip(rows, faults):
        table = {}
        for key, (cost, audit, lines) in inserted(ways).items():
            better(table, key, (cost + 2, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            more = 5 if fault == "t" else 0
            for new, letter, c, name in ((role[:1], "K", 0, role), ("u", "R", 1, "user"), ("a", "R", 1, "assistant")):
                whole = {"": "", "s": "s", "u": "u", "a": "ua"}[key] + new
                if new and legal.fullmatch(whole):
                    better(table, short(whole), (cost + c + more, audit + letter, lines + [f"{name}:{text}"]))
        ways = table
    return min(way for key, way in inserted(ways).items() if key in ("", "a"))


def repaired(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(name.encode()) % 20
        convs[conv]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = Counter()
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = best([r[1:] for r in own], faults)
        out[conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    roles = ["user", "assistant"] * 5 + ["system", "User", "tool", "", None, "agent"]
    texts = ["Hi there.", "What?", "no stop", "wait!  \n", "", " \t", None, "é.", "Same again.", "Same again.", "中文", "end.\u0085"]
    out = []
    for conv in [None, *range(150)]:
        order = [None, *range(9)]
        for turn in order[: r.randint(1, 9)]:
            if r.random() < 0.9:
                role = ("user", "assistant")[(turn or 0) % 2] if r.random() < 0.6 else r.choice(roles)
                out.append((conv, turn, role, f"Turn {turn} of {conv}." if r.random() < 0.4 else r.choice(texts)))
    # A hot conversation, rows of one turn, repeated rows, a long text.
    out += [(7, r.randint(0, 300), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"t{k}.") for k in range(700)]
    out += out[40:60] + [out[3]] * 4 + [(8, 50, "user", "long " * 100_000 + "end.")]
    r.shuffle(out)
    return out


def found(df):
    return Counter(tuple(x) for x in df.select(*COLUMNS).collect())


def test_conversation_repair(spark, rows):
    table, want = spark.createDataFrame(rows, SCHEMA).repartition(4), repaired(rows)
    assert found(conversation_repair(table)) == want
    # Pieces of a few rows: matrices, walks from every state and chains give the same.
    for size in (1, 300):
        assert found(conversation_repair(table, piece_bytes=size)) == want
    named = table.withColumnsRenamed({"conv_id": "conv", "role": "a.b"}).withColumn("at", table["turn"]).withColumn("codes", table["text"])
    assert found(conversation_repair(named, conv_col="conv", role_col="a.b")) == want


def test_conversation_repair_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair(empty).count() == 0
    gone = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    nothing = found(conversation_repair(spark.createDataFrame(gone, SCHEMA)))
    assert nothing == Counter((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone)
    ends = [("x", turn + k, "user", f"Hi {k}.") for turn in (-(2**63), 2**63 - 9) for k in range(9)]
    row = conversation_repair(spark.createDataFrame(ends, SCHEMA.replace("conv_id long", "conv_id string"))).first()
    assert row.conv_id == "x" and row.gaps == 2**63 - 1


def test_distances_and_matrices_agree():
    r = random.Random(5)
    for _ in range(60):
        codes = bytes(r.randrange(16) for _ in range(r.randint(1, 12)))
        whole, cut = distances(codes, GOAL), r.randint(0, len(codes))
        behind = distances(codes[cut:], GOAL)[0]
        left = distances(codes[:cut], behind)
        assert left + distances(codes[cut:], GOAL)[1:] == whole
        m = matrix(codes)
        assert whole[0] == [min(m[4 * x + y] + GOAL[y] for y in range(4) if m[4 * x + y] < FAR) for x in range(4)]
        first, state = walk(codes[:cut], left, 0)
        second, last = walk(codes[cut:], distances(codes[cut:], GOAL), state)
        assert (first + second, last) == walk(codes, whole, 0)
