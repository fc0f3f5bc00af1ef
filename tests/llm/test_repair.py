import hashlib
import itertools
import random
import re
import zlib

import pytest

from checks import compare
from ledgerloom.llm import queries, repair

FOLDER = "/root/testdata/sf0.001"
SHAPE = re.compile("(s?(ua)+)?").fullmatch
GAP = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(roles, faults):
    """All edits of a conversation by a plain table over (turns read, last roles), least cost and audit by far end first."""
    n, never = len(roles), (10**9, "")
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {(n, q): (0, "") if q in (0, 3) else never for q in range(4)}
    add = lambda cost, letter, rest: (cost + rest[0], letter + rest[1]) if rest != never else never
    for i in range(n, -1, -1):
        if i < n:
            for q in range(4):
                ways = [add(2, "D", best[i + 1, q])]
                if faults[i] != "d":
                    more = 5 if faults[i] == "t" else 0
                    ways += [add(more, "K", best[i + 1, step[q][roles[i]]])] if roles[i] in step[q] else []
                    ways += [add(more + 1, "R", best[i + 1, t]) for r, t in step[q].items() if r != "s"]
                best[i, q] = min(ways)
        for _ in range(3):  # insertions stay at i
            for q in range(4):
                best[i, q] = min(best[i, q], *(add(5, "I", best[i, t]) for r, t in step[q].items() if r != "s"))
    return best[0, 0]


def edited(roles, faults, limit=3):
    """Least (cost, audit) by trying every sequence of edits of up to `limit` insertions."""
    found = []
    for letters in itertools.product("KRD", repeat=len(roles)):
        if any(f == "d" and e != "D" for f, e in zip(faults, letters)):
            continue
        base = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if f == "t" and e != "D" else 0) for f, e in zip(faults, letters))
        for extra in range(limit + 1):
            for spots in itertools.combinations_with_replacement(range(len(roles) + 1), extra):
                audit = "".join("I" * spots.count(i) + (letters[i] if i < len(roles) else "") for i in range(len(roles) + 1))
                slots = [roles[i - audit[:k].count("I")] if e == "K" else "?" for k, e in enumerate(audit) for i in [k] if e != "D"]
                options = itertools.product(*("ua" if s == "?" else s for s in slots))
                if any(SHAPE("".join(o)) for o in options):
                    found.append((base + 5 * extra, audit))
    return min(found)


def by_hand(conv, rows):
    """The result's row for the turns (turn, role, text) of one conversation, in order."""
    kinds, seen, blank, dup, cut = "", set(), 0, 0, 0
    for _, role, text in rows:
        body = text.strip(GAP)
        kinds += "d" if not body or (role, text) in seen else "." if body[-1] in ".!?" else "t"
        blank += not body
        dup += bool(body) and (role, text) in seen
        cut += kinds[-1] == "t"
        seen.add((role, text))
    roles = "".join(r[:1] if r[:1] in ("s", "u", "a") and r else "o" for _, r, _ in rows)
    cost, audit = cheapest(roles, kinds)
    left, i = [], 0
    for e in audit:
        want = "assistant" if left and left[-1][0][:1] == "u" else "user"
        if e in "IR":
            left.append((want, "" if e == "I" else rows[i][2]))
        elif e == "K":
            left.append(rows[i][1:])
        i += e != "I"
    assert SHAPE("".join(r[0] for r, _ in left))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (conv, gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def expected(rows, every):
    out = []
    for conv in every:
        mine = [(t, r, x) for c, t, r, x in rows if c == conv]
        out.append(by_hand(conv, sorted(mine, key=lambda t: (t[0] is not None, t[0] or 0))))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_agenda_by_every_sequence_of_edits():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randint(0, 4)
        roles = "".join(rnd.choice("suao") for _ in range(n))
        faults = "".join(rnd.choice("...dt") for _ in range(n))
        spans = repair.derived(roles, faults)
        assert min(spans[0, q] for q in (0, 3) if (0, q) in spans) == edited(roles, faults) == cheapest(roles, faults)


def test_parts_in_a_chain_by_a_plain_table():
    rnd = random.Random(2)
    for _ in range(400):
        n = rnd.randint(0, 60)
        roles = "".join(rnd.choice(["su", "ua", "a", "u", "uaua", "o"]) for _ in range(n))
        faults = "".join(rnd.choice(rnd.choice(["...dt", ".", "t", "d."])) for _ in roles)
        chain, audit, cost, i = repair.Chain(), "", 0, 0
        while i < len(roles):
            size = rnd.randint(1, 9)
            chain.add(repair.derived(roles[i:i + size], faults[i:i + size]))
            i += size
            for _, piece, c in chain.final():
                audit, cost = audit + piece, cost + c
        for _, piece, c in chain.final(at_end=True):
            audit, cost = audit + piece, cost + c
        assert (cost, audit) == cheapest(roles, faults)


def test_query_by_hand(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_repair(spark, FOLDER)) == expected(damage(rows), {r[0] for r in rows})


def test_query_matches_sql(spark):
    assert compare.compare(queries.op13_repair(spark, FOLDER), compare.connect(FOLDER), queries.oracle_sql()["op13_repair"]) is None


@pytest.mark.parametrize("part", [256, 3])
def test_odd_rows(spark, monkeypatch, part):
    """Also with conversations cut into many parts; a third of all rows in one of them, many without a number."""
    monkeypatch.setattr(repair, "PART", part)
    monkeypatch.setattr(repair, "RANGE_ROWS", 20)
    rnd = random.Random(part)
    texts = ["a.", "b!", "c", "", " \t", "d? \n", None, "\u2003.", "e. x", "f.\x1c"]
    rows = [(c, i, rnd.choice(["user", "assistant"]), rnd.choice(texts) or f"{i}.") for c in range(12) for i in range(rnd.randint(1, 8))]
    rows += [(99, i, ["user", "assistant"][i % 2 if rnd.random() < 0.8 else 0], f"text {i}" + rnd.choice(["." * 1, "?", ""])) for i in range(90)]
    rows += [(None, None, "user", "same.")] * 3 + [(50, None, "system", "x.")] + [(50, 2, None, "y."), (50, 9, "admin", None), (51, -5, "", "z.")]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "conv_id long, turn long, role string, text string, part int, conv string, at double")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    every = {r[0] for r in rows}
    assert got(repair.summaries(frame)) == expected(plain, every)
    assert got(repair.summaries(repair.damaged(frame), frame)) == expected(damage(rows), every)
    assert repair.summaries(frame.limit(0)).collect() == [] and repair.repaired(frame.limit(0)).collect() == []
    left = repair.repaired(frame).where("conv_id = '99'").orderBy("part", "place").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest() == by_hand(99, sorted(r[1:] for r in plain if r[0] == 99))[-1]
    assert repair.damaged(frame).columns == frame.columns


def test_text_ids_and_wide_numbers(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    frame = spark.createDataFrame([("a", low, "user", "x."), ("a", high, "assistant", "y."), ("b", high, "user", "x.")], "conv_id string, turn long, role string, text string")
    assert [r[:2] for r in got(repair.summaries(frame))] == [("a", None), ("b", 0)]
