"""Conversation repair: the cheapest edits that turn each conversation into turns of the shape (system? (user assistant)+)?.

Edits: keep a turn (0, and 5 more if its text is cut off), give it another role (1, and 5 more if cut off), delete it
(2; blank and repeated turns must go), insert an empty turn of user or assistant (5).

Method: Knuth's lightest derivation. An item [p, i, q] says that the first i turns of a part can be edited so that the
reader goes from state p to state q; edits are deductions from one item to the next, and two parts side by side are a
deduction with two premises: [p, part, r] and [r, next part, q] give [p, both, q]. An agenda pops items by (cost,
audit), the audit being the initials of the edits. Both grow with every deduction, and of two audits of one item with
one cost neither begins the other, as their turns cost the same letter by letter; so what is popped first is final.

Hot conversations: turns are range-partitioned by (conversation, order, row) and cut into parts of at most `PART`
turns, so one conversation may cover many tasks. Parts are derived on their own, each for all states. A chain then
joins the parts of a conversation in order, with four survivors at most and without any text; a survivor that cannot
win any more is dropped, and what all survivors share is final and leaves. Texts are edited part by part. Only the
digest of a conversation of several parts passes through one task, as a stream, since SHA-256 has to read in order.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import Workspace, unused, worked_out

PART = 256
RANGE_ROWS = 100_000
RELABEL, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A conversation may end in 0 or 3.
_READS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_ENDS = (0, 3)
# (a, b): from state a, any turns to come cost at most so much more than from state b.
_BEHIND = {(3, 1): 0, (3, 0): 2, (2, 3): 5, (3, 2): 5, (2, 1): 5, (2, 0): 7, (1, 3): 10, (1, 2): 5, (0, 3): 0, (0, 1): 0, (0, 2): 5}
_KEY = ["conv", "nameless"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _next(state: int) -> int:
    """The state after a turn of the role that alternation asks for."""
    return 3 if state == 2 else 2


@lru_cache(20_000)
def derived(roles: str, faults: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of the lightest derivation from each state to each state that can be reached.

    roles has s, u, a or o (other) for each turn; faults has d (must go), t (cut off) or a full stop.
    """
    n, done = len(roles), {}
    agenda: list[tuple[int, str, int, int, int]] = [(0, "", p, 0, p) for p in range(4)]
    while agenda:
        cost, audit, p, i, q = heappop(agenda)
        if (p, i, q) in done:
            continue
        done[p, i, q] = cost, audit
        heappush(agenda, (cost + INSERT, audit + "I", p, i, _next(q)))
        if i == n:
            continue
        heappush(agenda, (cost + DELETE, audit + "D", p, i + 1, q))
        if faults[i] != "d":
            left = cost + (CUT_OFF if faults[i] == "t" else 0)
            heappush(agenda, (left + RELABEL, audit + "R", p, i + 1, _next(q)))
            if roles[i] in _READS[q]:
                heappush(agenda, (left, audit + "K", p, i + 1, _READS[q][roles[i]]))
    return {(p, q): best for (p, i, q), best in done.items() if i == n}


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(role, text, edit) of the turns that the edits leave, read from `state` on."""
    out, i = [], 0
    for edit in audit:
        if edit in "IR":
            out.append(("assistant" if state == 2 else "user", "" if edit == "I" else texts[i], edit))
            state = _next(state)
        elif edit == "K":
            out.append((roles[i], texts[i], edit))
            state = _READS[state][_class_of(roles[i])]
        i += edit != "I"
    return out


def _class_of(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


class Chain:
    """Joins the parts of one conversation in order and gives back the edits of each part as soon as they are final."""

    def __init__(self):
        self.best: dict[int, tuple[int, list]] = {0: (0, [])}  # state -> cost, edits of parts not yet final

    def add(self, spans: dict[tuple[int, int], tuple[int, str]]) -> None:
        new: dict[int, tuple[int, str, list]] = {}
        for (r, q), (cost, audit) in spans.items():
            if r not in self.best:
                continue
            before, edits = self.best[r]
            if q in new and new[q][0] < before + cost:
                continue
            whole = "".join(e[1] for e in edits) + audit
            if q not in new or (before + cost, whole) < new[q][:2]:
                new[q] = before + cost, whole, [*edits, (r, audit, cost)]
        costs = {q: c for q, (c, _, _) in new.items()}
        self.best = {q: (c, edits) for q, (c, _, edits) in new.items()
                     if not any(o + _BEHIND.get((b, q), 1 << 40) < c for b, o in costs.items())}

    def final(self, at_end: bool = False) -> list[tuple[int, str, int]]:
        """(state before, audit, cost) of the parts that are final now."""
        if at_end:
            ends = [(c, "".join(e[1] for e in edits), edits) for q, (c, edits) in self.best.items() if q in _ENDS]
            return min(ends)[2]
        paths = [edits for _, edits in self.best.values()]
        n = 0
        while all(n < len(e) for e in paths) and all(e[n] == paths[0][n] for e in paths):
            n += 1
        out = paths[0][:n]
        self.best = {q: (c, edits[n:]) for q, (c, edits) in self.best.items()}
        return out


def damaged(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns with faults put in by crc32(`conv_id:turn`) % 20: the contract's test of this operator.

    0 drops the row, 1 empties its text, 2 removes `.`, `!` and `?` from it, 3 repeats the row, 4 makes its role user.
    A null id, number, role or text counts as one space; role and text come back so. Other columns stay.
    """
    code, times = unused(turns, "_code"), unused(turns, "_times")
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = F.concat(held(key), F.lit(":"), held(turn)).cast("binary")
    marked = turns.withColumn(code, F.pmod(F.crc32(named), F.lit(20))).where(F.col(code) != 0)
    return marked.withColumns({
        role: F.when(F.col(code) == 4, F.lit("user")).otherwise(held(role)),
        text: F.when(F.col(code) == 1, F.lit("")).when(F.col(code) == 2, F.regexp_replace(held(text), "[.!?]", "")).otherwise(held(text)),
        times: F.explode(F.when(F.col(code) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))}).drop(code, times)


def _identity(key: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("conv"), F.col(key).isNull().alias("nameless")]


def _ordered(work: Workspace, turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, nameless, turn, role, text, at and part: places that ascend in each conversation, and parts of them."""
    rows = turns.select(*_identity(key), F.col(turn).cast("long").alias("turn"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    # Rows that agree in all of this are equal; the row number spreads them over ranges if they are very many.
    order = [*_KEY, F.asc_nulls_first("turn"), "role", F.xxhash64("text"), "row"]
    rows = work.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    kept = work.keep(ranged.withColumn("at", F.monotonically_increasing_id()).drop("row"), "ordered")
    work.drop("rows")
    return kept.withColumn("part", F.floor(F.col("at") / PART))


def _faults(rows: DataFrame) -> DataFrame:
    """Each row without its text: class of the role, and the first fault: blank, duplicate, truncated or null."""
    prints = [F.xxhash64("role", "text").alias("f1"), F.xxhash64(F.lit(1), "text", "role").alias("f2")]
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    first = F.substring("role", 1, 1)
    narrow = rows.select(*_KEY, "turn", "at", "part", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("class"),
                         F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("seen"), *prints)
    same = [*_KEY, "f1", "f2"]
    again = narrow.groupBy(*same).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("seen") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("seen"))
    return narrow.join(again, same, "left").select(*_KEY, "turn", "at", "part", "class", fault.alias("fault"))


def _string(name: str) -> Column:
    """One letter a turn of a part, in order."""
    return F.array_join(F.transform(F.col("turns"), lambda t: t[name]), "").alias(name)


def _parts(faults: DataFrame) -> DataFrame:
    """conv, nameless, part, roles and faults of each part as two strings."""
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise(".")
    rows = faults.groupBy(*_KEY, "part").agg(F.sort_array(F.collect_list(
        F.struct("at", F.col("class").alias("roles"), letter.alias("faults")))).alias("turns"))
    return rows.select(*_KEY, "part", _string("roles"), _string("faults"))


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each part what its derivations from every state to every state cost and do, and its broken pairs."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        froms, tos, costs, audits, broken, ends = [], [], [], [], [], []
        for roles, faults in zip(columns["roles"].to_pylist(), columns["faults"].to_pylist(), strict=True):
            spans = derived(roles, faults)
            froms.append([p for p, _ in spans])
            tos.append([q for _, q in spans])
            costs.append([c for c, _ in spans.values()])
            audits.append([a for _, a in spans.values()])
            broken.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])))
            ends.append(roles[0] + roles[-1])
        numbers = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [columns["conv"], columns["nameless"], columns["part"], pa.array(froms, numbers), pa.array(tos, numbers),
             pa.array(costs, numbers), pa.array(audits, pa.list_(pa.string())), pa.array(broken, pa.int64()), pa.array(ends, pa.string())],
            ["conv", "nameless", "part", "froms", "tos", "costs", "audits", "illegal", "ends"])


_DERIVED = "conv string, nameless boolean, part long, froms array<int>, tos array<int>, costs array<int>, audits array<string>, illegal long, ends string"
_CHAINED = "conv string, nameless boolean, part long, state int, audit string, cost long, illegal long, alone boolean"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each part; parts come sorted by conversation and part."""
    out: list[tuple] = []
    me, chain, waiting, last, several = None, Chain(), deque(), "", False

    def leave(done: list[tuple[int, str, int]]) -> None:
        for state, audit, cost in done:
            part, illegal = waiting.popleft()
            out.append((*me, part, state, audit, cost, illegal, not several))

    def rows() -> pa.RecordBatch:
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in _CHAINED.split(", ")]
        data = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(data, kinds, strict=True)], names)
        out.clear()
        return made

    for batch in batches:
        for conv, nameless, part, froms, tos, costs, audits, illegal, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, nameless) != me:
                if me:
                    leave(chain.final(at_end=True))
                me, chain, last, several = (conv, nameless), Chain(), "", False
            else:
                several = True
                leave(chain.final())  # only now is it known that the conversation goes on
                illegal += last + ends[0] not in ("su", "ua", "au")
            waiting.append((part, illegal))
            chain.add({(p, q): (c, a) for p, q, c, a in zip(froms, tos, costs, audits, strict=True)})
            last = ends[1]
        yield rows()
    if me:
        leave(chain.final(at_end=True))
    yield rows()


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that are left of each part."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):  # part by part: texts may be long
            turns = columns["turns"][i].as_py()
            left = applied(columns["audit"][i].as_py(), columns["state"][i].as_py(), [t["role"] for t in turns], [t["text"] for t in turns])
            yield pa.RecordBatch.from_arrays(
                [*[columns[c].slice(i, 1) for c in ("conv", "nameless", "part", "alone")],
                 pa.array([[dict(zip(("role", "text", "edit"), t, strict=True)) for t in left]], kind)],
                ["conv", "nameless", "part", "alone", "turns"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation from its parts, which come sorted."""
    me, state, begun = None, hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([me[0]]), pa.array([me[1]]), pa.array([state.hexdigest()])], ["conv", "nameless", "sha"])
    for batch in batches:
        for i in range(batch.num_rows):
            now = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if now != me:
                if me:
                    yield row()
                me, state, begun = now, hashlib.sha256(), False
            if begun:
                state.update(b"\n")
            state.update(batch.column(2)[i].as_buffer())
            begun = True
    if me:
        yield row()


def _planned(work: Workspace, faults: DataFrame) -> DataFrame:
    """The edits of every part."""
    parts = _parts(faults).mapInArrow(_derive, _DERIVED)
    return work.keep(parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "part").mapInArrow(_chain, _CHAINED), "edits")


def _edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, nameless, part, alone and the turns that are left, in order."""
    parts = rows.groupBy(*_KEY, "part").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    return parts.join(edits, [*_KEY, "part"]).select(*_KEY, "part", "alone", "state", "audit", "turns").mapInArrow(
        _edit, "conv string, nameless boolean, part long, alone boolean, turns array<struct<role string, text string, edit string>>")


def _digests(work: Workspace, rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, nameless, sha of the repaired conversation."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    bodies = work.keep(_edited(rows, edits).where(F.size("turns") > 0).select(*_KEY, "part", "alone", lines.alias("body")), "bodies")
    long = bodies.where(~F.col("alone")).repartition(*_KEY).sortWithinPartitions(*_KEY, "part").select(*_KEY, "body")
    return bodies.where("alone").select(*_KEY, F.sha2("body", 256).alias("sha")).unionByName(
        long.mapInArrow(_digest, "conv string, nameless boolean, sha string"))


def repaired(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, place, role, text, edit) of the repaired conversations; edit is K, R or I.

    Turns of a conversation are in the order of (part, place). The id comes back as text. Order of the turns given:
    by number, null numbers first, equal ones by role and a hash of the text; a repeated row is a turn of its own and
    is deleted as a duplicate. A null role or text is one space, so such a text is blank. Rows without an id are one
    conversation, with a null id. Other columns are not read; an empty table gives no rows.
    """
    def build(work: Workspace) -> DataFrame:
        rows = _ordered(work, turns, key, turn, role, text)
        left = _edited(rows, _planned(work, _faults(rows)))
        return left.select(*_KEY, "part", F.posexplode("turns").alias("place", "t")).select(
            F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"), "part", "place", "t.role", "t.text", "t.edit")
    return worked_out(turns.sparkSession, "repaired", build)


def summaries(turns: DataFrame, all_turns: DataFrame | None = None, key: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    gaps: numbers missing between the least and the greatest (null where that is beyond a long integer); blank,
    duplicate, truncated: turns by their first fault; illegal: neighbours that are not system-user, user-assistant or
    assistant-user, by initials; cost and audit of the cheapest edits, ties to the least audit; the digest of
    `role:text` lines that are left. Conversations that only `all_turns` has get zeros, an empty audit and the digest
    of nothing. Rows are read and ordered as `repaired` says.
    """
    def build(work: Workspace) -> DataFrame:
        rows = _ordered(work, turns, key, turn, role, text)
        faults = work.keep(_faults(rows), "faults")
        edits = _planned(work, faults)
        count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
        width = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
        found = faults.groupBy(*_KEY).agg(F.coalesce(F.when(F.count("turn") == 0, F.lit(0)), width.try_cast("long")).alias("gaps"),
                                          count("blank"), count("duplicate"), count("truncated"))
        total = edits.groupBy(*_KEY).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit"))
        every = (turns if all_turns is None else all_turns).select(*_identity(key), F.col(key).alias("conv_id"))
        every = every.groupBy(*_KEY).agg(F.first("conv_id").alias("conv_id"))
        number = lambda name: F.when(F.col("found"), F.col(name)).otherwise(0).alias(name)
        joined = every.join(found.withColumn("found", F.lit(True)), _KEY, "left").join(total, _KEY, "left").join(
            _digests(work, rows, edits), _KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))
        return joined.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                             F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(_EMPTY)).alias("repaired_sha256"))
    return worked_out(turns.sparkSession, "repair", build)
