"""Chat formatting: conversations logged after every turn are collapsed to the longest ones, then rendered.

Every turn gets its place in its conversation and a rolling hash of the turns up to it. A conversation whose hash at
its end equals another's hash at the same place is a prefix of it. Anti-joins drop conversations that a longer one
continues, and of equal ones all but the smallest id. What remains is rendered in parts of at most `PART` turns.

Only DataFrame functions: places and rolling hashes go by slices of a conversation, so a very long one is not one
task, and prefixes that many conversations share are counted together before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import Workspace, worked_out
from ledgerloom.operators.ordered import along

SLICE = 4096
PART = 256
_KEY = ["conv", "nameless"]


def placed(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, nameless, role, text, place (from 1) and h1, h2: two sums of hashes of (place, role, text) up to here.

    Turns are ordered by number, role and text, null numbers last; repeated rows are turns of their own. All rows
    without a conversation id are one conversation (`nameless`).
    """
    rows = turns.select(
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("conv"), F.col(key).isNull().alias("nameless"),
        F.coalesce(F.col(turn).cast("long"), F.lit((1 << 63) - 1)).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    numbered = along(rows, _KEY, ["turn", "role", "text"], F.floor(F.col("turn") / SLICE), number="place")
    def piece(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), "place", "role", "text").cast("decimal(20,0)")
    hashed = numbered.withColumns({"own1": piece(1), "own2": piece(2)})
    rolled = along(hashed, _KEY, ["place"], F.floor(F.col("place") / SLICE), running={"h1": "own1", "h2": "own2"})
    return rolled.select(*_KEY, "place", "role", "text", "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, nameless, n_turns, copies) of conversations that no other continues; of equal ones the first.

    `turns` is what `placed` gives. copies counts the equal conversations, this one included.
    """
    length = turns.groupBy(*_KEY).agg(F.max("place").alias("n_turns"))
    whole = turns.join(length, _KEY).where("place = n_turns").select(*_KEY, "n_turns", "h1", "h2")
    continued = turns.join(length, _KEY).where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    ends = ["n_turns", "h1", "h2"]
    # Equal conversations are counted in every task first, so that many copies of one are one row in the join.
    first = whole.groupBy(*ends).agg(F.min(F.struct("nameless", "conv")).alias("c"), F.count(F.lit(1)).alias("copies"))
    return first.join(continued, ends, "left_anti").select("c.conv", "c.nameless", "n_turns", "copies")


def segment(role: str = "role", text: str = "text") -> Column:
    """One turn as text; the opening mark inside a text is broken up, so that no text can pose as a turn."""
    return F.concat(F.lit("<|"), F.replace(F.col(role), F.lit("<|"), F.lit("< |")), F.lit("|>\n"),
                    F.replace(F.col(text), F.lit("<|"), F.lit("< |")), F.lit("\n"))


def rendered(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, part, n_turns, copies, rendered) of the maximal conversations.

    A conversation of up to 256 turns is one row, part 0; a longer one goes on in further parts. A null role is
    `unknown`, a null text empty. Other columns are not read; an empty table gives an empty result.
    """
    def build(work: Workspace) -> DataFrame:
        rows = work.keep(placed(turns, **columns), "turns")
        kept = work.keep(maximal(rows), "kept")
        parts = rows.join(kept, _KEY).select(
            *_KEY, "n_turns", "copies", F.floor((F.col("place") - 1) / PART).cast("int").alias("part"), "place", segment().alias("s"))
        joined = parts.groupBy(*_KEY, "part").agg(
            F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]), "").alias("rendered"))
        return joined.select(F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"), "part", F.col("n_turns").cast("long").alias("n_turns"),
                             "copies", "rendered")
    return worked_out(turns.sparkSession, "chat", build)
