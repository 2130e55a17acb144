"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, ending with the assistant. A dynamic program over the states of
that automaton (nothing yet, system, user, assistant) decides for each turn
whether it keeps its role, gets another, is merged into the turn before it, or
has empty turns put before it, at the least total cost.

A conversation may hold more turns than a task should see. Turns are sorted
globally and dealt by range, so a long one spreads over neighbouring partitions.
A stretch of turns is a 4 x 4 matrix of least costs, and matrices multiply; so
only the conversations that cross a border send such summaries (two for each
partition at most) to the driver, which gives each stretch the costs it starts
with, then the state in which it ends. With those every stretch is solved where
it lies, and ties are settled as in a single pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, adopt, table, width

ROLES = ("system", "user", "assistant")
NEVER = 1 << 60
OUT = "conv_id string, position long, turn string, role string, action string, fragment string"
START = (0, NEVER, NEVER, NEVER)

#: Turns that must be put in between two states of the automaton (states: 0 nothing yet, 1 system, 2 user, 3 assistant).
BETWEEN = {(0, 1): (), (0, 2): (), (0, 3): (2,), (1, 2): (), (1, 3): (2,), (2, 3): (), (2, 2): (3,), (3, 2): (), (3, 3): (2,)}
#: Turns that must be put at the end.
ENDING = ((), (2, 3), (3,), ())


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3


class Automaton:
    """Steps of the dynamic program, remembered by the differences of the costs so far."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.cost = [[[NEVER] * 4 for _ in range(4)] for _ in range(4)]  # [role read][state before][state after]
        self.merges = [[False] * 4 for _ in range(4)]
        for before in range(4):
            for after in (1, 2, 3):
                ways = [(costs.insert * len(BETWEEN[before, after]), False)] if (before, after) in BETWEEN else []
                ways += [(costs.merge, True)] if before == after else []
                if ways:
                    least, self.merges[before][after] = min(ways, key=lambda w: (w[0], not w[1]))
                    for read in range(4):
                        self.cost[read][before][after] = least + costs.relabel * (read + 1 != after)
        self.seen: dict[tuple, tuple] = {}

    def step(self, known: tuple, read: int) -> tuple[tuple, tuple, int]:
        """(costs after the turn above the least, state before for each state after, least cost); of equal states the smallest."""
        if (known, read) not in self.seen:
            table_ = self.cost[read]
            after, back = [], []
            for q in range(4):
                ways = [(known[p] + table_[p][q], p) for p in range(4) if known[p] < NEVER and table_[p][q] < NEVER]
                least = min(ways, default=(NEVER, 0))
                after.append(least[0])
                back.append(least[1])
            low = min(after)
            self.seen[known, read] = tuple(x - low if x < NEVER else NEVER for x in after), tuple(back), low
        return self.seen[known, read]

    def forward(self, known: tuple, reads: list[int]) -> tuple[tuple, list[tuple]]:
        """(costs after all turns, steps back)."""
        base = min(known)
        known = tuple(x - base if x < NEVER else NEVER for x in known)
        backs = []
        for r in reads:
            known, back, low = self.step(known, r)
            base += low
            backs.append(back)
        return tuple(x + base if x < NEVER else NEVER for x in known), backs

    def matrix(self, reads: list[int]) -> list[tuple]:
        return [self.forward(tuple(0 if p == q else NEVER for q in range(4)), reads)[0] for p in range(4)]

    def best_end(self, known: tuple) -> int:
        return min(range(4), key=lambda q: (known[q] + self.costs.insert * len(ENDING[q]), q))

    def trace(self, backs: list[tuple], state: int) -> list[int]:
        """States before the first turn and after each, ending in ``state``."""
        path = [state]
        for back in reversed(backs):
            path.append(back[path[-1]])
        return path[::-1]

    def added(self, path: list[int]) -> int:
        """Rows that a path gives: one for each turn and one for each inserted turn."""
        return sum(1 + (0 if self.merges[p][q] else len(BETWEEN[p, q])) for p, q in zip(path, path[1:], strict=False))


def combine(known: tuple, matrix: list[list[int]]) -> tuple:
    return tuple(min(NEVER, *(known[p] + matrix[p][q] for p in range(4) if known[p] < NEVER)) for q in range(4))


def open_turn(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


CLOSE = "<|im_end|>\n"


def escape(text: Column) -> Column:
    """The text with a backslash put before the bar of each mark that opens or closes a turn, so that no text makes a turn of its own. Marks that are escaped already get one more, so ``unescape`` gives back what there was."""
    return F.regexp_replace(text, r"<(\\*)\|(im_start|im_end)\|>", r"<$1\\|$2|>")


def unescape(text: Column) -> Column:
    """A text of a rendered turn as it was before ``escape``."""
    return F.regexp_replace(text, r"<(\\*)\\\|(im_start|im_end)\|>", "<$1|$2|>")


def fragments(a: Automaton, reads: list[int], turns: list, texts: list[str], path: list[int], position: int, more: int | None) -> list[tuple]:
    """Rows (position, turn, role, action, fragment) of a stretch. ``more`` is the state after the first turn of the next stretch, None at the end of the conversation."""
    out = []
    for i, (p, q) in enumerate(zip(path, path[1:], strict=False)):
        merged = a.merges[p][q] and p == q
        for s in () if merged else BETWEEN[p, q]:
            out.append((position + len(out), None, ROLES[s - 1], "insert", open_turn(s) + CLOSE))
        last = i + 1 == len(reads)
        after = more if last else path[i + 2]
        goes_on = after is not None and after == q and a.merges[q][after]
        new_role = reads[i] + 1 != q
        action = ("relabel+merge" if new_role else "merge") if merged else ("relabel" if new_role else "keep")
        out.append((position + len(out), turns[i], ROLES[q - 1], action, ("\n" if merged else open_turn(q)) + texts[i] + ("" if goes_on else CLOSE)))
    if more is None:
        for s in ENDING[path[-1]]:
            out.append((position + len(out), None, ROLES[s - 1], "insert", open_turn(s) + CLOSE))
    return out


def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, object, list[int], list, list[str], bool, bool]]:
    """(partition, conversation, roles, turns, texts, first of the partition, last of the partition)."""
    held, first = None, True
    for pdf in batches:
        for part, c, t, r, x in zip(pdf["part"].tolist(), pdf["conv"], pdf["turn"], pdf["read"].tolist(), pdf["text"], strict=True):
            if held is None or held[1] != c or held[0] != part:
                if held is not None:
                    yield *held, first, False
                    first = False
                held = (part, c, [], [], [])
            held[2].append(r)
            held[3].append(t)
            held[4].append(x)
    if held is not None:
        yield *held, first, True


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Repaired conversations as rendered rows: conv_id, position, turn, role, action, fragment.

    The fragments of a conversation, joined in order of position (0, 1, ...), are
    its rendered text. ``action`` is keep, relabel, merge, relabel+merge or
    insert; inserted turns have no source turn. Turns sort by turn (nulls first),
    then role, then a hash of the text, then the text, so equal rows are
    interchangeable; each takes part. Marks of turns within a text are escaped. A
    null conv_id is a conversation of its own. Roles are compared trimmed and in
    lower case; any other role, or none, must be relabelled. A null text counts as
    empty. An empty table gives an empty result. Other columns are ignored.
    """
    turns = adopt(turns)
    spark = turns.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(Scratch(spark, "chat").passing())
    role = F.lower(F.trim("role"))
    read = F.when(role == "system", 0).when(role == "user", 1).when(role == "assistant", 2).otherwise(3)
    base = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), read.alias("read"), escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    # Ids and turns go through Python as text: beside nulls pandas would make doubles of numbers.
    kind = dict(base.dtypes)["conv"]
    dealt = base.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()}).repartitionByRange(width(spark), "conv", "turn", "role", "h", "n")
    dealt = dealt.sortWithinPartitions("conv", "turn", "role", "h", "text").select(F.spark_partition_id().alias("part"), F.col("conv").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "read", "text").checkpoint()

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = Automaton(costs)
        rows = [(part, c, [x for row in a.matrix(reads) for x in row]) for part, c, reads, _, _, first, last in stretches(batches) if first or last]
        yield pd.DataFrame(rows, columns=["part", "conv", "matrix"])

    borders: dict[object, list] = {}
    for r in sorted(dealt.mapInPandas(summaries, "part int, conv string, matrix array<long>").collect(), key=lambda r: r["part"]):
        borders.setdefault(r["conv"], []).append((r["part"], r["matrix"]))
    a = Automaton(costs)
    starts, ends = {}, {}
    for c, parts in borders.items():
        known = START
        for part, m in parts if len(parts) > 1 else ():
            starts[part, c] = known
            known = combine(known, [m[4 * p : 4 * p + 4] for p in range(4)])
        if len(parts) > 1:
            ends[c] = a.best_end(known)
    places: dict[tuple, tuple[int, int, int | None]] = {}
    if starts:

        def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = Automaton(costs)
            rows = []
            for part, c, reads, *_ in stretches(batches):
                if (part, c) in starts:
                    known, backs = b.forward(starts[part, c], reads)
                    for q in range(4):
                        if known[q] < NEVER:
                            path = b.trace(backs, q)
                            rows.append((part, c, q, path[0], path[1], b.added(path)))
            yield pd.DataFrame(rows, columns=["part", "conv", "last", "first", "second", "n"])

        found = {(r["part"], r["conv"], r["last"]): (r["first"], r["second"], r["n"]) for r in dealt.mapInPandas(traces, "part int, conv string, last int, first int, second int, n long").collect()}
        for c, state in ends.items():
            way, more = [], None
            for part, _ in reversed(borders[c]):
                first, second, n = found[part, c, state]
                way.append((part, state, n, more))
                state, more = first, second
            position = 0
            for part, last, n, more in reversed(way):
                places[part, c] = (last, position, more)
                position += n

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = Automaton(costs)
        rows: list[tuple] = []
        for part, c, reads, own, texts, *_ in stretches(batches):
            known, backs = b.forward(starts.get((part, c), START), reads)
            last, position, more = places.get((part, c)) or (b.best_end(known), 0, None)
            rows += [(c, *r) for r in fragments(b, reads, own, texts, b.trace(backs, last), position, more)]
            if len(rows) > 5000:
                yield frame(rows)
                rows = []
        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "position", "turn", "role", "action", "fragment"], dtype=object)

    return dealt.mapInPandas(solve, OUT).withColumns({"conv_id": F.col("conv_id").cast(kind), "turn": F.col("turn").cast("long")})


def render(repaired: DataFrame) -> DataFrame:
    """One text for each conversation (conv_id, text); for conversations that fit into a task."""
    rows = F.sort_array(F.collect_list(F.struct("position", "fragment")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["fragment"]), "").alias("text"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
