"""Chat formatting by minimum-cost role repair.

The legal-turn automaton: an optional system turn, then user and assistant turns in turn, beginning with user and ending with assistant.
Its states are the role of the last turn written (or none yet). Dynamic programming reads a conversation's turns in order; each turn is
  kept (0) or relabelled (RELABEL; UNKNOWN for a role that isn't one of the three) where the automaton allows,
  or merged into the last turn written (MERGE, and the relabel cost if the roles differ),
  and before it, or at the end, empty turns may be inserted (INSERT each).
The cheapest way is taken and rendered. Among equally cheap ones the order of STATES and of the list above decides.

Scale: a conversation is cut into segments of SEGMENT turns, by their place in it (found from turns sorted over all tasks, not by a window over the
conversation). Each segment gives its table of costs from any state to any state
(a min-plus matrix), a conversation's few matrices are chained, and each segment is then traced back and rendered for itself between the states
found. So a very long conversation is spread over tasks, and only its rendered parts meet. Ties in `turn` are ordered by role,
then by a hash of the text, so neither equal nor null turn numbers make a segment longer.

Defined results: null or empty texts are empty turns, kept like others. A null role is an unknown one; a null turn comes first; rows with a null conv_id form one
conversation. Repeated rows are turns of their own (and get merged). Roles are compared in lower case, trimmed. The template's markers inside a text
are broken up by a space, so that no text can forge a turn. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.ranks import numbered
from pagewright.session import materialize, table

STATES = ("none", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 3, 1, 2
SEGMENT = 4096
FAR = 1 << 40

#: Cheapest empty turns that lead from one state to another (none: the state itself).
_INSERTS: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(4)}
for _ in range(4):
    for (_a, _b), _way in list(_INSERTS.items()):
        for _c in NEXT[_b]:
            if (_a, _c) not in _INSERTS or len(_INSERTS[_a, _c]) > len(_way) + 1:
                _INSERTS[_a, _c] = (*_way, _c)


def _relabel(role: int, to: int) -> int:
    return UNKNOWN if role == 0 else 0 if role == to else RELABEL


def _moves() -> dict[int, list[tuple[int, int, int, tuple[int, ...], bool]]]:
    """For each role (0: unknown): cost, from state, to state, empty turns before, merged."""
    out = {}
    for role in range(4):
        moves = []
        for a in range(4):
            for b in range(1, 4):
                ways = [(a_, w) for (f, a_), w in _INSERTS.items() if f == a and b in NEXT[a_]]
                if ways:
                    _, way = min(ways, key=lambda x: (len(x[1]), x[1]))
                    moves.append((_relabel(role, b) + INSERT * len(way), a, b, way, False))
                if a == b:
                    moves.append((MERGE + _relabel(role, b), a, b, (), True))
        out[role] = moves
    return out


MOVES = _moves()
#: Cost of the empty turns that end a conversation in each state.
CLOSE = [INSERT * len(_INSERTS.get((s, 3), (2, 3))) for s in range(4)]


def costs(roles: list[int], start: list[int]) -> list[list[int]]:
    """Row i: the cheapest cost of being in each state after i turns."""
    out = [start]
    for r in roles:
        best = [FAR] * 4
        last = out[-1]
        for c, a, b, _, _ in MOVES[r]:
            if last[a] + c < best[b]:
                best[b] = last[a] + c
        out.append(best)
    return out


def matrix(roles: list[int]) -> list[int]:
    """Costs from each state (rows) to each state, through these turns."""
    m = []
    for s in range(4):
        m += costs(roles, [0 if x == s else FAR for x in range(4)])[-1]
    return m


def trace(roles: list[int], start: int, end: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """For each turn its role, the empty turns before it, and whether it is merged into the turn before."""
    table_ = costs(roles, [0 if x == start else FAR for x in range(4)])
    out, state = [], end
    for i in range(len(roles) - 1, -1, -1):
        for c, a, b, way, merged in MOVES[roles[i]]:
            if b == state and table_[i][a] + c == table_[i + 1][state]:
                out.append((b, way, merged))
                state = a
                break
    return out[::-1]


def chain(matrices: list[list[int]]) -> tuple[list[int], int]:
    """States at the borders of segments (one more than segments), and the whole cost."""
    rows = [[0, FAR, FAR, FAR]]
    for m in matrices:
        rows.append([min(rows[-1][a] + m[4 * a + b] for a in range(4)) for b in range(4)])
    cost, state = min((rows[-1][s] + CLOSE[s], s) for s in range(4))
    out = [state]
    for m, before, after in zip(matrices[::-1], rows[-2::-1], rows[:0:-1], strict=True):
        state = next(a for a in range(4) if before[a] + m[4 * a + state] == after[state])
        out.append(state)
    return out[::-1], cost


OPEN, SHUT = "<|im_start|>", "<|im_end|>"


def _turn(role: int, text: str = "") -> str:
    return f"{OPEN}{STATES[role]}\n{text}"


def render(turns: list[tuple[int, tuple[int, ...], bool]], texts: list[str], first: bool) -> str:
    """A segment's part. A turn's end is written when the next one begins, so that a merge can go on across segments."""
    out, begun = [], not first
    for (role, way, merged), text in zip(turns, texts, strict=True):
        text = text.replace("<|im_", "<| im_")
        for w in way:
            out.append(f"{SHUT}\n" * begun + _turn(w))
            begun = True
        out.append(f"\n{text}" if merged else f"{SHUT}\n" * begun + _turn(role, text))
        begun = True
    return "".join(out)


def closing(state: int) -> tuple[str, int]:
    way = _INSERTS.get((state, 3), (2, 3))
    return "".join(f"{SHUT}\n{_turn(w)}" for w in way) + f"{SHUT}\n", len(way)


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (tuples) of each key, from sorted frames."""
    rows = (r for f in frames for r in f.astype(object).where(f.notna(), None).itertuples(index=False, name=None))
    n = len(keys)
    for k, g in groupby(rows, key=lambda r: r[:n]):
        yield k, list(g)


def _out(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def format_chats(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, n_turns, n_rendered, cost, actions, text: one row for each conversation.

    actions: for each turn the letter of the role it got (s, u, a), + if merged, after one - with its role for each empty turn inserted before it; closing turns last.
    """
    role = F.lower(F.trim(F.coalesce(F.col("role"), F.lit(""))))
    code = F.when(role == "system", 1).when(role == "user", 2).when(role == "assistant", 3).otherwise(0)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.alias("code"), F.xxhash64("text").alias("tie"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = numbered(rows, "conv_id", ["turn", "code", "tie"], "at").select("conv_id", F.expr(f"at div {int(segment)}").alias("seg"), "at", "code", "text")
    order = ["conv_id", "seg", "at"]

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for k, g in _groups(frames, ["conv_id", "seg"]):
            out.append((*k, len(g), matrix([r[3] for r in g])))
            if len(out) == 5000:
                yield _out(out, ["conv_id", "seg", "n", "m"])
                out = []
        yield _out(out, ["conv_id", "seg", "n", "m"])

    keyed = rows.drop("text").repartition("conv_id", "seg").sortWithinPartitions(*order)
    ms = keyed.mapInPandas(matrices, "conv_id long, seg long, n long, m array<long>")

    def chains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "seg", "start", "end", "first", "last", "cost"]
        out = []
        for k, g in _groups(frames, ["conv_id"]):
            states, cost = chain([list(r[3]) for r in g])
            out += [(k[0], r[1], states[i], states[i + 1], i == 0, i == len(g) - 1, cost) for i, r in enumerate(g)]
            if len(out) >= 5000:
                yield _out(out, names)
                out = []
        yield _out(out, names)

    states = materialize(ms.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInPandas(chains, "conv_id long, seg long, start int, end int, first boolean, last boolean, cost long"), "states")

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "seg", "n_turns", "n_rendered", "cost", "actions", "part"]
        out, size = [], 0
        for k, g in _groups(frames, ["conv_id", "seg"]):
            start, end, first, last, cost = g[0][5:]
            way = trace([r[3] for r in g], start, end)
            text = render(way, [r[4] for r in g], bool(first))
            actions = "".join("".join(f"-{STATES[w][0]}" for w in ins) + STATES[b][0] + "+" * merged for b, ins, merged in way)
            n = sum(len(ins) + (not merged) for _, ins, merged in way)
            if last:
                tail, more = closing(end)
                text, n, actions = text + tail, n + more, actions + "".join(f"-{STATES[w][0]}" for w in _INSERTS.get((end, 3), (2, 3)))
            out.append((*k, len(g), n, cost, actions, text))
            size += len(text)
            if size > 1 << 22:
                yield _out(out, names)
                out, size = [], 0
        yield _out(out, names)

    same = rows["conv_id"].eqNullSafe(states["conv_id"]) & (rows["seg"] == states["seg"])
    both = rows.join(states, same).select(*(rows[c] for c in ("conv_id", "seg", "at", "code", "text")), "start", "end", "first", "last", "cost")
    done = both.repartition("conv_id", "seg").sortWithinPartitions(*order).mapInPandas(parts, "conv_id long, seg long, n_turns long, n_rendered long, cost long, actions string, part string")
    whole = done.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_rendered").alias("n_rendered"), F.max("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("seg", "actions", "part"))).alias("p"))
    return whole.select("conv_id", "n_turns", "n_rendered", "cost", F.array_join("p.actions", "").alias("actions"), F.array_join("p.part", "").alias("text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


