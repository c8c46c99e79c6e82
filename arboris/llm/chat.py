"""Chat formatting with minimum-cost role repair.

Turns must run through a legal-turn automaton whose states are the roles. Each
turn can keep its role, be relabelled, be merged into the turn before it, or
have empty turns inserted before it; each of these has a cost, and dynamic
programming finds the cheapest repair of the whole conversation, which is then
rendered.

A turn's costs are a matrix of states by states, and a stretch of turns has the
(min, +) product of its turns' matrices. So conversations are cut into segments
of SEGMENT turns, in order of rows: the segments' matrices are made in parallel.
The product is associative, so FAN matrices in a row are made one, and so on up
to the top of a tree; the cheapest way through the top gives each node its two end
states, down to the segments, and every segment is traced back and rendered on
its own between them. No row holds more than FAN matrices or SEGMENT turns, and
turns are numbered by ranges of rows: a conversation with a third of all turns is
many tasks' work, whatever its turn numbers.

A conversation may end with a user's or an assistant's turn only (ENDS); where it
ends otherwise, empty turns are appended at the cost of insertions. Texts are
escaped: each ``<|`` in a text becomes ``<||``, so no text can look like a mark,
and ``unescaped`` gives it back.

Defined results: unknown and null roles are relabelled; null text is empty; turns
come by turn, role, text, null turns last; repeated turns are turns; ties go to
the role first in ROLES, from the top of the tree down; turns without conv_id are one conversation; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arboris.llm.common import small_batches, staged
from arboris.operators.number import numbered

ROLES = ("system", "user", "assistant", "tool")
START = len(ROLES)
#: What may follow what.
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
#: Roles of the last turn that a conversation may have.
ENDS = ("user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "function": "tool", "developer": "system"}
MERGE, NAME, RELABEL, INSERT = 1, 1, 2, 3
SEGMENT, FAN = 256, 256
_FAR = 10**9


def _paths() -> tuple[np.ndarray, dict[tuple[int, int], list[int]]]:
    """Fewest empty turns between two states, and which."""
    names = [*ROLES, "start"]
    count = np.full((START + 1, START + 1), _FAR)
    via: dict[tuple[int, int], list[int]] = {}
    for s, name in enumerate(names):
        queue = [(ROLES.index(q), []) for q in LEGAL[name]]
        for q, way in queue:
            if (s, q) not in via:
                via[s, q], count[s, q] = way, len(way)
                queue += [(ROLES.index(n), [*way, q]) for n in LEGAL[ROLES[q]]]
    return count, via


_GAP, _VIA = _paths()


def _endings() -> tuple[np.ndarray, list[list[int]]]:
    """Cost of ending in each state, and the empty turns that it takes."""
    ways = []
    for s in range(START + 1):
        fits = [[]] if s == START or ROLES[s] in ENDS else [[*_VIA[s, q], q] for q in range(START) if ROLES[q] in ENDS and (s, q) in _VIA]
        ways.append(min(fits, key=len))
    return np.array([len(w) * INSERT for w in ways]), ways


_CLOSE, _LAST = _endings()


def escaped(text: str) -> str:
    return text.replace("<|", "<||")


def unescaped(text: str) -> str:
    return text.replace("<||", "<|")


def role_number(role: str | None) -> int:
    """Number of a role, -1 if it is none."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def step_costs(role: int) -> np.ndarray:
    """Cost of a turn of this role from each state (row) to each (column)."""
    label = np.array([NAME if role < 0 else 0 if q == role else RELABEL for q in range(START)] + [_FAR])
    move = np.minimum(_GAP, _FAR // INSERT) * INSERT
    stay = np.full_like(move, _FAR)
    np.fill_diagonal(stay[:START, :START], MERGE)
    return np.minimum(np.minimum(move, stay) + label, _FAR)


_STEP = {r: step_costs(r) for r in range(-1, START)}


def chain_costs(roles: list[int]) -> np.ndarray:
    """Matrix of a stretch of turns."""
    out = np.where(np.eye(START + 1, dtype=bool), 0, _FAR)
    for r in roles:
        out = np.minimum((out[:, :, None] + _STEP[r][None]).min(1), _FAR)
    return out


def trace(steps: list[np.ndarray], entry: int, end: int | None = None) -> tuple[int, list[int]]:
    """Cost and states of the cheapest way through ``steps`` from ``entry`` (to ``end``)."""
    at = np.full(START + 1, _FAR)
    at[entry] = 0
    back = []
    for m in steps:
        total = at[:, None] + m
        back.append(total.argmin(0))
        at = np.minimum(total.min(0), _FAR)
    q = int((at + _CLOSE).argmin()) if end is None else end
    cost, way = int(at[q]), []
    for b in reversed(back):
        way.append(q)
        q = int(b[q])
    return cost, way[::-1]


def rendered(turns: list[tuple[int, str]], way: list[int], entry: int, last: bool) -> tuple[str, int]:
    """Text of a segment's turns (role, text) along the states ``way``, and how many turns start in it."""
    out, n, state = [], 0, entry
    for (role, text), q in zip(turns, way):
        label = NAME if role < 0 else 0 if q == role else RELABEL
        if q == state and MERGE + label <= _GAP[state, q] * INSERT + label:
            out.append("\n" + escaped(text))
            continue
        for e in [*_VIA[state, q], q]:
            out.append(("" if state == START else "<|end|>\n") + f"<|{ROLES[e]}|>\n")
            n, state = n + 1, e
        out.append(escaped(text))
    if last and state != START:
        for e in _LAST[state]:
            out.append(f"<|end|>\n<|{ROLES[e]}|>\n")
            n += 1
        out.append("<|end|>\n")
    return "".join(out), n


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Matrix of stretches in a row."""
    out = matrices[0]
    for m in matrices[1:]:
        out = np.minimum((out[:, :, None] + m[None]).min(1), _FAR)
    return out


def _chain(rows: list[dict]) -> list[np.ndarray]:
    return [np.array(r["costs"]).reshape(START + 1, START + 1) for r in rows]


def ways(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """c, no, entry, end and last of each of ``matrices`` (conv_id, no, costs): the states between which its conversation's
    cheapest way runs through it, and whether it is the last. ``no`` counts from 0 in each conversation."""
    conv = matrices.schema["conv_id"].dataType.simpleString()
    matrices = staged(matrices, "matrices")
    groups = matrices.groupBy("conv_id", F.floor(F.col("no") / fan).alias("g")).agg(F.sort_array(F.collect_list(F.struct("no", "costs"))).alias("chain"))  # of ``fan`` rows
    if (matrices.agg(F.max("no")).first()[0] or 0) < fan:
        within = groups.select("conv_id", "chain", F.lit(START).alias("entry"), F.lit(None).cast("int").alias("end"), F.lit(True).alias("last"))
    else:

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                costs = [product(_chain(x)).ravel().tolist() for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "no", "costs"])

        upper = ways(small_batches(groups).mapInArrow(merged, f"conv_id {conv}, no long, costs array<long>"), fan)
        within = groups.join(upper, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("g") == F.col("no"))).select("conv_id", "chain", "entry", "end", "last")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for i, (chain, entry, end, last) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 5)))):
                _, way = trace(_chain(chain), entry, end)
                for k, c in enumerate(chain):
                    take.append(i)
                    rows.append((c["no"], way[k - 1] if k else entry, way[k], last and k == len(chain) - 1))
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["c", "no", "entry", "end", "last"])

    return small_batches(within).mapInArrow(place, f"c {conv}, no long, entry int, end int, last boolean")


def repaired(turns: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """conv_id, part (from 0), n_turns, n_repaired (turns that start in the part), cost and rendered text,
    a row for each conversation and segment; ``turns`` has conv_id, turn, role, text."""
    rows = turns.select("conv_id", F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("one"))
    order = numbered(rows, ["conv_id"], ["one"], "place").select("conv_id", "place", F.floor((F.col("place") - 1) / segment).alias("part"), "one.role", "one.text")
    grouped = order.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    grouped = staged(grouped.select("conv_id", "part", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts")), "segments")
    conv = grouped.schema["conv_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = [chain_costs([role_number(r) for r in x]).ravel().tolist() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "no", "costs"])

    placed = ways(small_batches(grouped).select("conv_id", "part", "roles").mapInArrow(measure, f"conv_id {conv}, no long, costs array<long>"), fan)
    both = grouped.join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("no")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, made, cost, text = [], [], [], []
            for roles, texts, entry, end, last in zip(*(b.column(i).to_pylist() for i in range(2, 7))):
                numbers = [role_number(r) for r in roles]
                total, way = trace([_STEP[r] for r in numbers], entry, end)
                total += int(_CLOSE[end]) if last else 0
                out, k = rendered(list(zip(numbers, texts)), way, entry, last)
                n.append(len(roles)), made.append(k), cost.append(total), text.append(out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n, made, cost)), pa.array(text, pa.string())],
                ["conv_id", "part", "n_turns", "n_repaired", "cost", "rendered"],
            )

    both = both.select("conv_id", "part", "roles", "texts", "entry", "end", "last")
    return small_batches(both).mapInArrow(write, f"conv_id {conv}, part long, n_turns long, n_repaired long, cost long, rendered string")
