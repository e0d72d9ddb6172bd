"""Chat formatting: repair of roles at least cost over a legal-turn automaton, then rendering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, written

ROLES = ("system", "user", "assistant")
#: State after an output turn: 0 at the start, else 1 + index of the role of the last output turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = np.iinfo(np.int64).max // 4
_COST = 1 << 32  # a value is cost * _COST + output turns, so that equal costs prefer fewer turns


@dataclass(frozen=True)
class Repair:
    """Costs of what a repair may do, and how turns are rendered."""

    merge: int = 1  # with the turn before, of the same role
    relabel_unknown: int = 1  # a role that is none of the three
    relabel: int = 2
    insert: int = 3  # an empty turn
    fragment: int = 500  # turns of a conversation that one step looks at
    header: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    join: str = "\n\n"


def legal(state: int, role: int) -> bool:
    """An optional system turn first, then user and assistant in turn, the user first."""
    return (state == START) if role == 0 else (state in (START, SYSTEM, ASSISTANT)) if role == 1 else state == USER


def choices(role: int, how: Repair) -> list[tuple[int, int, int, int, int]]:
    """(state, next state, value, role given, kind) of all ways to take a turn of ``role`` (-1: unknown).

    Kind 0 appends, 1 merges, 2 inserts the missing turn before. In order of preference.
    """
    out = []
    for state in range(4):
        for new in range(3):
            cost = 0 if new == role else how.relabel_unknown if role < 0 else how.relabel
            if legal(state, new):
                out.append((state, new + 1, cost * _COST + 1, new, 0))
            if state == new + 1:
                out.append((state, state, (cost + how.merge) * _COST, new, 1))
            if new == 1 and state == USER or new == 2 and state != USER:
                out.append((state, new + 1, (cost + how.insert) * _COST + 2, new, 2))
    return out


def closing(how: Repair) -> list[int]:
    """Value of ending in each state: a conversation ends with the assistant; one without turns is left empty."""
    return [0, 2 * (how.insert * _COST + 1), how.insert * _COST + 1, 0]


def role_number(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else -1


def fragment_matrix(roles: list[int], options: dict[int, list]) -> np.ndarray:
    """Least value from every entry state to every exit state."""
    out = np.full((4, 4), _NEVER, np.int64)
    np.fill_diagonal(out, 0)
    for role in roles:
        new = np.full((4, 4), _NEVER, np.int64)
        for state, to, value, _, _ in options[role]:
            np.minimum(new[:, to], out[:, state] + value, out=new[:, to])
        out = np.minimum(new, _NEVER)
    return out


def best_path(roles: list[int], entry: int, exit_: int, options: dict[int, list]) -> list[tuple[int, int, int]]:
    """(state before, role given, kind) of each turn on the best path; the first of equal ones."""
    values = [[_NEVER] * 4 for _ in range(len(roles) + 1)]
    back: list[list] = [[None] * 4 for _ in range(len(roles) + 1)]
    values[0][entry] = 0
    for t, role in enumerate(roles):
        for option in options[role]:
            v = values[t][option[0]] + option[2]
            if v < values[t + 1][option[1]]:
                values[t + 1][option[1]] = v
                back[t + 1][option[1]] = option
    out, state = [], exit_
    for t in range(len(roles), 0, -1):
        option = back[t][state]
        out.append((option[0], option[3], option[4]))
        state = option[0]
    return out[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, from sorted batches."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def format_chats(conversations: DataFrame, how: Repair | None = None) -> DataFrame:
    """Repair and render conversations (conv_id, turn, role, text).

    Turns are taken in order of ``turn``. Dynamic programming over the automaton of ``legal``
    chooses, at least total cost, what becomes of each turn: kept, relabelled, merged into the one
    before, or preceded by an empty turn of the missing role; the end is completed with empty
    turns. Of equal costs, fewer output turns win, then the order of ``choices``.

    Long conversations are cut into fragments. A first pass reduces each to a 4 x 4 matrix of least
    values between states; a second chains the matrices of a conversation (one short row for each
    ``fragment`` turns) and settles the states at the cuts; a third repairs every fragment alone.
    The result is that of one pass over the whole, and no task holds more than a fragment's turns.

    Returns one row per input turn or inserted turn: conv_id, out_turn (from 0), piece (order of
    the rows of a conversation), role, text, action (keep, relabel, merge, merge_relabel, insert)
    and rendered: the concatenation by piece is the chat. Defined cases: roles are compared in
    lower case without blanks around, null or other ones are unknown and get the cheapest legal
    role; a null text is empty; equal turns are taken in input order; a null conv_id is a
    conversation of its own; a null turn comes first; other columns are ignored; an empty table
    gives no rows.
    """
    small_batches(conversations.sparkSession)
    how = how or Repair()
    options = {role: choices(role, how) for role in range(-1, 3)}
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    ranged = conversations.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("tie")
    ).repartitionByRange("conv_id", "turn", "tie")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "chat-ranges")
    place = W.partitionBy("part", "conv_id").orderBy("turn", "tie")
    cut = written(
        ranged.withColumn("frag", F.floor((F.row_number().over(place) - 1) / how.fragment).cast("int")), "chat-fragments"
    )
    keys = ["conv_id", "part", "frag"]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in _groups(batches, keys):
            out.append((*key, len(rows), fragment_matrix([role_number(r["role"]) for r in rows], options).ravel().tolist()))
            if len(out) == 5_000:
                yield _table(out, [*keys, "n", "values"], reduced_types)
                out = []
        yield _table(out, [*keys, "n", "values"], reduced_types)

    arrow_id = _arrow_id(conversations)
    reduced_types = [arrow_id, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    matrices = (
        cut.select(*keys, "turn", "tie", "role")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "turn", "tie")
        .mapInArrow(reduced, f"conv_id {id_type}, part int, frag int, n long, values array<bigint>")
    )

    settled_types = [arrow_id, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
    settled_names = ["conv_id", "part", "frag", "entry", "exit", "turns_before", "is_last"]

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv,), rows in _groups(batches, ["conv_id"]):
            steps = [np.array(r["values"], np.int64).reshape(4, 4) for r in rows]
            ahead = [np.array(closing(how), np.int64)]  # least value from each state to the end
            for m in reversed(steps):
                ahead.append((m + ahead[-1][None, :]).min(1))
            ahead = ahead[::-1]
            state, turns = START, 0
            for k, (row, m) in enumerate(zip(rows, steps, strict=True)):
                entry, state = state, int((m[state] + ahead[k + 1]).argmin())
                made = int(m[entry, state] % _COST)
                out.append((conv, row["part"], row["frag"], entry, state, turns, k == len(rows) - 1))
                turns += made
            if len(out) > 5_000:
                yield _table(out, settled_names, settled_types)
                out = []
        yield _table(out, settled_names, settled_types)

    states = (
        matrices.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "frag")
        .mapInArrow(
            settled,
            f"conv_id {id_type}, part int, frag int, entry int, exit int, turns_before long, is_last boolean",
        )
        .withColumnsRenamed({"conv_id": "conv_", "part": "part_", "frag": "frag_"})
    )
    names = ["conv_id", "out_turn", "piece", "role", "text", "action", "rendered"]
    types = [arrow_id, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, part, frag), rows in _groups(batches, keys):
            first = rows[0]
            path = best_path([role_number(r["role"]) for r in rows], first["entry"], first["exit"], options)
            turn = first["turns_before"] - 1
            # Rows of a conversation in order: the part, the fragment, and three places a turn.
            piece = (part << 40) + frag * (3 * how.fragment + 3)
            for at, (row, (state, role, kind)) in enumerate(zip(rows, path, strict=True)):
                text, known = row["text"] or "", role_number(row["role"])
                here = piece + 3 * at
                if kind == 2:
                    turn += 1
                    missing = ROLES[2] if role == 1 else ROLES[1]
                    out.append((conv, turn, here, missing, "", "insert", _open(missing, turn, how)))
                if kind == 1:
                    out.append((conv, turn, here + 1, ROLES[role], text, "merge" if role == known else "merge_relabel", how.join + text))
                else:
                    turn += 1
                    out.append((conv, turn, here + 1, ROLES[role], text, "keep" if role == known else "relabel", _open(ROLES[role], turn, how) + text))
            if first["is_last"]:
                here = piece + 3 * len(rows)
                for missing in {SYSTEM: ROLES[1:], USER: ROLES[2:]}.get(first["exit"], ()):
                    turn += 1
                    out.append((conv, turn, here, missing, "", "insert", _open(missing, turn, how)))
                    here += 1
                out[-1] = (*out[-1][:6], out[-1][6] + how.end)
            if len(out) > 2_000:
                yield _table(out, names, types)
                out = []
        yield _table(out, names, types)

    return (
        cut.join(
            states,
            F.col("conv_id").eqNullSafe(F.col("conv_"))
            & (F.col("part") == F.col("part_"))
            & (F.col("frag") == F.col("frag_")),
        )
        .select(*keys, "turn", "tie", "role", "text", "entry", "exit", "turns_before", "is_last")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "turn", "tie")
        .mapInArrow(
            repaired,
            f"conv_id {id_type}, out_turn long, piece long, role string, text string, action string, rendered string",
        )
    )


def _open(role: str, turn: int, how: Repair) -> str:
    return (how.end if turn else "") + how.header.format(role=role)


def _arrow_id(conversations: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(conversations.schema["conv_id"].dataType)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
