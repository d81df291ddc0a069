"""Conversation structure repair by weighted finite-state composition.

A conversation is an acceptor of its rows in order, the edits are a transducer
(keep, rerole, delete, insert, with costs), the allowed role sequences an acceptor
of role initials. Their composition is never built: states (row, grammar state)
come up as paths reach them, in the order of the rows, insertions within a row
after its other edits. A path's weight is (cost, edit initials, role initials),
compared in this order. Weights of paths to one state with equal costs never have
initials of which one begins the other (an insertion always costs), so comparing
them early is right.

Conversations of any length run on bounded memory. Rows are sorted by ranges and
streamed into blocks of at most ``block_rows`` rows; a block becomes the best
weights from every entry state to every exit state, one pass over the blocks of a
conversation finds the states between them, and the blocks' edits are then
applied one by one. Blocks of equal symbols are composed once a worker.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import materialise

BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
DELETED = "-"


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of role initials: (state, initial, next state) arcs, state 0 is the first."""

    arcs: tuple[tuple[int, str, int], ...]
    accepting: tuple[int, ...]

    @property
    def states(self) -> int:
        return 1 + max([0, *self.accepting, *(s for a in self.arcs for s in (a[0], a[2]))])


@dataclass(frozen=True)
class Costs:
    """All above 0. ``truncated`` is added for each truncated row that stays."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


#: (s?(ua)+)?
DIALOGUE = Grammar(((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)), (0, 3))
#: Roles that rows can get, by their initials.
ROLES = {"u": "user", "a": "assistant"}

GOOD, TRUNCATED, SPOILT = "g", "t", "x"
Weight = tuple[int, str, str]


@functools.lru_cache(maxsize=1 << 14)
def compose(symbols: tuple[tuple[str, str], ...], first: bool, grammar: Grammar, costs: Costs, given: tuple[str, ...]) -> tuple[tuple[int, int, int, str, str], ...]:
    """(entry state, exit state, cost, edits, roles) of the best path through rows of (initial, condition) for each pair of states.

    first: the rows begin a conversation, so that state 0 is the only entry.
    Insertions may come before the rows, too; between two blocks that is one path
    found twice.
    """
    steps: dict[tuple[int, str], int] = {(a, x): b for a, x, b in grammar.arcs}
    inserts = [(a, x, b) for a, x, b in grammar.arcs if x in given]

    def better(reached: dict[int, Weight], state: int, weight: Weight) -> bool:
        if state in reached and reached[state] <= weight:
            return False
        reached[state] = weight
        return True

    def insert(reached: dict[int, Weight]) -> dict[int, Weight]:
        changed = True
        while changed:  # ends, as every insertion costs
            changed = False
            for a, x, b in inserts:
                if a in reached:
                    cost, edits, roles = reached[a]
                    changed |= better(reached, b, (cost + costs.insert, edits + "I", roles + x))
        return reached

    out = []
    for entry in [0] if first else range(grammar.states):
        reached: dict[int, Weight] = insert({entry: (0, "", "")})
        for initial, condition in symbols:
            now, extra = reached, costs.truncated if condition == TRUNCATED else 0
            reached = {}
            for state, (cost, edits, roles) in now.items():
                better(reached, state, (cost + costs.delete, edits + "D", roles + DELETED))
                if condition == SPOILT:
                    continue
                if (state, initial) in steps:
                    better(reached, steps[state, initial], (cost + extra, edits + "K", roles + initial))
                for x in given:
                    if (state, x) in steps:
                        better(reached, steps[state, x], (cost + extra + costs.rerole, edits + "R", roles + x))
            insert(reached)
        out += [(entry, state, *weight) for state, weight in sorted(reached.items())]
    return tuple(out)


SUMMARY = (
    "conversation string, part long, block long, first boolean, n_rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "low long, high long, turns long, first_turn long, last_turn long, paths array<struct<entry:int,exit:int,cost:long,edits:string,roles:string>>, roles array<string>, texts array<string>"
)
_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string()), ("roles", pa.string())]))
_BLOCKS = pa.schema(
    [("conversation", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("first", pa.bool_()), *[(c, pa.int64()) for c in ("n_rows", "blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string())]
    + [(c, pa.int64()) for c in ("low", "high", "turns", "first_turn", "last_turn")]
    + [("paths", _PATHS), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)


def _legal(grammar: Grammar) -> frozenset[str]:
    """Pairs of initials that follow each other on some path."""
    return frozenset(x + y for _, x, b in grammar.arcs for a, y, _ in grammar.arcs if a == b)


def _blocks(grammar: Grammar, costs: Costs, roles: dict[str, str], block_rows: int, block_bytes: int):
    """Blocks of sorted rows (conversation, turn, role, text, earliest turn of the same, blank, whole)."""
    given, legal = tuple(sorted(roles)), _legal(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []
        conversation, number, began = None, 0, False  # began: the conversation's first row is here for sure
        rows: list[tuple] = []
        size, last, any_rows = 0, None, False

        def close() -> None:
            nonlocal rows, size, number
            if not rows:
                return
            counts = {c: 0 for c in ("blank", "duplicate", "truncated")}
            symbols = []
            for _, role, _, fault in rows:
                if fault:
                    counts[fault] += 1
                symbols.append((role[:1], TRUNCATED if fault == "truncated" else SPOILT if fault else GOOD))
            initials = [s for s, _ in symbols]
            turns = [r[0] for r in rows if r[0] is not None]
            first = began and number == 0
            out.append(
                {
                    "conversation": conversation, "part": part, "block": number, "first": first, "n_rows": len(rows), **counts,
                    "illegal": sum(x + y not in legal for x, y in zip(initials, initials[1:], strict=False)), "head": initials[0], "tail": initials[-1],
                    "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                    "paths": [dict(zip(("entry", "exit", "cost", "edits", "roles"), p, strict=True)) for p in compose(tuple(symbols), first, grammar, costs, given)],
                    "roles": [r[1] for r in rows], "texts": [r[2] for r in rows],
                }
            )
            rows, size, number = [], 0, number + 1

        def flush() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_pylist(out, _BLOCKS)
            out = []
            return batch

        held = 0
        for batch in batches:
            for name, turn, role, text, earlier, known, blank, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not any_rows or name != conversation:
                    close()
                    conversation, number, began, last, any_rows = name, 0, any_rows, None, True
                same = (turn, role, text)
                # rows that repeat in one turn are neighbours; an earlier turn of the same role and text is known
                again = same == last or (known and (earlier is None) != (turn is None)) or (known and turn is not None and earlier is not None and earlier < turn)
                last = same
                fault = "blank" if blank else "duplicate" if again else None if whole else "truncated"
                rows.append((turn, role, text, fault))
                size += len(text) + len(role)
                held += len(text) + len(role) + 400
                if len(rows) >= block_rows or size >= block_bytes:
                    close()
                if held >= block_bytes and out:
                    yield flush()
                    held = 0
        close()
        if out:
            yield flush()

    return run


_CHOSEN = pa.schema(
    [("conversation", pa.string()), *[(c, pa.int64()) for c in ("part", "block")], ("edits", pa.string()), ("roles", pa.string())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)
CHOSEN = "conversation string, part long, block long, edits string, roles string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _common(strings: Sequence[str]) -> int:
    """Length of what all strings begin with."""
    low, high = min(strings), max(strings)
    return next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))


class _Course:
    """The best paths so far through the blocks of one conversation: a weight and the choice made in each block for every state."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.said, self.legal = grammar, [], _legal(grammar)
        self.now: dict[int, tuple[int, str]] = {0: (0, "")}  # what all paths begin with is kept in said
        self.blocks: list[tuple[int, int, dict[int, tuple[int, str, str]]]] = []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.tail = self.turn = None

    def add(self, b: dict) -> None:
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            self.sums[c] += b[c]
        if self.tail is not None:
            self.sums["illegal"] += self.tail + b["head"] not in self.legal
        if b["low"] is not None:
            self.low = b["low"] if self.low is None else min(self.low, b["low"])
            self.high = b["high"] if self.high is None else max(self.high, b["high"])
            self.sums["turns"] -= self.turn == b["first_turn"]
            self.turn = b["last_turn"]
        self.tail = b["tail"]
        reached, choice = {}, {}
        for p in b["paths"]:
            if p["entry"] in self.now:
                cost, before = self.now[p["entry"]]
                weight = (cost + p["cost"], before + p["edits"])
                if p["exit"] not in reached or weight < reached[p["exit"]]:
                    reached[p["exit"]] = weight
                    choice[p["exit"]] = (p["entry"], p["edits"], p["roles"])
        shared = _common([s for _, s in reached.values()])
        if shared:
            self.said.append(next(iter(reached.values()))[1][:shared])
        self.now = {k: (cost, s[shared:]) for k, (cost, s) in reached.items()}
        self.blocks.append((b["part"], b["block"], choice))

    def end(self) -> tuple[list[tuple[int, int, str, str]], dict]:
        """(part, block, edits, roles) of each block, and what is said of the conversation."""
        cost, rest, state = min((*w, k) for k, w in self.now.items() if k in self.grammar.accepting)
        out = []
        for part, block, choice in reversed(self.blocks):
            state, edits, roles = choice[state]
            out.append((part, block, edits, roles))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums.pop("turns")
        self.sums.pop("turns", None)
        return out[::-1], {"gaps": gaps, **self.sums, "cost": cost, "audit": "".join(self.said) + rest}


def _choose(grammar: Grammar):
    """The edits of every block, from blocks sorted by conversation, part and number; what is said of a conversation stands with its last block."""
    names = ["conversation", "part", "block", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns", "first_turn", "last_turn", "paths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        course, conversation, out = None, None, []

        def close() -> None:
            if course:
                blocks, said = course.end()
                for k, (part, block, edits, roles) in enumerate(blocks):
                    row = {"conversation": conversation, "part": part, "block": block, "edits": edits, "roles": roles}
                    out.append(row | (said if k == len(blocks) - 1 else {}))

        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                b = dict(zip(names, values, strict=True))
                if course is None or b["conversation"] != conversation:
                    close()
                    conversation, course = b["conversation"], _Course(grammar)
                course.add(b)
            if out:
                yield pa.RecordBatch.from_pylist(out, _CHOSEN)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, _CHOSEN)

    return run


def applied(roles: list[str], texts: list[str], edits: str, given_roles: str, names: dict[str, str]) -> list[tuple[str, str]]:
    """The rows (role, text) that edits leave."""
    out, at = [], 0
    for edit, initial in zip(edits, given_roles, strict=True):
        if edit == "I":
            out.append((names[initial], ""))
            continue
        if edit != "D":
            out.append((roles[at] if edit == "K" else names[initial], texts[at]))
        at += 1
    return out


def _repaired(names: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, roles, texts, edits, given = batch.columns
            said = [applied(*row, names) for row in zip(roles.to_pylist(), texts.to_pylist(), edits.to_pylist(), given.to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*keys, pa.array([[{"role": r, "text": t} for r, t in rows] for rows in said], kind)], ["conversation", "part", "block", "turns"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, from its blocks in order."""
    conversation, state, empty, out = None, None, True, []
    kind = pa.schema([("conversation", pa.string()), ("sha256", pa.string())])
    for batch in batches:
        for name, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or name != conversation:
                if state is not None:
                    out.append({"conversation": conversation, "sha256": state.hexdigest()})
                conversation, state, empty = name, hashlib.sha256(), True
            for t in turns:
                state.update(("" if empty else "\n").encode() + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                empty = False
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)
            out = []
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"conversation": conversation, "sha256": state.hexdigest()}], kind)


@dataclass
class Repair:
    """What became of conversations: ``summary`` has a row for each, ``turns`` its repaired rows by block."""

    summary: DataFrame
    turns: DataFrame

    def digests(self) -> DataFrame:
        """(conversation, sha256) of the repaired ``role:text`` lines, newline-joined."""
        rows = self.turns.repartition("conversation").sortWithinPartitions("conversation", "part", "block")
        return rows.select("conversation", "turns").mapInArrow(_hashed, "conversation string, sha256 string")


def named(conversation: Column) -> Column:
    """The name of a conversation in the results: ``=`` and its identifier, empty for null."""
    return F.coalesce(F.concat(F.lit("="), conversation.cast("string")), F.lit(""))


NO_BLANK = r"[^\x20\x09-\x0D]"


def repair(rows: DataFrame, *, conversation: Column, turn: Column, role: Column, text: Column, grammar: Grammar = DIALOGUE, costs: Costs = Costs(), roles: dict[str, str] | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> Repair:
    """Find and mend faults of conversations at the least cost.

    Rows are taken by turn, nulls first, then by role and text, bytewise; a null
    role or text counts as one space, a null conversation is one of its own. A
    row's first fault counts: blank (only blanks), duplicate (role and text seen
    earlier in the conversation, so of rows that repeat all but the first),
    truncated (the last character that isn't blank is none of ``.!?``). Blank and
    duplicate rows must go, an empty role can't be kept; insertions have an empty text. Of the cheapest edits
    that give initials of the grammar, the ASCII-least stand. Texts of any length
    are taken whole, a conversation may hold any share of the rows; an empty table
    has no conversations. Columns are read through the four expressions only.

    ``summary``: conversation (as ``named``), gaps (turns missing between the least and the largest), blank, duplicate,
    truncated, illegal (neighbours whose initials never follow each other), cost,
    audit. ``turns``: conversation, part, block, turns (role, text), in order of
    part and block.
    """
    names = ROLES if roles is None else roles
    if min(costs.rerole, costs.delete, costs.insert) <= 0 or costs.truncated < 0:
        raise ValueError("edits cost more than 0")
    flat = rows.select(
        named(conversation).alias("conversation"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text")
    )
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    flat = materialise(flat.withColumn("same", F.unhex(same)), "turns")
    # turns of what is said more than once; the least, where null comes first
    seen = flat.groupBy("conversation", "same").agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.count_if(F.col("turn").isNull()).alias("unknown"))
    repeated = seen.where("n > 1").select("conversation", "same", F.when(F.col("unknown") == 0, F.col("least")).alias("earlier"), F.lit(True).alias("known"))
    told = flat.join(repeated, ["conversation", "same"], "left")
    tail = F.regexp_extract("text", rf"({NO_BLANK})[\x20\x09-\x0D]*\z", 1)
    told = told.select("conversation", "turn", "role", "text", "earlier", F.coalesce("known", F.lit(False)).alias("known"), (tail == "").alias("blank"), tail.isin(".", "!", "?").alias("whole"))
    order = ["conversation", F.col("turn").asc_nulls_first(), "role", "text"]
    blocks = materialise(told.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(grammar, costs, names, block_rows, block_bytes), SUMMARY), "turn-blocks")
    slim = blocks.drop("first", "n_rows", "roles", "texts").repartition("conversation").sortWithinPartitions("conversation", "part", "block")
    chosen = materialise(slim.mapInArrow(_choose(grammar), CHOSEN), "turn-edits")
    edits = chosen.select("conversation", "part", "block", F.col("edits").alias("_edits"), F.col("roles").alias("_roles"))
    turns = blocks.select("conversation", "part", "block", "roles", "texts").join(edits, ["conversation", "part", "block"])
    turns = turns.mapInArrow(_repaired(names), "conversation string, part long, block long, turns array<struct<role:string,text:string>>")
    summary = chosen.where("audit IS NOT NULL").drop("part", "block", "edits", "roles")
    return Repair(summary, turns)
