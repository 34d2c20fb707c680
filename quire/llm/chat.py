"""Chat formatting with minimum-cost role repair.

Legal conversations: an optional system turn, then user and assistant turns in alternation, the assistant
last. The turns of a conversation run through an automaton whose state is the role of the last open turn.
Each turn may keep its role, take another (RELABEL), or be merged into the open turn (MERGE, plus RELABEL if
the roles differ); before it, and at the end, empty turns may be inserted (INSERT each). Dynamic programming
finds the cheapest way; among equal ways the first in the order keep, merge, relabel, insert wins, turn by
turn. Unknown and null roles can only be relabelled or merged.

Conversations of more than CHUNK turns are numbered in order by a range sort and cut into chunks of CHUNK turns;
one task's chunks of a conversation are a piece. A chunk is a matrix: the least cost from each state before it to
each state after it. Matrices are multiplied up to pieces, a backward pass over the pieces and then over the
chunks of each gives every chunk the cost that remains behind it, and with that the chunk's own task finds for
each state before it the state after it, turn by turn. These maps are composed in the same way, forward, and give
every chunk the state in which it begins; then each is rendered on its own. So the result does not depend on
CHUNK. Tasks hold one chunk of turns, one piece of matrices, or one row a piece of a conversation.

Result: one row per conversation and chunk (nearly always one), chunks numbered from 0, in this order the parts of
the rendered conversation, with the repairs counted. Where a conversation is cut may differ from run to run; the
parts joined do not.

Defined cases: turns are ordered by turn, then role, then text (nulls first); repeated rows are turns of
their own; null text is empty text; a null conv_id is a conversation; a null turn comes first. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import materialise, partitions, small

CHUNK = 256
#: Characters of a text that decide to which task a turn of a long conversation goes.
PREFIX = 1000
MERGE, RELABEL, INSERT = 1, 2, 3
ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, NO = 4, 1 << 40
#: The roles that may follow each state.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
FIELDS = "conv_id bigint, chunk bigint, turns int, merged int, relabelled int, inserted int, cost bigint, rendered string"


def role_state(role: str | None) -> int:
    """The state of a turn with this role, 0 if it has none of the known names."""
    told = (role or "").strip().lower()
    told = ALIASES.get(told, told)
    return ROLES.index(told) + 1 if told in ROLES else 0


@lru_cache(maxsize=None)
def inserts(a: int, b: int) -> tuple[int, ...] | None:
    """The fewest empty turns after state a, so that a turn of role b may follow; None if none do."""
    found, reach = {a: ()}, [a]
    for s in reach:
        if b in FOLLOWS[s]:
            return found[s]
        for n in FOLLOWS[s]:
            if n not in found:
                found[n] = (*found[s], n)
                reach.append(n)
    return None


@lru_cache(maxsize=None)
def choices(state: int, role: int) -> tuple[tuple[int, int, int, str], ...]:
    """(cost, place in the order of preference, next state, what is done) for a turn met in a state."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        gap = inserts(state, to)
        if gap is None:
            continue
        same = to == role
        rank = 3 if gap else 0 if same else 2
        out.append((INSERT * len(gap) + (0 if same else RELABEL), rank, to, "keep" if same else "relabel"))
    if state != START:
        out.append((MERGE + (0 if role == state else RELABEL), 1, state, "merge"))
    return tuple(sorted(out, key=lambda x: (x[1], x[0], x[2])))


def ending(state: int) -> tuple[int, ...]:
    """The empty turns that close a conversation."""
    return {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


END_COST = tuple(INSERT * len(ending(s)) for s in range(STATES))


def matrix(roles: Sequence[int]) -> list[int]:
    """Least costs from each state to each state over these turns, row by row."""
    rows = []
    for s in range(STATES):
        costs = [0 if x == s else NO for x in range(STATES)]
        for r in roles:
            after = [NO] * STATES
            for x, c in enumerate(costs):
                if c < NO:
                    for cost, _, to, _ in choices(x, r):
                        after[to] = min(after[to], c + cost)
            costs = after
        rows += costs
    return rows


def product(m: Sequence[int], n: Sequence[int]) -> list[int]:
    """Least costs over the turns of m and then those of n."""
    return [min(min(m[s * STATES + x] + n[x * STATES + t] for x in range(STATES)), NO) for s in range(STATES) for t in range(STATES)]


def best_start(m: Sequence[int], rest: Sequence[int]) -> list[int]:
    """Cost from each state before a chunk to the end, given the costs from each state after it."""
    return [min(min(m[s * STATES + x] + rest[x] for x in range(STATES)), NO) for s in range(STATES)]


def repair(roles: Sequence[int], state: int, rest: Sequence[int]) -> tuple[list[tuple[str, int, tuple[int, ...]]], int]:
    """What is done with each turn from this state on: (deed, state after, inserted before), and the last state.

    rest: the cost to the end of the conversation from each state after these turns.
    """
    to_go = [list(rest)]
    for r in reversed(roles):
        to_go.append([min((c + to_go[-1][to] for c, _, to, _ in choices(s, r)), default=NO) for s in range(STATES)])
    to_go.reverse()
    deeds = []
    for k, r in enumerate(roles):
        cost, _, to, deed = next(x for x in choices(state, r) if x[0] + to_go[k + 1][x[2]] == to_go[k][state])
        deeds.append((deed, to, () if deed == "merge" else inserts(state, to)))
        state = to
    return deeds, state


def render(turns: Sequence[tuple[int, str]], state: int, rest: Sequence[int], last: bool) -> dict:
    """The piece of the rendered conversation that these turns (role, text) give, and the counts."""
    deeds, end = repair([r for r, _ in turns], state, rest)
    out, counts, cost = [], {"merge": 0, "relabel": 0, "insert": 0}, 0

    def begin(role: int, text: str) -> None:
        nonlocal state
        out.append(("" if state == START else "\n" + CLOSE) + OPEN.format(ROLES[role - 1]) + text)
        state = role

    for (role, text), (deed, to, gap) in zip(turns, deeds, strict=True):
        for x in gap:
            begin(x, "")
        counts["insert"] += len(gap)
        changed = role != to
        counts["relabel"] += changed
        cost += INSERT * len(gap) + RELABEL * changed + MERGE * (deed == "merge")
        if deed == "merge":
            counts["merge"] += 1
            out.append("\n" + text)
        else:
            begin(to, text)
    if last:
        for x in ending(end):
            begin(x, "")
        counts["insert"] += len(ending(end))
        cost += INSERT * len(ending(end))
        out.append("" if state == START else "\n" + CLOSE)
    return {"merged": counts["merge"], "relabelled": counts["relabel"], "inserted": counts["insert"], "cost": cost, "rendered": "".join(out)}


def _runs(batches: Iterable[pa.RecordBatch], key: Sequence[str], values: Sequence[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with one key, in the order in which they come."""
    now, held = None, []
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in key), strict=True)
        for k, v in zip(keys, zip(*(batch.column(c).to_pylist() for c in values), strict=True), strict=True):
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(v)
    if held:
        yield now, held


def _by_run(df: DataFrame, key: list[str], order: list[Column], work: Callable[[tuple, list[tuple]], Iterable[tuple]], fields: str, size: int = 1 << 20) -> DataFrame:
    """Rows (a tuple of fields each) that work(key, rows) gives for each run of rows with one key, in order; rows are tuples of the columns beyond the key."""
    schema = to_arrow_schema(StructType.fromDDL(fields))
    values = [c for c in df.columns if c not in key]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for k, rows in _runs(batches, key, values):
            for row in work(k, rows):
                held.append(row)
                n += 200 + (len(row[-1]) if isinstance(row[-1], str) else 0)
                if n > size:
                    yield batch(held)
                    held, n = [], 0
        if held:
            yield batch(held)

    return df.repartition(*key).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in key], *order).mapInArrow(run, fields)


def _rendered(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """FIELDS of a chunk; its plan (kind 0: number, state, rest, last), if it has one, comes before its turns."""
    nth, state, rest, last = rows[0][-4:] if rows[0][0] == 0 else (0, START, END_COST, True)
    turns = [(role_state(r[2]), r[3]) for r in rows if r[0]]
    piece = render(turns, state, rest, last)
    yield key[0], nth, len(turns), *piece.values()


def _plans(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, nth, state, rest, last of each chunk of turns: where it stands and in which state it begins."""
    key, up, down = ["conv_id", "piece"], F.col("chunk").asc(), F.col("chunk").desc()
    told = lambda df, kind, *more: df.select(*key, *more, F.lit(kind).alias("kind"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)

    def matrices(k, rows):
        roles = [role_state(r) for _, r in rows]
        yield *k, matrix(roles), bytes(roles)

    chunks = _by_run(turns.select(*key, "chunk", "place", "role"), [*key, "chunk"], [F.col("place").asc()], matrices, "conv_id bigint, piece bigint, chunk bigint, m array<bigint>, roles binary")
    chunks = materialise(chunks, "chat-chunks")

    def multiplied(k, rows):
        yield *k, reduce(product, (m for _, m in rows))

    pieces = _by_run(chunks.select(*key, "chunk", "m"), key, [up], multiplied, "conv_id bigint, piece bigint, m array<bigint>")

    def backward(k, rows):
        rest, last = list(END_COST), True
        for piece, m in rows:
            yield k[0], piece, rest, last
            rest, last = best_start(m, rest), False

    rests = _by_run(pieces, ["conv_id"], [F.col("piece").desc()], backward, "conv_id bigint, piece bigint, rest array<bigint>, last boolean")

    def ended(k, rows):
        (_, _, _, _, rest, last), *own = rows
        for _, chunk, m, roles, *_ in own:
            yield *k, chunk, rest, last, [repair(roles, s, rest)[1] for s in range(STATES)]
            rest, last = best_start(m, rest), False

    both = told(rests, 0, none("chunk", "bigint"), none("m", "array<bigint>"), none("roles", "binary"), "rest", "last").unionByName(told(chunks, 1, "chunk", "m", "roles", none("rest", "array<bigint>"), none("last", "boolean")))
    both = both.select(*key, "kind", "chunk", "m", "roles", "rest", "last")
    ends = _by_run(both, key, [F.col("kind").asc(), down], ended, "conv_id bigint, piece bigint, chunk bigint, rest array<bigint>, last boolean, ends array<bigint>")
    ends = materialise(ends, "chat-ends")

    def composed(k, rows):
        yield *k, len(rows), reduce(lambda a, b: [b[x] for x in a], (e for _, e in rows))

    ways = _by_run(ends.select(*key, "chunk", "ends"), key, [up], composed, "conv_id bigint, piece bigint, n bigint, ends array<bigint>")

    def forward(k, rows):
        state, nth = START, 0
        for piece, n, to in rows:
            yield k[0], piece, nth, state
            state, nth = to[state], nth + n

    starts = _by_run(ways, ["conv_id"], [F.col("piece").asc()], forward, "conv_id bigint, piece bigint, nth bigint, state bigint")

    def planned(k, rows):
        (_, _, _, _, _, nth, state), *own = rows
        for _, chunk, rest, last, to, *_ in own:
            yield k[0], chunk, nth, state, rest, last
            nth, state = nth + 1, to[state]

    both = told(starts, 0, none("chunk", "bigint"), none("rest", "array<bigint>"), none("last", "boolean"), none("ends", "array<bigint>"), "nth", "state")
    both = both.unionByName(told(ends, 1, "chunk", "rest", "last", "ends", none("nth", "bigint"), none("state", "bigint"))).select(*key, "kind", "chunk", "rest", "last", "ends", "nth", "state")
    return _by_run(both, key, [F.col("kind").asc(), up], planned, "conv_id bigint, chunk bigint, nth bigint, state bigint, rest array<bigint>, last boolean")


def format_chats(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation and chunk: conv_id, chunk, turns, merged, relabelled, inserted, cost, rendered."""
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    many = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select(F.col("conv_id").alias("_conv"))
    many = materialise(many, "long-chats")
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    as_turns = lambda df: df.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    if not many.limit(1).count():
        return _by_run(as_turns(own), ["conv_id"], order, _rendered, FIELDS)
    is_long = F.col("conv_id").eqNullSafe(F.col("_conv"))
    short = _by_run(as_turns(own.join(small(many), is_long, "left_anti")), ["conv_id"], order, _rendered, FIELDS)
    # Equal turns are dealt out at random, as one of them is like the other; the numbers are written once.
    salt = F.when(F.length("text") <= PREFIX, F.rand(7)).otherwise(2.0)
    long_ = own.withColumns({"prefix": F.substring("text", 1, PREFIX), "salt": salt}).join(small(many), is_long, "left_semi")
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    dealt = long_.repartitionByRange(partitions(own.sparkSession), *by, "prefix", "salt").sortWithinPartitions(*by, "text")
    numbered = dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place"))
    numbered = numbered.withColumns({"piece": F.shiftright("place", 33), "chunk": F.floor(F.col("place") / chunk).cast("long")})
    numbered = materialise(numbered, "turns")
    plans = _plans(numbered)
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    ready = numbered.select("conv_id", "chunk", F.lit(1).alias("kind"), "place", "role", "text", none("nth", "bigint"), none("state", "bigint"), none("rest", "array<bigint>"), none("last", "boolean"))
    ready = ready.unionByName(plans.select("conv_id", "chunk", F.lit(0).alias("kind"), none("place", "bigint"), none("role", "string"), none("text", "string"), "nth", "state", "rest", "last"))
    return short.unionByName(_by_run(ready, ["conv_id", "chunk"], [F.col("kind").asc(), F.col("place").asc()], _rendered, FIELDS))
