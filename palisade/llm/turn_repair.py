"""Repair of conversation structure by a generalised LR parser.

Roles must follow the grammar S -> empty | D | s D; D -> D P | P; P -> u a (system, user, assistant by initials). Its SLR(1) table is built here.
The parser keeps a graph-structured stack: stacks share their lower parts, and equal tops are merged by minimum (cost, audit). A row is kept (0),
rerolled to user or assistant (1), or deleted (2); a user or assistant turn with an empty text can be inserted before any row and at the end (5). Blank
rows and duplicates must be deleted; a truncated row that stays adds 5. The grammar is left recursive, so only a few stacks exist and a row costs
a constant amount of work.

Nothing holds a whole conversation in one group. Rows are dealt by range of (conversation, turn, role, text), exact copies counted first; a task streams
over its sorted rows. A conversation inside one range is parsed at once. Of one that goes over several ranges each part is parsed from every
possible stack top into a small table of (top before, top after, cost, audit); the tables are joined in order, and its texts flow through one
sorted stream for the hash alone, which SHA-256 makes sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, _parse_datatype_string

from palisade.llm.common import save, shared_dir

GRAMMAR = (("S", ()), ("S", ("D",)), ("S", ("s", "D")), ("D", ("D", "P")), ("D", ("P",)), ("P", ("u", "a")))
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
ROWS_PER_RANGE = 20_000
HELD = 32_000_000  # code points of a conversation that a task holds at most
BLANK = "[^\\x20\\x09-\\x0D]"
NO_TEXT = hashlib.sha256(b"").hexdigest()


def slr_table(grammar=GRAMMAR, start: str = "S", end: str = "$") -> tuple[list[dict], list[dict], list[dict]]:
    """(shifts, reductions, gotos) per state: symbol -> state, look-ahead -> rule, symbol -> state. Raises if a look-ahead leaves a choice."""
    left = {lhs for lhs, _ in grammar}
    empty = {lhs for lhs, rhs in grammar if not rhs}

    def starts(symbol: str, seen: frozenset = frozenset()) -> set:
        if symbol not in left:
            return {symbol}
        return set().union(*(starts(rhs[0], seen | {symbol}) for lhs, rhs in grammar if lhs == symbol and rhs and rhs[0] not in seen | {symbol}))

    follow: dict[str, set] = {x: set() for x in left}
    follow[start].add(end)
    size = -1
    while size != (size := sum(map(len, follow.values()))):
        for lhs, rhs in grammar:
            for i, x in enumerate(rhs):
                if x in left:
                    follow[x] |= starts(rhs[i + 1]) if i + 1 < len(rhs) else follow[lhs]
                    if i + 1 < len(rhs) and rhs[i + 1] in empty:
                        follow[x] |= follow[lhs]

    def closure(items: set) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            rhs = grammar[rule][1] if rule >= 0 else (start,)
            if dot < len(rhs) and rhs[dot] in left:
                for i, (lhs, _) in enumerate(grammar):
                    if lhs == rhs[dot] and (i, 0) not in items:
                        items.add((i, 0))
                        todo.append((i, 0))
        return frozenset(items)

    states, shifts, reductions, gotos = [closure({(-1, 0)})], [], [], []
    for state in states:
        moves: dict[str, set] = {}
        reduce: dict[str, int] = {}
        for rule, dot in state:
            rhs = grammar[rule][1] if rule >= 0 else (start,)
            if dot < len(rhs):
                moves.setdefault(rhs[dot], set()).add((rule, dot + 1))
            elif rule >= 0:
                for look in follow[grammar[rule][0]]:
                    if look in reduce:
                        raise ValueError(f"two reductions at {look}")
                    reduce[look] = rule
        targets = {}
        for symbol, items in sorted(moves.items()):
            target = closure(items)
            if target not in states:
                states.append(target)
            targets[symbol] = states.index(target)
        if set(reduce) & set(targets):
            raise ValueError("shift and reduction at the same look-ahead")
        shifts.append({x: t for x, t in targets.items() if x not in left})
        gotos.append({x: t for x, t in targets.items() if x in left})
        reductions.append(reduce)
    return shifts, reductions, gotos


class Stacks:
    """The graph-structured stack: a node is (LR state, node below) and exists once, so equal tops are one number."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = grammar
        self.shifts, self.reductions, self.gotos = slr_table(grammar)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.numbers = {(0, -1): 0}
        self.terminals = sorted({x for s in self.shifts for x in s})
        self.after: dict[int, dict[str, int]] = {}  # per top that a row can leave: terminal -> top
        todo = [0]
        while todo:
            top = todo.pop()
            if top not in self.after:
                self.after[top] = {t: n for t in self.terminals if (n := self._shift(top, t)) is not None}
                todo += self.after[top].values()
        self.accepts = {top: self._reduced(top, "$") == -2 for top in self.after}

    def _push(self, state: int, below: int) -> int:
        if (state, below) not in self.numbers:
            self.numbers[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.numbers[state, below]

    def _reduced(self, node: int, look: str, only_sure: bool = False) -> int:
        """Top after all reductions for a look-ahead (-2: accepted). only_sure: while the state has nothing but one reduction."""
        while (rules := self.reductions[self.nodes[node][0]]) and (not only_sure or not self.shifts[self.nodes[node][0]]):
            rule = next(iter(rules.values())) if only_sure else rules.get(look)
            if rule is None or (only_sure and self.grammar[rule][0] == "S"):
                return node
            lhs, rhs = self.grammar[rule]
            for _ in rhs:
                node = self.nodes[node][1]
            if lhs == "S" and node == 0:
                return -2
            node = self._push(self.gotos[self.nodes[node][0]][lhs], node)
        return node

    def _shift(self, node: int, terminal: str) -> int | None:
        node = self._reduced(node, terminal)
        target = self.shifts[self.nodes[node][0]].get(terminal) if node >= 0 else None
        return None if target is None else self._reduced(self._push(target, node), "", only_sure=True)


STACKS = Stacks()
KEEP, DROP, RETYPE, ADD = "K", "D", "R", "I"


@dataclass
class Parse:
    """Tops reached from one top, with cost and audit. Audits are kept as (step before, letters): steps are shared between tops."""

    tops: dict[int, tuple[int, int, tuple | None]] = field(default_factory=lambda: {0: (0, 0, None)})

    def _inserted(self) -> dict[int, tuple[int, int, str]]:
        """Tops after any insertions that may help, with (cost, rank of the audit before, letters of this step)."""
        best = {top: (cost, rank, "") for top, (cost, rank, _) in self.tops.items()}
        todo = list(best)
        while todo:
            top = todo.pop()
            cost, rank, letters = best[top]
            for t in NAMES:
                after = STACKS.after[top].get(t)
                way = (cost + INSERT, rank, letters + ADD)
                if after is not None and (after not in best or way < best[after]):
                    best[after] = way
                    todo.append(after)
        return best

    def rows(self, initial: str, fault: str, count: int = 1) -> None:
        """`count` equal rows one after the other; more than one only where they must go."""
        must_go = fault in ("blank", "duplicate")
        if count > 1:  # D comes before I, so of equal cost an insertion stands before the last of them
            self.tops = {top: (cost + DELETE * (count - 1), rank, step) for top, (cost, rank, step) in self.tops.items()}
            seen: dict[int, tuple] = {}
            self.tops = {top: (cost, rank, seen.setdefault(rank, (step, DROP * (count - 1)))) for top, (cost, rank, step) in self.tops.items()}
        kept = TRUNCATED if fault == "truncated" else 0
        found: dict[int, tuple[int, int, str]] = {}

        def way(top: int | None, cost: int, rank: int, letters: str) -> None:
            if top is not None and (top not in found or (cost, rank, letters) < found[top]):
                found[top] = (cost, rank, letters)

        # ranks order the audits so far; two audits at a row's end are never a proper prefix of each other, so letters decide only between equal ones
        for top, (cost, rank, letters) in self._inserted().items():
            way(top, cost + DELETE, rank, letters + DROP)
            if not must_go:
                way(STACKS.after[top].get(initial), cost + kept, rank, letters + KEEP)
                for t in NAMES:
                    way(STACKS.after[top].get(t), cost + kept + REROLE, rank, letters + RETYPE)
        order = {w: i for i, w in enumerate(sorted({(rank, letters) for _, rank, letters in found.values()}))}
        before = {rank: step for _, rank, step in self.tops.values()}
        steps = {w: (before[w[0]], w[1]) for w in order}
        self.tops = {top: (cost, order[rank, letters], steps[rank, letters]) for top, (cost, rank, letters) in found.items()}

    def ends(self) -> dict[int, tuple[int, str]]:
        """top -> (cost, audit)."""
        return {top: (cost, audit_of(step)) for top, (cost, _, step) in self.tops.items()}


def audit_of(step: tuple | None) -> str:
    letters = []
    while step is not None:
        step, last = step
        letters.append(last)
    return "".join(reversed(letters))


def finish(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """Cheapest (cost, audit) over the tops, after insertions at the end, that the grammar accepts."""
    return min((cost + INSERT * len(letters), audit + letters) for top, (cost, audit) in ends.items() for letters in closings(top))


class Repaired:
    """Repaired lines of a conversation into a hash, from its audit and its rows in order. The roles follow from the number of turns that stay."""

    def __init__(self, turns: int, done: int = 0, sha=None):
        self.turns, self.done, self.sha = turns, done, sha or hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.done else ''}{role}:{text}".encode("utf-8", "replace"))
        self.done += 1

    def _role(self) -> str:
        return NAMES["ua"[(self.done - self.turns % 2) % 2]]

    def step(self, letters: str, row: tuple[str, str] | None) -> None:
        for x in letters:
            if x == ADD:
                self._line(self._role(), "")
            elif x == RETYPE:
                self._line(self._role(), row[1])
            elif x == KEEP:
                self._line(*row)


def staying(audit: str) -> int:
    return len(audit) - audit.count(DROP)


def steps_of(audit: str) -> Iterator[str]:
    """The letters of each row: its insertions and its own; at last the insertions at the end."""
    start = 0
    for i, x in enumerate(audit):
        if x != ADD:
            yield audit[start : i + 1]
            start = i + 1
    yield audit[start:]


def repair(rows: list[tuple[str, str, str, int]]) -> tuple[int, str, str]:
    """(cost, audit, hash of the repaired conversation) of rows (role, text, fault, count) in order."""
    parse = Parse()
    for role, _, fault, count in rows:
        parse.rows(role[:1], fault, count)
    cost, audit = finish(parse.ends())
    out, steps = Repaired(staying(audit)), steps_of(audit)
    for role, text, _, count in rows:
        for _ in range(count):
            out.step(next(steps), (role, text))
    out.step(next(steps), None)
    return cost, audit, out.sha.hexdigest()


@dataclass
class Counts:
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str = ""
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0
    turn: int | None = None

    def rows(self, initial: str, fault: str, turn: int | None, count: int) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + count)
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + (count - 1) * (initial * 2 not in LEGAL)
        self.first = initial if self.last is None else self.first
        self.last = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += self.high is None or turn != self.high
            self.high = turn

    def join(self, other: Counts) -> Counts:
        """This part followed by the next; a turn that both hold counts once."""
        lows = [x for x in (self.low, other.low) if x is not None]
        highs = [x for x in (self.high, other.high) if x is not None]
        same = self.high is not None and self.high == other.low
        return Counts(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last + other.first not in LEGAL), self.first, other.last,
            min(lows, default=None), max(highs, default=None), self.turns + other.turns - same,
        )

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def runs(count: int, first: bool, state: str) -> list[tuple[str, int]]:
    """(fault, how many) of the copies of a row: after the first, all are duplicates (or blank). state: '', blank, truncated."""
    if state == "blank":
        return [("blank", count)]
    own = [(state, 1)] if first else []
    return own + [("duplicate", count - len(own))] * (count > len(own))


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, iterator of its rows) of rows sorted by id, one after the other; a conversation is not held."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def own() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        part = own()
        yield key, part
        for _ in part:
            pass


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")
_COUNTS_DDL = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
_PART_DDL = f"part int, {_COUNTS_DDL}, cost long, audit string, sha string, ways array<struct<top:int,after:int,cost:long,rank:int,audit:string>>"


def _counts(values) -> dict:
    get = values.get if isinstance(values, dict) else lambda x: getattr(values, x)
    return {x: get(x) for x in _COUNTS}


def _ways(parses: dict[int, Parse]) -> list[dict]:
    """Every way through a part; rank orders their audits, so that joining parts needs no audits."""
    found = [(top, after, cost, audit) for top, p in parses.items() for after, (cost, audit) in p.ends().items()]
    order = {audit: i for i, audit in enumerate(sorted({w[3] for w in found}))}
    return [{"top": top, "after": after, "cost": cost, "rank": order[audit], "audit": audit} for top, after, cost, audit in found]


def _every_top() -> dict[int, Parse]:
    return {top: Parse({top: (0, 0, None)}) for top in STACKS.after}


def _parse_range(schema: pa.Schema) -> Callable:
    """Sorted rows (conv_id, turn, role, text, count, first, state) of one range -> one row per conversation of it.

    The first and the last conversation of a range may go on in another: they, and one too large to hold, are given as ways from every top.
    """

    def run(batches):
        part = TaskContext.get().partitionId()

        def whole(key, counts, rows):
            cost, audit, sha = repair(rows)
            return {"conv_id": key, "part": part, **_counts(counts), "cost": cost, "audit": audit, "sha": sha}

        def open_ends(key, counts, parses):
            return {"conv_id": key, "part": part, **_counts(counts), "ways": _ways(parses)}

        def through(parses, rows):
            for role, _, fault, count in rows:
                for p in parses.values():
                    p.rows(role[:1], fault, count)

        out, last, is_first = [], None, True
        for key, rows in _conversations(_rows_of(batches)):
            if last is not None:
                out.append(whole(*last))
                last = None
            counts, kept, size = Counts(), [], 0
            parses = _every_top() if is_first else None
            for _, turn, role, text, copies, first, state in rows:
                for fault, count in runs(copies, first, state):
                    counts.rows(role[:1], fault, turn, count)
                    kept.append((role, text, fault, count))
                    size += len(text) + 64
                if parses is None and size > HELD:
                    parses = _every_top()
                if parses is not None:
                    through(parses, kept)
                    kept = []
            if parses is None:
                last = (key, counts, kept)
            else:
                out.append(open_ends(key, counts, parses))
            is_first = False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if last is not None:
            parses = _every_top()
            through(parses, last[2])
            out.append(open_ends(last[0], last[1], parses))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _join_parts(schema: pa.Schema) -> Callable:
    """The parts of one conversation, in order, without their audits -> its counts, cost, letters at the end, and the way through each part."""

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda p: p["part"])
        counts = None
        ends: dict[int, tuple[int, int, tuple | None]] = {0: (0, 0, None)}
        for p in parts:
            own = Counts(**_counts(p))
            counts = own if counts is None else counts.join(own)
            best: dict[int, tuple] = {}
            for w in p["ways"]:
                if w["top"] in ends:
                    cost, rank, steps = ends[w["top"]]
                    way = (cost + w["cost"], rank, w["rank"], (steps, (p["part"], w["top"], w["after"])))
                    if w["after"] not in best or way[:3] < best[w["after"]][:3]:
                        best[w["after"]] = way
            order = {x: i for i, x in enumerate(sorted({way[1:3] for way in best.values()}))}
            ends = {after: (way[0], order[way[1:3]], way[3]) for after, way in best.items()}
        closing = [(cost + INSERT * len(letters), rank, letters, steps) for after, (cost, rank, steps) in ends.items() for letters in closings(after)]
        cost, _, letters, steps = min(closing, key=lambda x: x[:3])
        chosen = []
        while steps is not None:
            steps, way = steps
            chosen.append(dict(zip(("part", "top", "after"), way, strict=True)))
        row = {"conv_id": parts[0]["conv_id"], **_counts(counts), "cost": cost, "closing": letters, "chosen": chosen}
        return pa.Table.from_pylist([row], schema)

    return run


def closings(top: int) -> list[str]:
    """Fewest insertions that lead from a top to an accepted one, if any do."""
    seen, level, letters = {top}, [top], ""
    while level:
        if any(STACKS.accepts[t] for t in level):
            return [letters]
        level = [x for t in level for n in NAMES if (x := STACKS.after[t].get(n)) is not None and x not in seen]
        seen.update(level)
        letters += ADD
    return []


def _hash_stream(schema: pa.Schema) -> Callable:
    """Sorted (conv_id, is_row, turn, role, text, count, audit), the audit before the rows of its conversation -> (conv_id, sha)."""

    def run(batches):
        for key, rows in _conversations(_rows_of(batches)):
            audit = next(rows)[6]
            out, steps = Repaired(staying(audit)), steps_of(audit)
            for _, _, _, role, text, count, _ in rows:
                for _ in range(count):
                    out.step(next(steps), (role, text))
            out.step(next(steps), None)
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "sha": out.sha.hexdigest()}], schema)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after the damage, by crc32(`conv_id:turn`) % 20. Nulls count as one space, in the key as well; n is how often the row stands."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("n"),
        kind.alias("kind"),
    ).filter("kind <> 0").drop("kind")


def row_state(text: Column) -> Column:
    last = F.regexp_extract(text, f"({BLANK})[\\x20\\x09-\\x0D]*$", 1)
    return F.when(~text.rlike(BLANK), "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn become one with its count; `first` tells whether role and text come up here for the first time in the conversation."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("count")).withColumn("digest", F.sha2("text", 256))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = counted.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("at")).select(
        F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("at.turn").alias("_t"), F.lit(True).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return counted.join(earliest, same, "left").select("conv_id", "turn", "role", "text", "count", F.coalesce("first", F.lit(False)).alias("first"), row_state(F.col("text")).alias("state"))


def repair_conversations(rows: DataFrame, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per conv_id of `rows` (conv_id, turn, role, text, as they stand): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand by turn (nulls first), then role and text; null ids are one conversation; a null role or text counts as one space. A role without an
    initial of s, u or a can only be rerolled or deleted. Further columns are not read; an empty table gives no rows.
    """
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return _repaired(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *space, F.lit(1).alias("n")), rows, per_range)


def repair_damaged(rows: DataFrame, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """As `repair_conversations`, of the rows after `damaged`; a conversation without rows left has zeros, an empty audit and the hash of an empty text."""
    return _repaired(damaged(rows), rows, per_range)


def _repaired(rows: DataFrame, original: DataFrame, per_range: int) -> DataFrame:
    folder = shared_dir(rows.sparkSession)
    whole_number = isinstance(original.schema["conv_id"].dataType, IntegralType)
    kind = "long" if whole_number else "string"
    arrow_id = pa.field("conv_id", pa.int64() if whole_number else pa.string())

    def mapped(ddl: str) -> tuple[pa.Schema, str]:
        names = to_arrow_schema(_parse_datatype_string(ddl))
        return pa.schema([arrow_id, *names]), f"conv_id {kind}, {ddl}"

    faults = save(with_faults(rows.withColumn("conv_id", F.col("conv_id").cast(kind))), folder, "rows")
    ranges = max(1, -(-faults.count() // per_range))
    order = ["conv_id", "turn", "role", "text"]
    schema, ddl = mapped(_PART_DDL)
    sorted_rows = faults.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(*order, "count", "first", "state")
    parts = save(sorted_rows.mapInArrow(_parse_range(schema), ddl), folder, "parts")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long").alias("gaps")
    plain = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")]
    done = parts.filter("ways is null").select(*plain)

    spread = parts.filter("ways is not null")
    narrow = F.transform("ways", lambda w: F.struct(w["top"].alias("top"), w["after"].alias("after"), w["cost"].alias("cost"), w["rank"].alias("rank")))
    schema, ddl = mapped(f"{_COUNTS_DDL}, cost long, closing string, chosen array<struct<part:int,top:int,after:int>>")
    joined = spread.select("conv_id", "part", *_COUNTS, narrow.alias("ways")).groupBy("conv_id").applyInArrow(_join_parts(schema), ddl)
    joined = save(joined, folder, "joined")
    taken = joined.select(F.col("conv_id").alias("_c"), F.explode("chosen").alias("way"))
    audits = spread.select("conv_id", "part", F.explode("ways").alias("w"))
    fits = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("way.part")) & (F.col("w.top") == F.col("way.top")) & (F.col("w.after") == F.col("way.after"))
    pieces = audits.join(taken, fits).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", F.col("w.audit").alias("audit")))).alias("pieces"))
    pieces = pieces.select(F.col("conv_id").alias("_c"), F.concat_ws("", F.transform("pieces", lambda p: p["audit"])).alias("_audit"))
    joined = joined.join(pieces, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("audit", F.concat("_audit", "closing")).drop("_c", "_audit")
    joined = save(joined, folder, "audits")
    none = lambda kind: F.lit(None).cast(kind)
    heads = joined.select("conv_id", F.lit(False).alias("is_row"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("count"), "audit")
    texts = faults.join(joined.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    texts = texts.select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "text", "count", none("string").alias("audit"))
    schema, ddl = mapped("sha string")
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "text")
    hashes = stream.mapInArrow(_hash_stream(schema), ddl)
    late = joined.join(hashes.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).select(*plain)
    found = done.unionByName(late).withColumnRenamed("conv_id", "_c")

    ids = original.select("conv_id").distinct()
    out = ids.join(found, ids["conv_id"].cast(kind).eqNullSafe(F.col("_c")), "left")
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NO_TEXT)).alias("repaired_sha256"),
    )
