"""Repair of conversation structure by Four-Russians block tables.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Keeping
a row costs 0, giving it the role user or assistant 2, deleting it 3, putting an
empty turn of either in anywhere 2; a row that is kept or renamed with a
truncated text costs 1 more; blank and duplicate rows must go. A row is one of
nine symbols, and what the rest of a conversation costs from each of the four
states of the grammar is a vector. Less their least entry only few vectors
exist, so tables tell for each of them and each block of ``BLOCK`` symbols the
vector before the block and the cost it adds. Blocks are looked up from the
end to the start; then each is expanded backward, symbol by symbol, from the
vector at its right edge, and traced forward with the ASCII-least of the
cheapest edits, so ties come out the same everywhere. The sequence of edits
tells the roles: one edit never leads to two of them.

Rows are dealt by ranges of conversation and turn, so a conversation may span
many tasks. One that a task holds whole and that is no longer than a piece is
finished there; of the others, pieces and the min-plus matrix of each part
go on: matrices give the vector at the right edge of each part, parts give the
state they end in for each state they start in, and pieces are traced by
themselves. Only the digest reads a conversation in one go, piece by piece.

Rows go by turn, null first, then by role and text. Null roles and texts are one
space; a null conversation is one of its own. Equal rows of a turn are counted
instead of repeated. Very long texts are read whole; an empty table comes out
empty. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marketloom.llm.common import staged

START, SYSTEM, USER, ASSISTANT = range(4)
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
INITIALS = {"s": 0, "u": 1, "a": 2}
GONE, N_SYMBOLS, BLOCK = 0, 9, 4
#: What each state expects next, and the names of the roles that edits give.
EXPECTED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that complete a conversation which ends in a state, and what they cost.
CLOSING = ("", "II", "I", "")
INFINITE = 1 << 20
#: A piece has at most so many rows and, but for its last row, so many bytes.
PIECE_ROWS, PIECE_BYTES = 2048, 1 << 20
LEGAL = {"su", "ua", "au"}


def symbol_of(role: str, truncated: bool) -> int:
    return 1 + 2 * INITIALS.get(role[:1], 3) + truncated


def kept_state(state: int, kind: int) -> int | None:
    """The state after a row of that initial is kept, None if it cannot be."""
    if kind == 0:
        return SYSTEM if state == START else None
    return EXPECTED[state] if kind + 1 == EXPECTED[state] else None


def before(symbol: int, after: tuple) -> tuple:
    """What each state costs before a row, given what it costs after it; inserts come first."""
    kind, cut = divmod(symbol - 1, 2)
    costs = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if symbol != GONE:
            ways.append(RENAME + CUT * cut + after[EXPECTED[state]])
            if (then := kept_state(state, kind)) is not None:
                ways.append(CUT * cut + after[then])
        costs.append(min(ways))
    costs[USER], costs[ASSISTANT] = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return tuple(min(c, INSERT + costs[USER]) if s in (START, SYSTEM) else c for s, c in enumerate(costs))


def normal(vector) -> tuple[tuple, int]:
    least = min(vector)
    return tuple(INFINITE if x >= INFINITE // 2 else x - least for x in vector), least


class Tables:
    """Every vector that can occur, with the steps of symbols and of blocks between them."""

    def __init__(self) -> None:
        end = tuple(INSERT * len(x) for x in CLOSING)
        units = [tuple(0 if s == t else INFINITE for s in range(4)) for t in range(4)]
        self.vectors, self.number = [], {}
        for v in (end, *units):
            self._add(v)
        step, cost = [], []
        for v in self.vectors:  # grows as vectors are found
            found = [normal(before(c, v)) for c in range(N_SYMBOLS)]
            step.append([self._add(w) for w, _ in found])
            cost.append([x for _, x in found])
        self.end, self.units = self.number[end], [self.number[u] for u in units]
        self.step, self.cost = np.array(step, np.int32), np.array(cost, np.int32)
        to, add = self.step, self.cost
        for _ in range(BLOCK - 1):  # one more symbol in front of a block
            left, more = self.step[to], self.cost[to] + add[:, :, None]
            to, add = left.transpose(0, 2, 1).reshape(len(to), -1), more.transpose(0, 2, 1).reshape(len(to), -1)
        self.block_step, self.block_cost = to.tolist(), add.tolist()
        self.step_list = self.step.tolist()
        self.picks = [[[self._pick(v, c, s) for s in range(4)] for c in range(N_SYMBOLS)] for v in self.vectors]

    def _add(self, v: tuple) -> int:
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def _pick(self, after: tuple, symbol: int, state: int) -> tuple[str, int]:
        """The ASCII-least of the cheapest edits from a state up to and with one row, and the state after it."""
        costs, (kind, cut), letters = before(symbol, after), divmod(symbol - 1, 2), ""
        while len(letters) < 4:
            goal = costs[state]
            if goal >= INFINITE // 2:
                break
            if DELETE + after[state] == goal:
                return letters + "D", state
            if INSERT + costs[EXPECTED[state]] == goal:
                letters, state = letters + "I", EXPECTED[state]
                continue
            then = kept_state(state, kind) if symbol != GONE else None
            if then is not None and CUT * cut + after[then] == goal:
                return letters + "K", then
            return letters + "R", EXPECTED[state]
        return "", state  # no way to the end from here


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def block_codes(symbols: np.ndarray) -> list[int]:
    whole = len(symbols) // BLOCK
    return (symbols[: whole * BLOCK].reshape(whole, BLOCK).astype(np.int64) @ N_SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()


def sweep(symbols: np.ndarray, v: int) -> tuple[list[int], int, int]:
    """``(vectors at the right edges of the blocks, the one before all symbols, cost added)``, from the vector after them."""
    t, cost, codes = tables(), 0, block_codes(symbols)
    for c in symbols[len(codes) * BLOCK :][::-1].tolist():
        cost += int(t.cost[v, c])
        v = t.step_list[v][c]
    edges = [0] * len(codes)
    for k in range(len(codes) - 1, -1, -1):
        edges[k] = v
        cost += t.block_cost[v][codes[k]]
        v = t.block_step[v][codes[k]]
    return edges, v, cost


def trace(symbols: np.ndarray, v: int, state: int) -> tuple[list[str], int]:
    """``(edits of each row, the state after them)``, from the vector after all symbols."""
    t, out = tables(), []
    edges = sweep(symbols, v)[0]
    for k in range(0, len(edges) + 1):
        part = symbols[k * BLOCK : (k + 1) * BLOCK].tolist()
        inner = [edges[k] if k < len(edges) else v]
        for c in part[:0:-1]:
            inner.append(t.step_list[inner[-1]][c])
        for c in part:
            letters, state = t.picks[inner.pop()][c][state]
            out.append(letters)
    return out, state


def lines_of(edits, state: int, rows: Iterator[tuple[str, str]], symbols) -> Iterator[str]:
    """The repaired rows as ``role:text``; ``rows`` are those that need not be deleted."""
    for letters, symbol in zip(edits, symbols):
        role, text = next(rows) if symbol != GONE else ("", "")
        for x in letters:
            if x == "D":
                continue
            state = kept_state(state, (symbol - 1) // 2) if x == "K" else EXPECTED[state]
            yield f"{role if x == 'K' else NAMES[state]}:{'' if x == 'I' else text}"


def closing_lines(state: int) -> list[str]:
    out = []
    for _ in CLOSING[state]:
        state = EXPECTED[state]
        out.append(f"{NAMES[state]}:")
    return out


def matrix(symbols: np.ndarray) -> np.ndarray:
    """int64[4, 4]: the cost from each state before the symbols to each one after them."""
    t, out = tables(), np.zeros((4, 4), np.int64)
    for column, v in enumerate(t.units):
        _, at, cost = sweep(symbols, v)
        out[:, column] = [min(INFINITE, x) if x >= INFINITE // 2 else x + cost for x in t.vectors[at]]
    return np.where(out >= INFINITE // 2, INFINITE << 20, out)


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), INFINITE << 20)


class Summary:
    """Faults, initials and turns of consecutive rows."""

    FIELDS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "n_turns")

    def __init__(self, values=(0, 0, 0, 0, 0, None, None, None, None, 0)) -> None:
        self.n_rows, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.n_turns = values

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def take(self, other: Summary) -> None:
        """``other`` follows; turns rise, so both share one at most."""
        if self.n_rows and other.n_rows:
            self.illegal += self.last + other.first not in LEGAL
        same = self.high is not None and self.high == other.low
        for f in ("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns"):
            setattr(self, f, getattr(self, f) + getattr(other, f))
        self.n_turns -= same
        self.first = other.first if self.first is None else self.first
        self.last = other.last if other.n_rows else self.last
        self.low = other.low if self.low is None else self.low
        self.high = other.high if other.high is not None else self.high

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.n_turns if self.n_turns else 0


def judged(role: str, text: str, turn: int | None, copies: int, first: bool) -> tuple[Summary, int]:
    """``(summary, symbol)`` of equal rows; the symbol is that of the first of them, the others must go."""
    raw, initial = text.encode().rstrip(), role[:1]
    turns = (turn, turn, 1) if turn is not None else (None, None, 0)
    if not raw:
        return Summary((copies, copies, 0, 0, copies - 1, initial, initial, *turns)), GONE
    cut = first and raw[-1:] not in (b".", b"!", b"?")
    return Summary((copies, 0, copies - first, int(cut), copies - 1, initial, initial, *turns)), symbol_of(role, cut) if first else GONE


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copies``: the rows after the damage that the checksum of id and turn decides."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("fate <> 0").select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Distinct ``conv, turn, role, text`` with ``copies`` and whether they are the ``first`` of their text, dealt by ranges and sorted."""
    same = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = same.withColumn("digest", F.unhex(F.sha2(F.encode(F.concat("role", F.lit("\n"), "text"), "UTF-8"), 256)))
    least = same.groupBy("conv", "digest").agg(F.min(F.struct("turn")).alias("least")).select(F.col("conv").alias("c"), F.col("digest").alias("d"), F.col("least.turn").alias("t"))
    # a row meets its own digest and turn alone, so no key of this join is hot
    match = same["conv"].eqNullSafe(least["c"]) & (same["digest"] == least["d"]) & same["turn"].eqNullSafe(least["t"])
    marked = same.join(least.hint("merge"), match, "left").select("conv", "turn", "role", "text", "copies", F.col("d").isNotNull().alias("first"))
    order = ["conv", "turn", "role", "text"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order)


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SUMMARY = "n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, n_turns long"
_KIND = {"whole": 0, "piece": 1, "part": 2}


def _pieces(rows) -> Iterator[tuple[Summary, list, list, list]]:
    """``(summary, symbols, roles, texts)`` of runs of one conversation's rows, each a piece at most."""
    total, symbols, roles, texts, size = Summary(), [], [], [], 0
    for turn, role, text, copies, first in rows:
        summary, symbol = judged(role, text, turn, copies, first)
        total.take(summary)
        symbols.append(symbol)
        if symbol != GONE:
            roles.append(role)
            texts.append(text)
            size += len(text)
        for low in range(1, copies, PIECE_ROWS):
            symbols.extend([GONE] * (min(copies, low + PIECE_ROWS) - low))
            if len(symbols) >= PIECE_ROWS:
                yield total, symbols, roles, texts
                total, symbols, roles, texts, size = Summary(), [], [], [], 0
        if len(symbols) >= PIECE_ROWS or size >= PIECE_BYTES:
            yield total, symbols, roles, texts
            total, symbols, roles, texts, size = Summary(), [], [], [], 0
    if symbols or total.n_rows:
        yield total, symbols, roles, texts


def _first_pass(ordered: DataFrame) -> DataFrame:
    kind = ordered.schema["conv"].dataType.simpleString()
    schema = f"kind int, conv {kind}, part int, piece long, result struct<{_RESULT.replace(' ', ':').replace(',:', ',')}>, summary struct<{_SUMMARY.replace(' ', ':').replace(',:', ',')}>, matrix array<long>, symbols binary, roles array<string>, texts array<string>"
    result_names = [x.split()[0] for x in _RESULT.split(", ")]

    def flat(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "first")))

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    def finish(conv, piece) -> dict:
        total, symbols, roles, texts = piece
        marks = np.array(symbols, np.uint8)
        edits, state = trace(marks, tables().end, START)
        _, v, cost = sweep(marks, tables().end)
        lines = [*lines_of(edits, START, iter(zip(roles, texts)), symbols), *closing_lines(state)]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        values = (total.gaps, total.blank, total.duplicate, total.truncated, total.illegal, cost + tables().vectors[v][START], "".join(edits) + CLOSING[state], digest)
        return {"kind": _KIND["whole"], "conv": conv, "result": dict(zip(result_names, values))}

    def rows(batches):
        part, held, size = TaskContext.get().partitionId(), [], 0
        conversations = groupby(flat(batches), key=lambda r: r[0])
        at_start, upcoming = True, next(conversations, None)
        # the first and the last conversation of a range may go on in its neighbours
        waiting = None
        while upcoming is not None:
            conv, members = upcoming
            pieces = _pieces(r[1:] for r in members)
            piece, total, costs, number = next(pieces), Summary(), None, 0
            more = next(pieces, None)
            if waiting is not None:
                held.append(finish(*waiting))
                waiting = None
            if more is None and not at_start:
                waiting = (conv, piece)  # whole, unless it turns out to be the last
            else:
                while piece is not None:
                    held.append(_piece_row(conv, part, number, piece))
                    total.take(piece[0])
                    here = matrix(np.array(piece[1], np.uint8))
                    costs = here if costs is None else min_plus(costs, here)
                    piece, number, more = more, number + 1, next(pieces, None)
                    yield out(held)
                    held = []
                held.append(_part_row(conv, part, total, costs))
            at_start, upcoming = False, next(conversations, None)
            if len(held) >= 512:
                yield out(held)
                held = []
        if waiting is not None:
            conv, piece = waiting
            held += [_piece_row(conv, part, 0, piece), _part_row(conv, part, piece[0], matrix(np.array(piece[1], np.uint8)))]
        yield out(held)

    return ordered.mapInArrow(rows, schema)


def _piece_row(conv, part, number, piece) -> dict:
    return {"kind": _KIND["piece"], "conv": conv, "part": part, "piece": number, "symbols": bytes(piece[1]), "roles": piece[2], "texts": piece[3]}


def _part_row(conv, part, total, costs) -> dict:
    return {"kind": _KIND["part"], "conv": conv, "part": part, "summary": dict(zip(Summary.FIELDS, total.values())), "matrix": costs.ravel().tolist()}


def _none(x):
    return None if x is None or x != x else x


def _right_edges(parts: DataFrame, kind: str) -> DataFrame:
    """The vector at the right edge of each part, and the conversation's numbers: a row for each part, of which a conversation has as many as there are tasks at most."""

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        group, t, total = group.sort_values("part"), tables(), Summary()
        for row in group.itertuples():
            values = [_none(getattr(row, f)) for f in Summary.FIELDS]
            total.take(Summary(tuple(x if isinstance(x, str) or x is None else int(x) for x in values)))
        vector, right = np.array(t.vectors[t.end], np.int64), []
        for m in reversed(group["matrix"].tolist()):
            right.append(t.number[normal(vector.tolist())[0]])
            vector = (np.array(m, np.int64).reshape(4, 4) + vector).min(1)
        out = group[["conv", "part"]].copy()
        return out.assign(edge=right[::-1], gaps=total.gaps, blank=total.blank, duplicate=total.duplicate, truncated=total.truncated, illegal=total.illegal, cost=int(vector[START]))

    schema = f"conv {kind}, part int, edge int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return parts.select("conv", "part", "matrix", "summary.*").groupBy("conv").applyInPandas(edges, schema)


def _piece_edges(pieces: DataFrame, kind: str) -> DataFrame:
    """Of each piece the vector at its right edge and its state for each state that its part starts in; ``ends`` are those after its part."""

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        marks, v, right = [np.frombuffer(s, np.uint8) for s in group["symbols"]], int(group["edge"].iloc[0]), []
        for m in reversed(marks):
            right.append(v)
            v = sweep(m, v)[1]
        right.reverse()
        states, starts = list(range(4)), []
        for m, v in zip(marks, right):
            starts.append(list(states))
            states = [trace(m, v, s)[1] for s in states]
        return group[["conv", "part", "piece"]].assign(right=right, starts=starts, ends=[states] * len(group))

    return pieces.groupBy("conv", "part").applyInPandas(edges, f"conv {kind}, part int, piece long, right int, starts array<int>, ends array<int>")


def _part_starts(ends: DataFrame, kind: str) -> DataFrame:
    """The state that each part starts in."""

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        group, state, found = group.sort_values("part"), START, []
        for ends in group["ends"]:
            found.append(state)
            state = int(ends[state])
        return group[["conv", "part"]].assign(start=found)

    return ends.groupBy("conv").applyInPandas(starts, f"conv {kind}, part int, start int")


def _traced(pieces: DataFrame, kind: str) -> DataFrame:
    """``conv, part, piece, edits, repaired, state``: pieces repaired one by one."""

    def rows(batches):
        for batch in batches:
            out = {"conv": [], "part": [], "piece": [], "edits": [], "repaired": [], "state": []}
            for r in batch.to_pylist():
                marks = np.frombuffer(r["symbols"], np.uint8)
                edits, state = trace(marks, r["right"], r["start"])
                lines = list(lines_of(edits, r["start"], iter(zip(r["roles"], r["texts"])), marks.tolist()))
                for k, x in zip(out, (r["conv"], r["part"], r["piece"], "".join(edits), "\n".join(lines) if lines else None, state)):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays([batch.column("conv").cast(batch.schema.field("conv").type), *(pa.array(out[k], t) for k, t in (("part", pa.int32()), ("piece", pa.int64()), ("edits", pa.string()), ("repaired", pa.string()), ("state", pa.int32())))], list(out))

    return pieces.mapInArrow(rows, f"conv {kind}, part int, piece long, edits string, repaired string, state int")


def _digests(traced: DataFrame, kind: str) -> DataFrame:
    """``conv, audit, repaired_sha256``: the pieces of a conversation stream by in order."""

    def rows(batches):
        pieces = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "repaired", "state"))))
        for conv, members in groupby(pieces, key=lambda r: r[0]):
            digest, audit, any_line, state = hashlib.sha256(), [], False, START
            for _, edits, repaired, state in members:
                audit.append(edits)
                if repaired is not None:
                    digest.update(b"\n" * any_line + repaired.encode())
                    any_line = True
            for line in closing_lines(state):
                digest.update(b"\n" * any_line + line.encode())
                any_line = True
            audit.append(CLOSING[state])
            yield pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=arrow)

    schema = f"conv {kind}, audit string, repaired_sha256 string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return traced.repartition("conv").sortWithinPartitions("conv", "part", "piece").mapInArrow(rows, schema)


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys that may be null; the columns of ``a``, then the others of ``b``."""
    b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    match = None
    for k in keys:
        same = a[k].eqNullSafe(b[f"__{k}"])
        match = same if match is None else match & same
    return a.join(b, match, how).drop(*[f"__{k}" for k in keys])


def repair(rows: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``rows`` (``conv, turn, role, text, copies``)."""
    kind = rows.schema["conv"].dataType.simpleString()
    found = staged(_first_pass(ordered_rows(rows)), "repair")
    whole = found.where(F.col("kind") == _KIND["whole"]).select("conv", "result.*")
    pieces = found.where(F.col("kind") == _KIND["piece"])
    right = staged(_right_edges(found.where(F.col("kind") == _KIND["part"]), kind), "part-edges")
    edges = staged(_piece_edges(_joined(pieces.select("conv", "part", "piece", "symbols"), right.select("conv", "part", "edge"), ["conv", "part"]), kind), "piece-edges")
    starts = _part_starts(edges.where("piece = 0").select("conv", "part", "ends"), kind)
    states = _joined(edges, starts, ["conv", "part"]).select("conv", "part", "piece", "right", F.get("starts", F.col("start")).alias("start"))
    traced = _traced(_joined(pieces.select("conv", "part", "piece", "symbols", "roles", "texts"), states, ["conv", "part", "piece"]), kind)
    numbers = right.groupBy("conv").agg(*[F.first(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    return whole.unionByName(_joined(numbers, _digests(traced, kind), ["conv"]))


def audit(conversations: DataFrame) -> DataFrame:
    """The repair of every conversation after the damage, also of those that lost all rows: zeros, no edits and the digest of nothing."""
    every = conversations.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = _joined(every.withColumnRenamed("conv_id", "conv"), repair(damaged(conversations)), ["conv"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
