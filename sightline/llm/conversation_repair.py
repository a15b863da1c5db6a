"""Repair of conversation structure: the cheapest edits that bring the roles of a conversation into its grammar, and an audit of them.

Method. The grammar ``C -> (empty) | P | s P``, ``P -> X | P X``, ``X -> u a`` (system, user, assistant) is compiled into SLR tables. A
generalised LR parse reads a conversation's rows with a graph-structured stack: from each stack top, a row is kept, re-roled to the token a
shift allows, or deleted, after any inserted turns; tops that are equal after a row merge into the one of the least (cost, audit). As the
grammar is left recursive, the stacks reached are few, and those with an equal top have the same continuations (checked when
the tables are built), so a row costs a constant number of moves. Audits are compared by rank: no audit of a top is a prefix of
another's after the same row, so (rank before, moves since) orders them as text.

Scale. Rows are range-partitioned by (conversation, turn) and sorted, so a conversation with a third of all rows lies in many tasks. A
conversation inside one task and one block is repaired there. All others (at most two a task, and the long ones) leave their rows as blocks
of at most ``BLOCK_ROWS`` rows or about ``BLOCK_BYTES`` bytes: repeats are found by a grouping of digests, every block is parsed from every possible
top, which gives its cost from each top to each, and only these small tables are folded in order, forwards for the costs and
backwards for the choice. Then every block is repaired alone. Tasks that fold or hash stream over sorted rows and hold one conversation's running values.

Rows are ordered by turn (null first), then role and text. Null roles and texts are one space; rows with a null conversation are one conversation.
A role's kind is its first character; an empty role has none of the grammar. The first fault of a row counts: blank, a repeat of
an earlier row's role and text, or no ``. ! ?`` as its last visible character. Blank and repeated rows have to go. Equal rows are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import written

BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 22
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
GRAMMAR = (("C", ()), ("C", ("P",)), ("C", ("s", "P")), ("P", ("X",)), ("P", ("P", "X")), ("X", ("u", "a")))
TOKENS, END = ("s", "u", "a"), "$"
SPACE = " \t\n\v\f\r"
#: where the inserted turns after a conversation's last block stand
LAST = 1 << 62


# ---- tables ---------------------------------------------------------------------------------------------------


def _closure(items: Iterable[tuple[int, int]]) -> frozenset:
    found, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        for n, (head, _) in enumerate(GRAMMAR):
            if GRAMMAR[rule][1][dot : dot + 1] == (head,) and (n, 0) not in found:
                found.add((n, 0))
                todo.append((n, 0))
    return frozenset(found)


def _goto(state: frozenset, symbol: str) -> frozenset:
    return _closure([(r, d + 1) for r, d in state if GRAMMAR[r][1][d : d + 1] == (symbol,)])


def _follow() -> dict[str, set[str]]:
    """The tokens that can stand after each head (no head but the start is empty)."""
    heads = {h for h, _ in GRAMMAR}
    first = {h: set() for h in heads}
    follow = {h: {END} if h == GRAMMAR[0][0] else set() for h in heads}
    for _ in GRAMMAR:
        for head, body in GRAMMAR:
            first[head] |= {t for x in body[:1] for t in first.get(x, {x})}
            for x, after in zip(body, (*body[1:], None), strict=False):
                if x in heads:
                    follow[x] |= follow[head] if after is None else first.get(after, {after})
    return follow


_START, _FOLLOW = _closure([(n, 0) for n, (h, _) in enumerate(GRAMMAR) if h == GRAMMAR[0][0]]), _follow()


def _shifted(stacks: set[tuple], token: str) -> tuple[set[tuple], bool]:
    """The stacks after every reduction that the token allows and its shift, and whether the end of the input is accepted."""
    found, accepted, todo = set(), False, list(stacks)
    while todo:
        stack = todo.pop()
        if _goto(stack[-1], token):
            found.add((*stack, _goto(stack[-1], token)))
        for rule, dot in stack[-1]:
            head, body = GRAMMAR[rule]
            if dot == len(body) and token in _FOLLOW[head]:
                rest = stack[: len(stack) - len(body)]
                if head == GRAMMAR[0][0]:
                    accepted |= len(rest) == 1
                else:
                    todo.append((*rest, _goto(rest[-1], head)))
    return found, accepted


def _automaton() -> tuple[list[dict[str, int]], list[bool]]:
    """For each stack top (0: nothing read) the top after each token, and whether the input may end. Stacks with an equal top must agree."""
    tops, stacks, todo = [_START], {(_START,): 0}, [(_START,)]
    shifts, ends = [None], [False]
    while todo:
        stack = todo.pop()
        own = {}
        for token in TOKENS:
            for after in _shifted({stack}, token)[0]:
                if after[-1] not in tops:
                    tops.append(after[-1])
                    shifts.append(None)
                    ends.append(False)
                own[token] = tops.index(after[-1])
                if after not in stacks:
                    stacks[after] = own[token]
                    todo.append(after)
        known = stacks[stack]
        end = _shifted({stack}, END)[1]
        if shifts[known] is not None and (shifts[known], ends[known]) != (own, end):
            raise ValueError("stacks with an equal top continue differently")
        shifts[known], ends[known] = own, end
    return shifts, ends


SHIFTS, ENDS = _automaton()
TOPS = range(len(SHIFTS))


def _inserts(top: int) -> Iterator[tuple[int, int, str]]:
    """(top, cost, moves) after any inserted turns; more than there are tops would come back to one."""
    ways = [(top, 0, "")]
    while ways:
        yield from ways
        ways = [(SHIFTS[t][x], c + INSERT, m + "I") for t, c, m in ways if len(m) < len(SHIFTS) for x in ROLES if x in SHIFTS[t]]


def _moves(kind: str, gone: bool, cut: bool) -> list[list[tuple[int, int, str]]]:
    """For each top the (top after, cost, moves) over a row of a kind; the least (cost, moves) of each."""
    found = []
    for start in TOPS:
        best: dict[int, tuple[int, str]] = {}
        for top, cost, moves in _inserts(start):
            ways = [(top, DELETE, "D")]
            if not gone:
                more = TRUNCATED * cut
                ways += [(SHIFTS[top][kind], KEEP + more, "K")] if kind in SHIFTS[top] else []
                ways += [(SHIFTS[top][x], REROLE + more, "R") for x in ROLES if x in SHIFTS[top]]
            for after, c, m in ways:
                best[after] = min(best.get(after, (1 << 60, "")), (cost + c, moves + m))
        found.append([(after, c, m) for after, (c, m) in sorted(best.items())])
    return found


MOVES = {(kind, gone, cut): _moves(kind, gone, cut) for kind in (*TOKENS, "") for gone in (False, True) for cut in (False, True)}
#: for each top the least (cost, moves) to the end of the input
FINISH = [min((c, m) for t, c, m in _inserts(top) if ENDS[t]) for top in TOPS]


def parse(kinds: list[tuple], start: int) -> tuple[dict[int, tuple[int, int]], list[dict[int, tuple[int, str]]]]:
    """Of the rows, read from one top: (cost, rank of the audit) of each top reached, and for each row each top's link (top before, moves)."""
    tops, links = {start: (0, 0)}, []
    for kind in kinds:
        best: dict[int, tuple[int, int, str, int]] = {}
        moves = MOVES[kind]
        for top, (cost, rank) in tops.items():
            for after, c, m in moves[top]:
                way = (cost + c, rank, m, top)
                if after not in best or way < best[after]:
                    best[after] = way
        order = sorted(best, key=lambda t: best[t][1:3])
        tops = {t: (best[t][0], n) for n, t in enumerate(order)}
        links.append({t: (w[3], w[2]) for t, w in best.items()})
    return tops, links


def trace(links: list[dict[int, tuple[int, str]]], top: int) -> list[str]:
    """The moves over each row, the way back from a top."""
    found = []
    for row in reversed(links):
        top, moves = row[top]
        found.append(moves)
    return found[::-1]


# ---- rows -----------------------------------------------------------------------------------------------------


def faults(rows: list[tuple], repeated: list[bool]) -> tuple[list[tuple], dict[str, int]]:
    """The kind of each (turn, role, text), for MOVES, and the counts of a block."""
    kinds, counts, before, turn = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}, None, None
    for (t, role, text), again in zip(rows, repeated, strict=True):
        visible = text.rstrip(SPACE)
        fault = "blank" if not visible else "duplicate" if again else "truncated" if visible[-1] not in ".!?" else ""
        if fault:
            counts[fault] += 1
        initial = role[:1]
        counts["illegal"] += before is not None and before + initial not in ("su", "ua", "au")
        counts["turns"] += t is not None and t != turn
        before, turn = initial, t
        kinds.append((initial if initial in TOKENS else "", fault in ("blank", "duplicate"), fault == "truncated"))
    return kinds, counts


def edited(rows: list[tuple], moves: list[str], top: int, end: str = "") -> list[dict]:
    """The edits, in order, from a top on: {edit, turn, role, text}. ``end``: inserted turns after the rows."""
    found = []
    for row, own in zip([*rows, None], [*moves, end], strict=True):
        for move in own:
            turn, role, text = row if move != "I" else (None, None, "")
            if move in "IR":
                token = next(x for x in ROLES if x in SHIFTS[top])
                role = ROLES[token]
            elif move == "K":
                token = role[:1]
            if move != "D":
                top = SHIFTS[top][token]
            found.append({"edit": move, "turn": turn, "role": role, "text": text})
    return found


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_EDIT = pa.struct([("edit", pa.string()), *[(f.name, f.type) for f in _ROW]])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_STATS = pa.struct([(c, pa.int64()) for c in COUNTS])
ROW_DDL = "struct<turn: bigint, role: string, text: string>"
EDIT_DDL = "array<struct<edit: string, turn: bigint, role: string, text: string>>"
STATS_DDL = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"


def _fields(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _whole(rows: list[tuple]) -> tuple[list[dict], dict]:
    """The edits and counts of a conversation that lies in one block."""
    seen: set[tuple] = set()
    repeated = [r[1:] in seen or bool(seen.add(r[1:])) for r in rows]
    kinds, counts = faults(rows, repeated)
    tops, links = parse(kinds, 0)
    cost, _, moves, top = min((c + FINISH[t][0], rank, FINISH[t][1], t) for t, (c, rank) in tops.items())
    turns = [r[0] for r in rows if r[0] is not None]
    counts["gaps"] = turns[-1] - turns[0] + 1 - counts["turns"] if turns else 0
    return edited(rows, trace(links, top), 0, moves), {c: counts.get(c, cost) for c in COUNTS}


def _in_order(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _out(rows: Iterable[dict], schema: pa.Schema, size=lambda r: 200, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= limit:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _text_size(row: dict) -> int:
    return 200 + sum(len(x["text"]) + 100 for x in (row.get("edits") or row.get("rows") or ()))


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, block, whole, edits, stats) for rows (conv_id, turn, role, text): the edits of a conversation in the order of its blocks. ``whole``: the
    block is the conversation. ``stats`` is set in one block of each conversation (its only or last one)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    # texts decide only between rows of one turn and role; their beginnings are enough to deal rows out in that order
    dealt = rows.repartitionByRange(*order[:3], F.substring("text", 1, 64).asc()).sortWithinPartitions(*order)
    schema = _fields(conv_id=pa.int64(), whole=pa.bool_(), rows=pa.list_(_ROW), edits=pa.list_(_EDIT), stats=_STATS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[dict]:
            held, size, conv, is_open = [], 0, None, True  # the first conversation may have begun in the task before

            def block() -> dict:
                return {"conv_id": conv, "whole": False, "rows": [dict(zip(("turn", "role", "text"), r, strict=True)) for r in held]}

            for own, *row in _in_order(batches, "conv_id", "turn", "role", "text"):
                if held and own != conv:
                    if is_open:
                        yield block()
                    else:
                        edits, stats = _whole(held)
                        yield {"conv_id": conv, "whole": True, "edits": edits, "stats": stats}
                    held, size, is_open = [], 0, False
                elif held and (len(held) >= block_rows or size >= block_bytes):
                    is_open = True
                    yield block()
                    held, size = [], 0
                conv = own
                held.append(tuple(row))
                size += len(row[2]) + 50
            if held:  # may go on in the next task
                yield block()

        yield from _out(blocks(), schema, _text_size)

    ddl = f"conv_id long, whole boolean, rows array<{ROW_DDL}>, edits {EDIT_DDL}, stats {STATS_DDL}"
    first = written(dealt.mapInArrow(cut, ddl).withColumn("block", F.monotonically_increasing_id()), "conversations")
    done = first.filter("whole").select("conv_id", "block", "whole", "edits", "stats")
    return done.unionByName(_repair_blocks(first.filter("NOT whole").select("conv_id", "block", "rows")))


def _repair_blocks(blocks: DataFrame) -> DataFrame:
    """The same for conversations of several blocks."""
    # the first row of each role and text; others are repeats
    each = blocks.select("conv_id", "block", F.posexplode("rows").alias("i", "r")).select("conv_id", "block", "i", F.col("r.role").alias("role"), F.sha2(F.col("r.text").cast("binary"), 256).alias("h"))
    fresh = each.groupBy("conv_id", "role", "h").agg(F.min(F.struct("block", "i")).alias("f"))
    fresh = fresh.groupBy(F.col("f.block").alias("block")).agg(F.collect_list("f.i").alias("fresh"))  # no longer than a block
    blocks = written(blocks.join(fresh, "block", "left"), "blocks")
    table = _fields(conv_id=pa.int64(), block=pa.int64(), **{c: pa.int64() for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")}, head=pa.string(), tail=pa.string(), costs=pa.list_(pa.int64()), ranks=pa.list_(pa.int64()))

    def kinds_of(rows: list[dict], new: list[int] | None) -> tuple[list[tuple], list[tuple], dict[str, int]]:
        own, known = [(r["turn"], r["role"], r["text"]) for r in rows], set(new or ())
        return own, *faults(own, [i not in known for i in range(len(own))])

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summaries() -> Iterator[dict]:
            for conv, at, rows, new in _in_order(batches, "conv_id", "block", "rows", "fresh"):
                own, kinds, counts = kinds_of(rows, new)
                ways = [parse(kinds, top)[0] for top in TOPS]
                turns = [r[0] for r in own if r[0] is not None]
                ends = {"low": min(turns, default=None), "high": max(turns, default=None), "first": own[0][0], "last": own[-1][0], "head": own[0][1][:1], "tail": own[-1][1][:1]}
                flat = [way.get(top, (-1, -1)) for way in ways for top in TOPS]
                yield {"conv_id": conv, "block": at, **counts, **ends, "costs": [c for c, _ in flat], "ranks": [r for _, r in flat]}

        yield from _out(summaries(), table)

    ddl = "conv_id long, block long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first long, last long, head string, tail string, costs array<long>, ranks array<long>"
    summary = blocks.select("conv_id", "block", "rows", "fresh").mapInArrow(costs, ddl)
    link = _fields(conv_id=pa.int64(), block=pa.int64(), links=pa.list_(pa.int64()), top=pa.int64(), stats=_STATS)

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = table.names

        def steps() -> Iterator[dict]:
            conv = total = tops = None

            def end() -> dict:
                cost, _, _, top = min((c + FINISH[t][0], rank, FINISH[t][1], t) for t, (c, rank) in tops.items())
                gaps = total["high"] - total["low"] + 1 - total["turns"] if total["low"] is not None else 0
                return {"conv_id": conv, "block": LAST, "top": top, "stats": {c: {"gaps": gaps, "cost": cost}.get(c, total.get(c)) for c in COUNTS}}

            for values in _in_order(batches, *names):
                own = dict(zip(names, values, strict=True))
                if total is None or own["conv_id"] != conv:
                    if total is not None:
                        yield end()
                    conv, total, tops = own["conv_id"], None, {0: (0, 0)}
                if total is None:
                    total = dict(own)
                else:
                    for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        total[c] += own[c]
                    total["illegal"] += total["tail"] + own["head"] not in ("su", "ua", "au")
                    total["turns"] -= own["first"] is not None and own["first"] == total["last"]
                    total["low"] = own["low"] if total["low"] is None else total["low"]
                    total["high"] = total["high"] if own["high"] is None else own["high"]
                    total |= {c: own[c] for c in ("last", "tail")}
                best: dict[int, tuple[int, int, int, int]] = {}
                for top, (cost, rank) in tops.items():
                    for after in TOPS:
                        c, r = own["costs"][top * len(TOPS) + after], own["ranks"][top * len(TOPS) + after]
                        if c >= 0 and (after not in best or (cost + c, rank, r, top) < best[after]):
                            best[after] = (cost + c, rank, r, top)
                ordered = sorted(best, key=lambda t: best[t][1:3])
                tops = {t: (best[t][0], n) for n, t in enumerate(ordered)}
                yield {"conv_id": conv, "block": own["block"], "links": [best[t][3] if t in best else -1 for t in TOPS]}
            if total is not None:
                yield end()

        yield from _out(steps(), link)

    link_ddl = f"conv_id long, block long, links array<long>, top long, stats {STATS_DDL}"
    by = F.col("conv_id").asc_nulls_first()
    linked = written(summary.repartition("conv_id").sortWithinPartitions(by, "block").mapInArrow(forwards, link_ddl), "links")
    choice = _fields(block=pa.int64(), start=pa.int64(), top=pa.int64())

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def choices() -> Iterator[dict]:
            after = None
            for at, links, top in _in_order(batches, "block", "links", "top"):
                if at == LAST:
                    after = top
                else:
                    yield {"block": at, "start": links[after], "top": after}
                    after = links[after]

        yield from _out(choices(), choice)

    chosen = linked.select("conv_id", "block", "links", "top").repartition("conv_id").sortWithinPartitions(by, F.col("block").desc()).mapInArrow(backwards, "block long, start long, top long")
    done = _fields(conv_id=pa.int64(), block=pa.int64(), edits=pa.list_(_EDIT))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_edits() -> Iterator[dict]:
            for conv, at, rows, new, start, top in _in_order(batches, "conv_id", "block", "rows", "fresh", "start", "top"):
                own, kinds, _ = kinds_of(rows, new)
                yield {"conv_id": conv, "block": at, "edits": edited(own, trace(parse(kinds, start)[1], top), start)}

        yield from _out(all_edits(), done, _text_size)

    middle = blocks.join(chosen, "block").select("conv_id", "block", "rows", "fresh", "start", "top").mapInArrow(rewrite, f"conv_id long, block long, edits {EDIT_DDL}")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = ({"conv_id": conv, "block": LAST, "edits": edited([], [], top, FINISH[top][1])} for conv, top in _in_order(batches, "conv_id", "top"))
        yield from _out(ends, done)

    last = linked.filter("stats IS NOT NULL")
    tail = last.select("conv_id", "top").mapInArrow(close, f"conv_id long, block long, edits {EDIT_DDL}")
    stats = last.select(F.col("conv_id").alias("c"), "stats", F.lit(LAST).alias("b"))
    tail = tail.join(stats, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c", "b")
    parts = middle.withColumn("stats", F.lit(None).cast(STATS_DDL)).unionByName(tail)
    return parts.select("conv_id", "block", F.lit(False).alias("whole"), "edits", "stats")


def turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, block, place, turn, role, text): the rows of the repaired conversations."""
    rows = repaired.select("conv_id", "block", F.posexplode("edits").alias("place", "e")).filter("e.edit <> 'D'")
    return rows.select("conv_id", "block", "place", "e.turn", "e.role", "e.text")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, counts, audit, repaired_sha256) of each conversation: SHA-256 of its ``role:text`` lines. A hash is made in order, so a
    conversation of several blocks streams through one task."""
    audit = F.array_join(F.transform("edits", lambda e: e["edit"]), "")
    lines = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    counts = [F.col(f"stats.{c}").alias(c) for c in COUNTS]
    whole = repaired.filter("whole").select("conv_id", *counts, audit.alias("audit"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    parts = repaired.filter("NOT whole").select("conv_id", "block", audit.alias("audit"), F.size(lines).alias("n"), F.array_join(lines, "\n").alias("text"), "stats")
    schema = _fields(conv_id=pa.int64(), stats=_STATS, audit=pa.string(), repaired_sha256=pa.string())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            own, begun, moves = hashlib.sha256(), False, []
            for conv, at, some, n, text, stats in _in_order(batches, "conv_id", "block", "audit", "n", "text", "stats"):
                moves.append(some)
                if n:
                    own.update((("\n" if begun else "") + text).encode())
                    begun = True
                if at == LAST:
                    yield {"conv_id": conv, "stats": stats, "audit": "".join(moves), "repaired_sha256": own.hexdigest()}
                    own, begun, moves = hashlib.sha256(), False, []

        yield from _out(found(), schema)

    ordered = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block")
    streamed = ordered.mapInArrow(stream, f"conv_id long, stats {STATS_DDL}, audit string, repaired_sha256 string")
    return whole.unionByName(streamed.select("conv_id", *counts, "audit", "repaired_sha256"))


# ---- damage, for the registered query -------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with every twentieth each dropped, emptied, without its ``. ! ?``, repeated or re-roled, by a hash of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), pick.alias("pick"))
    rows = rows.withColumns({
        "text": F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("pick") == 4, "user").otherwise(F.col("role")),
        "copies": F.when(F.col("pick") == 0, 0).when(F.col("pick") == 3, 2).otherwise(1),
    })
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("conv_id", "turn", "role", "text")


def report(conversations: DataFrame, rows: DataFrame, **blocks: int) -> DataFrame:
    """``digests`` of the repaired ``rows`` for every conversation of ``conversations``; one without rows has zeros, an empty audit and
    the hash of nothing."""
    every = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    found = every.join(digests(repair(rows, **blocks)), F.col("c").eqNullSafe(F.col("conv_id")), "left")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return found.select(
        F.col("c").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], *[F.coalesce(c, F.lit(x)).alias(c) for c, x in nothing.items()]
    )


def _oracle() -> str:
    from sightline.llm.merkle_manifest import sql_crc32

    blank = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
y AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE d <> 0),
z AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM y),
f AS (SELECT *, left(role, 1) AS i, left(lag(role) OVER (PARTITION BY c ORDER BY k), 1) AS j,
  CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM z),
one(s, t, token) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
ins AS (SELECT s, s AS t, 0 AS cost, '' AS m FROM (VALUES (''), ('s'), ('u'), ('a')) v(s)
  UNION ALL SELECT ins.s, one.t, cost + 3, m || 'I' FROM ins JOIN one ON one.s = ins.t WHERE token <> 's' AND length(m) < 3),
way AS (
  SELECT c, max(conv_id) AS conv_id, 0 AS k, '' AS s, {{'cost': 0, 'audit': ''}} AS best FROM f GROUP BY c
  UNION ALL
  SELECT way.c, way.conv_id, way.k + 1, r.t, min({{'cost': way.best.cost + ins.cost + r.cost, 'audit': way.best.audit || ins.m || r.m}})
  FROM way JOIN ins ON ins.s = way.s JOIN f ON f.c = way.c AND f.k = way.k + 1, LATERAL (
    SELECT ins.t AS t, 4 AS cost, 'D' AS m
    UNION ALL SELECT one.t, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END, 'K' FROM one WHERE one.s = ins.t AND one.token = f.i AND f.fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT one.t, CASE WHEN f.fault = 'truncated' THEN 6 ELSE 3 END, 'R' FROM one WHERE one.s = ins.t AND one.token <> 's' AND f.fault NOT IN ('blank', 'duplicate')
  ) r GROUP BY way.c, way.conv_id, way.k, r.t
),
n AS (SELECT c, max(k) AS k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
  count_if(fault = 'truncated') AS truncated, count_if(j IS NOT NULL AND j || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
last AS (SELECT way.c, min({{'cost': best.cost + ins.cost, 'audit': best.audit || ins.m}}) AS best FROM way JOIN n ON n.c = way.c AND n.k = way.k JOIN ins ON ins.s = way.s AND ins.t IN ('', 'a') GROUP BY way.c),
play AS (
  SELECT c, best.audit AS audit, 0 AS p, 0 AS k, '' AS s, []::VARCHAR[] AS lines FROM last
  UNION ALL
  SELECT play.c, audit, p + 1, CASE WHEN e = 'I' THEN play.k ELSE play.k + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' THEN f.i WHEN s = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN e = 'D' THEN lines ELSE list_append(lines, CASE WHEN e = 'K' THEN f.role WHEN s = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END) END
  FROM (SELECT *, audit[p + 1] AS e FROM play WHERE p < length(audit)) play LEFT JOIN f ON f.c = play.c AND f.k = play.k + 1
),
done AS (SELECT f.conv_id, n.*, last.best.cost AS cost, play.audit, sha256(array_to_string(lines, chr(10))) AS hash
  FROM n JOIN last USING (c) JOIN play USING (c) JOIN (SELECT DISTINCT c, conv_id FROM f) f USING (c) WHERE p = length(play.audit))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id
"""


ORACLE = _oracle()
