import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sightline.llm import conversation_repair as c

COLUMNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        pick = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        yield from [(conv, turn, "user" if pick == 4 else role, text)] * (0 if pick == 0 else 2 if pick == 3 else 1)


def brute(rows):
    """Counts, the cheapest audit and the hash of one conversation: all edits in turn, by a plain search over them."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    ways = {"": (0, "", [])}  # by the initials so far, as only they decide what follows
    def insert(ways):
        for initials, (cost, audit, lines) in list(ways.items()):
            for n in range(1, 4):
                for more in itertools.product("ua", repeat=n):
                    key, way = initials + "".join(more), (cost + 3 * n, audit + "I" * n, lines + [("user:" if x == "u" else "assistant:") for x in more])
                    if key not in ways or way[:2] < ways[key][:2]:
                        ways[key] = way
        return ways
    def viable(initials):
        return re.fullmatch("s?(ua)*u?", initials)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for initials, (cost, audit, lines) in insert(ways).items():
            options = [(initials, cost + 4, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options.append((initials + (role[:1] or "-"), cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                options += [(initials + x[0], cost + 3 + more, audit + "R", [*lines, f"{x}:{text}"]) for x in ("user", "assistant")]
            for key, *way in options:
                if viable(key) and (key not in after or tuple(way[:2]) < after[key][:2]):
                    after[key] = tuple(way)
        ways = after
    cost, audit, lines = min(w for k, w in insert(ways).items() if LEGAL.fullmatch(k))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(seed, n=40):
    rng, rows = random.Random(seed), []
    texts = ["Fine.", "Yes!", "cut", "", " \t", "Really? \n", None, "Long " * 50 + ".", "é.", "no stop é", " "]
    for conv in range(n):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice([turn, turn, turn * 3, None, 1]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    rows += [(None, 0, "user", "No id."), (None, 1, "assistant", "None."), (2**60, 5, "user", "x" * 100_000)]
    return rows


def expected(rows):
    kept = {}
    for conv, *row in damage(rows):
        kept.setdefault(conv, []).append(tuple(row))
    return {conv: brute(kept.get(conv, [])) for conv in {r[0] for r in rows}}


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize(("seed", "parts", "blocks"), [(1, 1, {}), (2, 9, {"block_rows": 2}), (3, 30, {"block_rows": 1}), (4, 5, {"block_bytes": 60})])
def test_equals_brute_force(spark, seed, parts, blocks):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"block": F.lit(1), "edits": F.lit("x"), "whole": F.lit(0)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert result(c.report(df, c.damaged(df), **blocks)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_one_long_conversation(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"Turn {rng.randrange(400)}{rng.choice(['.', '', '!'])}") for t in range(1500)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    blocked = c.repair(df, block_rows=16)
    assert blocked.filter("whole").count() == 0 and blocked.count() > 90
    own = [r[1:] for r in sorted(rows, key=lambda r: r[1])]
    edits, stats = c._whole(own)
    [got] = c.digests(blocked).collect()
    assert got.audit == "".join(e["edit"] for e in edits) and [got[x] for x in c.COUNTS] == [stats[x] for x in c.COUNTS]
    lines = [f"{e['role']}:{e['text']}" for e in edits if e["edit"] != "D"]
    assert got.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert [f"{r.role}:{r.text}" for r in c.turns(blocked).orderBy("block", "place").collect()] == lines
    assert LEGAL.fullmatch("".join(x[0] for x in lines))


def test_no_rows_and_all_dropped(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert c.report(empty, c.damaged(empty)).collect() == []
    gone = spark.createDataFrame([(3, 1, "user", "Hello.")], COLUMNS)
    assert result(c.report(gone, gone.limit(0))) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_tables():
    """The compiled grammar accepts what the pattern does."""
    for n in range(7):
        for text in itertools.product("sua", repeat=n):
            top = 0
            for x in text:
                top = None if top is None else c.SHIFTS[top].get(x)
            assert (top is not None and c.ENDS[top]) == bool(LEGAL.fullmatch("".join(text)))
