"""Packing of tokenised documents into training sequences of a fixed capacity, by minimum bin slack.

Method. Documents are cut at multiples of the capacity; what counts for the packing is only how many pieces of each length there are.
While pieces are left, the longest one opens a window and a subset-sum dynamic program over bitsets (bit s: the sum s can be
reached, copies of a length by binary splitting) finds the multiset of remaining lengths that fills the rest closest; the way back through
the layers gives its counts. The window is repeated as often as the counts allow. If slack stays, a further piece is cut to fill it
and its rest goes back to the remaining lengths. What is left at the end and fills no window is cut into powers of two, which need no padding.

Scale. The plan depends on the numbers of pieces of each length, ``capacity`` numbers whatever the input; it is a few thousand ranges of
ranks, bounded by the capacity too (every step uses up a length for its multiplicity). Every piece finds its place alone, by its length and its rank
among the pieces of that length. Ranks are counted within tasks and shifted by the counts of the tasks before, so a length that a third of
all documents have is no hot key. Token ids are written once to the shared folder, as the plan needs all counts first.

A null text is empty; every document ends with ``end_id``, so an empty one has one token. Strings of special tokens in a text are
ordinary text. Equal rows are documents of their own; a null id is kept. No rows give no sequence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import written

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"
#: bytes of an output batch, about
BATCH_BYTES = 1 << 22
#: characters that both libraries class alike in every version; a text with another one is left to the file's own library
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
_ENCODERS: dict[str, tuple] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def encoder(path: str):
    """(text to ids, bytes of an id). A byte-level vocabulary whose ids follow its merges is read as ranks, which a faster library encodes; it
    gets the texts of plain characters, where both give the same ids."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges") or []
        order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and order == sorted(set(order))
        fast = None
        if plain:
            import public_tokenizers
            import tiktoken

            byte = _byte_alphabet()
            ranks = {bytes(byte[c] for c in word): n for word, n in vocab.items() if all(c in byte for c in word)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if fast is not None and _PLAIN.fullmatch(text):
                return np.asarray(fast.encode_ordinary(text), np.uint32)
            return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[path] = encode, 2 if max(vocab.values(), default=0) < 1 << 16 else 4
    return _ENCODERS[path]


# ---- the plan -------------------------------------------------------------------------------------------------


def fill(left: dict[int, int], room: int) -> dict[int, int]:
    """The counts of a multiset of the lengths in ``left`` (length: copies) whose sum is closest to ``room`` from below. Of equal sums,
    one of long pieces, so that short ones stay for later."""
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in left.items() if n > 0 and x <= room), reverse=True):
        copies, power = min(left[length], room // length), 1
        while copies > 0:
            some = min(power, copies)
            layers.append((length, some, reach))
            reach |= (reach << (length * some)) & mask
            copies, power = copies - some, power * 2
        if reach >> room:
            break
    at, counts = reach.bit_length() - 1, {}
    for length, some, before in reversed(layers):
        if not before >> at & 1:
            counts[length] = counts.get(length, 0) + some
            at -= length * some
    return counts


#: the columns of a plan: of the pieces of ``length``, those of the ranks from ``low`` lie ``each`` to a sequence, from ``sequence`` and
#: ``offset`` on. cut: so many first tokens only; the rest is a piece with the ranks from ``rest`` on
PLAN = ("length", "low", "each", "sequence", "offset", "cut", "rest")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Ranges of ranks and where they go, one row each, sorted by length and low."""
    left = {length: n for length, n in counts.items() if n > 0}
    sizes, used, rows, sequence = dict(left), dict.fromkeys(left, 0), [], 0
    total = sum(length * n for length, n in left.items())

    def put(length: int, n: int, each: int, offset: int, cut: int = 0) -> None:
        rest = 0
        if cut:
            rest = sizes.get(length - cut, 0)
            sizes[length - cut] = rest + n
            left[length - cut] = left.get(length - cut, 0) + n
            used.setdefault(length - cut, 0)
        rows.append((length, used[length], each, sequence, offset, cut, rest))
        used[length] += n
        left[length] -= n

    while total >= capacity:
        longest = max(x for x, n in left.items() if n)
        more = fill(left | {longest: left[longest] - 1}, capacity - longest)
        window = more | {longest: more.get(longest, 0) + 1}
        repeats = min(left[x] // n for x, n in window.items())
        slack = capacity - sum(x * n for x, n in window.items())
        cut = 0
        if slack:  # what is no longer than the slack is in the window already
            cut = max(x for x, n in left.items() if x > slack and n > window.get(x, 0))
            repeats = min(repeats, left[cut] // (window.get(cut, 0) + 1))
        offset = 0
        for length in sorted(window, reverse=True):
            put(length, repeats * window[length], window[length], offset)
            offset += length * window[length]
        if slack:
            put(cut, repeats, 1, offset, slack)
        sequence, total = sequence + repeats, total - repeats * capacity
    while total:
        room = size = 1 << (total.bit_length() - 1)
        while room:
            whole = max((x for x, n in left.items() if n and x <= room), default=0)
            length = whole or min(x for x, n in left.items() if n)
            put(length, 1, 1, size - room, 0 if whole else room)
            room -= whole or room
        sequence, total = sequence + 1, total - size
    return np.array(sorted(rows), np.int64).reshape(-1, len(PLAN))


def place(steps: np.ndarray, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(index of the piece, start in it, length, sequence, offset) of what the pieces become, in rounds of one cut each."""
    keys = steps[:, 0] << 42 | steps[:, 1]
    index, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    while len(index):
        at = np.searchsorted(keys, length << 42 | rank, "right") - 1
        _, low, each, sequence, offset, cut, rest = steps[at].T
        own = rank - low
        yield index, start, np.where(cut > 0, cut, length), sequence + own // each, offset + own % each * length
        on = cut > 0
        index, start, length, rank = index[on], (start + cut)[on], (length - cut)[on], (rest + own)[on]


# ---- the job --------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids, k, task): the documents cut at multiples of the capacity. ``ids`` are little-endian; ``k``
    numbers the pieces of a length within a task."""
    path = path or vocabulary_path()
    kinds = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(path)
        seen, rows, size = np.zeros(capacity + 1, np.int64), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype(f"<u{width}")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, len(ids), start, len(part), part.tobytes(), seen[len(part)]))
                    seen[len(part)] += 1
                    size += part.nbytes + 64
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, doc_tokens long, start long, length long, ids binary, k long").withColumn("task", F.spark_partition_id())


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece of a document. ``ids`` are little-endian unsigned
    32-bit numbers."""
    path = path or vocabulary_path()
    rows = written(pieces(docs, path, capacity, end_id), "pieces")
    counts = written(rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    # at most ``capacity`` rows reach the driver
    steps = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = rows.join(before.hint("shuffle_hash"), ["length", "task"]).select("doc_id", "doc_tokens", "start", "length", "ids", (F.col("before") + F.col("k")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, width = encoder(path)
        for batch in batches:
            first, length, rank = (batch.column(c).to_numpy() for c in ("start", "length", "rank"))
            ids = batch.column("ids")
            for index, start, size, sequence, offset in place(steps, length, rank):
                cut = [np.frombuffer(ids[int(i)].as_buffer(), f"<u{width}")[s : s + n].astype("<u4").tobytes() for i, s, n in zip(index, start, size, strict=True)]
                at = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), pa.array(first[index] + start), pa.array(size), pa.array(cut, pa.binary()), batch.column("doc_tokens").take(at), pa.array(sequence), pa.array(offset)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
