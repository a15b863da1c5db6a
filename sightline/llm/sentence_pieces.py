"""SentencePiece encoding and decoding with a unigram lattice.

Method. The pieces of a public model file, with a log score each, are laid out as a double-array trie over UTF-8 bytes. A
text gets a leading space, spaces become the marker of white space, and the Viterbi path of the highest total score through
the lattice of pieces is its encoding. A character that is no piece costs ten more than the worst piece and is written as its
bytes' pieces. Decoding joins pieces, turns markers into spaces and removes the leading one. The marker character
itself, where a text holds it, is written as bytes, so every text decodes to itself.

No piece crosses from a non-space to a space (checked when the model is loaded; otherwise a text is one unit), so a lattice
splits into words. The distinct words of a slice of a batch go through one vectorised Viterbi; a bounded cache keeps words between
batches. A model of merge ranks has no log scores: with ``scores="zipf"`` a piece of rank r gets -ln(r + 2.7), with ``"file"`` the
numbers in the file are used as they are.

A null text has null ids, an empty one none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: words of more bytes go through the lattice one by one
LONG_WORD = 256
CACHE_WORDS = 300_000
#: bytes of text that are encoded at a time; a longer text is a slice of its own
SLICE_BYTES = 1 << 20


@dataclass
class Pieces:
    texts: list[bytes]  # by id, with spaces for markers
    scores: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # id of the piece that ends at a node, else -1
    byte_ids: list[int]
    unknown_score: float
    splits: bool
    isolated: str  # characters that are in no longer piece


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: the child of node s by byte c is base[s] + c + 1 if check of it is s."""
    keys = sorted(keys)
    size = 1 << 12
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    free = 1
    work = [(0, 0, len(keys), 0)]
    while work:
        node, lo, hi, depth = work.pop()
        if len(keys[lo][0]) == depth:
            value[node] = keys[lo][1]
            lo += 1
        if lo == hi:
            continue
        heads = [k[0][depth] for k in keys[lo:hi]]
        cuts = [0, *[i for i in range(1, len(heads)) if heads[i] != heads[i - 1]], len(heads)]
        codes = np.array([heads[i] + 1 for i in cuts[:-1]])
        at, first = max(1, free - int(codes[0])), int(codes[0])
        tries = 0
        while True:
            tries += 1
            if at + 257 >= len(check):
                grow = len(check)
                base, check, value = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32)), np.append(value, np.full(grow, -1, np.int32))
            if check[at + first] < 0 and (check[at + codes] < 0).all():
                break
            at += 1
        base[node] = at
        check[at + codes] = node
        if tries > 64:  # the slots behind are nearly all taken
            free = max(free, at)
        while check[free] >= 0:
            free += 1
        work += [(at + int(c), lo + a, lo + b, depth + 1) for c, a, b in zip(codes, cuts, cuts[1:], strict=False)]
    return base, check, value


def load_pieces(path: str = MODEL_PATH, scores: str = "zipf") -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(count)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    value = np.array([model.get_score(i) for i in range(count)], np.float64)
    if scores == "zipf":
        value[plain] = -np.log(np.argsort(np.argsort(-value[plain], kind="stable"), kind="stable") + 2.7)
    texts = [b""] * count
    for i in plain:
        texts[i] = names[i].replace(MARK, " ").encode()
    for b, i in enumerate(byte_ids):
        texts[i] = bytes([b])
    base, check, ends = double_array([(texts[i], i) for i in plain])
    longer = {c for i in plain if len(names[i]) > 1 for c in names[i]}
    splits = not any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain)
    return Pieces(texts, value, base, check, ends, byte_ids, float(value[plain].min()) - UNKNOWN_PENALTY, splits, "".join(c for c in "\n\t\r" if c not in longer))


_FIRST = np.array([1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])


def _paths(model: Pieces, words: list[bytes]) -> list[bytes]:
    """The best encodings, packed, of words of similar length: one lattice column after the other, for all words at once."""
    n, width = len(words), max(map(len, words))
    text = np.zeros((n, width), np.int32)
    sizes = np.array([len(w) for w in words])
    text[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)

    def better(rows: np.ndarray, to: np.ndarray, start: int, score: np.ndarray, ids: np.ndarray) -> None:
        win = score > best[rows, to]
        rows, to = rows[win], to[win]
        best[rows, to], back[rows, to], piece[rows, to] = score[win], start, ids[win]

    for start in range(width):
        rows = np.flatnonzero((sizes > start) & (best[:, start] > -np.inf))
        if not len(rows):
            continue
        begun, single = rows, np.zeros(n, bool)
        step = _FIRST[text[rows, start]].clip(1)
        step_of = np.zeros(n, np.int64)
        step_of[rows] = np.minimum(step, sizes[rows] - start)
        node, depth = np.zeros(len(rows), np.int64), 0
        while len(rows):
            inside = sizes[rows] > start + depth
            rows, node = rows[inside], node[inside]
            if not len(rows):
                break
            after = model.base[node] + text[rows, start + depth] + 1
            on = model.check[after] == node
            rows, node = rows[on], after[on]
            depth += 1
            ids = model.value[node]
            end = ids >= 0
            if end.any():
                r, i = rows[end], ids[end]
                single[r[step_of[r] == depth]] = True
                better(r, np.full(len(r), start + depth), start, best[r, start] + model.scores[i], i)
        lone = begun[~single[begun]]
        better(lone, start + step_of[lone], start, best[lone, start] + model.unknown_score, np.full(len(lone), -1, np.int32))
    # all paths are walked back together, and written from the right
    ids, at, used = np.zeros((n, width), np.int32), sizes.copy(), np.zeros(n, np.int64)
    whole = np.ones(n, bool)
    rows = np.flatnonzero(at > 0)
    while len(rows):
        own = piece[rows, at[rows]]
        whole[rows[own < 0]] = False
        used[rows] += 1
        ids[rows, width - used[rows]] = own
        at[rows] = back[rows, at[rows]]
        rows = rows[at[rows] > 0]
    packed, ends = ids.tobytes(), (np.arange(1, n + 1) * width * 4).tolist()
    out = [packed[e - 4 * u : e] for e, u in zip(ends, used.tolist(), strict=True)]
    for k in np.flatnonzero(~whole):  # with characters that are no piece
        out[k] = np.array(_walk(model, words[k], back[k], piece[k]), np.int32).tobytes()
    return out


def _walk(model: Pieces, word: bytes, back, piece) -> list[int]:
    out, at = [], len(word)
    while at > 0:
        start = back[at]
        out += [int(piece[at])] if piece[at] >= 0 else [model.byte_ids[b] for b in reversed(word[start:at])]
        at = start
    return out[::-1]


def _path(model: Pieces, word: bytes) -> list[int]:
    """The best encoding of one (long) word."""
    n = len(word)
    best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = model.base, model.check, model.value, model.scores
    for start in range(n):
        own = best[start]
        if own == -np.inf:
            continue
        step = min(max(1, int(_FIRST[word[start]])), n - start)
        node, at, single = 0, start, False
        while at < n:
            after = int(base[node]) + word[at] + 1
            if check[after] != node:
                break
            node, at = after, at + 1
            i = value[node]
            if i >= 0:
                single = single or at - start == step
                if own + scores[i] > best[at]:
                    best[at], back[at], piece[at] = own + scores[i], start, i
        if not single and own + model.unknown_score > best[start + step]:
            best[start + step], back[start + step], piece[start + step] = own + model.unknown_score, start, -1
    return _walk(model, word, back, piece)


def encode_words(model: Pieces, words: list[str]) -> dict[str, bytes]:
    """Packed 32-bit ids of each word."""
    raws = [word.encode("utf-8", "replace") for word in words]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    found = {words[k]: np.array(_path(model, raws[k]), np.int32).tobytes() for k in np.flatnonzero(sizes > LONG_WORD).tolist()}
    order = np.argsort(sizes, kind="stable")[: len(raws) - len(found)].tolist()
    for lo in range(0, len(order), 20_000):
        own = order[lo : lo + 20_000]
        found.update(zip(map(words.__getitem__, own), _paths(model, list(map(raws.__getitem__, own))), strict=True))
    if MARK in found:
        found[MARK] = np.array([model.byte_ids[b] for b in MARK.encode()], np.int32).tobytes()
    return found


def in_slices(column: pa.Array, sizes: np.ndarray, most: int, code: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``code`` of a column, applied to runs of rows whose sizes add up to about ``most`` (one row at least), so that what it holds
    at a time depends on the longest row but not on how many rows a batch has."""
    total = int(sizes.sum())
    groups = (np.cumsum(sizes) - sizes) * max(1, round(total / most)) // max(1, total)  # of equal size, no small rest
    bounds = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(column)]
    return pa.concat_arrays([code(column.slice(lo, hi - lo)) for lo, hi in zip(bounds, bounds[1:])])


def _coders(spark: SparkSession, model: Pieces) -> tuple[Callable[[pa.Array], pa.Array], Callable[[pa.Array], pa.Array]]:
    """Arrow functions of a batch: texts -> ids and ids -> texts."""
    sent = spark.sparkContext.broadcast(model)
    cache: dict[str, bytes] = {}
    pieces: list = []

    def encode(text: pa.Array) -> pa.Array:
        text = text.cast(pa.string())
        return in_slices(text, pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64), SLICE_BYTES, encode_some)

    def encode_some(text: pa.Array) -> pa.Array:
        model = sent.value
        edge = re.escape(model.isolated)
        pattern = re.compile(f"{MARK}|[{edge}]| *[^ {MARK}{edge}]+| +" if edge else f"{MARK}| *[^ {MARK}]+| +")
        if not model.splits:
            pattern = re.compile(f"{MARK}|[^{MARK}]+")
        words = [None if x is None else pattern.findall(" " + x) if x else [] for x in text.to_pylist()]
        every = set().union(*filter(None, words))
        fresh = every.difference(cache)
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
            fresh = every
        now = encode_words(model, list(fresh))
        lookup = {**cache, **now} if len(cache) + len(now) > CACHE_WORDS else cache
        if lookup is cache:
            cache.update(now)
        packed = [b"" if own is None else b"".join(map(lookup.__getitem__, own)) for own in words]
        ends = np.cumsum([0, *[len(x) // 4 for x in packed]])
        missing = pa.array([own is None for own in words], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)), mask=missing)

    def decode(ids: pa.Array) -> pa.Array:
        return in_slices(ids, pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64), SLICE_BYTES // 4, decode_some)

    def decode_some(ids: pa.Array) -> pa.Array:
        texts = sent.value.texts
        if not pieces:
            size = np.array([len(x) for x in texts])
            pieces.append((np.frombuffer(b"".join(texts), np.uint8), size, np.cumsum(size) - size))
        letters, size, first = pieces[0]
        own = ids.flatten().to_numpy(zero_copy_only=False)
        counts = np.fromiter((len(x) if x.is_valid else 0 for x in ids), np.int64, len(ids)) if ids.null_count else np.diff(ids.offsets.to_numpy())
        length = size[own]
        stops = np.cumsum(length)
        out = letters[np.arange(int(stops[-1]) if len(own) else 0) + np.repeat(first[own] - stops + length, length)]
        ends = np.concatenate([[0], np.concatenate([[0], stops])[np.cumsum(counts)]])
        lead = ends[:-1][counts > 0]
        lead = lead[out[lead] == 32]  # the space before each text
        ends = ends - np.searchsorted(lead, ends, "left")
        out = np.delete(out, lead)
        valid = None if not ids.null_count else pa.py_buffer(np.packbits(ids.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        column = pa.Array.from_buffers(pa.large_binary(), len(ids), [valid, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])
        try:
            return column.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that no text has
            return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    return encode, decode


def codec(spark: SparkSession, model: Pieces):
    """(encode, decode) column functions: text -> ids and ids -> text."""
    encode, decode = _coders(spark, model)
    return F.arrow_udf(encode, "array<int>"), F.arrow_udf(decode, "string")


def round_trip(spark: SparkSession, model: Pieces):
    """Column function text -> (ids, text decoded from these ids). Where both are wanted, ``decode(encode(text))`` beside ``encode(text)``
    would encode twice, as Spark evaluates nested Python functions as one and shares no part of them."""
    encode, decode = _coders(spark, model)

    @F.arrow_udf("struct<ids: array<int>, text: string>")
    def both(text: pa.Array) -> pa.Array:
        ids = encode(text)
        return pa.StructArray.from_arrays([ids, decode(ids)], ["ids", "text"])

    return both
