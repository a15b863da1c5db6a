import struct

import pytest


def _varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _number(value):
    out = b""
    while True:
        out += bytes([value & 127 | (128 if value > 127 else 0)])
        value >>= 7
        if not value:
            return out


def _fields(data):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag, value


def _message(fields):
    return b"".join(_number(t) + (_number(v) if t & 7 == 0 else v if t & 7 == 5 else _number(len(v)) + v) for t, v in fields)


@pytest.fixture(scope="session")
def as_unigram():
    """Rewrites a SentencePiece model file as a unigram model with given scores, for the library to read."""

    def rewrite(path, scores):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        out, n = [], 0
        for tag, value in fields:
            if tag >> 3 == 1:
                own = [(t, v) for t, v in _fields(value) if t >> 3 != 2]
                value = _message([*own[:1], (2 << 3 | 5, struct.pack("<f", scores[n])), *own[1:]])
                n += 1
            elif tag >> 3 == 2:
                value = _message([(t, 1 if t >> 3 == 3 else v) for t, v in _fields(value)])
            out.append((tag, value))
        return _message(out)

    return rewrite
