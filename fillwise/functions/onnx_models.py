"""Small ONNX models written without the ONNX package: sums of inputs, for tests and examples.

Only the few message fields that such a model needs are encoded (protobuf wire format)."""

from __future__ import annotations


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _message(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, width: int) -> bytes:
    shape = _message(1, _message(2, "batch")) + _message(1, _number(1, width))
    return _message(1, name) + _message(2, _message(1, _number(1, 1) + _message(2, shape)))


def sum_model(width: int) -> bytes:
    """total = a + b and twice = total + total, all float[batch, width]."""
    nodes = [(("a", "b"), "total"), (("total", "total"), "twice")]
    graph = b"".join(_message(1, b"".join(_message(1, i) for i in inputs) + _message(2, out) + _message(4, "Add")) for inputs, out in nodes)
    graph += _message(2, "g") + b"".join(_message(11, _tensor(n, width)) for n in ("a", "b")) + b"".join(_message(12, _tensor(n, width)) for n in ("total", "twice"))
    return _number(1, 8) + _message(7, graph) + _message(8, _number(2, 13))
