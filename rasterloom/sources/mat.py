"""MAT files (version 5): enough of the format for ground truth, a cell array of structs with a Boundaries plane."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: numeric element types, array classes.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR = 1, 2, 4


def elements(data: bytes, order: str, pos: int = 0):
    """(type, bytes) of each data element; compressed ones are opened."""
    while pos + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, pos)
        if kind >> 16:  # short form: type and size share four bytes, the data the other four
            yield kind & 0xFFFF, data[pos + 4 : pos + 4 + (kind >> 16)]
            pos += 8
            continue
        body = data[pos + 8 : pos + 8 + size]
        pos += 8 + size
        if kind == COMPRESSED:
            yield from elements(zlib.decompress(body), order)
        else:
            yield kind, body
            pos += -size % 8


def matrix(data: bytes, order: str):
    """(name, value): numbers as arrays, cells as lists, structs as lists of dicts."""
    parts = list(elements(data, order))
    if not parts:
        return "", np.zeros((0, 0))
    kind = struct.unpack_from(order + "I", parts[0][1])[0] & 0xFF
    shape = np.frombuffer(parts[1][1], order + "i4")
    name, rest = parts[2][1].decode("latin-1"), parts[3:]
    if kind == CELL:
        return name, [matrix(body, order)[1] for _, body in rest]
    if kind == STRUCT:
        width = struct.unpack_from(order + "i", rest[0][1])[0]
        labels = [rest[1][1][i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(rest[1][1]), width)]
        values = [matrix(body, order)[1] for _, body in rest[2:]]
        return name, [dict(zip(labels, values[i : i + len(labels)])) for i in range(0, len(values), max(1, len(labels)))]
    if kind == CHAR or not rest:
        return name, np.zeros(shape)
    stored = np.frombuffer(rest[0][1], order + NUMBERS[rest[0][0]])
    return name, stored.reshape(shape, order="F")


def read(data: bytes) -> dict:
    """Variables of a file by name."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of version 5")
    order = "<" if data[126:128] == b"IM" else ">"
    return dict(matrix(body, order) for kind, body in elements(data, order, 128) if kind == MATRIX)


def boundaries(data: bytes) -> list[np.ndarray]:
    """Boolean planes, one an annotator: those of the variable groundTruth, else of the first cell array of structs with Boundaries."""
    found = read(data)
    for cell in [found.get("groundTruth"), *found.values()]:
        if isinstance(cell, list) and cell and isinstance(cell[0], list) and cell[0] and isinstance(cell[0][0], dict) and "Boundaries" in cell[0][0]:
            return [np.asarray(one[0]["Boundaries"]) != 0 for one in cell]
    raise ValueError("no cell array of structs with Boundaries")
