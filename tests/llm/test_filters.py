"""Stored media have filtered rows, so that reading back unfilters."""

import zlib

import numpy as np

from leadspark.llm import media as M


def test_rows_are_filtered():
    ramp = bytes(range(64))
    payload = ramp + bytes([200, 3] * 32) * 2 + bytes(64) + ramp
    png = M.encode(payload)
    at = png.index(b"IDAT")
    lines = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")]), np.uint8).reshape(-1, 65)
    assert lines[:, 0].tolist() == [1, 0, 2, 0, 1]
    assert M.decode([png])[0].tobytes() == payload
