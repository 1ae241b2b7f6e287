"""Rows and small helpers for the tests of this folder."""

from __future__ import annotations

import zlib

import duckdb

SMALL = "/root/testdata/sf0.001"
#: Texts that are null, empty, only white space, one very long word, very long, repeated, or oddly spaced.
ODD_TEXTS = [
    (900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "x" * 70_000), (900_005, "wide  \x0bspace\r\nÉté Ünï 東京 1234567"),
    (900_006, "the of and " * 40_000), (900_007, "the of and " * 40_000), (900_008, "don't <|endoftext|> Σίσυφος ﬁ é  nbsp İstanbul"),
    (900_009, "one"), (900_010, "one two"), (900_011, "!?! --- ..."), (900_011, "!?! --- ..."), (None, "a text without an id"),
]


def remainder(doc_id, divisor: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % divisor


def read(name: str, columns: str = "*", folder: str = SMALL) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()
