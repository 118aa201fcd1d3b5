"""Symbols of ELF files as a table: one row for each function symbol, by file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tracelake.plans.session import ship

SCHEMA = "file string, build_id string, address bigint, size bigint, name string, precedence int"
# Fixed values of the format.
TYPES = {2, 3}  # executable, shared object
SYMTAB, DYNSYM, NOTE = 2, 11, 7
FUNCTION_TYPES = {1, 2, 10}  # object, function, indirect function


def read_symbols(data: bytes) -> tuple[str | None, list[tuple[int, int, str, int]]]:
    """(build id, [(address, size, name, precedence)]) of a 64-bit little-endian file; ValueError for others.

    Full symbol tables come before dynamic ones, global symbols before local ones.
    """
    if data[:4] != b"\x7fELF" or data[4:6] != b"\x02\x01":
        raise ValueError("not a 64-bit little-endian ELF file")
    kind, = struct.unpack_from("<H", data, 16)
    if kind not in TYPES:
        raise ValueError("not an executable or shared object")
    program, sections = struct.unpack_from("<QQ", data, 32)
    p_size, p_count, s_size, s_count = struct.unpack_from("<4H", data, 54)
    if not any(struct.unpack_from("<I", data, program + i * p_size)[0] == 1 for i in range(p_count)):
        raise ValueError("no loadable segment")
    heads = [struct.unpack_from("<IIQQQQIIQQ", data, sections + i * s_size) for i in range(s_count)]
    found: list[tuple[int, int, str, int]] = []
    build = None
    for _, s_type, _, _, offset, size, link, _, _, entry in heads:
        if offset + size > len(data) and s_type != 8:
            raise ValueError("section leaves the file")
        if s_type == NOTE and size >= 16:
            n_name, n_desc, n_type = struct.unpack_from("<III", data, offset)
            if n_type == 3 and data[offset + 12 : offset + 12 + n_name] == b"GNU\0":
                at = offset + 12 + (n_name + 3 & ~3)
                build = data[at : at + n_desc].hex()
        if s_type in (SYMTAB, DYNSYM) and entry:
            names = heads[link]
            table = data[names[4] : names[4] + names[5]]
            for at in range(offset, offset + size, entry):
                name, info, _, section, value, length = struct.unpack_from("<IBBHQQ", data, at)
                if info & 15 in FUNCTION_TYPES and section and name < len(table):
                    text = table[name : table.index(b"\0", name)].decode("utf-8", "replace")
                    if text:
                        found.append((value, length, text, (0 if s_type == SYMTAB else 2) + (0 if info >> 4 else 1)))
    return build, sorted(found)


def load_symbols(spark: SparkSession, path: str) -> DataFrame:
    """The symbols of every ELF file under a path; files that aren't one give no rows."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    build, symbols = read_symbols(data)
                except (ValueError, struct.error, IndexError):
                    continue
                rows += [(file, build, a - 2**64 if a >= 2**63 else a, n, s, p) for a, n, s, p in symbols]
            yield pd.DataFrame(rows, columns=["file", "build_id", "address", "size", "name", "precedence"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
