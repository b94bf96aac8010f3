"""Stored members of ZIP archives, located by their directories and read by range."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

#: Fixed values of the format: signatures and sizes of its structures.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ZIP64_FIELD = 1


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    header: int  # where its local header starts


#: Reads length bytes from an offset.
ReadAt = Callable[[int, int], bytes]


def _directory(read_at: ReadAt, total: int) -> tuple[int, int, int]:
    """Offset, size and number of entries of the central directory."""
    tail_size = min(total, END_SIZE + FULL16 + LOCATOR_SIZE)
    tail = read_at(total - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0 and at + END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, entries, size, offset, _ = struct.unpack("<4H2LH", tail[at + 4 : at + END_SIZE])
    if FULL16 in (entries,) or FULL32 in (size, offset):
        spot = total - tail_size + at - LOCATOR_SIZE
        locator = read_at(spot, LOCATOR_SIZE) if spot >= 0 else b""
        if locator[:4] != LOCATOR64:
            raise ValueError("no locator of the ZIP64 directory")
        record = read_at(struct.unpack("<Q", locator[8:16])[0], END64_SIZE)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        _, entries, size, offset = struct.unpack("<4Q", record[24:56])
    return offset, size, entries


def members(read_at: ReadAt, total: int) -> list[Member]:
    """The members that the central directory lists, ZIP64 fields resolved."""
    offset, size, entries = _directory(read_at, total)
    data, out, i = read_at(offset, size), [], 0
    for _ in range(entries):
        if data[i : i + 4] != ENTRY:
            raise ValueError("broken central directory")
        (flags, method) = struct.unpack("<2H", data[i + 8 : i + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<2L3H", data[i + 20 : i + 34])
        (header,) = struct.unpack("<L", data[i + 42 : i + 46])
        name = data[i + ENTRY_SIZE : i + ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[i + ENTRY_SIZE + n_name : i + ENTRY_SIZE + n_name + n_extra]
        j = 0
        while j + 4 <= len(extra):
            kind, length = struct.unpack("<2H", extra[j : j + 4])
            if kind == ZIP64_FIELD:
                wide = [x for (x,) in struct.iter_unpack("<Q", extra[j + 4 : j + 4 + length // 8 * 8])]
                # present in this order, each only if its own field is full
                plain = wide.pop(0) if plain == FULL32 and wide else plain
                packed = wide.pop(0) if packed == FULL32 and wide else packed
                header = wide.pop(0) if header == FULL32 and wide else header
            j += 4 + length
        out.append(Member(name, method == zipfile.ZIP_STORED and packed == plain, plain, header))
        i += ENTRY_SIZE + n_name + n_extra + n_note
    return out


def data_offset(read_at: ReadAt, member: Member) -> int:
    """Where a stored member's bytes start."""
    if not member.stored:
        raise ValueError(f"{member.name} is compressed; records in it can't be read by range")
    head = read_at(member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack("<2H", head[26:30])
    return member.header + LOCAL_SIZE + n_name + n_extra
