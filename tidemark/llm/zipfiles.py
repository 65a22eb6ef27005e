"""ZIP directories by range reads: members of an archive and where their bytes lie, without reading the members.

``read(offset, length)`` returns the bytes of a range of the archive. What is read
is the archive's end, its central directory and 30 bytes a member wanted.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Read = Callable[[int, int], bytes]

STORED, DEFLATED = 0, 8
_END, _LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
#: Bytes of the end record without its comment, the longest comment, the ZIP64 locator and the ZIP64 end record.
_TAIL = 22 + 65_535 + 20 + 56
_NONE16, _NONE32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """``header`` is where the member's local header begins, ``size`` its bytes as they lie in the archive."""

    name: str
    method: int
    size: int
    length: int
    crc: int
    header: int


def _end(read: Read, size: int) -> tuple[int, int, int, int]:
    """(entries, begin and size of the central directory, bytes that stand before the archive in the file)."""
    start = max(0, size - _TAIL)
    tail = read(start, size - start)
    at = len(tail)
    while True:
        at = tail.rfind(_END, 0, at + 3 if at < len(tail) else at)
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    stop = start + at
    locator = at - 20
    if locator >= 0 and tail[locator : locator + 4] == _LOCATOR:
        where = struct.unpack_from("<Q", tail, locator + 8)[0]
        record = read(where, 56) if where + 56 <= size else b""
        if record[:4] != _END64:  # bytes stand before the archive
            near = tail.rfind(_END64, 0, locator)
            if near < 0:
                raise ValueError("no ZIP64 end of directory where its locator points")
            where, record = start + near, tail[near : near + 56]
        entries64, length64, offset64 = struct.unpack_from("<QQQ", record, 32)
        entries = entries64 if entries == _NONE16 else entries
        length = length64 if length == _NONE32 else length
        offset = offset64 if offset == _NONE32 else offset
        stop = where
    if stop - length < offset:
        raise ValueError("ZIP directory longer than its archive")
    return entries, stop - length, length, stop - length - offset


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset of an entry, those that say so replaced by the ZIP64 field's."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body = extra[at + 4 : at + 4 + n]
            for i, v in enumerate(values):
                if v == _NONE32:
                    values[i], body = struct.unpack_from("<Q", body)[0], body[8:]
            break
        at += 4 + n
    return values


def members(read: Read, size: int) -> list[Member]:
    """All members of an archive of ``size`` bytes, in the order of its central directory."""
    entries, begin, length, before = _end(read, size)
    directory = read(begin, length)
    found, at = [], 0
    for _ in range(entries):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        crc, packed, full, n, extra, comment = struct.unpack_from("<IIIHHH", directory, at + 16)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, header = _wide(directory[at + 46 + n : at + 46 + n + extra], [full, packed, header])
        if flags & 1:
            raise ValueError(f"member {name} is encrypted")
        found.append(Member(name, method, packed, full, crc, header + before))
        at += 46 + n + extra + comment
    return found


def data_offset(read: Read, member: Member) -> int:
    """Where the member's bytes begin."""
    head = read(member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    name, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name + extra


def content(read: Read, member: Member) -> bytes:
    """The whole member, inflated where it is deflated, checked by its CRC."""
    raw = read(data_offset(read, member), member.size)
    if member.method == DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif member.method != STORED:
        raise ValueError(f"member {member.name} has method {member.method}")
    if zlib.crc32(raw) != member.crc:
        raise ValueError(f"member {member.name} is damaged")
    return raw


def ranges(read: Read, wanted: list[tuple[int, int]], most: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of the ranges (offset, length) in their order; neighbouring ranges are read together up to ``most`` bytes."""
    i = 0
    while i < len(wanted):
        begin, end = wanted[i][0], sum(wanted[i])
        j = i + 1
        while j < len(wanted) and wanted[j][0] == end and sum(wanted[j]) - begin <= most:
            end = sum(wanted[j])
            j += 1
        block = read(begin, end - begin)
        if len(block) < end - begin:
            raise ValueError("range beyond the end of the archive")
        for offset, length in wanted[i:j]:
            yield block[offset - begin : offset - begin + length]
        i = j
