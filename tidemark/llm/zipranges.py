"""Reading ZIP packages by ranges: the central directory, ZIP64 included, and stored members.

Nothing is extracted. ``ZipRanges`` reads the end of the file, then the directory, and gives
each member's place; ``read`` fetches bytes of a stored member by their place in it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Signatures and sizes of the ZIP format; fixed values.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED = 0


class BadPackage(ValueError):
    """The file isn't a ZIP package, or is cut off."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    stored: int
    size: int
    header: int


class ZipRanges:
    """``read_at(length, offset)`` reads the file; ``size`` is its length."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        self.members = {m.name: m for m in self._directory()}
        self._data: dict[str, int] = {}

    def _end(self) -> tuple[int, int, int]:
        """(offset, size, entries) of the central directory."""
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self.read_at(self.size - tail_at, tail_at)
        at = tail.rfind(END)
        while at >= 0:
            if len(tail) - at >= 22 and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22:
                break
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise BadPackage("no end of central directory")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if entries != FULL16 and size != FULL32 and offset != FULL32:
            return offset, size, entries
        place = tail_at + at - 20
        locator = self.read_at(20, place) if place >= 0 else b""
        if locator[:4] != LOCATOR64:
            return offset, size, entries
        end64_at = struct.unpack_from("<Q", locator, 8)[0]
        end64 = self.read_at(56, end64_at)
        if end64[:4] != END64:
            raise BadPackage("no ZIP64 end of central directory")
        entries, size, offset = struct.unpack_from("<QQQ", end64, 32)
        return offset, size, entries

    def _directory(self):
        offset, size, entries = self._end()
        data = self.read_at(size, offset)
        at = 0
        for _ in range(entries):
            if data[at : at + 4] != CENTRAL:
                raise BadPackage("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            stored, full, n_name, n_extra, n_comment, disk = struct.unpack_from("<IIHHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, stored, header = self._zip64(extra, full, stored, header)
            yield Member(name, method, stored, full, header)
            at += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _zip64(extra: bytes, *values: int) -> list[int]:
        """Values that are all ones are in the ZIP64 extra field, in this order."""
        out, at = list(values), 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                place = at + 4
                for k, v in enumerate(out):
                    if v == FULL32 and place + 8 <= at + 4 + n:
                        out[k] = struct.unpack_from("<Q", extra, place)[0]
                        place += 8
            at += 4 + n
        return out

    def data_offset(self, name: str) -> int:
        """Where a member's bytes begin; its local header says how long it is itself."""
        if name not in self._data:
            m = self.members[name]
            head = self.read_at(30, m.header)
            if head[:4] != LOCAL:
                raise BadPackage(f"no local header: {name}")
            n_name, n_extra = struct.unpack_from("<HH", head, 26)
            self._data[name] = m.header + 30 + n_name + n_extra
        return self._data[name]

    def read(self, name: str, length: int, offset: int = 0) -> bytes:
        """A range of a stored member."""
        m = self.members[name]
        if m.method != STORED:
            raise BadPackage(f"compressed member: {name}")
        if offset < 0 or length < 0 or offset + length > m.stored:
            raise BadPackage(f"range outside {name}")
        return self.read_at(length, self.data_offset(name) + offset)
