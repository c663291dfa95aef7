"""ZIP archives as rows of parts, with one error kind per way in which an archive can fail."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .blocks import rows_of

#: Declared sizes beyond this are refused before anything is inflated.
MAX_ENTRY = 512 << 20

PART_DDL = "path string, ord int, part string, content binary, error_kind string"


class ArchiveError(ValueError):
    """kind: notAnArchive, zip64, truncated, encrypted, unsupportedMethod, tooLarge, sizeMismatch, missing."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


class Archive:
    """The central directory of a ZIP archive; entries are inflated only when asked for. CRCs are not checked."""

    def __init__(self, data: bytes):
        self.data = data
        end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
        if end < 0 or end + 22 > len(data):
            raise ArchiveError("notAnArchive")
        count, size, at = struct.unpack_from("<HII", data, end + 10)
        if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
            raise ArchiveError("zip64")
        self.entries: dict[str, tuple[int, int, int, int, int]] = {}
        for _ in range(count):
            if at + 46 > len(data) or data[at : at + 4] != b"PK\x01\x02":
                raise ArchiveError("truncated", "central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, plain = struct.unpack_from("<II", data, at + 20)
            n, extra, comment = struct.unpack_from("<HHH", data, at + 28)
            local = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
            self.entries.setdefault(name, (flags, method, packed, plain, local))
            at += 46 + n + extra + comment

    def read(self, name: str) -> bytes:
        if name not in self.entries:
            raise ArchiveError("missing", name)
        flags, method, packed, plain, local = self.entries[name]
        if flags & 1:
            raise ArchiveError("encrypted", name)
        if plain > MAX_ENTRY:
            raise ArchiveError("tooLarge", name)
        if local + 30 > len(self.data) or self.data[local : local + 4] != b"PK\x03\x04":
            raise ArchiveError("truncated", name)
        n, extra = struct.unpack_from("<HH", self.data, local + 26)
        start = local + 30 + n + extra
        raw = self.data[start : start + packed]
        if len(raw) < packed:
            raise ArchiveError("truncated", name)
        if method == 0:
            out = raw
        elif method == 8:
            try:
                out = zlib.decompressobj(-15).decompress(raw, plain + 1)
            except zlib.error as e:
                raise ArchiveError("sizeMismatch", str(e)) from e
        else:
            raise ArchiveError("unsupportedMethod", str(method))
        if len(out) != plain:
            raise ArchiveError("sizeMismatch", name)
        return out

    def get(self, name: str) -> bytes | None:
        return self.read(name) if name in self.entries else None


def parts(files: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """A row per entry of each file's archive (path, content), in the archive's order; only wanted names are inflated.

    An archive or entry that can't be read gives a row with its error kind and no content.
    """

    def entries(content: bytes) -> Iterator[dict]:
        try:
            archive = Archive(content)
        except Exception as e:  # a directory may be damaged in any way
            yield {"error_kind": getattr(e, "kind", "truncated")}
            return
        for i, name in enumerate(archive.entries):
            if wanted is None or name in wanted:
                try:
                    yield {"ord": i, "part": name, "content": archive.read(name)}
                except ArchiveError as e:
                    yield {"ord": i, "part": name, "error_kind": e.kind}

    return rows_of(files, ["content"], PART_DDL, entries)
