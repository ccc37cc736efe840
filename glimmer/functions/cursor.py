"""Opaque cursors: position, query fingerprint, last entity and snapshot boundary in a strict little-endian layout."""

from __future__ import annotations

import struct
from dataclasses import dataclass


class CursorError(ValueError):
    pass


@dataclass(frozen=True, order=True)
class Entity:
    """A span's natural identity (tag 0), or an assigned serial from 1 (tag 1). Orders as entities do."""

    tag: int
    trace_id: str = ""
    span_id: str = ""
    serial: int = 0

    def encode(self) -> bytes:
        if self.tag == 0:
            return b"\x00" + bytes.fromhex(self.trace_id) + bytes.fromhex(self.span_id)
        return b"\x01" + struct.pack("<Q", self.serial)

    @staticmethod
    def decode(raw: bytes) -> tuple[Entity, int]:
        if raw[:1] == b"\x00" and len(raw) >= 25:
            return Entity(0, raw[1:17].hex(), raw[17:25].hex()), 25
        if raw[:1] == b"\x01" and len(raw) >= 9 and (serial := struct.unpack("<Q", raw[1:9])[0]):
            return Entity(1, serial=serial), 9
        raise CursorError("malformed")


@dataclass(frozen=True, order=True)
class Key:
    """Residency order: admission time, then entity."""

    admitted_at: int
    entity: Entity


def fingerprint(canonical: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in canonical:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass(frozen=True)
class Cursor:
    anchor: Key
    fingerprint: int
    snapshot: Key

    def encode(self) -> bytes:
        return struct.pack("<QQ", self.anchor.admitted_at, self.fingerprint) + self.anchor.entity.encode() + struct.pack("<Q", self.snapshot.admitted_at) + self.snapshot.entity.encode()

    @staticmethod
    def decode(raw: bytes, expected: int | None = None) -> Cursor:
        """Raises CursorError unless ``raw`` is exactly one cursor (of the expected query, where one is given)."""
        if len(raw) < 17:
            raise CursorError("malformed")
        position, mark = struct.unpack("<QQ", raw[:16])
        last, used = Entity.decode(raw[16:])
        at = 16 + used
        if len(raw) < at + 9:
            raise CursorError("malformed")
        (nanos,) = struct.unpack("<Q", raw[at : at + 8])
        entity, used = Entity.decode(raw[at + 8 :])
        if at + 8 + used != len(raw):
            raise CursorError("malformed")
        if expected is not None and mark != expected:
            raise CursorError("another query's cursor")
        return Cursor(Key(position, last), mark, Key(nanos, entity))
