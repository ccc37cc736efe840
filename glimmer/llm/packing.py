"""Best-fit packing of token sequences, certified by dual feasible functions.

Documents become token ids (one closing id added) and only those over ``capacity`` are cut. Pieces are dealt to
partitions by a hash; each partition packs best-fit decreasing and compares its bin count with lower bounds from dual
feasible functions. Where bound and count agree the partition is done; partitions with gaps hand the documents of
their loosest bins to new groups across partitions, which pack again, and a regrouping that needs no fewer bins is
not taken.

Defined results: a null or empty text is the closing id alone; null and repeated doc_ids are packed row by row; an
empty table gives an empty one; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count, islice, repeat
from operator import not_
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, kept, materialize, table
from .word_bpe import IdRows, WordMerger

CAPACITY = 2048
_ODD_SPACE = "\x1c\x1d\x1e\x1f᠎"


#: The steps before the merges that the fast path knows; a file with others goes to the library whole. The pattern parts
#: lower-cased text and is only used for words whose letters all Unicode versions agree on.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_PIECE = regex.compile(_PATTERN)
_BEYOND = re.compile("[^\\x00-\u024f]")


def _numbers() -> defaultdict[str, int]:
    """Numbers words from 0 in the order in which they are first asked for."""
    return defaultdict(count().__next__)


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file whose pre-tokens never hold white space.

    Words repeat, so each gets a number when it is met and its ids are kept under it, in two generations of which the
    older is dropped when the younger is full; what is met again moves to the younger. New words are merged by
    ``WordMerger``, many at a time, their parts once for all of them. Words with letters beyond Latin, on whose classes
    and cases Unicode versions may differ, go to the library's tokenizer; so do whole texts that hold an added token of
    the file (one id, as the library has it), and all texts where the file's normaliser or pre-tokens are not those
    that the fast path knows.
    """

    def __init__(self, path: str, most_words: int = 150_000):
        self.path = path
        self._tokenizer = None
        file = json.loads(Path(path).read_text())
        self.plain = all(file.get(k) == v for k, v in _KNOWN.items())
        self.marks = [x["content"] for x in file.get("added_tokens") or []]
        self.merger = WordMerger(path) if self.plain else None
        self.most_words = most_words
        self.numbers, self.ids = _numbers(), IdRows()
        self.older: tuple[dict[str, int], IdRows] = ({}, IdRows())

    @property
    def tokenizer(self):
        """The library's tokenizer, loaded when a word first needs it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def _whole(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(words, add_special_tokens=False)] if words else []

    def learn(self) -> None:
        """Ids for all numbers that have none yet."""
        new = [*islice(self.numbers, len(self.ids), None)]
        if not new:
            return
        older, ids = self.older
        at = np.fromiter(map(older.get, new, repeat(-1)), np.int64, len(new))
        made = self._made([*compress(new, (at < 0).tolist())])
        at[at < 0] = np.arange(len(made)) + len(ids)
        self.ids = self.ids + (ids + made).take(at)

    def _made(self, words: list[str]) -> IdRows:
        joined = "\n".join(words)
        if not joined.isascii() and _BEYOND.search(joined):
            far = np.array([not w.isascii() and _BEYOND.search(w) is not None for w in words])
            whole = IdRows.of(self._whole([*compress(words, far.tolist())]))
            at = np.where(far, np.cumsum(far) - 1, len(whole) + np.cumsum(~far) - 1)
            return (whole + self._made([*compress(words, (~far).tolist())])).take(at)
        low = joined.lower().split("\n") if words else []
        single = [*map(str.isalpha, low)]
        parted = [(x[:-1], x[-1]) if x[-1] in ".,:;?!" and x[:-1].isalpha() else _PIECE.findall(x) for x in compress(low, map(not_, single))]
        parts = _numbers()
        alone = np.fromiter(map(parts.__getitem__, compress(low, single)), np.int64)
        others = np.fromiter(map(parts.__getitem__, chain.from_iterable(parted)), np.int64)
        # of each word the parts, end to end
        single = np.array(single, bool)
        size = np.ones(len(low), np.int64)
        size[~single] = [*map(len, parted)]
        of = np.empty(int(size.sum()), np.int64)
        whole = np.repeat(single, size)
        of[whole], of[~whole] = alone, others
        ask = [*parts]
        made = IdRows()
        for i in range(0, len(ask), 20_000):
            made = made + self.merger.encode("\n".join(ask[i : i + 20_000]).encode().split(b"\n"))
        return made.take(of).joined(size)

    def encode_batch(self, texts: list[str | None], most_chars: int = 4_000_000) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, in order; words are learned for some texts at a time."""
        i = 0
        while i < len(texts):
            if len(self.numbers) > self.most_words:
                self.older, self.numbers, self.ids = (self.numbers, self.ids), _numbers(), IdRows()
            number = self.numbers.__getitem__
            part: list = []
            size = 0
            while i < len(texts) and (not part or size < most_chars):
                text = texts[i] or ""
                i += 1
                size += len(text)
                if not self.plain or any(c in text for c in _ODD_SPACE) or any(m in text for m in self.marks):
                    part.append(text)
                    continue
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                words = text.split()
                part.append(np.fromiter(map(number, words), np.int32, len(words)))
            self.learn()
            known = [x for x in part if not isinstance(x, str)]
            ids = iter(self.ids.take(np.concatenate(known)).joined(np.array([*map(len, known)])).bytes()) if known else iter(())
            for x in part:
                yield self._whole([x])[0].tobytes() if isinstance(x, str) else next(ids)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text])), "<u4").tolist()


def tokenizer_for(path: str) -> WordTokenizer:
    return kept(("tokenizer", path), lambda: WordTokenizer(path))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 per piece; one pass over the texts, no shuffle."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer_for(tokenizer_path)
        for b in batches:
            out = []
            end = struct.pack("<I", closing)
            for doc_id, ids in zip(b.doc_id.array, t.encode_batch(b.text.tolist())):
                ids += end
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    out.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins) for each item: longest first, each into the fullest bin that holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []
    n = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                del open_bins[room]
                rooms.pop(k)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            if left in open_bins:
                open_bins[left].append(b)
            else:
                open_bins[left] = [b]
                insort(rooms, left)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions.

    For a threshold p up to half the capacity, sizes over capacity - p count whole and sizes under p not at all; for
    k = 1.., a size s counts floor((k+1)s/capacity)/k, or s/capacity where (k+1)s is a multiple of the capacity.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """As ``lower_bound``, of how many items there are of each size from 0."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    many, mass = np.cumsum(count), np.cumsum(count * size)
    p = np.arange(0, capacity // 2 + 1)
    below = np.where(p > 0, mass[np.maximum(p - 1, 0)], 0)
    best = int((-(-(mass[capacity - p] - below + capacity * (many[-1] - many[capacity - p])) // capacity)).max())
    for k in range(1, 41):
        whole = (k + 1) * size % capacity == 0
        scaled = np.where(whole, k * size, (k + 1) * size // capacity * capacity)  # times k * capacity
        best = max(best, int(-(-int((count * scaled).sum()) // (k * capacity))))
    return best


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = 50_000, rounds: int | None = None, loose_share: float = 0.1) -> DataFrame:
    """``pieces`` (any columns, with length) plus sequence_id and offset; columns of these names are replaced, and one
    named ``_uid`` is refused.

    ``partition_pieces`` is the expected size of a partition and bounds what one task holds. Partitions exchange until
    no gap is left or two rounds in a row saved no sequence (``rounds`` bounds them where given).
    """
    if "_uid" in pieces.columns:
        raise ValueError("column _uid is reserved")
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    marked = materialize(pieces.withColumn("_uid", F.monotonically_increasing_id()))
    full = marked.where(F.col("length") >= capacity).select(*names, (-F.col("_uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = marked.where(F.col("length") < capacity).select("_uid", "length")
    n = todo.count()

    def groups_of(rows: int) -> int:
        return max(1, round(rows / partition_pieces))

    def packer(number: int):
        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_uid", kind="stable").reset_index(drop=True)
            lengths, g = rows.length.to_numpy(np.int64), int(rows["_group"].iloc[0])
            at, offset, bins = best_fit_decreasing(lengths, capacity)
            was = rows["_bin"].nunique() if number else bins + 1
            gap = bins > lower_bound(lengths, capacity)
            taken = bins < was
            if not taken:  # as good as before: the packing stays, and meets others next time where it has a gap
                return pd.DataFrame({"_uid": rows["_uid"], "length": lengths, "_bin": rows["_bin"], "_offset": rows["_offset"], "_loose": gap})
            load = np.bincount(at, lengths, bins)
            loose = np.zeros(bins, bool)
            if gap:
                loose[np.argsort(load, kind="stable")[: max(32, int(bins * loose_share))]] = True
            return pd.DataFrame({"_uid": rows["_uid"], "length": lengths, "_bin": (number << 56) + (g << 32) + at, "_offset": offset, "_loose": loose[at]})

        return pack

    schema = "_uid long, length long, _bin long, _offset long, _loose boolean"
    k = groups_of(n)
    dealt = todo.select("*", F.lit(0).cast("long").alias("_bin"), F.lit(0).cast("long").alias("_offset"), F.pmod(F.xxhash64("_uid"), F.lit(k)).alias("_group"))
    now = materialize(dealt.groupBy("_group").applyInPandas(packer(0), schema))
    number, idle, before = 0, 0, None
    while k > 1 and idle < 2 and (rounds is None or number < rounds):
        number += 1
        loose = now.where("_loose")
        m = loose.count()
        if not m:
            break
        again = loose.select("_uid", "length", "_bin", "_offset", F.pmod(F.xxhash64("_bin", F.lit(number)), F.lit(groups_of(m))).alias("_group"))
        new = materialize(now.where("not _loose").unionByName(again.groupBy("_group").applyInPandas(packer(number), schema)))
        discard(now)
        now, all_bins = new, new.select(F.count_distinct("_bin")).first()[0]
        idle, before = (idle + 1 if all_bins == before else 0), all_bins
    placed = marked.where(F.col("length") < capacity).join(now.select("_uid", F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset")), "_uid").select(*names, "sequence_id", "offset")
    return full.unionByName(placed)


def packing_gap(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, the certified lower bound over all lengths, and how many sequences lie between them."""
    sizes = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        count[r.length] = r.n
    bound = bound_of(count, capacity)
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_pieces(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
