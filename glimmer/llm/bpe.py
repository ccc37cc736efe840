"""Byte-level BPE encoding and decoding: Spark's higher-order functions fold the distinct words.

Encoding is one narrow stage without a shuffle, so a lost executor costs no more than its tasks:

1. A pass over the texts cuts them into words. A word that is itself a piece has its id; any other gets a number, and
   its byte array, with its first ``FIRST_JOINS`` joins made by numpy, leaves once in a task, ahead of the first document
   that needs it.
2. Higher-order functions fold these arrays: the leftmost pair of lowest rank is joined until no pair has a rank, as
   the published encoders do. The rank map of pairs of ids is a literal: a perfect hash of two arrays, so a lookup
   is two reads and an XOR at any size.
3. The next pass receives the folded words in the same order, writes and decodes the ids of each word once and joins
   what its words have to each document by Arrow.

Decoding concatenates the binary pieces of the ids.

Bounds: a task holds at most ``most_words`` folded words and then begins anew, which costs time and changes nothing. A
fold of n bytes costs n^2 small steps, so words of over ``LONG_WORD`` bytes are joined by a heap (n log n) in the first
pass instead, to the same ids; tests hold both against the library. A table of the commonest words, learnt from a
bounded sample and folded likewise, spares tasks the folds that they have in common.

Defined results: a null or empty text has no ids and decodes to no bytes; a null doc_id keeps its row; repeated rows
all come back; an empty table gives an empty one; whole texts are read; extra columns pass through ``encode`` and
``decode``, whose own columns win a clash of names; columns named ``_words``, ``_done``, ``_first`` or ``_numbers`` are
refused by ``encode``.
"""

from __future__ import annotations

import base64
import heapq
import json
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Where a text has only characters under this one, letters and numbers are written out for the faster matcher.
_NEAR = 0x250
#: Words of more bytes are not folded by higher-order functions.
LONG_WORD = 1024
#: The first joins of a word are made where its byte array is; the fold makes all others.
FIRST_JOINS = 3
_ROW_WORDS = 512
#: Bytes after which a batch to or from the fold goes on.
_CHUNK = 4 << 20
_ID_BITS, _RANK_BITS = 20, 22
_NONE = 1 << _RANK_BITS
#: A token in a fold is one long: rank of the pair that it opens, place in the word, id.
_PLACE_BITS = 12
_LOW = _PLACE_BITS + _ID_BITS


def unicode_spaces(pattern: str) -> str:
    """The same pattern with \\s and \\S written out, as Python counts four control characters among them as well."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            if inside and two == r"\S":
                raise ValueError("\\S inside a class can't be written out")
            out.append(_SPACE if inside else f"[{_SPACE}]" if two == r"\s" else f"[^{_SPACE}]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = True if two[0] == "[" else False if two[0] == "]" else inside
            out.append(two[0])
            i += 1
    return "".join(out)


def near_pattern(pattern: str) -> str:
    """The same pattern for characters under ``_NEAR``, with \\p{L} and its like written out."""

    def written(found: re.Match) -> str:
        return "".join(re.escape(chr(c)) for c in range(_NEAR) if unicodedata.category(chr(c)).startswith(found[1]))

    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        inside = True if part == "[" else False if part == "]" else inside
        if found := re.fullmatch(r"\\p\{(\w+)\}", part):
            part = written(found) if inside else f"[{written(found)}]"
        out.append(part)
    return "".join(out)


def word_finder(pattern: str):
    """All matches of the pattern in a text."""
    import regex

    any_text, near_text = regex.compile(pattern).findall, re.compile(near_pattern(pattern)).findall
    far = re.compile(f"[^\0-{chr(_NEAR - 1)}]").search
    return lambda text: near_text(text) if far(text) is None else any_text(text)


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used; a literal so stands in a plan once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joined_pairs(ranks: dict[bytes, int]) -> dict[int, dict[int, int]]:
    """Left id to right id to the id of the two pieces together."""
    out: dict[int, dict[int, int]] = {}
    for piece, joined in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                out.setdefault(left, {})[right] = joined
    return out


def _prime(least: int) -> int:
    n = least | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def displaced(pairs: dict[int, dict[int, int]]) -> tuple[list[int], list[int]]:
    """(shifts, entries): a perfect hash of the pairs. With ``key = left * 2^20 + right``, the joined id is
    ``entries[(key + shifts[key % len(shifts)]) % len(entries)] ^ (key << 22)``, and a pair without a rank gives at
    least 2^22. Groups of keys with one shift are placed from the largest."""
    joined = {(left << _ID_BITS) + right: r for left, row in pairs.items() for right, r in row.items()}
    p, q = _prime(max(3, len(joined) // 3)), _prime(max(5, len(joined) * 3 // 2))
    groups: dict[int, list[int]] = {}
    for key in joined:
        groups.setdefault(key % p, []).append(key)
    empty = 1 << (2 * _ID_BITS + _RANK_BITS)
    shifts, entries = [0] * p, [empty] * q
    rng = random.Random(0)
    for at, keys in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        while True:
            d = rng.randrange(q)
            slots = [(k + d) % q for k in keys]
            if all(entries[s] == empty for s in slots) and len({*slots}) == len(slots):
                break
        shifts[at] = d
        for s, k in zip(slots, keys):
            entries[s] = (k << _RANK_BITS) ^ joined[k]
    return shifts, entries


def heap_fold(word: bytes, byte_ids: list[int], pairs: dict[int, dict[int, int]]) -> list[int]:
    """The ids of one word by a heap of pairs and a linked list, in n log n."""
    ids: list[int | None] = [byte_ids[x] for x in word]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    rank = lambda i: pairs.get(ids[i], {}).get(ids[after[i]]) if after[i] < len(ids) else None
    heap = [(r, i, ids[i], ids[after[i]]) for i in range(len(ids)) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= len(ids) or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = r, None, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (x := rank(k)) is not None:
                heapq.heappush(heap, (x, k, ids[k], ids[after[k]]))
    return [x for x in ids if x is not None]


def ranks_of(keys: np.ndarray, shifts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The ids that pairs of ids join to, or ``_NONE``, by the tables of ``displaced``."""
    return np.minimum(entries[(keys + shifts[keys % len(shifts)]) % len(entries)] ^ (keys << _RANK_BITS), _NONE)


def byte_array(words: list[bytes], ids: np.ndarray, first: np.ndarray, shifts: np.ndarray, entries: np.ndarray, joins: int = FIRST_JOINS) -> pa.ListArray:
    """The array of each word between two edges, as a fold begins with it: each token's id, its place, and the rank of
    the pair that it opens, in one long. Tokens are bytes, of which up to ``joins`` pairs are joined as the fold would
    join them, in all words at once."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.append(0, np.cumsum(size))
    raw = np.full(int(starts[-1]), 256, np.int64)
    inside = np.ones(len(raw), bool)
    inside[starts[:-1]] = inside[starts[1:] - 1] = False
    raw[inside] = np.frombuffer(b"".join(words), np.uint8)
    ranks = first[raw, np.append(raw[1:], 256)]
    place = np.arange(len(raw)) - np.repeat(starts[:-1], size)
    tokens = (ranks << _LOW) + (place << _ID_BITS) + ids[raw]
    id_of, none = (1 << _ID_BITS) - 1, _NONE << _LOW
    for _ in range(joins if words else 0):
        low = np.minimum.reduceat(tokens, starts[:-1])
        on = low < none
        at = np.flatnonzero((tokens == np.repeat(low, size)) & np.repeat(on, size))  # one in a word, as places differ
        if not len(at):
            break
        joined = tokens[at] >> _LOW
        left, right = tokens[at - 1], tokens[at + 2]
        tokens[at - 1] = (ranks_of(((left & id_of) << _ID_BITS) + joined, shifts, entries) << _LOW) + (left & ((1 << _LOW) - 1))
        tokens[at] = (ranks_of((joined << _ID_BITS) + (right & id_of), shifts, entries) << _LOW) + (tokens[at] & (((1 << _PLACE_BITS) - 1) << _ID_BITS)) + joined
        tokens = np.delete(tokens, at + 1)
        size -= on
        starts = np.append(0, np.cumsum(size))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tokens))


def _joined(texts: pa.Array, of: pa.Array, starts: np.ndarray, between: str | bytes) -> pa.Array:
    """The texts of those numbers, joined from start to start."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), texts.take(of)), between)


def _named(words: pa.ListArray, id_texts: pa.Array, pieces: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each word's tokens between its edges: the ids joined by commas, their number, and the bytes they decode to."""
    size = words.value_lengths().to_numpy()
    ends = np.cumsum(size)
    inside = np.ones(int(size.sum()), bool)
    inside[ends - size] = inside[ends - 1] = False
    ids = pa.array(words.flatten().to_numpy()[inside] & ((1 << _ID_BITS) - 1))
    starts = np.append(0, np.cumsum(size - 2))
    return _joined(id_texts, ids, starts, ","), pa.array(size - 2, pa.int64()), _joined(pieces, ids, starts, b"")


class _Numbers(dict):
    """Word to number: the place of a piece or learnt word in their list, running numbers beyond it for any other."""

    def __init__(self, listed: list[str]):
        super().__init__(zip(listed, range(len(listed))))
        self.new: list[str] = []
        self.next = len(listed)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = self.next
        self.next += 1
        return n


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most_words: int = 250_000):
        """Every byte must be a piece. ``most_words`` bounds the folded words that a task holds."""
        self.ranks, self.pattern, self.most_words = ranks, unicode_spaces(pattern), most_words
        self.pairs = joined_pairs(ranks)
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        self.edge = max(ranks.values()) + 1  # stands before and behind a word; no pair with it has a rank
        if self.edge >> _ID_BITS or LONG_WORD + 2 >> _PLACE_BITS:
            raise ValueError("ids over 2^20 and words over 2^12 bytes have no place in a fold")
        shifts, entries = displaced(self.pairs)
        self.sizes = len(shifts), len(entries)
        self.rank_map = F.from_json(F.lit(json.dumps({"shifts": shifts, "entries": entries}, separators=(",", ":"))), "shifts array<bigint>, entries array<bigint>")
        ids = np.array([*self.byte_ids, self.edge], np.int64)
        first = np.full((257, 257), _NONE, np.int64)
        for i, left in enumerate(self.byte_ids):
            row = self.pairs.get(left, {})
            first[i, :256] = [row.get(right, _NONE) for right in self.byte_ids]
        self.byte_rows = ids, first, np.array(shifts, np.int64), np.array(entries, np.int64)
        self.known: dict[str, str] = {}

    def folded(self, word: Column, literal: Column) -> Column:
        """The tokens of one word between its edges, with no pair left to join; the low bits of each are its id. ``word``
        is the byte array as ``byte_array`` makes it; ``literal`` is the rank map, bound by ``let``.

        These functions are interpreted, so each node of a step costs: a pair is packed once in one long and bound, and
        bits are set rather than added."""

        def long(value: int) -> Column:
            return F.lit(value).cast("bigint")

        token, place = (1 << _ID_BITS) - 1, ((1 << _PLACE_BITS) - 1) << _ID_BITS

        def opened(pair: Column) -> Column:
            # of the left token's place, the left id and the right id: the left token with its pair's rank
            key = pair.bitwiseAND(long((1 << 2 * _ID_BITS) - 1))
            found = F.get(literal["entries"], (key + F.get(literal["shifts"], key % long(self.sizes[0]))) % long(self.sizes[1])).bitwiseXOR(F.shiftleft(key, _RANK_BITS))
            return F.shiftleft(F.least(found, long(_NONE)), _LOW).bitwiseOR(F.shiftright(pair, _ID_BITS))

        def merged(s: Column, low: Column, at: Column) -> Column:
            joined, before, after = F.shiftright(low, _LOW), F.get(s, at - 2), F.get(s, at + 1)
            left = F.shiftleft(before.bitwiseAND(long((1 << _LOW) - 1)), _ID_BITS).bitwiseOR(joined)
            right = F.shiftleft(low.bitwiseAND(long(place)).bitwiseOR(joined), _ID_BITS).bitwiseOR(after.bitwiseAND(long(token)))
            return F.flatten(F.array(F.slice(s, F.lit(1), at - 2), F.transform(F.array(left, right), opened), F.slice(s, at + 2, F.lit(2**30))))

        def step(s: Column) -> Column:
            # the least entry is the leftmost pair of lowest rank
            return let(F.array_min(s), lambda low: F.when(low >= long(_NONE << _LOW), s).otherwise(let(F.array_position(s, low).cast("int"), lambda at: merged(s, low, at))))

        # n bytes between two edges have n - 1 joins at most
        return F.aggregate(F.slice(word, F.lit(4), F.lit(2**30)), word, lambda s, _: step(s))

    def fold(self, word: Column, literal: Column) -> Column:
        """Ids of one word, joined by commas."""
        return let(self.folded(word, literal), lambda s: F.array_join(F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND((1 << _ID_BITS) - 1).cast("string")), ","))

    def learn_words(self, docs: DataFrame, text: str = "text", most_words: int = 131_072, most_docs: int = 20_000) -> None:
        """Fold the commonest words of about ``most_docs`` documents (drawn by a hash) once for all tasks.

        The bounded table that tasks then share changes the cost and never a result."""
        total = max(docs.count(), 1)
        drawn = docs.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most_docs / total))).select(F.col(text).cast("string"))
        pieces, pattern = {*self._pieces()}, self.pattern

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, seen = word_finder(pattern), Counter()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    seen.update(find(t) if t else ())
                found = [(w, n) for w, n in seen.items() if w not in pieces and len(w) <= 64]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["w", "n"])
                seen = Counter()

        common = drawn.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(most_words)
        rows = self.byte_rows

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), byte_array([w.encode() for w in words], *rows)], names=["w", "word"])

        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        made = common.select("w").repartition(parts).mapInArrow(arrays, "w string, word array<bigint>").select("w", let(self.rank_map, lambda literal: self.fold(F.col("word"), literal)).alias("ids")).toArrow()
        self.known = dict(zip(made.column(0).to_pylist(), made.column(1).to_pylist()))

    def _pieces(self) -> dict[str, str]:
        """Pieces that are texts of their own, with their ids."""
        out = {}
        for piece, i in self.ranks.items():
            try:
                out[piece.decode()] = str(i)
            except UnicodeDecodeError:
                continue
        return out

    def _written(self, listed: dict[str, str]) -> tuple:
        """What the ids of the listed words are written as, as ``_named`` gives it, and the decimal id and the piece of
        each id."""
        pieces: list[bytes] = [b""] * (self.edge + 1)
        for piece, i in self.ranks.items():
            pieces[i] = piece
        by_id = pa.array(map(str, range(len(pieces))), pa.string()), pa.array(pieces, pa.binary())
        return _named(pa.array([[0, *map(int, ids.split(",")), 0] for ids in listed.values()], pa.list_(pa.int64())), *by_id), *by_id

    def encode(self, docs: DataFrame, text: str = "text", to: str = "ids", count: str = "n_tokens", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
        """``docs`` with the decimal ids of each text, joined by commas, and their number; with ``decoded`` also the
        bytes that these ids decode to, in the same pass."""
        own = {"_words", "_done", "_first", "_numbers"}
        if clash := own & set(docs.columns):
            raise ValueError(f"columns {sorted(clash)} are reserved")
        rest = docs.select([c for c in docs.columns if c not in (to, count, decoded) and (keep_text or c != text)])
        source = docs.select(*(F.col(f"`{c}`") for c in rest.columns), F.col(text).cast("string").alias("_words"))
        listed = {**self.known, **self._pieces()}
        # as large as the vocabulary and the learnt words
        context = docs.sparkSession.sparkContext
        to_cut = context.broadcast((list(listed), self.byte_ids, self.byte_rows, self.pairs))
        to_write = context.broadcast(self._written(listed))
        pattern, most_words, width = self.pattern, self.most_words, len(rest.columns)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = word_finder(pattern)
            listed, byte_ids, byte_rows, pairs = to_cut.value
            numbers = _Numbers(listed)
            sent = least = numbers.next

            def words_of(schema: pa.Schema) -> pa.RecordBatch:
                raw = [w.encode() for w in numbers.new]
                done = [[0, *heap_fold(w, byte_ids, pairs), 0] if len(w) > LONG_WORD else None for w in raw]  # with edges, as folded words have
                inner = byte_array([w if d is None else b"" for w, d in zip(raw, done)], *byte_rows)
                starts = [*range(0, len(raw), _ROW_WORDS)]
                outer = pa.array([*starts, len(raw)], pa.int32())
                out = {"_words": pa.ListArray.from_arrays(outer, inner), "_done": pa.ListArray.from_arrays(outer, pa.array(done, pa.list_(pa.int64()))), "_first": pa.array([sent + s for s in starts], pa.int32()), "_numbers": pa.nulls(len(starts), pa.binary())}
                return pa.RecordBatch.from_arrays([pa.nulls(len(starts), f.type) for f in schema][:width] + [*out.values()], names=schema.names[:width] + [*out])

            for batch in batches:
                schema, texts = batch.schema, batch.column(width)
                begin, size, coded = 0, 0, []

                def documents() -> Iterator[pa.RecordBatch]:
                    if numbers.new:
                        yield words_of(schema)
                    if coded:
                        n = len(coded)
                        out = {"_words": pa.nulls(n, pa.list_(pa.list_(pa.int64()))), "_done": pa.nulls(n, pa.list_(pa.list_(pa.int64()))), "_first": pa.nulls(n, pa.int32()), "_numbers": pa.array(coded, pa.binary())}
                        yield pa.RecordBatch.from_arrays([batch.column(i).slice(begin, n) for i in range(width)] + [*out.values()], names=schema.names[:width] + [*out])

                for k in range(len(texts)):
                    t = texts[k].as_py()
                    new_words = numbers.next - least > most_words  # no document needs words of two generations
                    if new_words or size > _CHUNK:
                        yield from documents()
                        begin, size, coded, numbers.new, sent = k, 0, [], [], numbers.next
                        if new_words:
                            numbers, sent = _Numbers(listed), least
                    coded.append(np.fromiter(map(numbers.__getitem__, find(t)), np.int32).tobytes() if t else b"")
                    size += len(coded[-1])
                yield from documents()
                numbers.new, sent = [], numbers.next

        plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in rest.schema])
        sent = source.mapInArrow(cut, T.StructType([*plain, *T._parse_datatype_string("_words array<array<bigint>>, _done array<array<bigint>>, _first int, _numbers binary").fields]))
        folded = F.when(F.col("_words").isNotNull(), let(self.rank_map, lambda literal: F.zip_with("_words", "_done", lambda w, d: F.coalesce(d, self.folded(w, literal)))))
        sent = sent.select(*(F.col(f"`{c}`") for c in rest.columns), folded.alias("_words"), "_first", "_numbers")
        names = [to, count] + [decoded] * bool(decoded)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed, id_texts, pieces = to_write.value
            known, new = listed, []

            for batch in batches:
                first, words, numbers = (batch.column(width + i) for i in (1, 0, 2))
                rows, coded, size = [], [], 0

                def made() -> pa.RecordBatch:
                    nonlocal known, new
                    if new:
                        known, new = tuple(map(pa.concat_arrays, zip(known, *new))), []
                    of = pa.array(np.frombuffer(b"".join(coded), np.int32))
                    starts = np.cumsum([0, *(len(c) // 4 for c in coded)])
                    counts = np.append(0, np.cumsum(known[1].take(of).to_numpy()))[starts]
                    columns = [_joined(known[0], of, starts, ","), pa.array(np.diff(counts), pa.int64())]
                    if decoded:
                        columns.append(_joined(known[2], of, starts, b""))
                    return pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(rows)) for i in range(width)] + columns, names=[*batch.schema.names[:width], *names])

                for k, at in enumerate(first.to_pylist()):
                    if at is None:
                        rows.append(k)
                        coded.append(numbers[k].as_py())
                        size += len(coded[-1])
                    if rows and (size > _CHUNK // 4 or at == len(listed[0])):
                        yield made()
                        rows, coded, size = [], [], 0
                    if at is not None:
                        if at == len(listed[0]):
                            known, new = listed, []
                        new.append(_named(words[k].values, id_texts, pieces))
                if rows:
                    yield made()

        kinds = [T.StringType(), T.LongType(), T.BinaryType()]
        return sent.mapInArrow(write, T.StructType([*plain, *(T.StructField(n, k) for n, k in zip(names, kinds))]))

    def decode(self, rows: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """``rows`` with the bytes of comma-joined ids."""
        pieces = rows.sparkSession.sparkContext.broadcast({str(i): piece for piece, i in self.ranks.items()})

        @F.arrow_udf("binary")
        def concatenated(ids: pa.Array) -> pa.Array:
            piece = pieces.value.__getitem__
            return pa.array([b"".join(map(piece, x.split(","))) if x else b"" for x in ids.to_pylist()], pa.binary())

        return rows.withColumn(to, concatenated(F.col(ids)))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = BytePairCodec(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codec.learn_words(docs)
    done = codec.encode(docs, decoded="decoded", keep_text=False)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
