"""Token ids in patched frame-of-reference segments.

A segment is a run of bytes that stands for itself:

    magic 4s | values u64 | block u32 | blocks u32 | starts u64[blocks + 1] | blocks

and a block of up to ``BLOCK`` values is

    minimum u32 | width u8 | exceptions u16 | packed bits | places u16[] | high parts u32[]

The minimum is subtracted, the rest is packed at the width that holds ``PERCENTILE``
percent of the block's values (lowest bit first), and what does not fit keeps its place
and its upper bits in the exception list. ``starts`` index the blocks, so any block can
be read alone.

A shard of documents in ascending doc_id order is one stream of ids, each document
closed by an end id, and two streams for the documents: how long they are, and their
ids as differences. The streams are rows of a Parquet table in the shared folder, which
gives every store that Spark reaches, atomic commits and repeatable tasks; the bytes do
not depend on it.

Rows. NULL and empty texts are documents with the end id only. Repeated rows and doc_ids
are kept, side by side. A NULL doc_id comes first. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, ship
from .rolling import BASES, stretch_hashes

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 90
_HEAD, _BLOCK_HEAD = struct.Struct("<4sQII"), struct.Struct("<IBH")


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, lowest bit first."""
    data = np.ascontiguousarray(rows, dtype="<u4").view(np.uint8).reshape(*rows.shape, 4)
    bits = np.unpackbits(data, axis=2, bitorder="little", count=width)
    return np.packbits(bits.reshape(rows.shape[0], -1), axis=1, bitorder="little")


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1, bitorder="little", count=count * width).reshape(data.shape[0], count, width)
    whole = np.zeros((data.shape[0], count, 32), np.uint8)
    whole[:, :, :width] = bits
    return np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]


def encode_segment(values: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """Unsigned 32-bit values as one segment."""
    values = np.ascontiguousarray(values, dtype=np.uint32)
    whole = values.size // block
    parts: list[bytes] = [b""] * (whole + (values.size % block > 0))
    groups = [(0, values[: whole * block].reshape(whole, block))]
    if values.size % block:
        groups.append((whole, values[whole * block :].reshape(1, -1)))
    for first, group in groups:
        for at in range(0, group.shape[0], 256):  # bounds the memory of the bit matrix
            rows = group[at : at + 256]
            low = rows.min(axis=1)
            rest = rows - low[:, None]
            pivot = np.partition(rest, (rows.shape[1] * percentile - 1) // 100, axis=1)[:, (rows.shape[1] * percentile - 1) // 100]
            widths = np.ceil(np.log2(pivot.astype(np.float64) + 1)).astype(np.int64)
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                part = rest[own]
                high = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
                packed = _pack(part, int(width)) if width else np.zeros((own.size, 0), np.uint8)
                for k, r in enumerate(own):
                    places = np.flatnonzero(high[k])
                    parts[first + at + r] = b"".join(
                        (
                            _BLOCK_HEAD.pack(int(low[r]), int(width), places.size),
                            packed[k].tobytes(),
                            places.astype("<u2").tobytes(),
                            high[k][places].astype("<u4").tobytes(),
                        )
                    )
    head = _HEAD.pack(MAGIC, values.size, block, len(parts))
    starts = np.zeros(len(parts) + 1, dtype="<u8")
    np.cumsum([len(p) for p in parts], out=starts[1:])
    starts += len(head) + starts.nbytes
    return b"".join((head, starts.tobytes(), *parts))


def decode_blocks(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to before ``last``, found through the index."""
    magic, count, block, blocks = _HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    starts = np.frombuffer(segment, dtype="<u8", count=blocks + 1, offset=_HEAD.size)
    last = blocks if last is None else min(last, blocks)
    out = [np.empty(0, np.uint32)]
    by_shape: dict[tuple[int, int], list[int]] = {}
    heads = {}
    for i in range(first, last):
        heads[i] = _BLOCK_HEAD.unpack_from(segment, int(starts[i]))
        by_shape.setdefault((min(block, count - i * block), heads[i][1]), []).append(i)
    found: dict[int, np.ndarray] = {}
    for (n, width), own in by_shape.items():
        size = (n * width + 7) // 8
        for at in range(0, len(own), 256):
            some = own[at : at + 256]
            if width:
                data = np.stack([np.frombuffer(segment, np.uint8, size, int(starts[i]) + _BLOCK_HEAD.size) for i in some])
                rows = _unpack(data, n, width)
            else:
                rows = np.zeros((len(some), n), np.uint32)
            for k, i in enumerate(some):
                low, _, exceptions = heads[i]
                if exceptions:
                    at_places = int(starts[i]) + _BLOCK_HEAD.size + size
                    places = np.frombuffer(segment, "<u2", exceptions, at_places)
                    high = np.frombuffer(segment, "<u4", exceptions, at_places + 2 * exceptions)
                    rows[k, places] |= high << np.uint32(width)
                found[i] = rows[k] + np.uint32(low)
    return np.concatenate(out + [found[i] for i in range(first, last)])


#: Letters and marks for which splitting here agrees with the tokenizer's own: the
#: first 384 code points' letters but those with special case rules, and common marks.
_LETTERS = "a-zß-öø-ÿĀ-įĲ-ňŊ-ž"
_BLANK, _LETTER, _DIGIT, _MARK, _ELSE = range(5)


def _classes() -> np.ndarray:
    """The class of each 16-bit unit of a lower-cased text."""
    out = np.full(1 << 16, _ELSE, np.uint8)
    plain = "".join(map(chr, range(128))) + "¡«»¿" + "".join(map(chr, range(0x2010, 0x2028)))
    out[[ord(c) for c in plain]] = _MARK
    out[[ord(c) for c in " \t\n\v\f\r"]] = _BLANK
    out[ord("0") : ord("9") + 1] = _DIGIT
    letter = re.compile(f"[{_LETTERS}]")
    out[[i for i in range(0x180) if letter.match(chr(i))]] = _LETTER
    return out


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    For the tokenizer kind of ``word_bpe_49k.json`` (lower case, words split by pattern,
    white space dropped) the ids of a text are those of its words in order. So each
    distinct word goes through the library once and is remembered, up to ``remember``
    words at a time. Texts are split together: the classes of their characters give the
    words of the pattern, and equal words are known by two 64-bit hashes. Texts with
    characters outside the plain alphabets above, or with what might be a special token,
    are encoded whole.
    """

    UNITS = 500_000

    def __init__(self, path: str, remember: int = 1_000_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.classes = _classes()
        # The byte alphabet: what each byte of a word is written as in the vocabulary.
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ascii_ = {b: alphabet.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        taken = sorted(set(pre_tokenizers.ByteLevel.alphabet()) - set(ascii_.values()), key=ord)
        shown = [b for b in range(128, 256) if chr(b) in taken and b >= 0xA1 and b != 0xAD]
        rest = [c for c in taken if ord(c) > 255]
        hidden = [b for b in range(128, 256) if b not in shown]
        self.written = str.maketrans(ascii_ | {b: chr(b) for b in shown} | dict(zip(hidden, rest[-len(hidden) :], strict=True)))
        self._forget()

    def _forget(self) -> None:
        # Of each known word, by its first hash: the second, and where its ids are.
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int32)
        self.all_ids = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        """Remember words that are not known yet; ``keys`` ascend."""
        tokenize, written = self.tokenizer.model.tokenize, self.written
        found = [[t.id for t in tokenize(w.decode("utf-16-le").encode().decode("latin-1").translate(written))] for w in words]
        count = np.array([len(x) for x in found], np.int32)
        first = self.all_ids.size + np.cumsum(count) - count
        self.all_ids = np.concatenate([self.all_ids, np.array([i for x in found for i in x], np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last unit (exclusive) of each word of the tokenizer's pattern."""
        edges = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)]))
        stops = np.append(edges[1:], data.size)
        # An apostrophe on its own takes the ending behind it along: 's 't 'm 'd 're 've 'll
        quote = np.flatnonzero((stops - edges == 1) & (data[edges] == ord("'")))
        quote = quote[quote + 1 < edges.size]
        quote = quote[kind[edges[quote + 1]] == _LETTER]
        if quote.size:
            start = edges[quote + 1]
            one, two = data[start], data[np.minimum(start + 1, data.size - 1)]
            longer = stops[quote + 1] - start > 1
            pairs = [(one == ord(a)) & (two == ord(b)) & longer for a, b in ("re", "ve", "ll")]
            taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pairs[0] | pairs[1] | pairs[2], 2, 0))
            stops[quote] += taken
            edges[quote + 1] += taken
        word = (kind[np.minimum(edges, data.size - 1)] != _BLANK) & (stops > edges)
        return edges[word], stops[word]

    def _together(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        units = [t.lower().encode("utf-16-le", "surrogatepass") for t in texts]
        raw = b"\n\0".join([*units, b""])
        data = np.frombuffer(raw, "<u2")
        ends = np.cumsum([len(u) // 2 + 1 for u in units])
        kind = self.classes[data]
        apart = np.array(["<|" in t for t in texts], dtype=bool)
        apart[np.searchsorted(ends, np.flatnonzero(kind == _ELSE), side="right")] = True
        edges, stops = self._words(data, kind)
        if apart.any():
            plain = ~apart[np.searchsorted(ends, edges, side="right")]
            edges, stops = edges[plain], stops[plain]
        if not edges.size:
            return [self._whole(t) if away else b"" for t, away in zip(texts, apart, strict=True)]
        second = stretch_hashes(data, edges, stops, BASES[1])
        keys, one, which = np.unique(stretch_hashes(data, edges, stops), return_index=True, return_inverse=True)
        if self.keys.size + keys.size > self.remember:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, self.keys.size - 1))
        new = np.flatnonzero(self.keys[at] != keys) if self.keys.size else np.arange(keys.size)
        if new.size:
            places = zip((2 * edges[one[new]]).tolist(), (2 * stops[one[new]]).tolist(), strict=True)
            self._learn(keys[new], second[one[new]], [raw[a:b] for a, b in places])
        number = np.searchsorted(self.keys, keys)[which]
        if (self.checks[number] != second).any():  # two words with one hash: practically never
            return [self._whole(t) for t in texts]
        counts = self.count[number].astype(np.int64)
        done = np.cumsum(counts)
        ids = self.all_ids[np.arange(done[-1]) + np.repeat(self.first[number] - (done - counts), counts)]
        upto = np.concatenate([[0], done])[np.searchsorted(edges, np.concatenate([[0], ends]))]
        return [
            self._whole(t) if away else ids[a:b].astype("<u4").tobytes()
            for t, away, a, b in zip(texts, apart, upto[:-1], upto[1:], strict=True)
        ]

    def encode_all(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            if len(text) > self.UNITS:
                yield from self._together(waiting)
                waiting, size = [], 0
                if "<|" in text:  # special tokens are found in the whole text only
                    yield self._whole(text)
                    continue
                parts, at = [], 0
                while at < len(text):  # white space separates words whatever surrounds it
                    stop = text.rfind(" ", at, at + self.UNITS) + 1 or text.find(" ", at) + 1 or len(text)
                    parts.append(text[at:stop])
                    at = stop
                yield b"".join(self._together([p])[0] for p in parts)
                continue
            waiting.append(text)
            size += len(text)
            if size >= self.UNITS:
                yield from self._together(waiting)
                waiting, size = [], 0
        if waiting:
            yield from self._together(waiting)

    def encode(self, text: str) -> bytes:
        return next(iter(self.encode_all([text])))


SEGMENTS = "part int, seq int, docs long, tokens long, ids binary, lengths binary, doc_base long, doc_steps binary, doc_nulls long"


def write_segments(docs: DataFrame, tokenizer: str, end_id: int, path: str, segment_tokens: int = 1 << 20) -> None:
    """Write the ids of all texts, in ascending doc_id order, as segments at ``path``.

    doc_ids are stored as differences to the one before, in two 32-bit halves.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def segment() -> pa.RecordBatch:
            lengths = np.array([len(b) // 4 for b in ids], dtype=np.uint32)
            nulls = sum(n is None for n in names)  # they come first
            own = np.array([n for n in names if n is not None], dtype=np.int64)
            steps = np.diff(own, prepend=own[:1]).astype("<u8")
            halves = steps.view("<u4").reshape(-1, 2)
            columns = [
                [part],
                [seq],
                [len(ids)],
                [int(lengths.sum())],
                [encode_segment(np.frombuffer(b"".join(ids), dtype="<u4"))],
                [encode_segment(lengths)],
                [int(own[0]) if own.size else 0],
                [encode_segment(np.concatenate([halves[:, 0], halves[:, 1]]))],
                [nulls],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, SEGMENT_TYPES, strict=True)], names=SEGMENT_NAMES
            )

        end = struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, own in zip(some.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                    own += end
                    ids.append(own)
                    names.append(doc_id)
                    size += len(own) // 4
                    if size >= segment_tokens:
                        yield segment()
                        ids, names, size, seq = [], [], 0, seq + 1
        if ids:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.parquet(path)


SEGMENT_NAMES = [c.strip().split()[0] for c in SEGMENTS.split(",")]
SEGMENT_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SEGMENTS.split(",")]


def read_documents(segments: DataFrame, schema: str, derive: Callable[[np.ndarray], Sequence[object]]) -> DataFrame:
    """One row per document of the segments: place and what ``derive`` makes of its ids.

    ``schema`` names the derived columns. ``start`` is the number of ids before the
    document: those before its segment, from the segments' own counts (inside a part and
    over parts, so no window sees more than a part or one row per part), and those
    before it in the segment.
    """
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("t"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["ids"])
                lengths = decode_blocks(row["lengths"]).astype(np.int64)
                halves = decode_blocks(row["doc_steps"]).astype("<u4").reshape(2, -1)
                steps = np.ascontiguousarray(halves.T).view("<u8").reshape(-1).astype(np.int64)
                names: list[int | None] = [None] * row["doc_nulls"] + [int(x) for x in np.cumsum(steps) + row["doc_base"]]
                ends = np.cumsum(lengths)
                derived = [derive(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                columns = [
                    pa.array([row["part"]] * len(names), pa.int32()),
                    pa.array([row["seq"]] * len(names), pa.int32()),
                    pa.array(names, pa.int64()),
                    pa.array(ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    *[pa.array(list(c)) for c in zip(*derived, strict=True)],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    own_schema = f"part int, seq int, doc_id long, inside long, n_tokens long, {schema}"
    names_out = [c.strip().split()[0] for c in own_schema.split(",")]
    read = segments.select("part", "seq", "ids", "lengths", "doc_base", "doc_steps", "doc_nulls").mapInArrow(decode, own_schema)
    joined = read.join(starts, ["part", "seq"])
    start = F.col("part_start") + F.col("seq_start") + F.col("inside")
    return joined.select("doc_id", start.alias("start"), "n_tokens", *names_out[5:])


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all texts as segments, read them back, and tell each document's ids apart."""
    spark = docs.sparkSession
    path = new_folder(spark, "token-segments")
    write_segments(docs, tokenizer, end_id, path)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    return read_documents(segments, "ids_crc32 long", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))
