"""SentencePiece encoding that keeps the place of every piece in the original bytes.

Normalisation is done here: the model's compiled character map (a double-array trie and
the replacement texts) is read once into a table, texts are rewritten by the longest
prefix that the map knows, white space is trimmed, collapsed and escaped as the model
says, and each step records which original bytes a normalised byte comes from. Pieces
cover the normalised text without gaps, so their lengths give normalised places and the
recorded alignment projects them to original byte spans.

Segmentation of the normalised text is the library's, with a copy of the model whose own
normaliser does nothing. No piece of a model like ``piece_bpe_32k.model`` has the white
space mark after another character, so merges never cross into the next word: a text is
segmented word by word, and every distinct word only once (up to a bound). Models for
which that does not hold are segmented as whole texts.

Rows. NULL and empty texts have the begin and end ids only and decode to an empty text.
Repeated rows and doc_ids are kept. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

SPACE = "▁"
#: Appended to a model: a normaliser without map, prefix, trimming and escaping. In this
#: wire format a later value of a field replaces the earlier one.
_PLAIN = b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_character_map(compiled: bytes) -> dict[bytes, bytes]:
    """All rules of a compiled character map: UTF-8 prefix to replacement.

    Layout: size of the trie u32, the trie's units u32[], then the replacements, each
    closed by a zero byte. A unit holds a label, an offset to its children, and whether
    it has a value; a value is a place among the replacements.
    """
    if not compiled:
        return {}
    (size,) = struct.unpack_from("<I", compiled)
    units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
    texts = compiled[4 + size :]

    def children_of(unit: int, node: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    rules: dict[bytes, bytes] = {}
    stack = [(children_of(units[0], 0), b"")]
    while stack:
        base, prefix = stack.pop()
        for label in range(1, 256):
            node = base ^ label
            if node >= len(units) or units[node] & 0x800000FF != label:
                continue
            key, unit = prefix + bytes([label]), units[node]
            below = children_of(unit, node)
            if unit >> 8 & 1:
                place = units[below] & 0x7FFFFFFF
                rules[key] = texts[place : texts.index(b"\0", place)]
            stack.append((below, key))
    return rules


class Alignment:
    """Where normalised bytes come from: steps of (normalised place, original place).

    Between two steps both run alike; inside a replacement, a place maps to its start.
    """

    def __init__(self, normal: Sequence[int], original: Sequence[int], fixed: Sequence[bool]) -> None:
        self.normal = np.asarray(normal, dtype=np.int64)
        self.original = np.asarray(original, dtype=np.int64)
        self.fixed = np.asarray(fixed, dtype=bool)

    def project(self, places: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.normal, places, side="right") - 1
        return self.original[at] + np.where(self.fixed[at], 0, places - self.normal[at])


class PieceEncoder:
    """Ids and original byte spans of whole texts, and decoding."""

    def __init__(self, path: str, remember: int = 300_000) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + _PLAIN)
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.prefix = self.trim = self.escape = True  # the format's defaults
        rules: dict[bytes, bytes] = {}
        kinds, suffix, model_type = set(), 0, 1
        inner_space = False
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                kinds.add(own.get(3, 1))
                inner_space |= SPACE in own[1].decode().lstrip(SPACE)
            elif field == 2:
                own = dict(_fields(value))
                suffix, model_type = own.get(24, 0), own.get(3, 1)
            elif field == 3:
                own = dict(_fields(value))
                rules = read_character_map(own.get(2, b""))
                self.prefix, self.trim, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        if suffix or 4 in kinds:
            raise ValueError("models with white space as suffix or user-defined pieces are not supported")
        #: Merging by rank is local; other model types weigh whole texts.
        self.by_word = model_type == 2 and not inner_space and self.escape
        self.set_rules(rules)
        count = self.library.get_piece_size()
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.unknown = self.library.unk_id()
        sizes = [1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode()) for i in range(count)]
        self.sizes = np.array(sizes, dtype=np.int64)

    def set_rules(self, rules: dict[bytes, bytes]) -> None:
        self.rules = {k.decode(): v.decode() for k, v in rules.items()}
        # Alternatives are tried in order, so the longest come first.
        longest_first = sorted(self.rules, key=len, reverse=True)
        self.pattern = re.compile("|".join(map(re.escape, longest_first))) if self.rules else None

    def normalise(self, text: str) -> tuple[str, Alignment]:
        """The normalised text and the alignment of its bytes."""
        if not text:
            return "", Alignment([0], [0], [False])
        if self.pattern is None and not self.trim:
            return self._escaped(text)
        # (text, original bytes, whether both run alike)
        parts: list[tuple[str, int, bool]] = []
        at = 0
        for match in self.pattern.finditer(text) if self.pattern else ():
            if match.start() > at:
                parts.append((text[at : match.start()], len(text[at : match.start()].encode()), True))
            parts.append((self.rules[match[0]], len(match[0].encode()), False))
            at = match.end()
        if at < len(text):
            parts.append((text[at:], len(text[at:].encode()), True))
        out: list[str] = []
        normal, original, fixed = [], [], []
        have = came = 0

        def put(piece: str, start: int, alike: bool) -> None:
            nonlocal have
            normal.append(have)
            original.append(start)
            fixed.append(not alike)
            out.append(piece)
            have += len(piece.encode())

        mark = SPACE if self.escape else " "
        last_space, began = self.trim, False
        for piece, size, alike in parts:
            place = came
            for run in re.findall(r" +|[^ ]+", piece):
                width = len(run.encode())
                if run[0] == " ":
                    for _ in run if not self.trim else run[: 0 if last_space else 1]:
                        if not began and self.prefix and not self.trim:
                            put(mark, came, False)
                        began = True
                        put(mark, place, False)
                        place += 1 if alike else 0
                    if self.trim and alike:
                        place += width - (0 if last_space else 1)
                    last_space = True
                else:
                    if not began and self.prefix:
                        put(mark, place, False)
                    began = True
                    put(run, place, alike)
                    place += width if alike else 0
                    last_space = False
            came += size
        if self.trim:
            while out and out[-1] == mark and (len(out) > 1 or not self.prefix):
                out.pop(), normal.pop(), original.pop(), fixed.pop()
                have -= len(mark.encode())
        normal.append(have)
        original.append(came)
        fixed.append(True)
        return "".join(out), Alignment(normal, original, fixed)

    def _escaped(self, text: str) -> tuple[str, Alignment]:
        """Without map and trimming only blanks change, so places are arithmetic."""
        mark = SPACE if self.escape else " "
        data = np.frombuffer(text.encode(), np.uint8)
        blanks = np.flatnonzero(data == 32)
        grow, first = len(mark.encode()) - 1, len(mark.encode()) if self.prefix else 0
        # A blank's mark starts at its own place and the text goes on behind it.
        starts = blanks + first + grow * np.arange(blanks.size)
        normal = np.empty(2 * blanks.size + 2, np.int64)
        original = np.empty_like(normal)
        fixed = np.zeros(normal.size, bool)
        normal[0], original[0], fixed[0] = 0, 0, True
        normal[1], original[1] = first, 0
        normal[2::2], original[2::2], fixed[2::2] = starts, blanks, True
        normal[3::2], original[3::2] = starts + grow + 1, blanks + 1
        return (mark if self.prefix else "") + text.replace(" ", mark), Alignment(normal, original, fixed)

    def segment(self, normal: str) -> np.ndarray:
        """Ids of a normalised text."""
        if not self.by_word:
            return np.array(self.plain.encode(normal, num_threads=1), dtype="<u4")
        # A word with the marks before it: marks start where another character ends.
        words = normal.split(SPACE)
        if "" in words:
            words = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", normal)
        else:
            words = [words[0], *[SPACE + w for w in words[1:]]]
        return self._ids(words)

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > self.remember:
                known.clear()
                new = list(dict.fromkeys(words))
            found = self.plain.encode(new, num_threads=1)
            known.update((w, np.array(x, dtype="<u4").tobytes()) for w, x in zip(new, found, strict=True))
        return np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids without begin and end, and for each the original bytes it covers, from and to."""
        normal, alignment = self.normalise(text)
        ids = self.segment(normal)
        if not ids.size:
            return ids, np.empty((0, 2), np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if (ids == self.unknown).any() or ends[-1] != len(normal.encode()):
            # Unknown pieces have the length of what they stand for.
            sizes = np.array([len(p.surface.encode()) for p in self.plain.encode(normal, return_type="proto").pieces], np.int64)
            ends = np.cumsum(sizes)
        edges = alignment.project(np.concatenate([[0], ends]))
        return ids, np.stack([edges[:-1], edges[1:]], axis=1)


def piece_table(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: numbers and digests of ids, spans and decoded text.

    ``ids_sha256`` covers all ids with begin and end, ``spans_sha256`` the byte spans of
    the pieces between them (from and to, little-endian unsigned 32-bit each).
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model)
        edge = np.array([encoder.bos], "<u4"), np.array([encoder.eos], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                all_ids, rows = [], []
                for text in some.column(1).to_pylist():
                    ids, spans = encoder.encode(text or "")
                    ids = np.concatenate([edge[0], ids, edge[1]])
                    all_ids.append(ids.tolist())
                    rows.append((ids.size, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(spans.astype("<u4").tobytes()).hexdigest()))
                texts = encoder.library.decode(all_ids, num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                        pa.array([r[2] for r in rows]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(encode, schema)
