"""Suffix-array dedup: remove every byte of a long string that starts anywhere else.

All strings of ``length`` bytes that occur more than once, in other documents or the
same, are removed at all their places. Matches never cross documents, and places are
judged on the input.

1. *Contexts.* Of the hashes of a string's ``GRAM``-byte parts the smallest (the last
   among equals) is its anchor. Equal strings have equal anchors, so strings meet by
   anchor, and the consecutive strings of a document that share one anchor form a
   context: the bytes they cover. A text has about one context in 80 bytes. Anchors
   that occur once are dropped: none of their strings can occur twice.
2. *Copies.* Equal contexts are counted; from here on each stands once with its count.
3. *Shards.* Contexts are dealt to shards by anchor, and an anchor with more bytes than
   a shard holds (a passage that a third of all documents share) over several shards.
   Only anchors with two or more different contexts need that.
4. *Suffix arrays.* Each shard sorts the suffixes of its contexts by Larsson-Sadakane
   refinement: ranks by eight bytes first, then of ranks at twice the distance, sorting
   unsorted groups only. Kasai's common prefixes, computed for all contexts of a shard
   side by side, cut the order into groups of equal strings. A string is repeated if the
   counts in its group add up to two or more.
5. *Merging.* Strings of anchors that lie in several shards are handed on as sorted runs
   of 128-bit digests, one for each digest range. Binary search of every run in the
   union finds strings that other shards hold, too.
6. Places of repeated strings go back to their documents, which are cut.

Texts travel compressed, and what is over is deleted from the shared folder.

Rows. NULL and empty texts have no bytes. Rows that repeat doc_id and text are documents
of their own, so all their long strings are repeated. Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, written
from .rolling import BASES, window_hashes

GRAM = 32
#: Bytes that are looked at together; longer texts are cut with an overlap.
PIECE = 1 << 20
_LOW = np.uint64((1 << 21) - 1)

def contexts(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, text number, first string and number of strings of each context.

    ``data`` holds texts of the given sizes, one behind the other.
    """
    empty = np.empty(0, np.int64)
    strings = np.maximum(sizes - length + 1, 0)
    if not strings.sum():
        return empty.astype(np.uint64), empty, empty, empty
    hashes = window_hashes(data, gram)
    low = (hashes & ~_LOW) | (_LOW - np.arange(hashes.size, dtype=np.uint64))
    window, size = length - gram + 1, 1
    while 2 * size <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: low.size - (window - size)], low[window - size :])
    anchors = (_LOW - (low & _LOW)).astype(np.int64)
    text = np.repeat(np.arange(sizes.size), strings)
    first = np.cumsum(sizes) - sizes
    places = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings) + np.repeat(first, strings)
    own = anchors[places]
    change = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    return hashes[own[change]], text[change], places[change], np.diff(np.append(change, places.size))


def suffix_order(words: np.ndarray) -> np.ndarray:
    """The places of ``words`` in the order of the suffixes that begin there.

    ``words[i]`` holds the eight bytes from place i on, most significant first. Larsson
    and Sadakane's refinement: a group of equal rank is sorted by the ranks at distance
    ``h``, which doubles, and only groups of two or more are touched. The order is
    complete, which common prefixes rely on.
    """
    n = words.size
    order = np.argsort(words)
    found = words[order]
    slots = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(slots, np.diff(np.append(slots, n)))
    sizes = np.diff(np.append(slots, n))
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 8
    while open_.size:
        own = order[open_]
        ahead = own + h
        # Beyond the end the shorter suffix comes first.
        key = rank[own] * (4 * n) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n - 1 - ahead) + 2 * n
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[open_] = own
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(edges, key.size))
        rank[own] = np.repeat(open_[edges], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """Kasai's algorithm: bytes that each string shares with the one sorted before it.

    ``starts`` and ``counts`` tell the runs of consecutive strings, ``before`` the place
    of the string sorted before (-1: none), in the order of runs. All runs advance
    together; a string shares at least what its predecessor in the run shared, less one,
    if the predecessor's neighbour is followed by a string, too. Counted up to ``most``.
    """
    first = np.cumsum(counts) - counts
    by_size = np.argsort(-counts, kind="stable")
    starts, first, ordered = starts[by_size], first[by_size], counts[by_size]
    followed = np.zeros(words.size + 1, bool)
    followed[np.repeat(starts, ordered) + np.arange(ordered.sum()) - np.repeat(np.cumsum(ordered) - ordered, ordered)] = True
    out = np.zeros(int(counts.sum()), np.int64)
    shared = np.zeros(starts.size, np.int64)
    last = np.full(starts.size, -1, np.int64)
    active = np.searchsorted(-ordered, -np.arange(1, ordered.max(initial=0) + 1), side="right")
    for step, n in enumerate(active):
        here, there = starts[:n] + step, before[first[:n] + step]
        goes_on = (last[:n] >= 0) & followed[last[:n] + 1]
        now = np.where(goes_on, np.maximum(shared[:n] - 1, 0), 0)
        run = np.flatnonzero((there >= 0) & (now < most))
        now[there < 0] = 0
        while run.size:
            differ = words[here[run] + now[run]] ^ words[there[run] + now[run]]
            same = np.full(run.size, 8, np.int64)
            for k in range(8):
                same -= differ >= np.uint64(1 << 8 * k)
            now[run] += same
            run = run[(same == 8) & (now[run] < most)]
        shared[:n] = np.minimum(now, most)
        last[:n] = there
        out[first[:n] + step] = shared[:n]
    return out


def _ranges(flags: np.ndarray) -> np.ndarray:
    """From and to of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


_VERDICT = "h long, c long, ranges binary, bucket long, run binary"
_ENTRY = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("h", "<i8"), ("c", "<i8"), ("j", "<i4"), ("settled", "?")])


def _verdicts(rows: list[tuple], runs: list[tuple[int, bytes]] = []) -> pa.Table:
    return pa.table(
        {
            "h": pa.array([r[0] for r in rows] + [None] * len(runs), pa.int64()),
            "c": pa.array([r[1] for r in rows] + [None] * len(runs), pa.int64()),
            "ranges": pa.array([r[2].astype("<i4").tobytes() for r in rows] + [None] * len(runs), pa.binary()),
            "bucket": pa.array([None] * len(rows) + [r[0] for r in runs], pa.int64()),
            "run": pa.array([None] * len(rows) + [r[1] for r in runs], pa.binary()),
        }
    )


def sort_shard(parts: list[bytes], counts: np.ndarray, weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each context: its group of equal strings, and the group's weight."""
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join([*parts, b"\0" * (length + 16)]), np.uint8)
    words = np.zeros(data.size - 8, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | data[k : k + words.size]
    order = suffix_order(words)
    slot = np.empty(words.size, np.int64)
    slot[order] = np.arange(words.size)
    del order
    places = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    by = np.argsort(slot[places])
    before = np.full(places.size, -1, np.int64)
    before[by[1:]] = places[by[:-1]]
    shared = common_prefixes(words, starts, counts, before, length)
    group = np.empty(places.size, np.int64)
    group[by] = np.cumsum(shared[by] < length) - 1
    weight = np.bincount(group, weights=np.repeat(weights, counts)).astype(np.int64)
    return group, weight[group]


def _find(parts: list[bytes], h: np.ndarray, c: np.ndarray, weights: np.ndarray, hot: np.ndarray, length: int, buckets: int) -> pa.Table:
    counts = np.array([len(p) - length + 1 for p in parts], np.int64)
    group, weight = sort_shard(parts, counts, weights, length)
    first = np.cumsum(counts) - counts
    repeated = weight > 1
    rows = []
    for i in np.flatnonzero((weights == 1) & (np.add.reduceat(repeated.astype(np.int64), first) > 0)):
        rows.append((int(h[i]), int(c[i]), _ranges(repeated[first[i] : first[i] + counts[i]])))
    runs: list[tuple[int, bytes]] = []
    spread = np.flatnonzero(hot)
    if spread.size:
        # One entry for each distinct string of the anchors that other shards hold, too.
        entries = []
        _, one = np.unique(group, return_index=True)
        is_one = np.zeros(group.size, bool)
        is_one[one] = True
        for i in spread:
            own = np.flatnonzero(is_one[first[i] : first[i] + counts[i]])
            data = np.frombuffer(parts[i], np.uint8)
            entry = np.empty(own.size, _ENTRY)
            entry["d1"], entry["d2"] = (window_hashes(data, length, b)[own] for b in BASES)
            entry["h"], entry["c"], entry["j"] = h[i], c[i], own
            entry["settled"] = repeated[first[i] + own]
            entries.append(entry)
        all_ = np.concatenate(entries)
        at = (all_["d1"] % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(at):
            run = all_[at == b]
            runs.append((int(b), run[np.argsort(run["d1"])].tobytes()))
    return _verdicts(rows, runs)


def merge_runs(runs: list[np.ndarray]) -> list[tuple]:
    """Strings of sorted runs that another run holds, too: h, c and ranges."""
    union = np.sort(np.concatenate([r["d1"] for r in runs]))
    met = []
    for run in runs:  # binary search of each run in the union of all
        many = np.searchsorted(union, run["d1"], "right") - np.searchsorted(union, run["d1"], "left") > 1
        met.append(run[many])
    found = np.concatenate(met)
    found = found[np.lexsort((found["d2"], found["d1"]))]
    if not found.size:
        return []
    same = (found["d1"][1:] == found["d1"][:-1]) & (found["d2"][1:] == found["d2"][:-1])
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    found = found[twice & ~found["settled"]]
    found = found[np.lexsort((found["j"], found["c"], found["h"]))]
    if not found.size:
        return []
    edges = np.flatnonzero(np.concatenate([[True], (found["h"][1:] != found["h"][:-1]) | (found["c"][1:] != found["c"][:-1])]))
    rows = []
    for own in np.split(found, edges[1:]):
        flags = np.zeros(int(own["j"][-1]) + 1, bool)
        flags[own["j"]] = True
        rows.append((int(own["h"][0]), int(own["c"][0]), _ranges(flags)))
    return rows


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, shard_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes."""
    import zstandard

    spark = docs.sparkSession
    ship(spark)
    rows, named, different = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id")).first()
    # A key of a row: its doc_id if that is one, else a digest of all of it.
    is_key = rows == named == different
    key = F.col("doc_id").cast("long") if is_key else F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce("text", F.lit("\0")))
    texts = docs.select(key.alias("key"), "doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                packed = [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(packed, pa.binary())], names=["key", "doc_id", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    packed, _ = written(texts.mapInArrow(pack, f"key long, doc_id {kind}, packed binary"), "suffix-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        unpacker = zstandard.ZstdDecompressor()

        def flush(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            data = b"".join(p[2] for p in parts)
            h, text, place, count = contexts(np.frombuffer(data, np.uint8), np.array([len(p[2]) for p in parts], np.int64), length, gram)
            digest = xxhash.xxh3_64_intdigest
            c = np.array([digest(data[a : a + n + length - 1]) for a, n in zip(place.tolist(), count.tolist(), strict=True)], np.uint64)
            sizes = np.array([len(p[2]) for p in parts], np.int64)
            keys, offsets = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
            inside = place - (np.cumsum(sizes) - sizes)[text] + offsets[text]
            # place: first string and number of strings in one number
            columns = [h.view(np.int64), c.view(np.int64), keys[text], (inside << 16) | count]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "c", "key", "place"])

        parts: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for key_, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = unpacker.decompress(data.as_py())
                for at in range(0, max(len(text) - length + 1, 0), PIECE - length + 1):
                    piece = text[at : at + PIECE]
                    if size + len(piece) > PIECE and parts:
                        yield flush(parts)
                        parts, size = [], 0
                    parts.append((key_, at, piece))
                    size += len(piece)
        if parts:
            yield flush(parts)

    all_, all_path = written(packed.select("key", "packed").mapInArrow(cut, "h long, c long, key long, place long"), "suffix-contexts")
    anchors = all_.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    # Written first, so that the join has two plain shuffles and a hot anchor can be split.
    anchors, anchors_path = written(anchors, "suffix-repeated")
    occur, occur_path = written(all_.join(anchors, "h"), "suffix-candidates")
    release(spark, all_path, anchors_path)
    strings = F.col("place").bitwiseAND(F.lit(0xFFFF))
    groups, groups_path = written(
        occur.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("key", "place")).alias("x")).select("h", "c", "n", "x.key", "x.place"),
        "suffix-distinct",
    )
    sizes = groups.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum(strings + (length - 1)).alias("bytes")).filter("k > 1").select("h", "bytes")
    sizes, sizes_path = written(sizes, "suffix-anchors")
    spread = F.ceil(F.col("bytes") / F.lit(shard_bytes)).cast("long")
    total, hot_total = sizes.agg(F.sum("bytes"), F.sum(F.when(spread > 1, F.col("bytes")))).first()
    shards, buckets = max(1, ceil((total or 0) / shard_bytes)), max(1, ceil((hot_total or 0) / shard_bytes))
    wanted = (
        groups.join(sizes, "h")
        .withColumn("shard", F.pmod(F.xxhash64("h", F.pmod("c", spread)), F.lit(shards)))
        .withColumn("hot", spread > 1)
        .groupBy("key")
        .agg(F.collect_list(F.struct("shard", "hot", "h", "c", "n", "place")).alias("wanted"))
    )
    sources = packed.select("key", "packed") if is_key else packed.select("key", "packed").dropDuplicates(["key"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        names = ["shard", "hot", "h", "c", "n", "bytes"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for data, own in zip(batch.column(0), batch.column(1), strict=True):
                text = unpacker.decompress(data.as_py())
                own = own.as_py()
                places = [(x["place"] >> 16, x["place"] & 0xFFFF) for x in own]
                columns = [[x[name] for x in own] for name in names[:5]] + [[text[a : a + n + length - 1] for a, n in places]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    fetched = sources.join(wanted, "key").select("packed", "wanted").mapInArrow(fetch, "shard long, hot boolean, h long, c long, n long, bytes binary")

    def one_shard(table: pa.Table) -> pa.Table:
        h, c, n, hot = (table[name].to_numpy() for name in ("h", "c", "n", "hot"))
        return _find(table["bytes"].to_pylist(), h, c, np.minimum(n, 2), hot, length, buckets)

    verdicts, verdicts_path = written(fetched.groupBy("shard").applyInArrow(one_shard, _VERDICT), "suffix-verdicts")

    def one_bucket(table: pa.Table) -> pa.Table:
        return _verdicts(merge_runs([np.frombuffer(x, _ENTRY) for x in table["run"].to_pylist()]))

    merged = verdicts.filter("run IS NOT NULL").groupBy("bucket").applyInArrow(one_bucket, _VERDICT)
    partly = verdicts.filter("run IS NULL").unionAll(merged).select("h", "c", "ranges")
    whole = groups.filter("n > 1").select("h", "c", F.lit(None).cast("binary").alias("ranges"))
    gone = occur.join(partly.unionAll(whole), ["h", "c"]).groupBy("key").agg(F.collect_list(F.struct("place", "ranges")).alias("gone"))
    gone, _ = written(gone, "suffix-places")
    release(spark, occur_path, groups_path, sizes_path, verdicts_path)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(at, 512)
                out = []
                for data, own in zip(batch.column(1), batch.column(2), strict=True):
                    text = unpacker.decompress(data.as_py())
                    spans, kept = 0, text
                    if own.is_valid:
                        turns = np.zeros(len(text) + 1, np.int32)
                        for x in own.as_py():
                            first, count = x["place"] >> 16, x["place"] & 0xFFFF
                            cuts = [(0, count)] if x["ranges"] is None else np.frombuffer(x["ranges"], "<i4").reshape(-1, 2).tolist()
                            for a, b in cuts:
                                turns[first + a] += 1
                                turns[first + b - 1 + length] -= 1
                        away = np.cumsum(turns[:-1]) > 0
                        spans = len(_ranges(away))
                        kept = np.frombuffer(text, np.uint8)[~away].tobytes()
                    out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                columns = [[o[i] for o in out] for i in range(5)]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(x, t) for x, t in zip(columns, types, strict=True)]],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
                )

    joined = packed.join(gone, "key", "left").select("doc_id", "packed", "gone")
    return joined.mapInArrow(rewrite, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
