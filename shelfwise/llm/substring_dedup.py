"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks that every document chooses alike: of the 13
runs of eight words in a window of twenty, the one with the least hash anchors the window, and an
anchor with the words of all windows that it anchors is a block.  The index of blocks is the table
of anchors; the earliest block of an anchor is its reference.

A document is parsed against the index: where its block equals the reference, all of the block is a
copy, and consecutive copies make one long factor.  Where an anchor is known but the blocks differ,
a factor ends inside: there the windows themselves are checked, against the reference's and each
other's.  Equal windows choose the same anchor at the same place, so no copy is missed, and equality
is by 128 bits of hash, so none is made up.

Blocks and windows that repeat within one batch of documents are settled there, before any shuffle;
a passage that a third of all documents share reaches the shuffle once a batch.  Anchors that a
sample of the documents shows to be frequent are no key: their blocks would gather in one task, so
their windows are checked one by one.  The sample decides the way only, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm._common import slices, stored, table
from shelfwise.llm.simhash import word_pieces

WINDOW = 20
ANCHOR = 8
#: Words that are hashed at a time.
CHUNK = 500_000
#: Words whose hashes a worker remembers.
MEMO = 100_000
#: Anchors met so often in one of `SAMPLE` documents are frequent; at most `FREQUENT` of them, the others are ordinary.
SAMPLE, OFTEN, FREQUENT = 64, 16, 4096
#: Plain bytes of the texts that are cut into words together.
BATCH = 16 << 20
#: Ranks a null doc_id behind all others.
LAST = (1 << 63) - 1

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_memo: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest, memo = xxhash.xxh64_intdigest, _memo
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = digest(w)
            if len(memo) >= MEMO:
                memo.clear()
            memo[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


class Rolling:
    """Hashes of any word ranges of one array, from running sums; arithmetic is modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        powers = np.full(n + 1, base, dtype=np.uint64)
        powers[0] = 1
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        self.sums[1:] = np.cumsum(hashes * np.cumprod(powers)[:-1])
        self.unit = np.cumprod(inverse)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.unit[start])


def anchors_of(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each window start, the rightmost place of the least hash among the window's runs."""
    width = WINDOW - ANCHOR + 1
    out = np.empty(len(starts), dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    for k in range(0, len(starts), 1 << 17):
        part = starts[k : k + (1 << 17)]
        out[k : k + len(part)] = part + width - 1 - view[part].argmin(1)
    return out


class Chunk:
    """Documents, or stretches of long ones that overlap by a window less a word, hashed together."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.doc: list[int] = []
        self.ver: list[int] = []
        self.at: list[int] = []
        self.words = 0

    def add(self, hashes: np.ndarray, doc: int, ver: int, at: int) -> None:
        self.parts.append(hashes)
        self.doc.append(doc)
        self.ver.append(ver)
        self.at.append(at)
        self.words += len(hashes)

    def blocks(self) -> dict[str, np.ndarray]:
        """The blocks of all stretches as columns: key, ctx, doc, pos (first window and version), to (end of the last)."""
        sizes = np.array([len(p) for p in self.parts])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        hashes = np.concatenate(self.parts)
        stretch = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.arange(max(0, len(hashes) - WINDOW + 1))
        starts = starts[starts + WINDOW <= begin[stretch[starts] + 1]]
        roll = Rolling(hashes, _BASES[0])
        every = np.arange(max(0, len(hashes) - ANCHOR + 1))
        grams = roll.of(every, every + ANCHOR)
        anchor = anchors_of(grams, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        cut = np.flatnonzero(np.diff(anchor, prepend=-1) != 0) if len(anchor) else np.zeros(0, dtype=np.int64)
        if len(anchor):
            breaks = np.flatnonzero(np.diff(starts, prepend=starts[0] - 1) != 1)
            cut = np.union1d(cut, breaks)
        low, high, place = starts[cut], starts[np.append(cut[1:], len(starts)) - 1] if len(cut) else starts[cut], anchor[cut]
        shape = ((place - low) * 64 + (high - low)).astype(np.uint64)
        s = stretch[low]
        at = np.array(self.at, dtype=np.int64)[s] + low - begin[s]
        return {
            "key": grams[place].view(np.int64),
            "ctx": _mix(Rolling(hashes, _BASES[1]).of(low, high + WINDOW) + shape).view(np.int64),
            "doc": np.array(self.doc, dtype=np.int64)[s],
            "pos": (at << 24) | np.array(self.ver, dtype=np.int64)[s],
            "to": (at + (high - low) + WINDOW).astype(np.int64),
        }


def version(text: bytes) -> int:
    """24 bits of the text's hash; with the doc_id they name a row, so that rows of one doc_id stay apart."""
    return xxhash.xxh64_intdigest(text) & 0xFFFFFF


def stretches(text: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(word hashes, first word's number) of a text, in overlapping stretches if it is long."""
    tail, at = np.zeros(0, dtype=np.uint64), 0
    for words in word_pieces(text):
        hashes = np.concatenate([tail, word_hashes(words)])
        yield hashes, at
        tail = hashes[max(0, len(hashes) - WINDOW + 1) :]
        at += len(hashes) - len(tail)


def _settle_locally(b: dict[str, np.ndarray], frequent: np.ndarray) -> pa.RecordBatch:
    """Of equal blocks the earliest stays a block; a later one is a copy already: its ctx becomes null.

    Blocks of frequent anchors are to be checked by window: their ctx becomes null, too, and `to` negative.
    """
    place = b["pos"] >> 24
    order = np.lexsort((place, b["doc"], b["ctx"], b["key"]))
    b = {name: v[order] for name, v in b.items()}
    place = place[order]
    n = len(order)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (b["key"][1:] != b["key"][:-1]) | (b["ctx"][1:] != b["ctx"][:-1])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if n else np.zeros(0, dtype=np.int64)
    later = (b["doc"] != b["doc"][head]) | (place != place[head])
    copies = {name: v[later] for name, v in b.items() if name not in ("key", "ctx")}
    # copies of one document that adjoin become one factor
    order = np.lexsort((copies["pos"] >> 24, copies["pos"] & 0xFFFFFF, copies["doc"]))
    copies = {name: v[order] for name, v in copies.items()}
    doc, low, high = copies["doc"], copies["pos"] >> 24, copies["to"]
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (doc[1:] == doc[:-1]) & ((copies["pos"][1:] & 0xFFFFFF) == (copies["pos"][:-1] & 0xFFFFFF)) & (low[1:] <= high[:-1])
    first = np.flatnonzero(~same)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    keys = _mix(doc[first].astype(np.uint64) * np.uint64(_BASES[0]) + copies["pos"][first].astype(np.uint64)).view(np.int64)
    keep = ~later
    spread = _mix(b["doc"].astype(np.uint64) * np.uint64(_BASES[1]) + b["pos"].astype(np.uint64)).view(np.int64)
    opened = keep & np.isin(b["key"], frequent)
    b["key"], b["to"] = np.where(opened, spread, b["key"]), np.where(opened, -b["to"], b["to"])
    ctx = pa.array(np.concatenate([b["ctx"][keep], np.zeros(len(first), dtype=np.int64)]), mask=np.concatenate([opened[keep], np.ones(len(first), dtype=bool)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([b["key"][keep], keys])), ctx, pa.array(np.concatenate([b["doc"][keep], doc[first]])), pa.array(np.concatenate([b["pos"][keep], copies["pos"][first]])), pa.array(np.concatenate([b["to"][keep], high[last]]))],
        names=["key", "ctx", "doc", "pos", "to"],
    )


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes]]:
    for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield d, LAST if d is None else d, (t.as_py() or "").encode("utf-8", "surrogatepass")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for _, doc, text in _texts(batch):
            ver = version(text)
            for hashes, at in stretches(text):
                if len(hashes) >= WINDOW:
                    chunk.add(hashes, doc, ver, at)
                if chunk.words >= CHUNK:
                    yield chunk
                    chunk = Chunk()
    if chunk.words:
        yield chunk


def frequent_anchors(documents: DataFrame) -> np.ndarray:
    """At most `FREQUENT` anchors that many documents of a sample have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            found = chunk.blocks()
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.stack([found["key"], found["doc"]]), axis=1)[0])], names=["key"])

    sample = documents.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("doc_id", "text")
    counted = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    return np.array([r["key"] for r in counted.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()], dtype=np.int64)


def blocks(documents: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, ctx, doc, pos, to): the index rows; ctx is null for stretches already known to be copies, or to be checked if `to` is negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield _settle_locally(chunk.blocks(), frequent)

    return documents.select("doc_id", "text").mapInArrow(run, "key long, ctx long, doc long, pos long, to long")


def parsed(rows: DataFrame) -> DataFrame:
    """The index rows that are copies of their reference (check false) or have to be checked by window."""
    group = W.partitionBy("key")
    ordered = group.orderBy("doc", "pos")
    known = rows.withColumn("ref", F.first(F.struct("doc", "pos", "ctx")).over(ordered)).withColumn("one", F.min("ctx").over(group) == F.max("ctx").over(group))
    is_ref = (F.col("doc") == F.col("ref.doc")) & (F.shiftright("pos", 24) == F.shiftright("ref.pos", 24))
    copy = (F.col("ctx").isNull() & (F.col("to") > 0)) | ((F.col("ctx") == F.col("ref.ctx")) & ~is_ref)
    check = (F.col("to") < 0) | (~F.col("one") & (is_ref | (F.col("ctx") != F.col("ref.ctx"))))
    return known.where(F.coalesce(copy, F.lit(False)) | F.coalesce(check, F.lit(False))).select(
        "doc", F.col("pos").bitwiseAND(F.lit(0xFFFFFF)).alias("ver"), F.struct(F.shiftright("pos", 24).cast("int").alias("low"), F.abs("to").cast("int").alias("to"), F.coalesce(~copy, F.lit(True)).alias("check")).alias("s")
    )


def _merged(n: int, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    """A flag a word: whether any span covers it."""
    edges = np.zeros(n + 1, dtype=np.int32)
    for low, high in spans:
        edges[low] += 1
        edges[high] -= 1
    return np.cumsum(edges[:-1]) > 0


def _finished(words: list[bytes], gone: np.ndarray) -> tuple[int, int, str]:
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


PACKED = "doc_id long, doc long, ver long, z binary"
CHECKED = "doc_id long, doc long, ver long, n_words long, n_removed long, kept_sha256 string, z binary, spans array<int>, w1 array<long>, w2 array<long>, low array<int>"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def packed(documents: DataFrame) -> DataFrame:
    """The texts, compressed for the shuffle, under the names that the index uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = [(d, doc, version(t), squeeze.compress(t)) for d, doc, t in _texts(batch.slice(k, 512))]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "doc", "ver", "z"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


def _batch_of(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True)], names=[name for name, _ in schema])


_CHECKED_ARROW = [("doc_id", pa.int64()), ("doc", pa.int64()), ("ver", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("z", pa.binary()), ("spans", pa.list_(pa.int32())), ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64())), ("low", pa.list_(pa.int32()))]
_RESULT_ARROW = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]


def _windows(hashes: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(Rolling(hashes, base).of(low, low + WINDOW).view(np.int64) for base in _BASES)


def _words_of(row: dict) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(row["z"]).split()


def _check_batch(rows: list[dict]) -> pa.RecordBatch:
    """Finishes the documents without open windows; for the others, names the windows to check.

    Of equal windows of the batch only the earliest is passed on; the later ones are copies.
    """
    opened, spans, done = [], [], {}
    for k, row in enumerate(rows):
        found = row["found"] or []
        spans.append([(s["low"], s["to"]) for s in found if not s["check"]])
        starts = [np.arange(s["low"], s["to"] - WINDOW + 1) for s in found if s["check"]]
        words = _words_of(row)
        if starts:
            low = np.unique(np.concatenate(starts))
            a, b = _windows(word_hashes(words), low)
            opened.append((np.full(len(low), k), np.full(len(low), row["doc"], dtype=np.int64), low, a, b))
        else:
            done[k] = _finished(words, _merged(len(words), spans[k]))
    left: dict[int, tuple] = {}
    if opened:
        which, doc, low, a, b = (np.concatenate(c) for c in zip(*opened, strict=True))
        order = np.lexsort((low, doc, b, a))
        which, doc, low, a, b = (c[order] for c in (which, doc, low, a, b))
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later = (doc != doc[head]) | (low != low[head])
        for k, at in zip(which[later].tolist(), low[later].tolist(), strict=True):
            spans[k].append((at, at + WINDOW))
        stay = np.flatnonzero(~later)
        stay = stay[np.argsort(which[stay], kind="stable")]
        for k, part in zip(*_groups(which[stay], stay), strict=True):
            left[k] = (a[part], b[part], low[part])
    out = []
    for k, row in enumerate(rows):
        ids = (row["doc_id"], row["doc"], row["ver"])
        if k in done:
            out.append((*ids, *done[k], None, None, None, None, None))
            continue
        words = _words_of(row)  # split again rather than held for the whole batch
        gone = _merged(len(words), spans[k])
        if k in left:
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            out.append((*ids, None, None, None, row["z"], edges.astype(np.int32), *left[k][:2], left[k][2].astype(np.int32)))
        else:
            out.append((*ids, *_finished(words, gone), None, None, None, None, None))
    return _batch_of(out, _CHECKED_ARROW)


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cut = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cut])].tolist() if len(keys) else [], np.split(values, cut) if len(keys) else []


def _bounded(batches: Iterator[pa.RecordBatch], limit: int = BATCH) -> Iterator[list[dict]]:
    """The rows in lists whose texts together have about `limit` plain bytes, or one row with more."""
    rows, size = [], 0
    for batch in slices(batches):
        for k in range(batch.num_rows):
            row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            plain = zstandard.frame_content_size(row["z"])
            if rows and size + plain > limit:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += plain
    if rows:
        yield rows


def remove(documents: DataFrame) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of `WINDOW` consecutive words that covers it has the same words as one
    that starts earlier: in a row with a smaller doc_id, or earlier in the same text.  Windows are
    judged on the input.  A null doc_id comes after all others; rows with the same doc_id are none
    earlier than the other, so repeated rows get equal results and do not remove each other.  A
    null or empty text has no words; a text of fewer words than a window loses nothing.  An empty
    table gives an empty result; columns other than doc_id and text are not read.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = parsed(blocks(documents, frequent_anchors(documents))).groupBy("doc", "ver").agg(F.collect_list("s").alias("found"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bounded(batches):
            yield _check_batch(rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bounded(batches):
            out = []
            for row in rows:
                words = _words_of(row)
                edges = row["spans"]
                gone = _merged(len(words), [*zip(edges[::2], edges[1::2], strict=True), *((at, at + WINDOW) for at in row["copies"] or [])])
                out.append((row["doc_id"], *_finished(words, gone)))
            yield _batch_of(out, _RESULT_ARROW)

    texts = packed(documents)
    checked = stored(texts.join(found.hint("shuffle_hash"), ["doc", "ver"], "left").select("doc_id", "doc", "ver", "z", "found").mapInArrow(check, CHECKED), "substring-dedup")
    opened = checked.where("z is not null")
    windows = opened.select("doc", "ver", F.explode(F.arrays_zip("w1", "w2", "low")).alias("w")).select("doc", "ver", "w.w1", "w.w2", "w.low")
    earliest = F.first(F.struct("doc", "low")).over(W.partitionBy("w1", "w2").orderBy("doc", "low"))
    copies = windows.withColumn("ref", earliest).where((F.col("doc") != F.col("ref.doc")) | (F.col("low") != F.col("ref.low"))).groupBy("doc", "ver").agg(F.collect_list("low").alias("copies"))
    rest = opened.select("doc_id", "doc", "ver", "z", "spans").join(copies.hint("shuffle_hash"), ["doc", "ver"], "left").select("doc_id", "z", "spans", "copies").mapInArrow(finish, RESULT)
    return checked.where("z is null").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))
