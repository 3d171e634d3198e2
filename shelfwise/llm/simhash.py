"""SimHash near-deduplication with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Of two fingerprints that differ in at most
three bits, one segment differs in at most one bit.  So each distinct fingerprint is indexed, for
each segment, under the segment itself and under every variant with one bit made a wildcard.  Two
fingerprints whose segments are equal meet under the segment; two that differ in bit p alone meet
under the variant with p as the wildcard, one with a 0 there and one with a 1.  An equality join
finds the meetings, and the Hamming distance of the whole fingerprints, tested inside the join,
verifies them.  Every link is found; no bucket is capped.

Equal fingerprints are one node of the graph, whatever the number of their rows, so a large group
of copies costs what one document costs after a partially aggregated group-by.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm._common import release, settled, slices, stored, table, unused
from shelfwise.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BITS = 64
SEGMENT_BITS = 32
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size; no word is cut."""
    if len(text) <= piece:
        yield text.split()
        return
    start = 0
    while start < len(text):
        end = min(start + piece, len(text))
        if end < len(text):
            found = WHITE.search(text, end)
            end = found.start() if found else len(text)
        yield text[start:end].split()
        start = end


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the text's word shingles, as an unsigned 64-bit number; 0 without words."""
    digest, ones, n, tail = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), 0, []
    for words in word_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        tail = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
        if len(words) < shingle:
            continue
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
        n += len(hashes)
        ones += np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not n:
        return digest(b" ".join(tail), seed) if tail else 0
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _signatures(nodes: DataFrame, side: int) -> DataFrame:
    """One row for each segment, and for each of its bits that is `side`, with that bit cleared."""
    lists = []
    for k in range(BITS // SEGMENT_BITS):
        segment = f"(shiftrightunsigned(fp, {SEGMENT_BITS * k}) & {(1 << SEGMENT_BITS) - 1}L)"
        head = f"{k << 38}L"
        lists.append(f"array({head} | {segment})")
        bits = f"filter(sequence(0, {SEGMENT_BITS - 1}), p -> (shiftright({segment}, p) & 1L) = {side})"
        lists.append(f"transform({bits}, p -> {head} | shiftleft(cast(p + 1 as bigint), {SEGMENT_BITS}) | ({segment} & ~shiftleft(1L, p)))")
    return nodes.select("fp", F.explode(F.expr(f"concat({', '.join(lists)})")).alias("sig"))


def links(nodes: DataFrame, distance: int = DISTANCE, crowd: int | None = None) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that differ in 1 to `distance` bits; each pair once or twice.

    With a `crowd`, signatures of more fingerprints than that are met by the least of them only, for
    callers that have another way for the pairs left out.
    """
    if distance >= 2 * (BITS // SEGMENT_BITS):
        raise ValueError("two segments with one wildcard find up to three differing bits")
    zero, one = _signatures(nodes, 0), _signatures(nodes, 1).alias("b")
    if crowd is not None:
        of_sig = W.partitionBy("sig")
        zero = zero.withColumn("least", F.min("fp").over(of_sig)).withColumn("n", F.count(F.lit(1)).over(of_sig)).where((F.col("n") <= crowd) | (F.col("fp") == F.col("least"))).select("fp", "sig")
    zero = zero.alias("a")
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    return zero.join(one, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.fp") != F.col("b.fp")) & close).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def cluster(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """For each row: doc_id, fingerprint, component_id, group_size.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are joined by a space and
    repeats count.  A text of fewer words than a shingle is one shingle; a text without words, null
    included, has fingerprint zero and links like any other.  component_id is the smallest doc_id
    of the component; a null doc_id never is one, unless the component has no other.  Repeated
    rows get equal results.  An empty table gives an empty result; other columns are not read.
    """
    marked = settled(fingerprints(documents, shingle, seed))
    nodes = settled(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    joined = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("group_size"))
    of_node = settled(rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "group_size"))
    return marked.join(of_node, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


#: The near copies of `near_copies`: words a shingle, and the share of common shingles that makes a link.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of one signature that are all held against each other; more are held against the least of them.
CROWD = 64
#: Shingles met so often in one of `SAMPLE` texts are common, the most frequent `COMMON` of them; they come last in a text's order.
SAMPLE, OFTEN, COMMON = 16, 3, 1 << 16
#: Most rounds in which each bucket compares its rows with one of them, before all its pairs across classes are compared;
#: there are none once those pairs are at most so many a row, or less than that share of a round's pairs did link.
STAR_ROUNDS, FEW_PAIRS, LEAST_LINKED = 4, 1, 0.5
#: At most so many rows of two longs are broadcast to a join, beyond it is shuffled; sets that a verifying task remembers.
BROADCAST_ROWS, SETS = 500_000, 32
#: Sets that a task remembers to have named.
MEMO_IDS = 200_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct word shingles.

    Shingle hashes combine their words' hashes, so that a word is hashed once a text.
    """
    seen: dict[bytes, int] = {}
    order: list[int] = []
    for words in word_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        order.extend(seen.setdefault(w, len(seen)) for w in words)
    if not order:
        return np.zeros(0, dtype=np.int64)
    of_word = np.array([xxhash.xxh3_64_intdigest(w, SEED) for w in seen], dtype=np.uint64)[np.array(order)]
    width = min(shingle, len(order))
    mixed = np.zeros(len(order) - width + 1, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ of_word[k : k + len(mixed)]) * np.uint64(_ODD[0]) + np.uint64(_ODD[1])
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bits that tell of which hash remainders the set has an odd number, as longs; 4 to 8 bits a shingle.

    The bits of two sets differ in no more places than the sets in shingles.  The halves of a longer
    array, combined by exclusive or, are the array of half as many remainders.
    """
    bits = max(64, 1 << (4 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount(shingles & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, int]:
    """The first shingles in the order of all texts, and how many of them are not common.

    Sets of a similarity of at least `similarity` share one of their first n - ceil(similarity * n) + 1
    shingles in any order that all texts have; here common shingles come last, the most frequent at the end.
    """
    n = len(shingles)
    if not n:
        return shingles, 0
    place = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        place = np.where(common[at] == shingles, rank[at], 0)
    kept = np.lexsort((shingles, place))[: n - math.ceil(similarity * n - 1e-6) + 1]
    return shingles[kept], int((place[kept] == 0).sum())


def common_shingles(documents: DataFrame, shingle: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts of a sample have, and their ranks from 1, rarest first.

    They only decide the order of a text's shingles; any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingle_set(t.as_py(), shingle) for t in batch.column(0)], pa.list_(pa.int64()))], names=["s"])

    sample = documents.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "s array<bigint>")
    counted = sample.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    found = counted.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    hashes, ranks = np.array([r["h"] for r in found], dtype=np.int64), np.arange(len(found), 0, -1, dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def _marks(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (doc_id, key, text) to those of `_marked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps, ids, sizes, bits = [], [], [], []
            for t in batch.column(2):  # one set at a time: those of long texts are large
                text = t.as_py()
                s = shingle_set(text, shingle)
                for column, value in ((fps, fingerprint(text)), (ids, set_id(s)), (sizes, len(s)), (bits, parities(s))):
                    column.append(value)
            made = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "key", "fp", "id", "n", "bits"])

    return run


def _marked(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, fp, id, n, bits) for each row: a hash of the text, its fingerprint, the id that equal shingle sets share, the set's size."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_marks(shingle), f"doc_id {kind}, key long, fp long, id long, n int, bits array<bigint>")


def _postings(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(sig, id, n, pos, rare): the shingles of each text's prefix; a task names each set once.

    n is the size of the set, pos the shingle's place in the order of all texts, and rare tells
    whether the sample did not show it to be common.
    """
    common, rank = common_shingles(documents, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            heads, ids, sizes, few = [], [], [], []
            for t in batch.column(0):
                s = shingle_set(t.as_py(), shingle)
                name = set_id(s)
                if name in seen:
                    continue
                if len(seen) >= MEMO_IDS:
                    seen.clear()
                seen.add(name)
                head, rare = prefix(s, common, rank, similarity)
                for column, value in ((heads, head), (ids, name), (sizes, len(s)), (few, rare)):
                    column.append(value)
            if not heads:
                continue
            each = np.array([len(h) for h in heads])
            pos = np.concatenate([np.arange(k) for k in each])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(heads)), pa.array(np.repeat(np.array(ids, dtype=np.int64), each)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), each)), pa.array(pos.astype(np.int32)), pa.array(pos < np.repeat(np.array(few), each))],
                names=["sig", "id", "n", "pos", "rare"],
            )

    return documents.select("text").mapInArrow(run, "sig long, id long, n int, pos int, rare boolean")


def _small(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Whether sets that have this shingle as the first in common can be similar enough: by what is left of both behind it."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return left * (1 + similarity) >= similarity * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-6


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def _indexed(documents: DataFrame, marked: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, bits) and (id, text) of the sets that the index names, one row each."""
    named = _small(settled(index.select("id").distinct()))
    of_id = marked.join(named, "id", "left_semi").groupBy("id").agg(F.first(F.struct("key", "n", "bits")).alias("m"))
    sketches = stored(of_id.select("id", "m.key", "m.n", "m.bits"), "near-copies-sketches")
    texts = documents.select(F.xxhash64("text").alias("key"), "text").join(_small(sketches.select("key", "id")), "key")
    return sketches.select("id", "n", "bits"), stored(texts.groupBy("id").agg(F.first("text").alias("text")), "near-copies-texts")


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets may be similar enough, by the places in which their bits differ: none that is gets lost."""
    side = lambda p: sketches.select(F.col("id").alias(p), F.col("n").alias(f"{p}_n"), F.col("bits").alias(f"{p}_bits"))
    half = lambda p: f"zip_with(slice({p}_bits, 1, size({p}_bits) div 2), slice({p}_bits, size({p}_bits) div 2 + 1, size({p}_bits) div 2), (x, y) -> x ^ y)"
    differ = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    places = f"case when size(u_bits) = size(v_bits) then {differ('u_bits', 'v_bits')} when size(u_bits) = 2 * size(v_bits) then {differ(half('u'), 'v_bits')} when size(v_bits) = 2 * size(u_bits) then {differ('u_bits', half('v'))} else 0 end"
    return pairs.join(side("u"), "u").join(side("v"), "v").where(F.expr(places) <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("u_n") + F.col("v_n")) + 1e-6).select("u", "v")


def _tested(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): the pairs that are similar enough, held against the whole shingle sets of their texts where their bits leave it open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def set_of(name: int, text: pa.Scalar) -> np.ndarray:
            found = known.get(name)
            if found is None:
                if len(known) >= SETS:
                    known.clear()
                found = known[name] = shingle_set(text.as_py(), shingle)
            return found

        for batch in slices(batches):
            linked = []
            for u, v, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                left, right = set_of(u, a), set_of(v, b)
                common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(common >= similarity * (len(left) + len(right) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(linked, pa.bool_()))

    pairs = settled(_likely(pairs, sketches, similarity))
    wanted = settled(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    texts = texts.join(_small(wanted), "id", "left_semi")
    side = lambda p: texts.select(F.col("id").alias(p), F.col("text").alias(f"{p}_text"))
    whole = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_text", "v_text")
    return settled(whole.mapInArrow(run, "u long, v long"))


def _meetings(rows: DataFrame) -> int:
    """How many pairs of different classes the buckets have."""
    of_class = rows.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c"))
    of_bucket = of_class.groupBy("sig").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("twice"))
    return (of_bucket.agg(F.sum("twice")).first()[0] or 0) // 2


def near_index(documents: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(sig, id, n, pos): the postings of shingles that the prefixes of several sets have."""
    every = _postings(documents, shingle, similarity)
    of_sig = W.partitionBy("sig")
    rare = every.where("rare").withColumn("lo", F.min("id").over(of_sig)).withColumn("hi", F.max("id").over(of_sig)).where("lo <> hi").dropDuplicates(["sig", "id"]).select("sig", "id", "n", "pos")
    often = every.where("not rare").dropDuplicates(["sig", "id"]).select("sig", "id", "n", "pos")
    return stored(rare.unionByName(often), "near-copies-index")


def fingerprint_pairs(marked: DataFrame) -> DataFrame:
    """(u, v): ids of sets whose texts' fingerprints are equal or link, as `cluster` links them.

    The least id stands for a fingerprint: the other ids of the fingerprint are paired with it, and so
    are the least ids of fingerprints that differ in a few bits.
    """
    nodes = settled(marked.groupBy("fp").agg(F.min("id").alias("least"), F.max("id").alias("most")))
    met = settled(links(nodes.select("fp"), crowd=CROWD))
    hint = F.broadcast if met.count() <= BROADCAST_ROWS else (lambda df: df)
    alike = marked.select("fp", "id").join(_small(nodes.where("least <> most").select("fp", "least")), "fp").select(F.col("least").alias("a"), F.col("id").alias("b"))
    from_u = nodes.select(F.col("fp").alias("u"), F.col("least").alias("a")).join(hint(met), "u")
    near = nodes.select(F.col("fp").alias("v"), F.col("least").alias("b")).join(hint(from_u), "v").select("a", "b")
    return alike.unionByName(near).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _least_linked(linked: DataFrame) -> DataFrame:
    """(node, root) for each node with a link; root is the least of the node and what it links to.

    Nodes of one root are of one component, though a component may have several roots: what is
    compared may be grouped so without the rounds of `components`.
    """
    arcs = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return arcs.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root"))


def near_links(documents: DataFrame, marked: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (u, v) of ids with verified links whose components are those of all pairs that are similar enough.

    The pairs whose fingerprints link come first, each held against its whole sets, and what is
    similar enough becomes a class.  Fingerprints tell nothing of the pairs that they do not link,
    so these are searched exactly: texts with a shared shingle in their prefixes are a bucket.  In
    each of a few rounds every bucket compares its members with one of them of another class, and
    what links becomes a class.  Then all pairs of a bucket are compared that are of different
    classes.  A pair that is not compared is of one class.  The one row is first the one that shares
    most of its prefix, as the original of edited copies does; later it is one of the bucket's
    largest class, a different one each round.
    """
    index = near_index(documents, shingle, similarity)
    sketches, texts = _indexed(documents, marked, index)
    met = settled(fingerprint_pairs(marked))
    ends = _small(settled(met.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
    linked = _tested(met, sketches.join(ends, "id", "left_semi"), texts, shingle, similarity)
    classes = _small(settled(_least_linked(linked)))
    release(documents.sparkSession)
    shared = settled(index.groupBy("id").agg(F.count(F.lit(1)).alias("size")))
    rows = index.join(shared, "id").join(classes, F.col("id") == F.col("node"), "left").select("sig", "id", "n", "pos", F.coalesce("root", "id").alias("root"), "size")
    most, fruitful = FEW_PAIRS * index.count(), True
    for turn in range(STAR_ROUNDS + 1):
        last = turn == STAR_ROUNDS or not fruitful or _meetings(rows) <= most
        if not last:
            buckets = rows.groupBy("sig").agg(F.max(F.struct("size", F.xxhash64("id", F.lit(turn)).alias("k"), "id", "n", "pos", "root")).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            others = buckets.where("lo <> hi").select("sig", "p.id", "p.n", "p.pos", "p.root").alias("b")
        else:
            others = rows.alias("b")
        pairs = settled(_pairs(rows.alias("a").join(others, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.root") != F.col("b.root")) & _may_link("a", "b", similarity))))
        new = _tested(pairs, sketches, texts, shingle, similarity)
        found = new.count()
        fruitful = found >= LEAST_LINKED * pairs.count()
        linked = linked.unionByName(new)
        if last:
            break
        if found:
            classes = components(linked)
            classes = classes.join(classes.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
            rows = index.join(classes, index["id"] == classes["node"], "left").select(*index.columns, F.coalesce("root", "id").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
            mixed = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
            rows = stored(rows.join(mixed, "sig", "left_semi"), "near-copies-rows")
            release(documents.sparkSession)
    return linked


def _classed(documents: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, first) of every row with a doc_id; first is the (doc_id, key) of its component that stays."""
    documents = documents.where(F.col("doc_id").isNotNull())
    marked = stored(_marked(documents, shingle), "near-copies-sets")
    nodes = settled(marked.groupBy("id").agg(F.min(F.struct("doc_id", "key")).alias("least")))
    joined = components(near_links(documents, marked, shingle, similarity))
    rooted = nodes.join(joined, nodes["id"] == joined["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    of_node = settled(rooted.select("id", "root").join(named, "root").select("id", "first"))
    return marked.select("doc_id", "key", "id").join(of_node, "id").select("doc_id", "key", "first")


def near_copies(documents: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id: near copies by word shingles, none missed.

    Two texts link when their sets of `shingle`-word shingles have a Jaccard similarity of at least
    `similarity`; equal sets are one node.  Candidates are texts whose fingerprints link and, of
    the others, those that share a shingle in the prefixes of their sets, as all such pairs do.  component_id is the smallest doc_id that links reach.  Texts
    without words, null included, are one node.  Rows without a doc_id are left out; an empty table
    gives an empty result; other columns are not read.
    """
    return _classed(documents, shingle, similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """One row of each component of `near_copies`, one with the smallest doc_id, with all its columns.

    Rows are told apart by doc_id and text, so different texts of one doc_id stay or go each by itself,
    and of rows that repeat both one stays.  Rows without a doc_id are no copies and stay.  Texts without
    words, null included, are copies of each other.  An empty table gives an empty result; further
    columns, whatever their names, are carried along unchanged.
    """
    key, classed = unused(documents, "near_copy_key"), settled(_classed(documents))
    stays = F.struct("doc_id", "key") == F.col("first")
    copies = classed.where(~stays).select("doc_id", F.col("key").alias(key)).distinct()
    left = documents.withColumn(key, F.xxhash64("text")).join(copies, ["doc_id", key], "left_anti")
    repeated = settled(classed.where(stays).groupBy("doc_id", F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", key))
    if not repeated.isEmpty():
        once = left.join(repeated, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
        left = left.join(repeated, ["doc_id", key], "left_anti").unionByName(once)
    return left.select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))
