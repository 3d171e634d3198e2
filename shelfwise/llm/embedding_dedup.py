"""Embedding near-deduplication with cross-polytope hashing.

A vector is rotated by sign flips and fast Hadamard transforms, three times over; its hash is the
coordinate of largest magnitude with its sign, the nearest vertex of the cross-polytope.  A table's
bucket joins one to three such hashes, fewer for wider vectors, whose hashes tell more apart; narrow
vectors are padded to `LEAST_WIDTH`, so that there are rotations enough.  Each vector is filed in one bucket of each of `TABLES` tables and
looks, besides, in the buckets that exchange one hash for its runner-up (multiprobe).  Pairs that
meet are screened inside the join by the Hamming distance of 128 sign bits, named once, and verified
by their cosine in double precision.

Equal vectors are one node, whatever the number of their rows.  A pair that has met in an earlier
table's own bucket, as the whole codes of those buckets tell, is not named again, so a dense cluster
costs its links and little more.  No bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm._common import settled, table
from shelfwise.llm.components import components

COSINE = 0.9
#: Tables; a table's code, the numbers of its hashes, takes half of one of six longs.
TABLES = 12
LEAST_WIDTH = 32
SEED = 29
SIGN_BITS = 128
#: Two vectors of cosine 0.9 differ in 18.4 of 128 sign bits on average, with a deviation of 4.
SIGN_DISTANCE = 38
CODES = [f"c{k}" for k in range(TABLES // 2)]
BUCKET_SCHEMA = "node long, probe boolean, tab int, sig long, s0 long, s1 long, " + ", ".join(f"{c} long" for c in CODES)


def hashes_of(width: int) -> int:
    """How many hashes a bucket joins, by the padded width: their numbers fit 32 bits."""
    return 3 if width <= 128 else 2 if width <= 4096 else 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, orthonormal; the width is a power of two."""
    n, d = x.shape
    x, h = x.copy(), 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """One of a family of pseudo-random rotations; all processes draw the same signs."""
    signs = np.random.default_rng([seed, number, x.shape[1]]).choice((-1.0, 1.0), size=(3, x.shape[1]))
    for flips in signs:
        x = hadamard(x * flips)
    return x


def _padded(unit: np.ndarray) -> np.ndarray:
    width = max(LEAST_WIDTH, 1 << (unit.shape[1] - 1).bit_length())
    return np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def buckets(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of unit length: signatures (rows, tables, 1 + probes), sign bits (rows, 2), codes (rows, tables / 2)."""
    dim, x = unit.shape[1], _padded(unit)
    n, d = x.shape
    two, hashes = np.uint64(2 * d), hashes_of(d)
    signatures = np.empty((n, TABLES, 1 + hashes), dtype=np.uint64)
    codes = np.zeros((n, TABLES // 2), dtype=np.uint64)
    every = np.arange(n)
    for t in range(TABLES):
        best, second = [], []
        for k in range(hashes):
            y = rotate(x, t * 3 + k, seed)
            size = np.abs(y)
            first = size.argmax(1)
            size[every, first] = -1
            runner = size.argmax(1)
            best.append((first * 2 + (y[every, first] < 0)).astype(np.uint64))
            second.append((runner * 2 + (y[every, runner] < 0)).astype(np.uint64))
        for p in range(1 + hashes):
            code = np.zeros(n, dtype=np.uint64)
            for k in range(hashes):
                code = code * two + (second[k] if k == p - 1 else best[k])
            if not p:
                codes[:, t // 2] |= code << np.uint64(32 * (t % 2))
            whole = code + (np.uint64(dim) << np.uint64(32))
            signatures[:, t, p] = (whole * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((t + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
    signs = np.concatenate([rotate(x, 1000 + k, seed) >= 0 for k in range(-(-SIGN_BITS // d))], axis=1)[:, :SIGN_BITS]
    return signatures, np.packbits(signs, axis=1).view(np.uint64), codes


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None where it is null, empty, zero or holds null or non-finite components."""
    out: list[np.ndarray | None] = []
    for item in column:
        values = item.as_py()
        if not values or any(v is None for v in values):
            out.append(None)
            continue
        x = np.asarray(values, dtype=np.float64) + 0.0
        out.append(x if np.isfinite(x).all() and x.any() else None)
    return out


def addressed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, address, vector): the address names the vector's components; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1))
            names = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "address", "vector"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector")).mapInArrow(run, f"vec_id {kind}, address string, vector array<double>")


def filed(nodes: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of the index and of the probes, by `BUCKET_SCHEMA`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids, rows = part.column(0).to_numpy(), [np.asarray(v.values) for v in part.column(1)]
                for width in {len(r) for r in rows}:
                    which = [k for k, r in enumerate(rows) if len(r) == width]
                    x = np.stack([rows[k] for k in which])
                    x = x / np.abs(x).max(1)[:, None]
                    signatures, bits, codes = buckets(x / np.linalg.norm(x, axis=1)[:, None], seed)
                    n, probes = len(which), signatures.shape[2]
                    each = TABLES * (1 + probes)
                    sig = np.concatenate([signatures[:, :, :1], signatures], axis=2).reshape(-1)
                    probe = np.tile(np.array([False] + [True] * probes), n * TABLES)
                    tab = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + probes), n)
                    wide = lambda a: pa.array(np.repeat(a, each).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [wide(ids[which]), pa.array(probe), pa.array(tab), pa.array(sig.view(np.int64)), wide(bits[:, 0].copy()), wide(bits[:, 1].copy()), *(wide(codes[:, k].copy()) for k in range(len(CODES)))],
                        names=["node", "probe", "tab", "sig", "s0", "s1", *CODES],
                    )

    return nodes.select("node", "vector").mapInArrow(run, BUCKET_SCHEMA)


def candidates(nodes: DataFrame, seed: int = SEED) -> DataFrame:
    """Pairs u < v of nodes that meet in a bucket and pass the screen, each once."""
    rows = settled(filed(nodes, seed))
    at_home, looking = rows.where("not probe").alias("a"), rows.where("probe").alias("b")
    met_before = " or ".join(f"(b.tab > {t} and (shiftrightunsigned(a.c{t // 2} ^ b.c{t // 2}, {32 * (t % 2)}) & 4294967295L) = 0)" for t in range(TABLES - 1))
    near = F.expr(f"a.sig = b.sig and a.node <> b.node and bit_count(a.s0 ^ b.s0) + bit_count(a.s1 ^ b.s1) <= {SIGN_DISTANCE} and not ({met_before})")
    met = at_home.join(looking, near).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    return met.distinct()


def links(nodes: DataFrame, least: float = COSINE, seed: int = SEED) -> DataFrame:
    """(u, v) with u < v: the candidates whose cosine is at least `least`."""
    scaled = nodes.select("node", "vector", F.expr("transform(vector, x -> x / array_max(transform(vector, y -> abs(y))))").alias("x")).select("node", "x", F.expr("sqrt(aggregate(x, 0D, (s, y) -> s + y * y))").alias("norm"))
    left, right = (scaled.select(*(F.col(c).alias(f"{side}_{c}") for c in ("node", "x", "norm"))) for side in "uv")
    paired = candidates(nodes, seed).join(left, F.col("u") == F.col("u_node")).join(right, F.col("v") == F.col("v_node"))
    same = F.expr(f"aggregate(zip_with(u_x, v_x, (x, y) -> x * y), 0D, (s, x) -> s + x) / (u_norm * v_norm) >= {least}D")
    return paired.where(same).select("u", "v")


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = COSINE) -> DataFrame:
    """For each row: vec_id, n_links, component_id, kept.

    n_links counts the other rows linked directly; equal vectors are linked.  Vectors that are
    null, empty or zero, or hold null or non-finite components, link with nothing, and each is its
    own component; so do vectors of different lengths with each other.  component_id is the
    smallest vec_id of the component.  Repeated rows are vectors of their own with the same vec_id.
    An empty table gives an empty result; other columns are not read.
    """
    rows = settled(addressed(vectors, key, vector))
    grouped = rows.where("address is not null").groupBy("address").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    nodes = settled(grouped.withColumn("node", F.monotonically_increasing_id()))
    pairs = settled(links(nodes, least))
    arcs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sizes = nodes.select(F.col("node").alias("v"), "size")
    linked = arcs.join(sizes, "v").groupBy("u").agg(F.sum("size").alias("more"))
    rooted = nodes.select("node", "address", "least", "size").join(components(pairs), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.join(named, "root").join(linked, F.col("node") == F.col("u"), "left").select("address", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = rows.drop("vector").join(settled(told), "address", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
