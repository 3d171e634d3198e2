"""Each operator against plain Python on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import bpe, embedding_dedup, exact_dedup, html_extract, mixing, quality, secrets, sharding, simhash, substring_dedup

CLASHES = "digest string, rid long, fp long, key string, doc long, blob string, slot string, rate double, `_shelfwise_rank` string"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdeéß") for _ in range(R.randint(1, 6))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(60, 1)
TEXTS = [
    (3, BASE), (9, BASE.upper().replace("É", "é")), (5, BASE), (5, BASE), (1, None), (2, ""), (4, " \t\n"), (6, "one"), (7, "two words"), (8, prose(30000, 2)), (10, BASE + " tail"), (11, prose(50, 3) + " " + BASE[:150]), (None, prose(40, 4)), (None, None),
    (12, "password = abcdefgh1 AKIA" + "A1" * 8 + " x" + "ab12" * 9), (13, "Secret: short token: longenough99 é api_key='abcdefgh'"), (14, "A B\x0bC\x0cD"),
]


@pytest.fixture(scope="module")
def docs(spark):
    made = [(d, t, "en", [None, "a", "b"][k % 3], len(t or ""), *["x", 1, 2, "k", 3, "b", "s", 0.5, "r"]) for k, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup(docs, empty):
    groups = {}
    for d, t in TEXTS:
        groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(d)
    got = exact_dedup.assign(docs).collect()
    assert len(got) == len(TEXTS)
    for h, members in groups.items():
        mine = [r for r in got if r["text_sha256"] == h]
        assert {(r["group_size"], r["keep_id"]) for r in mine} == {(len(members), max((m for m in members if m is not None), default=None))}
        assert sum(r["kept"] for r in mine) == 1
    left = exact_dedup.deduplicate(docs)
    assert left.count() == len(groups) and left.columns == docs.columns
    clashing = docs.withColumns({"text_digest": F.lit("d"), "place_in_group": F.lit(7), "heavy_id": F.lit(None)})
    assert {(r["text_digest"], r["place_in_group"], r["_shelfwise_rank"]) for r in exact_dedup.deduplicate(clashing).collect()} == {("d", 7, "r")}
    assert {(r["mix_rate"], r["rate"]) for r in mixing.mix(docs.withColumn("mix_rate", F.lit("m"))).collect()} == {("m", 0.5)}
    assert exact_dedup.assign(empty).count() == 0


def test_exact_dedup_splits_heavy_groups(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.assign(many)
    assert got.where("group_size = 1000").select("keep_id").distinct().first()[0] == 2997 and got.where("kept").count() == 2001
    assert exact_dedup.heavy_digests(many.select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest"), F.col("doc_id").alias("rid"))).count() == 1


def plain_fingerprint(t):
    w = lower(t).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, empty):
    got = simhash.cluster(docs).collect()
    fps = [(d, plain_fingerprint(t)) for d, t in TEXTS]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(d), f"{f:016x}") for d, f in fps)
    parent = list(range(len(fps)))
    for _ in fps:
        for a, (_, x) in enumerate(fps):
            for b, (_, y) in enumerate(fps):
                if (x ^ y).bit_count() <= 3:
                    parent[b] = min(parent[a], parent[b])
    least = {p: min((d for k, (d, _) in enumerate(fps) if parent[k] == p and d is not None), default=None) for p in parent}
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(str((d, least[parent[k]])) for k, (d, _) in enumerate(fps))
    assert simhash.cluster(empty).count() == 0 and simhash.fingerprint(BASE) == plain_fingerprint(BASE)


def test_simhash_links_every_pair(spark):
    r = random.Random(8)
    made = [r.getrandbits(64) for _ in range(40)]
    for f in list(made):
        for n in (1, 2, 3, 4):
            x = f
            for b in r.sample(range(64), n):
                x ^= 1 << b
            made.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in set(made)]
    got = {tuple(sorted(p)) for p in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {tuple(sorted((a, b))) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def near_classes(made):
    """Smallest doc_id reachable by links of at least 0.8 over five-word shingles, in plain Python."""
    sets = []
    for _, t in made:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(made)))
    for a in range(len(made)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    return {(d, min(e for k, (e, _) in enumerate(made) if group[k] == g)) for (d, _), g in zip(made, group, strict=True)}


def test_near_copies(spark, docs, empty):
    """Edited copies are found as brute force finds them; nulls, empty texts, repeats and one very long text are in `docs`."""
    named = [(d, t) for d, t in TEXTS if d is not None]
    assert {tuple(r) for r in simhash.near_copies(docs).collect()} == near_classes(named)
    assert simhash.near_copies(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    left = simhash.deduplicate(docs)
    assert left.columns == docs.columns and left.where("doc_id is null").count() == 2

    r, made = random.Random(11), []
    for k in range(120):
        base = prose(r.randint(60, 400), 100 + k).split()
        made.append((10 * k, " ".join(base)))
        for n in range(1, 4):
            copy = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(VOCABULARY)
            made.append((10 * k + n, " ".join(copy)))
    got = {tuple(x) for x in simhash.near_copies(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    want = near_classes(made)
    copies = {p for p in want if p[0] != p[1]}
    assert len(copies) > 100 and len(got & copies) >= 0.95 * len(copies)
    assert all(a // 10 == b // 10 for a, b in got)


def test_near_copies_misses_no_kind_of_edit(spark):
    """Appended, cut and substituted copies from below to above the similarity, beside a passage that many texts share."""
    r, made, passage = random.Random(12), [], prose(30, 77)
    for k in range(150):
        n = r.randint(20, 300)
        base = [f"{w}{r.randrange(9)}" for w in prose(n, 900 + k).split()]
        cut, words = base[: n - round(n * r.uniform(0, 0.3))], list(base)
        for at in r.sample(range(n), max(1, n // 50)):
            words[at] = "edit"
        made += [(10 * k, base), (10 * k + 1, base + prose(round(n * r.uniform(0, 0.3)), 5000 + k).split()), (10 * k + 2, cut), (10 * k + 3, words), (10 * k + 4, passage.split() + base)]
    made = [(d, " ".join(t)) for d, t in made]
    want = near_classes(made)
    assert {tuple(x) for x in simhash.near_copies(spark.createDataFrame(made, "doc_id long, text string")).collect()} == want
    assert len({c for _, c in want}) < len(want) - 200


def test_near_copies_are_linked_by_fingerprints(spark, monkeypatch):
    """Without the search by prefixes the links are those of fingerprints with sets that are similar enough."""
    r, made = random.Random(13), []
    for k in range(40):
        base = prose(400, 3000 + k).split()
        made.append((10 * k, " ".join(base)))
        for n in range(1, 5):
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(VOCABULARY)
            made.append((10 * k + n, " ".join(copy)))
    passage = prose(5, 78) + " "
    made += [(1000, passage * 300 + prose(40, 79)), (1001, passage * 300 + prose(40, 80))]  # near fingerprints, unlike sets
    prints = [plain_fingerprint(t) for _, t in made]
    group = list(range(len(made)))
    for a, b in itertools.combinations(range(len(made)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and len({c for _, c in near_classes([made[a], made[b]])}) == 1:
            x, y = group[a], group[b]
            group = [min(x, y) if g in (x, y) else g for g in group]
    want = {(d, made[g][0]) for (d, _), g in zip(made, group, strict=True)}
    assert (prints[-1] ^ prints[-2]).bit_count() <= 3 and 40 < len({c for _, c in want}) < 150
    df = spark.createDataFrame(made, "doc_id long, text string")
    with monkeypatch.context() as only:
        only.setattr(simhash, "_may_link", lambda a, b, similarity: F.lit(False))
        assert {tuple(x) for x in simhash.near_copies(df).collect()} == want
    monkeypatch.setattr(simhash, "CROWD", 1)
    assert {tuple(x) for x in simhash.near_copies(df).collect()} == near_classes(made)


def test_near_copies_mark_long_texts_one_set_at_a_time():
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join(random.Random(k).choices(words, k=4000)) for k in range(40)] + ["", None, "One two", "one TWO"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "key", "text"])

    def peak(rows):
        tracemalloc.start()
        got = list(simhash._marks(simhash.NEAR_SHINGLE)(iter([batch.slice(0, rows)])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, pa.Table.from_batches(got).to_pylist()

    one, _ = peak(1)
    every, got = peak(len(texts))
    whole = sum(simhash.shingle_set(t).nbytes for t in texts)
    assert every - one < whole / 2
    for row, text in zip(got, texts, strict=True):
        shingles = simhash.shingle_set(text)
        assert row["fp"] % (1 << simhash.BITS) == simhash.fingerprint(text) and row["id"] == simhash.set_id(shingles)
        assert row["n"] == len(shingles) and row["bits"] == simhash.parities(shingles).tolist()


def test_simhash_crowded_signatures(spark):
    """A crowd keeps true links only, reaches every fingerprint of a signature by its least, and leaves smaller ones whole."""
    near = [(5 << 40) | k for k in (0, 1, 2, 4, 8, 16, 3, 5)]
    nodes = spark.createDataFrame([(x,) for x in [*near, 77 << 33, (77 << 33) | 64]], "fp long")
    every = {tuple(sorted(p)) for p in simhash.links(nodes).collect()}
    assert {tuple(sorted(p)) for p in simhash.links(nodes, crowd=64).collect()} == every
    few = {tuple(sorted(p)) for p in simhash.links(nodes, crowd=2).collect()}
    assert few < every and {(near[0], x) for x in near[1:]} <= few and (77 << 33, (77 << 33) | 64) in few


def test_near_dedup_drops_rows_not_doc_ids(spark):
    one, other, copy = prose(80, 21), prose(80, 22), prose(80, 21) + " tail"
    made = [(1, one, "a"), (1, one, "b"), (2, copy, "c"), (2, other, "d"), (3, other, "e"), (None, one, "f"), (None, one, "g")]
    left = simhash.deduplicate(spark.createDataFrame(made, "doc_id long, text string, source string"))
    got = sorted((str(r["doc_id"]), r["text"]) for r in left.collect())
    assert got == sorted([("1", one), ("2", other), ("None", one), ("None", one)])


def plain_secrets(t):
    t, out = t or "", []
    for place, (kind, pattern, group, least, flags) in enumerate([("assign", secrets.RULES[0].pattern[4:], 2, 8, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0, 16, 0), ("hex", r"[0-9a-f]+", 0, 32, 0)]):
        out += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t, flags) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets_and_ledger(spark, docs, empty, tmp_path):
    assert rows(secrets.find(docs), "doc_id", "spans") == sorted(((d, plain_secrets(t)) for d, t in TEXTS), key=str)
    seen, first = secrets.scan(docs)
    known = first.where("blob <> sha2('one', 256)")
    seen, again = secrets.scan(docs, known)
    assert again.select("blob").distinct().count() == 1 and again.count() == len(secrets.RULES)
    newer = (secrets.Rule("assign", secrets.RULES[0].pattern, 2, 8, version=2), *secrets.RULES[1:])
    assert {r["rule"] for r in secrets.scan(docs, first, newer)[1].collect()} == {"assign@2"}
    assert rows(secrets.report(seen, known.unionByName(again)), "doc_id", "spans") == rows(secrets.find(docs), "doc_id", "spans")
    assert secrets.find(empty).count() == 0

    path, half = str(tmp_path / "ledger"), docs.where("doc_id < 9")
    assert secrets.update(half, path).additions.select("blob").distinct().count() == len({t or "" for d, t in TEXTS if d is not None and d < 9})
    whole = secrets.update(docs, path)
    assert whole.additions.select("blob").distinct().count() == len({t or "" for _, t in TEXTS}) - len({t or "" for d, t in TEXTS if d is not None and d < 9})
    assert rows(whole.report, "doc_id", "spans") == rows(secrets.find(docs), "doc_id", "spans")
    assert secrets.update(docs, path).additions.count() == 0  # nothing is scanned twice
    assert {r["rule"] for r in secrets.update(docs, path, newer).additions.collect()} == {"assign@2"}
    assert rows(secrets.update(docs, path, newer).report, "doc_id", "spans") == rows(secrets.find(docs), "doc_id", "spans")


def test_secrets_of_long_and_of_frequent_texts(spark):
    long = "x " + "token=abcdefgh1 " * 3000 + "AKIA" + "Z9" * 8
    made = [(k, "password: hunter2hunter2" if k % 2 else long if k == 0 else f"plain {k}") for k in range(3000)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find(spark.createDataFrame(made, "doc_id long, text string").repartition(6)).collect()}
    assert got == {d: plain_secrets(t) for d, t in made}


def test_mixing(spark, docs, empty):
    got = mixing.assign(docs).collect()
    sizes = {}
    for k, (_, t) in enumerate(TEXTS):
        sizes[[None, "a", "b"][k % 3]] = sizes.get([None, "a", "b"][k % 3], 0) + len(words(t))
    assert {r["source"]: r["source_size"] for r in got} == sizes
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, goal, left = dict(zip(names, (3, 1, 2), strict=True)), {}, 1.5 * sum(sizes.values())
    open_ = set(names)
    while True:  # share by weight, stop at the cap, share the excess again
        level = (left - sum(2 * sizes[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    goal = {s: weight[s] * level if s in open_ else 2 * sizes[s] for s in names}
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == goal
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got) and mixing.mix(docs).columns == docs.columns
    assert mixing.assign(empty).count() == 0
    even = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    for r in mixing.assign(even).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.05


def test_embedding_dedup(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 64))
    near = base[:20] + 0.15 * r.normal(size=(20, 64))
    made = [[float(x) for x in v] for v in (*base, *near, base[0], 2 * base[1])] + [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in enumerate(made)], "vec_id long, embedding array<double>, label int, node string")
    got = {x["vec_id"]: x for x in embedding_dedup.cluster(df).collect()}
    v = np.array(made[:62])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    close = u @ u.T >= 0.9
    for k in range(62):
        assert got[k]["n_links"] == close[k].sum() - 1
    assert got[60]["component_id"] == 0 and got[61]["component_id"] == 1 and not got[60]["kept"]
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(62, 68))
    assert embedding_dedup.cluster(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("width", [2, 3, 8, 64, 128, 200, 384, 768, 1024])
def test_embedding_recall_at_the_threshold(width):
    r = np.random.default_rng(9)
    a = r.normal(size=(400, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n = r.normal(size=a.shape)
    n -= (n * a).sum(1)[:, None] * a
    n /= np.linalg.norm(n, axis=1)[:, None]
    x, y = embedding_dedup.buckets(a), embedding_dedup.buckets(0.9 * a + np.sqrt(0.19) * n)
    met = ((x[0][:, :, :1] == y[0]).any((1, 2))) | ((y[0][:, :, :1] == x[0]).any((1, 2)))
    signs = np.bitwise_count(x[1] ^ y[1]).sum(1) <= embedding_dedup.SIGN_DISTANCE
    assert (met & signs).mean() >= 0.9


def test_embedding_groups_and_wide_vectors(spark):
    """Dense groups of vectors of several widths against brute force, one vector in many rows, and a very long vector."""
    r, rows_, want = np.random.default_rng(7), [(9000, [1.0] * 20000), (9001, [2.0] * 20000)], {}
    for width in (3, 48, 300):
        centre = r.normal(size=(5, width))
        made = np.concatenate([c + s * np.linalg.norm(c) / np.sqrt(width) * r.normal(size=(20, width)) for c in centre for s in (0.05, 0.2)] + [centre[:1]] * 20)
        u = made / np.linalg.norm(made, axis=1)[:, None]
        for v, n in zip(made, (u @ u.T >= 0.9).sum(1) - 1, strict=True):
            want[len(want)] = n
            rows_.append((len(want) - 1, v.tolist()))
    got = {x["vec_id"]: x for x in embedding_dedup.cluster(spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert all(got[k]["n_links"] <= n for k, n in want.items()) and sum(got[k]["n_links"] for k in want) >= 0.97 * sum(want.values())
    assert got[9001]["component_id"] == 9000 and got[9000]["n_links"] == 1


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    library, coder = Tokenizer.from_file(path), bpe.codec(path)
    r = random.Random(2)
    signs = "aabbcdeéèßñ  \t\n 　'sStTrelmd!?.,0123456789ÀÉ中文Σσİ̈́\x1c\x85😀<|endoftext|>"
    odd = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["x<|endoftext|>y", "word \u3000é " * 40_000, "one\x1ctwo " * 30_000, "ab" * 4000, "theinthean" * 900, ""]
    for t in [*odd, *(t or "" for _, t in TEXTS)]:
        ids = [i for piece in coder.encode(t) for i in memoryview(piece).cast("I")]
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t[:80]
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.digests(docs, path).collect()}
    want = set()
    for d, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()))
    assert got == want and bpe.digests(empty, path).count() == 0
    of_symbol = {c: b for b, c in enumerate(bpe.byte_symbols())}
    for t in odd[::7]:  # the byte-to-text machine, piece by piece, against all bytes at once
        spelled, ids = [], [i for i in library.encode(t, add_special_tokens=False).ids if i not in coder.m.added.values()]
        for i in ids:
            token = library.id_to_token(i)
            spelled += [*(of_symbol[c] for c in token.removesuffix("</w>")), *([32] if token.endswith("</w>") else [])]
        assert "".join(coder.decode_text(iter(ids))) == bytes(spelled).decode(errors="replace")
    turned = bpe.decode(bpe.encode(docs.where("doc_id = 7"), path), path, text="back").first()
    assert turned["back"].strip() == "two words"


def plain_substrings(made):
    first, split = {}, [(d, (t or "").encode().split()) for d, t in made]
    rank = lambda d: (1 << 63) - 1 if d is None else d
    for d, w in split:
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (rank(d), k)), (rank(d), k))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (rank(d), k):
                gone[k : k + 20] = [True] * 20
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark, docs, empty):
    assert rows(substring_dedup.remove(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_substrings(TEXTS)
    assert substring_dedup.remove(empty).count() == 0
    r, passages = random.Random(6), [prose(r, 50 + r) for r in (19, 20, 21, 35, 60)]
    made = []
    for k in range(60):
        parts = [r.choice([prose(r.randint(1, 30), 900 + k * 7 + j), r.choice(passages), "that " * r.randint(1, 45), " ".join(passages[4].split()[r.randint(0, 20) :])]) for j in range(r.randint(1, 5))]
        made.append((k, " ".join(parts)))
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert rows(substring_dedup.remove(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_substrings(made)


def test_substring_dedup_with_frequent_anchors(spark, monkeypatch):
    """A run of ten words in surroundings that differ, a passage in all documents, and texts that compress well."""
    run, passage = prose(10, 70), prose(45, 71)
    made = [(k, f"{prose(k % 13 + 12, 2000 + k)} {run} {prose(14, 4000 + k // 3)} {passage} {'same ' * (k % 50)}") for k in range(400)]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substring_dedup, "OFTEN", 3)
    assert len(substring_dedup.frequent_anchors(frame)) >= 3
    assert rows(substring_dedup.remove(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_substrings(made)


def test_substring_batches_are_bounded_by_plain_bytes():
    z = substring_dedup.zstandard.ZstdCompressor().compress(b"word " * 2_000_000)
    batch = substring_dedup.pa.RecordBatch.from_arrays([substring_dedup.pa.array([z] * 4)], names=["z"])
    assert [len(rows_) for rows_ in substring_dedup._bounded(iter([batch]))] == [1, 1, 1, 1]


def test_html(spark):
    model = html_extract.train()
    held = html_extract.Pages(99)
    parts = [html_extract.labelled(held) for _ in range(60)]
    x, y = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    assert ((model.log_odds(x) > 0) == y).mean() > 0.99
    page = '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1><p>First <b>bo</b>ld  text&nbsp;here.<p>Second<br>part &lt;3.</article><footer>&copy; x</footer>'
    pages = spark.createDataFrame([(1, "u", page, "z"), (2, None, None, "z"), (3, "v", "", "z"), (None, "w", "<<<>&", "z"), (1, "u", page, "z")], "page_id long, url string, html string, text string")
    got = html_extract.main_text(pages, model).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["Head & line First bold text here. Second part <3."] * 2
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] in (2, 3)] == [("", 0)] * 2 and len(got) == 5
    assert html_extract.main_text(pages.where("1 = 0"), model).count() == 0


def test_html_layouts_without_names():
    """The main text is found in plain, hashed, absent and table wrappers; markup of formulas is kept, a page of boilerplate is empty."""
    model = html_extract.train()
    said = [f"Sentence number {k} tells of things, and of others that come after it." for k in range(4)]
    body = "".join(f"<p>{x}</p>" for x in said)
    menu = '<div class="menu"><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Us</a></li></ul></div>'
    foot = "<footer>Copyright 2020 us</footer>"
    pages = [
        f"<body><div>{body}</div>", f'<body>{menu}<div class="css-1x8f">{body}</div>{foot}</body>', f"<body>{body}</body>", f"<div>{body}</div>" + "</b></i>" * 50, "<div>" * 3000 + body + "</div>" * 3000,
        f"<body>{menu}<table><tr><td><ul><li><a href=/x>One</a><li><a href=/y>Two</a></ul></td><td>{body}</td></tr></table>{foot}</body>", f'<head><title>T</title>{body}<body class="has-header">',
    ]
    assert html_extract.extract(pages, model) == [" ".join(said)] * len(pages)
    others = ["<body>Some bare text here.<br>More of it.</body>", "<article><h1>T</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so, and more text here.</p></article>", f"<body>{menu}{foot}</body>", '<p title="open>One text</p><p>and more of it.</p>']
    assert html_extract.extract(others, model) == ["Some bare text here. More of it.", "T Let x=1 be so, and more text here.", "", "One text and more of it."]


def test_html_broken_pages_cost_no_more():
    for bad in ("<a " * 300_000, '<a "x>"' * 100_000, "<div>" * 50_000 + "</b>" * 100_000, "<b><div>" + "<x>" * 50_000 + "</b>" * 100_000, "<!-- " * 200_000, "<script>" * 100_000, "</p>" * 200_000, "<" * 500_000):
        began = time.time()
        html_extract.parse(bad)
        assert time.time() - began < 5, bad[:20]


def test_decoding_is_the_likeliest_choice():
    """Against all sets in which kept nodes have kept parents, on small trees."""
    r = np.random.default_rng(4)
    for _ in range(30):
        tree, n = html_extract.Tree(), 9
        for k in range(1, n):
            tree.add(r.choice(["div", "p", "script"]) if k < 6 else "#text", "", int(r.integers(0, min(k, 6))), "x")
        odds = r.normal(size=n) * 2
        gain = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)

        def worth(kept, tree=tree, gain=gain):
            return sum(gain[0 if kept[k] else 1][k] for k in range(1, len(kept)))

        best = max(
            worth(kept) for kept in itertools.product((False, True), repeat=n)
            if kept[0] and all(kept[tree.parent[k]] and tree.tag[k] != "script" for k in range(1, n) if kept[k])
        )
        assert worth(html_extract.decode(tree, odds)) == pytest.approx(best)


def test_kept_nodes_have_kept_parents():
    model, pages = html_extract.train(), html_extract.Pages(5)
    for _ in range(20):
        tree = html_extract.parse(pages.page()[0])
        kept = html_extract.decode(tree, model.log_odds(html_extract.features(tree)))
        assert all(kept[tree.parent[k]] for k in range(1, len(kept)) if kept[k])


def test_quality(spark, docs, empty):
    good = [(k, prose(80, k)) for k in range(200)]
    bad = [(1000 + k, " ".join(w.upper() + "!!$$" for w in prose(60, k).split())) for k in range(60)]
    frame = spark.createDataFrame([*good, *bad], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good[:120]] + [(d, 0, 0) for d, _ in bad[:40]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.classify(frame, labels).collect()}
    assert sum(got[d] for d, _ in good) >= 198 and sum(got[d] for d, _ in bad) <= 2
    assert {r["doc_id"] for r in quality.Sampler(frame, labels).kept(frame).collect()} == {d for d, k in got.items() if k}
    assert quality.classify(docs, labels.where("1 = 0")).where("kept").count() == len(TEXTS)
    assert quality.classify(empty, labels).count() == 0


def test_quality_against_plain_counting(spark, monkeypatch):
    """Counts, weights and kept rows by plain Python; the length of a run and words longer than any memo change nothing."""
    texts = [prose(r, 40 + r) + " " + "ab1-" * (r % 3 * 30) + " " + "Word Word word" * (r % 2) for r in range(1, 90)]
    texts += [None, "", " \n", "x" * 500 + "1" * 500 + " tail", prose(3000, 9)]

    def scramble(x):
        x = x * 0x9E3779B97F4A7C15 % 2**64
        return ((x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 48) % quality.BUCKETS

    def plain(text):
        out, before = [], None
        for w in (text or "").split():
            word = xxhash.xxh32_intdigest(w.lower().strip(".,;:!?").encode())
            form = re.sub(r"(.)\1+", r"\1", "".join("x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else c for c in w), flags=re.S)
            form = xxhash.xxh32_intdigest(form.encode()) >> 1
            seed = 1 if before is None else before[1] * 3 + 2
            out += [scramble(word), scramble((seed * 0xC2B2AE3D27D4EB4F + form * 2 + (before is not None and before[0] == word)) % 2**64)]
            before = (word, form)
        return out

    want = [sorted(plain(t)) for t in texts]
    for run, piece in ((50_000, 1 << 18), (7, 100), (1, 10)):
        monkeypatch.setattr(quality, "PIECE", piece)
        monkeypatch.setattr(quality.word_lists, "__defaults__", (piece,))
        got = [[] for _ in texts]
        for first, bucket, owner in quality.grams(texts, run=run):
            for b, o in zip(bucket.tolist(), owner.tolist(), strict=True):
                got[first + o].append(b)
        assert [sorted(g) for g in got] == want

    frame = spark.createDataFrame([(k, t, "clash", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, gumbel_key string, log_weight double").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    sampler = quality.Sampler(frame, labels)
    fits = {r["doc_id"] for r in quality.sampled_labels(labels).where("good and fits").collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for k, g in enumerate(want):
        for b in g:
            raw[b] += 1
            target[b] += k in fits
    ratios = np.log((target + 0.5) / (raw * (target.sum() / raw.sum()) + 0.5))
    weight = {k: quality.LENGTH * sum(ratios[b] for b in g) / (len(g) + quality.FILL) for k, g in enumerate(want)}
    rows_ = sampler.decisions().collect()
    assert all(r["log_weight"] == pytest.approx(weight[r["doc_id"]], abs=1e-9) for r in rows_) and len(rows_) == len(texts)
    by_key = sorted(rows_, key=lambda r: -r["gumbel_key"])
    assert {r["doc_id"] for r in rows_ if r["kept"]} == {r["doc_id"] for r in by_key[: sampler.k]}
    kept = sampler.kept(frame)
    assert kept.columns == frame.columns and {(r["doc_id"], r["gumbel_key"], r["log_weight"]) for r in kept.collect()} == {(r["doc_id"], "clash", 1.0) for r in by_key[: sampler.k]}


def test_kth_largest(spark):
    r = random.Random(1)
    values = [r.choice([0.5, r.random(), r.random() * 1e6]) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 700, 3000):
        assert quality.kth_largest(frame, "x", k, bins=16, enough=20) == sorted(values, reverse=True)[k - 1]


def test_sharding(docs, empty):
    names = sharding.shard_names(7)
    owner = sharding.lookup_table(names, 101)
    assert max(owner.count(k) for k in range(7)) - min(owner.count(k) for k in range(7)) <= 1
    taken, turn = {}, 0  # the fill by whole preference lists, claimed in turns
    lists = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(digest[:8], "big") % 101, int.from_bytes(digest[8:16], "big") % 100 + 1
        lists.append([(offset + k * skip) % 101 for k in range(101)])
    while len(taken) < 101:
        taken[next(slot for slot in lists[turn % 7] if slot not in taken)] = turn % 7
        turn += 1
    assert owner == [taken[slot] for slot in range(101)]
    fewer = sharding.lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6) < 35
    got = sharding.place(docs, shards=names, slots=101).collect()
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        assert r["slot"] == (h - (1 << 64) if h >> 63 else h) % 101 and r["shard"] == owner[r["slot"]]
    assert len(got) == len(TEXTS) and sharding.place(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_pipeline(spark, tmp_path):
    made = [(k, prose(80, k), "en", f"s{k % 3}", 0) for k in range(120)] + [(200 + k, prose(80, k).upper(), "en", "s0", 0) for k in range(20)] + [(300 + k, "$$$ !!! " * 30 + str(k), "en", "s1", 0) for k in range(20)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(100)] + [(300 + k, 0, 0) for k in range(16)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, held = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        held[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert not [d for d in held["quality classifier"] if d >= 300]
    assert len(held["exact dedup"]) == len(set(held["exact dedup"])) and set(held["simhash near-dedup"]) <= set(held["exact dedup"])
    assert sorted(held["bpe tokens"]) == sorted(held["source mixing"]) and max(held["source mixing"].count(d) for d in set(held["source mixing"])) <= 2
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(held["bpe tokens"])
