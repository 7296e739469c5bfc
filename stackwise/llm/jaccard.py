"""Operator 9: n-gram Jaccard join by a blocked sparse matrix product.

Documents are rows and word n-grams columns of a sparse incidence matrix X; the overlap of two
documents is an entry of X X^T. The product is never formed whole:

1. *Scan.* Every text becomes its sorted set of n-gram hashes. Equal sets form one class and only
   classes are multiplied. A fixed-size counter array estimates how common each n-gram is.
2. *Prefix block.* Order the n-grams from rare to common (estimate, then hash). Two sets with
   ``overlap >= t * union`` share one of the first ``n - ceil(t n) + 1`` n-grams of each (size-derived
   bound), so only that block of X can make a pair possible.
   Shared n-grams with the same members count once, by the first of them in the order.
3. *Families.* Each shared prefix n-gram names its smallest class as representative; a class that
   looks much like a representative (small signature) joins its family. Families only
   decide where a pair is multiplied, never whether.
4. *Blocks.* Inside a family all rows meet: rows are dealt into blocks and every pair of blocks is one
   cell, so a large family is many bounded cells. Across families a pair must share a prefix n-gram
   and survive the positional bound ``1 + min(rest of a, rest of b)`` and the bound of the size profiles (n-grams
   per hash range); such a pair is a cell of two rows.
5. *Product.* A cell accumulates overlap counts over blocks of columns, drops pairs that the size of
   what is left can no longer lift to the bound, and returns the links as a spanning forest (links
   between documents that the cell has connected already add nothing to the components).
6. *Components* of the links, then of the documents through their class.

No link is lost: the counters, signatures and families affect speed only. All hashes have 64 bits.

Defined cases: null and empty texts (and texts without a word) have 0 n-grams, link with nothing and
are their own component; texts with fewer words than n are one n-gram; repeated rows and repeated ids
are separate documents (one output row each); a null id never is the smallest of a component unless
all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.components import components
from stackwise.llm.shared import arrow_batch, counter_rows, merged_counters, ship, written

COUNTERS = 1 << 19      # n-gram frequency estimate: 2 MiB, whatever the input
FILTER_BITS = 1 << 26   # filters of shared n-grams and of classes that need their sets: 8 MiB each, whatever the input
SIGNATURE = 32          # bytes of the one-permutation signature
ALIKE = 0.4             # share of equal signature bytes from which a class joins a family
CELL_ROWS = 256         # rows of a block
CELL_NGRAMS = 1 << 19   # n-grams of a block, on average
COLUMNS = 4096          # columns multiplied at a time
PRIME = (1 << 31) - 1   # sums of so small hashes hold up to 2**32 members
FAMILY_SALTS = 16       # tasks that share the members of a family

PER_RANGE = 2           # n-grams per hash range of the size profile, about

_MARKS = [f"m{i}" for i in range(SIGNATURE // 8)]
_SCAN = f"cls long, n long, {', '.join(f'{m} long' for m in _MARKS)}, profile binary, chunk int, blob binary"


def _texts(batches, k: int):
    """(row range, list of n-gram sets) for runs of rows."""
    for batch in batches:
        for lo, hi, data, offsets in TS.text_slices(batch.column(batch.num_columns - 1)):
            _, _, hashes, first = TS.scan_words(data, offsets, TS.SPACES)
            yield batch, lo, hi, list(TS.shingle_sets(hashes, first, k))


def _class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


_EDGES = (np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(64 - 5))


def _signature(s: np.ndarray) -> np.ndarray:
    """One byte from the smallest n-gram of each of 32 hash ranges; 0 for an empty range."""
    at = np.searchsorted(s, _EDGES)
    nxt = np.append(at[1:], len(s))
    out = np.zeros(SIGNATURE, dtype=np.uint8)
    full = nxt > at
    out[full] = (s[at[full]] & np.uint64(0xFF)).astype(np.uint8) % np.uint8(255) + np.uint8(1)
    return out.view(np.int64)


def _profile(s: np.ndarray) -> bytes:
    """How many n-grams fall into each hash range (at most 255 is told); a power of two of ranges."""
    bits = max(0, (len(s) // PER_RANGE).bit_length() - 1)
    at = (s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), dtype=np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many n-grams only one of two sets has, from their profiles."""
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (a, b))
    if (x == 255).any() or (y == 255).any():
        return 0
    m = min(len(x), len(y))
    return int(np.abs(x.reshape(m, -1).sum(axis=1) - y.reshape(m, -1).sum(axis=1)).sum())


def _counter_of(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(7)) % np.uint64(COUNTERS)).astype(np.int64)


def _scan(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ship(docs)

    def run(batches):
        counts = np.zeros(COUNTERS, dtype=np.int32)
        schema = id_arrow = None
        for batch, lo, hi, sets in _texts(batches, k):
            if schema is None:
                id_arrow = batch.schema.field(0).type
                schema = pa.schema([("doc_id", id_arrow), ("cls", pa.int64()), ("n", pa.int64()), *((m, pa.int64()) for m in _MARKS), ("profile", pa.binary()),
                                    ("chunk", pa.int32()), ("blob", pa.binary())])
            sig = np.array([_signature(s) for s in sets], dtype=np.int64)
            for s in sets:
                np.add.at(counts, _counter_of(s), 1)
            m = hi - lo
            arrays = [batch.column(0).slice(lo, m), pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64()),
                      pa.array([len(s) for s in sets], pa.int64()), *(pa.array(sig[:, i]) for i in range(len(_MARKS))), pa.array([_profile(s) for s in sets], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if schema is not None:
            rows = counter_rows(counts)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), id_arrow), *(pa.nulls(len(rows), pa.int64()) for _ in range(2 + len(_MARKS))), pa.nulls(len(rows), pa.binary()),
                                                  pa.array([c for c, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], schema=schema)

    return written(src.mapInArrow(run, f"doc_id {id_type.simpleString()}, {_SCAN}"), "ngram-scan")


def prefix_length(n: int, percent: int) -> int:
    """How many of n ordered n-grams can hold the first one that two linked sets share."""
    return n - -(-percent * n // 100) + 1


def _prefixes(docs: DataFrame, text_col: str, k: int, percent: int, counters) -> DataFrame:
    src = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        counts = counters.value
        schema = pa.schema([("g", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
        seen = set()
        for _, _, _, sets in _texts(batches, k):
            cols = [[], [], [], []]
            for s in sets:
                if not len(s) or (c := _class_id(s)) in seen:
                    continue
                seen.add(c)
                p = prefix_length(len(s), percent)
                head = s[np.argsort(counts[_counter_of(s)], kind="stable")[:p]]  # s is sorted: ties by hash
                for col, v in zip(cols, (head.view(np.int64), np.full(p, c), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32))):
                    col.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(cols, schema)], schema=schema)

    return written(src.mapInArrow(run, "g long, cls long, n int, pos int"), "ngram-prefix")


def _bit(values: np.ndarray) -> np.ndarray:
    return (TS.mix64(values.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _bits_of(rows: DataFrame, col: str) -> np.ndarray:
    """Fixed-size filter of the values of a long column (may let others through, loses none)."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for b in batches:
            at = _bit(np.asarray(b.column(0)))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        filled = counter_rows(bits)
        if filled:
            yield arrow_batch({"chunk": [c for c, _ in filled], "blob": [x for _, x in filled]}, pa.schema([("chunk", pa.int32()), ("blob", pa.binary())]))

    return merged_counters(rows.select(col).mapInArrow(run, "chunk int, blob binary"), FILTER_BITS // 8, np.uint8, "or")


def _filtered(postings: DataFrame, bits: np.ndarray) -> DataFrame:
    sent = postings.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = sent.value
        for b in batches:
            at = _bit(np.asarray(b.column(0)))
            yield b.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return postings.select("g", "cls", "n", "pos").mapInArrow(run, "g long, cls long, n int, pos int")


def _alike(pairs: DataFrame) -> DataFrame:
    """Pairs (cls, rep) whose signatures agree in ALIKE of the ranges that either fills."""

    def run(batches):
        for b in batches:
            a, r = (np.stack([np.asarray(b.column(f"{p}{i}")) for i in range(4)], axis=1).view(np.uint8) for p in ("m", "r"))
            used = ((a > 0) | (r > 0)).sum(axis=1)
            same = ((a == r) & (a > 0)).sum(axis=1)
            yield b.select(["cls", "rep"]).filter(pa.array(same >= ALIKE * used))

    return pairs.mapInArrow(run, "cls long, rep long")


def _possible(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (k1, k2) that their size profiles leave possible."""
    pairs = written(pairs, "ngram-pairs")
    keys = pairs.select(F.explode(F.array("k1", "k2")).alias("cls")).distinct()
    profiles = rows.select("cls", "n", "profile").join(keys, "cls").dropDuplicates(["cls"])
    side = lambda k: profiles.select(F.col("cls").alias(f"k{k}"), F.col("n").alias(f"n{k}"), F.col("profile").alias(f"p{k}"))

    def run(batches):
        for b in batches:
            total = np.asarray(b.column("n1")) + np.asarray(b.column("n2"))
            apart = np.array([least_difference(x, y) for x, y in zip(b.column("p1").to_pylist(), b.column("p2").to_pylist())], dtype=np.int64)
            overlap = (total - apart) // 2
            yield b.select(["k1", "k2"]).filter(pa.array(100 * overlap >= percent * (total - overlap)))

    return pairs.join(side(1), "k1").join(side(2), "k2").select("k1", "k2", "n1", "n2", "p1", "p2").mapInArrow(run, "k1 long, k2 long")


def _cells(postings: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(cls, k1, k2, side): which rows meet in which cell."""
    # lists of the same members say the same; the one that comes first in the order bounds each of their pairs best
    mark = F.xxhash64("cls")
    lists = postings.groupBy("g").agg(F.min("cls").alias("rep"), F.max("cls").alias("other"), F.count("*").alias("m"), F.min("pos").alias("pos"),
                                      *(F.sum(F.pmod(F.shiftrightunsigned(mark, k), F.lit(PRIME))).alias(f"h{k}") for k in (0, 20))).filter("rep <> other")
    lists = written(lists.groupBy("rep", "other", "m", "h0", "h20").agg(F.min(F.struct("pos", "g"))["g"].alias("g")).select("g", "rep"), "ngram-lists")
    # most n-grams of a prefix are in no list; a fixed-size filter spares those the shuffle
    shared = written(_filtered(postings, _bits_of(lists, "g")).join(lists, "g"), "ngram-shared")
    sig = [f"m{i}" for i in range(4)]
    looks = shared.filter("cls <> rep").select("cls", "rep").distinct().join(classes.select("cls", *sig), "cls").join(
        classes.select(F.col("cls").alias("rep"), *(F.col(m).alias(f"r{m[1:]}") for m in sig)), "rep")
    family = written(_alike(looks).groupBy("cls").agg(F.min("rep").alias("fam")), "ngram-family")
    main = family.select(F.col("cls").alias("rep"), F.col("fam").alias("rep_fam"))
    placed = written(shared.join(family, "cls", "left").join(main, "rep", "left").select(
        "g", "cls", "n", "pos", F.coalesce("fam", "cls").alias("fam"), F.coalesce("rep_fam", "rep").alias("main")), "ngram-placed")

    # across families: one side outside the list's main family, so a large family never meets itself here
    o, c = placed.filter("fam <> main").alias("o"), placed.alias("c")
    need = F.ceil(F.lit(percent) * (F.col("o.n") + F.col("c.n")) / F.lit(100 + percent))
    across = o.join(c, (F.col("o.g") == F.col("c.g")) & (F.col("o.fam") != F.col("c.fam"))
                    & ((F.col("c.fam") == F.col("c.main")) | (F.col("o.cls") < F.col("c.cls")))
                    & (100 * F.least("o.n", "c.n") >= percent * F.greatest("o.n", "c.n"))
                    & (1 + F.least(F.col("o.n") - F.col("o.pos") - 1, F.col("c.n") - F.col("c.pos") - 1) >= need))
    pair = across.select(F.least("o.cls", "c.cls").alias("k1"), F.greatest("o.cls", "c.cls").alias("k2")).distinct()
    pair = _possible(pair, rows, percent)
    two = pair.select(F.explode(F.array("k1", "k2")).alias("cls"), "k1", "k2", F.lit(-1).alias("cell"), F.lit(0).alias("side"))

    # inside families: every block meets every block
    member = placed.select("cls", "n", "fam").distinct()
    size = member.groupBy("fam").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")).filter("rows > 1").select(
        "fam", F.greatest(F.ceil(F.col("rows") / CELL_ROWS), F.ceil(F.col("grams") / CELL_NGRAMS)).cast("int").alias("nb"))
    salts = F.sequence(F.lit(0), F.lit(FAMILY_SALTS - 1))
    block = member.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(FAMILY_SALTS)).cast("int")).join(
        size.withColumn("salt", F.explode(salts)), ["fam", "salt"]).withColumn("b", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    met = block.select("cls", F.col("fam").alias("k1"), "nb", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("x"))
    cell = met.select("cls", "k1", F.lit(0).cast("long").alias("k2"), (F.least("b", "x").cast("long") * F.col("nb") + F.greatest("b", "x")).alias("cell"),
                      F.when(F.col("b") == F.col("x"), 0).when(F.col("b") < F.col("x"), 1).otherwise(2).alias("side"))
    return written(two.select("cls", "k1", "k2", F.col("cell").cast("long").alias("cell"), "side").union(cell), "ngram-cells")


def _sets(docs: DataFrame, text_col: str, k: int, wanted) -> DataFrame:
    src = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bits = wanted.value
        seen = set()
        schema = pa.schema([("cls", pa.int64()), ("grams", pa.binary())])
        for _, _, _, sets in _texts(batches, k):
            ids, blobs = [], []
            for s in sets:
                if not len(s) or (c := _class_id(s)) in seen:
                    continue
                at = int(_bit(np.array([c], dtype=np.int64))[0])
                if bits[at >> 3] >> (at & 7) & 1:
                    seen.add(c)
                    ids.append(c)
                    blobs.append(s.tobytes())
            if ids:
                yield arrow_batch({"cls": ids, "grams": blobs}, schema)

    return src.mapInArrow(run, "cls long, grams binary").dropDuplicates(["cls"])


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the rows of a cell (side 0: all pairs; 1 and 2: pairs between the sides), as a spanning forest."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size[0] + size[1] - both) else []
    left, right = (np.arange(len(sets)),) * 2 if (side == 0).all() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    if not len(left) or not len(right):
        return []
    grams, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    keep = times[col] > 1  # a column with one entry adds to no overlap
    row, col = row[keep], (np.cumsum(times > 1) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = size[left][:, None] + size[right][None, :]
    rest = np.bincount(row, minlength=len(sets))
    open_ = 100 * np.minimum(size[left][:, None], size[right][None, :]) >= percent * np.maximum(size[left][:, None], size[right][None, :])
    if left is right:
        open_ &= np.triu(np.ones_like(open_), 1)
    overlap = np.zeros(open_.shape, dtype=np.float64)
    for c0 in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, (c0, c0 + COLUMNS))
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[row[a:b], col[a:b] - c0] = 1
        overlap += x[left] @ x[right].T
        rest = rest - np.bincount(row[a:b], minlength=len(sets))
        most = overlap + np.minimum(rest[left][:, None], rest[right][None, :])
        open_ &= 100 * most >= percent * (total - most)
        if not open_.any():
            return []
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in np.argwhere(open_ & (100 * overlap >= percent * (total - overlap))).tolist():
        i, j = int(left[i]), int(right[j])
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _products(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    key = ["k1", "k2", "cell"]
    dealt = cells.join(sets, "cls").repartition(*key).sortWithinPartitions(*key, "cls").select(*key, "side", "cls", "grams")

    def run(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def links(rows):
            sets_ = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
            return [(rows[i][1], rows[j][1]) for i, j in linked_pairs(sets_, np.array([r[0] for r in rows]), percent)]

        now, rows, out = None, [], []
        for b in batches:
            for k1, k2, cell, side, cls, grams in zip(*(c.to_pylist() for c in b.columns)):
                if (k1, k2, cell) != now:
                    out += links(rows) if len(rows) > 1 else []
                    now, rows = (k1, k2, cell), []
                rows.append((side, cls, grams))
            if len(out) > 10000:
                yield arrow_batch({"u": [a for a, _ in out], "v": [b_ for _, b_ in out]}, schema)
                out = []
        out += links(rows) if len(rows) > 1 else []
        if out:
            yield arrow_batch({"u": [a for a, _ in out], "v": [b_ for _, b_ in out]}, schema)

    return dealt.mapInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (equal sets share it), component_id (smallest id reachable).

    Two documents link when ``100 * overlap >= percent * union`` of their distinct ``words``-word shingles.
    """
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("percent must be in 1..100 and words at least 1")
    sc = docs.sparkSession.sparkContext
    scan = _scan(docs, id_col, text_col, words)
    rows = scan.filter("chunk is null").drop("chunk", "blob")
    counters = sc.broadcast(merged_counters(scan.filter("chunk is not null"), COUNTERS, np.int32))
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), *(F.first(m).alias(m) for m in _MARKS))
    postings = _prefixes(docs, text_col, words, percent, counters)
    cells = _cells(postings, classes, rows, percent)
    wanted = sc.broadcast(_bits_of(cells.select("cls").distinct(), "cls"))
    links = _products(cells, _sets(docs, text_col, words, wanted), percent)
    labels = components(links)
    counters.destroy()
    wanted.destroy()
    label = F.coalesce("label", "cls")
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least_id", label.alias("label"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    component = named.join(least, "label").select("cls", "component_id")
    return rows.join(component, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"),
                                                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
