"""Operator 12: exact duplicates by content-defined chunk recipes.

Texts are normalised (each run of white space becomes one space) and cut where a rolling hash of the last 32
bytes has a pattern, so equal stretches of text give equal chunks wherever they lie. A text is then a
recipe: the ordered list of its chunks' identifiers.

1. *Recipes.* One pass writes row number, id, SHA-256 of the normalised text and the recipe; texts stay where they are.
2. *Store.* A second pass emits chunks, which are deduplicated by digest *and bytes*: within a slice, within a
   task, and after one shuffle, in which every different chunk moves once per task at most. An identifier is the digest
   and an ordinal among the chunks of that digest, so it is verified: equal identifiers are equal bytes. Digests of
   128 bits do not clash in practice; where they do, recipes are rebuilt by a join on digest and bytes.
3. *Comparison.* Rows are grouped by recipe (whole lists as keys). Equal recipes are equal texts, as chunks are
   cut by content alone. The group's smallest id stays; its size and id go back to the rows by a join on the recipe.

Copies of long texts thus meet as lists of 20 bytes per chunk of about 1 KiB. Grouping adds up in the tasks first;
the join back is one row per group against the rows, and rows of large groups are dealt by a salt.

Defined cases: null is the empty text (an empty recipe); repeated rows and ids are rows of their own, of
which one stays; null ids come last and never keep a group that has others; texts of any length are cut whole, in pieces; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackwise.llm import textscan as TS
from stackwise.llm.shared import ship, written

WINDOW = 32            # bytes that decide a cut
SMALLEST, LARGEST = 256, 8192
PATTERN = (1 << 10) - 1
PIECE = 1 << 20        # bytes whose rolling hashes are held at a time
DIGEST_BITS = 128
HOT, SALTS = 1024, 64

_GEAR = (TS.mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each run of white space as one space; runs do not reach over texts."""
    space = TS.SPACES[data]
    again = np.zeros(len(data), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    again[starts] = False
    out = np.where(space, np.uint8(0x20), data)[~again]
    gone = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(again, out=gone[1:])
    return out, offsets - gone[offsets]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last 32 bytes has the pattern (only those with 32 bytes before them hold)."""
    found = []
    for lo in range(0, len(data), PIECE):
        head = max(0, lo - WINDOW + 1)
        h = _GEAR[data[head:lo + PIECE]]
        for width in (1, 2, 4, 8, 16):  # hash of 2 * width bytes from two of width
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        at = np.flatnonzero((h >> np.uint32(32 - PATTERN.bit_length())) == 0) + head + 1
        found.append(at[at > lo])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cut_points(cuts: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of a text: the first cut beyond the smallest size, or the largest size."""
    out, i = [], 0
    while start < end:
        i = bisect_left(cuts, start + SMALLEST, i)
        stop = cuts[i] if i < len(cuts) else end
        start = min(stop, start + LARGEST, end)
        out.append(start)
    return out


def _digest(chunk, bits: int) -> bytes:
    raw = xxhash.xxh3_128_digest(chunk)
    return raw if bits == 128 else (int.from_bytes(raw, "big") & ((1 << bits) - 1)).to_bytes(16, "big")


def _sliced(column: pa.Array):
    """(first row, normalised texts, list of chunk ends per text) of a column, slice by slice."""
    for lo, hi, data, offsets in TS.text_slices(column):
        data, offsets = normalised(data, offsets)
        cuts = _cuts(data)
        first = np.searchsorted(cuts, offsets, side="right").tolist()
        cuts, ends = cuts.tolist(), offsets.tolist()
        yield lo, memoryview(np.ascontiguousarray(data)), ends, [cut_points(cuts[a:b], s, e) for a, b, s, e in zip(first, first[1:], ends, ends[1:])]


def _chunks(data: memoryview, start: int, ends: list[int]):
    for end in ends:
        yield data[start:end]
        start = end


def chunk_recipes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = DIGEST_BITS) -> DataFrame:
    """row, doc_id, text_sha256, recipe (16 bytes of digest and 4 of ordinal per chunk): one row per row of ``docs``, written."""
    ship(docs)
    id_type = docs.schema[id_col].dataType

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("row", pa.int64()), ("doc_id", batch.schema.field(0).type), ("text_sha256", pa.string()), ("recipe", pa.binary())])
            for lo, data, offsets, ends in _sliced(batch.column(1)):
                sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])]
                recipe = [b"".join(_digest(c, digest_bits) + b"\0\0\0\0" for c in _chunks(data, a, e)) for a, e in zip(offsets, ends)]
                rows = np.arange(row, row + len(sha))
                row += len(sha)
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0).slice(lo, len(sha)), pa.array(sha), pa.array(recipe, pa.binary())], schema=schema)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(src.mapInArrow(run, f"row long, doc_id {id_type.simpleString()}, text_sha256 string, recipe binary"), "recipes")


def chunk_store(docs: DataFrame, *, text_col: str = "text", digest_bits: int = DIGEST_BITS) -> DataFrame:
    """digest, chunk, uses: every different chunk once."""
    ship(docs)
    schema = pa.schema([("digest", pa.binary()), ("chunk", pa.binary()), ("uses", pa.int64())])

    def run(batches):
        for batch in batches:
            for _, data, offsets, ends in _sliced(batch.column(0)):
                seen: dict[tuple, int] = {}
                for a, e in zip(offsets, ends):
                    for c in _chunks(data, a, e):
                        key = (_digest(c, digest_bits), bytes(c))
                        seen[key] = seen.get(key, 0) + 1
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                                     schema=schema)

    src = docs.select(F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "digest binary, chunk binary, uses long").groupBy("digest", "chunk").agg(F.sum("uses").alias("uses"))


def _ordinals(docs: DataFrame, clashing: DataFrame, store: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """Recipes where chunks of a clashing digest carry their ordinal: every chunk meets the store by digest and bytes."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("row", pa.int64()), ("doc_id", batch.schema.field(0).type), ("text_sha256", pa.string()), ("at", pa.int32()),
                                          ("digest", pa.binary()), ("chunk", pa.binary())])
            for lo, data, offsets, ends in _sliced(batch.column(1)):
                ids = batch.column(0).slice(lo, len(ends)).to_pylist()
                out = []
                for doc_id, a, b, e in zip(ids, offsets, offsets[1:], ends):
                    out.append((row, doc_id, hashlib.sha256(data[a:b]).hexdigest(), None, None, None))
                    out += [(row, None, None, at, _digest(c, digest_bits), bytes(c)) for at, c in enumerate(_chunks(data, a, e))]
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = written(src.mapInArrow(run, f"row long, doc_id {id_type.simpleString()}, text_sha256 string, at int, digest binary, chunk binary"), "recipe-parts")
    number = (F.row_number().over(Window.partitionBy("digest").orderBy("chunk")) - 1).alias("ordinal")
    numbered = store.join(clashing, "digest", "left_semi").select("digest", "chunk", number)
    ident = F.concat(F.hex("digest"), F.lpad(F.hex(F.coalesce("ordinal", F.lit(0))), 8, "0")).alias("ident")
    lists = parts.filter("at IS NOT NULL").join(numbered, ["digest", "chunk"], "left").select("row", "at", ident).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "ident"))).alias("ids"))
    recipe = lists.select("row", F.unhex(F.array_join(F.col("ids.ident"), "")).alias("recipe"))
    return written(parts.filter("at IS NULL").join(recipe, "row", "left").select("row", "doc_id", "text_sha256", F.coalesce("recipe", F.lit(b"")).alias("recipe")), "recipes")


def verified_recipes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = DIGEST_BITS) -> DataFrame:
    """:func:`chunk_recipes` with verified identifiers: equal recipes are equal normalised texts, and others are not."""
    recipes = chunk_recipes(docs, id_col=id_col, text_col=text_col, digest_bits=digest_bits)
    store = chunk_store(docs, text_col=text_col, digest_bits=digest_bits)
    clashing = written(store.groupBy("digest").agg(F.count("*").alias("chunks")).filter("chunks > 1").select("digest"), "clashing-digests")
    return recipes if clashing.isEmpty() else _ordinals(docs, clashing, store, id_col, text_col, digest_bits)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = DIGEST_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    recipes = verified_recipes(docs, id_col=id_col, text_col=text_col, digest_bits=digest_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = written(recipes.groupBy("recipe").agg(first, F.count("*").alias("copies")).filter("copies > 1"), "copy-groups")
    # at most HOT groups hold more than one in HOT of all rows; their rows are dealt over SALTS tasks
    mark = F.xxhash64("recipe")
    hot = [r["mark"] for r in groups.filter(F.col("copies") * HOT > recipes.count()).select(mark.alias("mark")).collect()]
    groups = groups.withColumn("salt", F.explode(F.when(mark.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    dealt = recipes.withColumn("salt", F.when(mark.isin(hot), F.col("row") % SALTS).otherwise(0).cast("int"))
    out = dealt.join(groups, ["recipe", "salt"], "left")
    alone = F.col("copies").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("row") == F.col("first.row"))).alias("kept"), "text_sha256")
