"""SimHash near-dedup with bit-sliced comparison.

A fingerprint is 64 bits, each the majority over the XXH64 hashes of the text's word shingles.
Equal fingerprints collapse to one before any comparison. For radius r the bits are cut into
r + 2 blocks: two fingerprints within the radius agree on at least two of them, so every link is
found among the rows that agree on some two blocks (about 26 bits for r = 3). Inside such a bucket
``bitslice`` compares all rows. A bucket above ``LIMIT`` rows is dealt again by further bits, by
the same argument: of the bits left, cut into 2r blocks, r must agree. A second bucket shares so
many bits (45 for r = 3) that it holds at most 2**19 distinct fingerprints. No link is dropped.

``deduplicate`` keeps one document of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.llm.bitslice import BITS, spanning_links
from aislewise.llm.common import ship, text_or_empty, unwrapped, wrapped
from aislewise.llm.components import components
from aislewise.llm.shingles import key_runs
from aislewise.session import stored

RADIUS = 3       # differing bits of a link, at most
SHINGLE = 3      # words
SEED = 42
LIMIT = 20_000   # rows of a bucket compared at once; larger ones are dealt again
CHUNK = 1 << 15  # shingles hashed at a time


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number; no word gives zero."""
    words = raw.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, total, CHUNK):
        part = words[start:start + CHUNK + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if total > 1 else [words]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: Column, name: str = "fingerprint",
                     shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint as long. Null texts count as empty."""

    ship(df.sparkSession)

    @F.pandas_udf("long")
    def hashed(texts):
        return texts.map(lambda raw: fingerprint(raw, shingle))

    return df.withColumn(name, hashed(text_or_empty(text).cast("binary")))


def _blocks(bits: list[int], count: int) -> list[int]:
    """The given bit positions cut into ``count`` masks of nearly equal size."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, count)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks(radius: int) -> list[int]:
    return [a | b for a, b in combinations(_blocks(list(range(BITS)), radius + 2), 2)]


def second_masks(radius: int) -> list[list[int]]:
    """For every first mask, that mask joined with each choice of ``radius`` further blocks."""
    out = []
    for mask in first_masks(radius):
        rest = _blocks([b for b in range(BITS) if not mask >> b & 1], 2 * radius)
        out.append([mask | sum(chosen) for chosen in combinations(rest, radius)]
                   if radius else [mask])
    return out


def _dealt(rows: DataFrame, masks: Column) -> DataFrame:
    """(fp, table) to (place, bucket, fp): one row per mask; masks: array<struct<place, mask>>."""
    return (rows.select("fp", F.explode(masks).alias("m"))
            .select("m.place", F.col("fp").bitwiseAND(F.col("m.mask")).alias("bucket"), "fp"))


def _masks(masks: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("place"), F.lit(_signed(m)).cast("long").alias("mask"))
                     for p, m in masks])


def _linked(dealt: DataFrame, radius: int, limit: int | None) -> DataFrame:
    """(a, b, place): links with place null; the rows of buckets above the limit have b null."""

    def out(a, b, place):
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(place, pa.int32())],
            names=["a", "b", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in key_runs(batches, 2):
            place, fp = table.column("place").to_numpy(), table.column("fp").to_numpy()
            sizes = np.diff(starts)
            large = sizes > limit if limit else np.zeros(len(sizes), bool)
            for k in np.nonzero(large)[0]:
                part = slice(starts[k], starts[k + 1])
                yield out(fp[part], [None] * sizes[k], place[part])
            kept = fp[np.repeat(~large, sizes)]
            first, second = spanning_links(np.r_[0, np.cumsum(sizes[~large])].astype(np.int64),
                                           kept.view(np.uint64), radius)
            if len(first):
                yield out(kept[first], kept[second], [None] * len(first))

    ship(dealt.sparkSession)
    ordered = dealt.repartition("place", "bucket").sortWithinPartitions("place", "bucket")
    return ordered.mapInArrow(run, "a long, b long, place int")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect all within the radius."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    first = stored(_linked(_dealt(fps.select("fp"), _masks(list(enumerate(first_masks(radius))))),
                           radius, limit))
    links = first.where("b IS NOT NULL").select("a", "b")
    again = first.where("b IS NULL").select(F.col("a").alias("fp"), "place")
    choices = second_masks(radius)
    width = len(choices[0])
    further = F.get(F.array(*[_masks([(t * width + k, m) for k, m in enumerate(masks)])
                              for t, masks in enumerate(choices)]), F.col("place"))
    return links.unionByName(_linked(_dealt(again, further), radius, None).select("a", "b"))


def classes(tagged: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(id, fp) to one row per fingerprint: fp, root (smallest linked fingerprint),
    component_id (smallest id of the class), representative (the fingerprint to keep)."""
    fps = stored(tagged.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = components(fingerprint_links(fps, radius, limit))
    rooted = stored(fps.join(roots, fps.fp == roots.node, "left")
                    .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    best = (rooted.groupBy("root").agg(F.min(F.struct(
        F.col("first_id").isNull().alias("none"), F.col("first_id"), F.col("fp"))).alias("best"))
            .select("root", F.col("best.first_id").alias("component_id"),
                    F.col("best.fp").alias("representative")))
    return rooted.join(best, "root").select("fp", "root", "component_id", "representative")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    radius: int = RADIUS, shingle: int = SHINGLE,
                    limit: int = LIMIT) -> DataFrame:
    """One row per document: id, fp (long), component_id, the smallest id it can reach.

    Null texts count as empty and empty texts have fingerprint zero, linked like any other. A
    null id is never the smallest unless a class has no other. Repeated rows all stay. An empty
    table gives an empty result; other columns are ignored.
    """
    tagged = stored(with_fingerprint(docs.select(F.col(id_column).alias("id"),
                                                 F.col(text_column).alias("text")),
                                     F.col("text"), "fp", shingle).select("id", "fp"))
    found = classes(tagged, radius, limit)
    return tagged.join(found, "fp").select("id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                radius: int = RADIUS, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns: that with the
    smallest id.

    A null id loses against any other. Of rows that repeat an id and a text, one stays; of other
    rows that repeat the smallest id, the one with the smallest fingerprint, then text hash. Null
    texts count as empty. Fingerprints are computed once; the rows meet the kept ones by id and a
    hash of the text, so copies of a text are spread by their ids.
    """
    text = text_or_empty(F.col(text_column))
    named = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    tagged = stored(with_fingerprint(named.withColumn("h", F.xxhash64("text")), F.col("text"), "fp",
                                     shingle).select("id", "fp", "h"))
    best = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "h")
    kept = (tagged.join(classes(tagged.select("id", "fp"), radius, limit).select("fp", "root"), "fp")
            .groupBy("root").agg(F.min(best).alias("best")).select("best.id", "best.h"))
    rows = wrapped(docs).select("row", F.col(f"row.`{id_column}`").alias("id"),
                                F.xxhash64(text_or_empty(F.col(f"row.`{text_column}`"))).alias("h"))
    mine = rows.alias("r").join(kept.alias("k"), (F.col("r.h") == F.col("k.h"))
                                & F.col("r.id").eqNullSafe(F.col("k.id")), "left_semi")
    one = Window.partitionBy("h", "id").orderBy(F.lit(1))
    return unwrapped(mine.withColumn("place", F.row_number().over(one)).where("place = 1"),
                     docs.columns)
