"""Substring dedup by paragraph MinHash banding.

A paragraph is a short run of whole sentences whose limits depend on the sentences alone: it ends
after a sentence whose hash is larger than the next one's. So a passage is cut alike wherever it
stands, also in the middle of a line. Each paragraph of at least ``WORDS`` words has a MinHash
signature over its five-word shingles, in ``BANDS`` bands of ``ROWS``: paragraphs of similarity 0.8
share a band with probability 0.98. Paragraphs that share a band and differ are verified by the
exact Jaccard similarity of their shingles; links are closed to components. Of a component's
paragraphs the first, by document and place, stays.

Exact repeats do not depend on that cut: every run of ``RUN`` words that stands earlier in the corpus
goes, wherever it begins. Of each ``RUN`` words the smallest hash of ``GRAM`` words is an anchor, so
equal runs share one; only runs around an anchor that occurs twice are listed and compared.

Where the words that would go are at least ``PASSAGE`` on end, they are a removal. A paragraph too
short to be compared goes with its neighbour only if the kept text has the same one at that place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.llm.common import (give_back, joined_batches, map_batches, ship, text_or_empty,
                                  unwrapped, wrapped)
from aislewise.llm.components import components
from aislewise.llm.jaccard import verified_links
from aislewise.llm.shingles import (key_runs, mixed, permutations, run_hashes, signed,
                                    word_hashes, word_spans)
from aislewise.session import released, stored

WORDS = 8            # of a paragraph that is compared
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 4, 2
PASSAGE = 20         # words of a removal, at least
RUN = 50             # words on end whose exact repeat goes, whatever the paragraphs
GRAM = 25            # words of an anchor
GATHERED = 1 << 19   # later runs that a task gathers by document at a time, about
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Cut:
    """The paragraphs of one text: byte spans, words, digests, and their words' hashes."""

    def __init__(self, raw: bytes):
        raw = raw.lower()
        starts, ends = word_spans(raw)
        self.hashes = word_hashes(raw, starts, ends)
        if not len(starts):
            self.first = self.stop = self.begin = self.end = self.digest = np.zeros(0, np.int64)
            return
        data = np.frombuffer(raw, np.uint8)
        closing = _ENDS[data[ends - 1]]
        before = np.searchsorted(starts, np.flatnonzero(data == 10))  # words before each line end
        closing[before[before > 0] - 1] = True
        closing[-1] = True
        last = np.flatnonzero(closing)
        sentence = np.zeros_like(last)                 # first word of each sentence
        sentence[1:] = last[:-1] + 1
        value = mixed(np.add.reduceat(self.hashes, sentence))
        new = np.ones(len(value), dtype=bool)
        np.greater(value[:-1], value[1:], out=new[1:])
        self.first = sentence[new]
        self.stop = np.r_[self.first[1:], len(starts)]
        self.begin, self.end = starts[self.first], ends[self.stop - 1]
        place = np.arange(len(starts), dtype=np.uint64)
        place -= np.repeat(self.first.astype(np.uint64), self.stop - self.first)
        place *= _STEP
        place += self.hashes
        self.digest = signed(mixed(np.add.reduceat(mixed(place), self.first)))


def _shingled(cut: Cut, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes inside the chosen paragraphs, one after another, and where each begins."""
    every = run_hashes(cut.hashes, SHINGLE)
    sizes = cut.stop[chosen] - cut.first[chosen] - SHINGLE + 1
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    return every[np.repeat(cut.first[chosen], sizes) + inside], starts


def paragraphs(docs: DataFrame, words: int = WORDS, bands: int = BANDS,
               rows: int = ROWS) -> DataFrame:
    """(id, text) to all its paragraphs: id, place, first, stop (words), digest, bands (array of
    long, empty for those below ``words``, which are not compared)."""
    factors, offsets = permutations(bands * rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, columns, keys, counts = [], [[] for _ in range(4)], [], []
        for k, raw in enumerate(batch.column(1).to_pylist()):
            cut = Cut(raw)
            if not len(cut.first):
                continue
            long = cut.stop - cut.first >= words
            chosen = np.nonzero(long)[0]
            if len(chosen):
                shingles, starts = _shingled(cut, chosen)
                # The shingles are mixed, so a product and a sum order them anew.
                low = np.stack([np.minimum.reduceat(shingles * f + o, starts)
                                for f, o in zip(factors, offsets, strict=True)])
                band = np.zeros((bands, len(chosen)), dtype=np.uint64)
                for p in range(rows):
                    band = mixed(band + low[p::rows])
                keys.append(signed(np.ascontiguousarray(band.T)).ravel())
            row.append(np.full(len(long), k))
            counts.append(long * bands)
            for held, part in zip(columns, (np.arange(len(long)), cut.first, cut.stop, cut.digest),
                                  strict=True):
                held.append(part)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        ends = np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, np.int64)
        ids = batch.column(0).take(pa.array(np.concatenate(row) if row else [], pa.int64()))
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c.astype(np.int64)) for c in flat), pa.ListArray.from_arrays(
                pa.array(np.r_[0, ends].astype(np.int32)), pa.array(key))],
            names=["id", "place", "first", "stop", "digest", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", text_or_empty("text").cast("binary").alias("text")), run,
                       f"id {kind}, place long, first long, stop long, digest long, "
                       "bands array<long>", 256)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values on end."""
    span = 1
    while span * 2 <= width:
        values, span = pick(values[:-span], values[span:]), span * 2
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, size: int = RUN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of a text's words, and which of them are the smallest of some ``size``
    words on end; none for a text below ``size`` words."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    grams, width = run_hashes(hashes, gram), size - gram + 1
    pad = np.zeros(width - 1, np.uint64)
    top = _sliding(np.r_[pad, _sliding(grams, width, np.minimum), pad], width, np.maximum)
    return grams, grams == top


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = raw.lower()
    starts, ends = word_spans(raw)
    return word_hashes(raw, starts, ends), starts, ends


def _anchored(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(id, text) to the anchors of each text: id, anchors (array of long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for raw in batch.column(1).to_pylist():
            grams, chosen = anchors(_hashed(raw)[0], size, gram)
            found.append(signed(grams[chosen]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)),
                pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))],
            names=["id", "anchors"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, run, f"id {kind}, anchors array<long>", 256)


def _listed(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(id, text, known) to every run of ``size`` words around a known anchor: run (its hash), the
    fields of its id (id0, id1, ...), first (its first word)."""
    width = size - gram + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, runs, first = [], [], []
        for k, (raw, known) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2),
                                             strict=True)):
            hashes = _hashed(raw)[0]
            if len(hashes) < size:
                continue
            hit = np.isin(signed(run_hashes(hashes, gram)), known.values.to_numpy())
            upto = np.r_[0, np.cumsum(hit)]
            at = np.nonzero(upto[width:] > upto[:-width])[0]
            rows.append(np.full(len(at), k))
            runs.append(signed(run_hashes(hashes, size)[at]))
            first.append(at.astype(np.int32))
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ids = batch.column(0).take(pa.array(flat(rows), pa.int64())).flatten()
        return pa.RecordBatch.from_arrays([pa.array(flat(runs), pa.int64()), *ids,
                                           pa.array(flat(first).astype(np.int32))],
                                          names=["run", *parts, "first"])

    fields = docs.schema["id"].dataType.fields
    parts = [f"id{n}" for n in range(len(fields))]
    kinds = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(parts, fields, strict=True))
    return map_batches(docs, run, f"run long, {kinds}, first int", 256)


def _gathered(runs: np.ndarray, ids: pa.StructArray, first: np.ndarray,
              kept: pa.StructArray) -> pa.RecordBatch:
    """Later runs by document: id, firsts, run (the smallest), kept_ids."""
    key, other = (x.field("key").to_numpy() for x in (ids, kept))
    order = np.lexsort((other, key))
    key, other = key[order], other[order]
    new = np.r_[True, key[1:] != key[:-1]]
    pair = np.flatnonzero(np.r_[True, other[1:] != other[:-1]] | new)
    heads = np.flatnonzero(new)
    lists = lambda starts, values: pa.ListArray.from_arrays(
        pa.array(np.r_[starts, len(values)].astype(np.int32)), values)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(order[heads])), lists(heads, pa.array(first[order])),
         pa.array(np.minimum.reduceat(runs[order], heads)),
         lists(np.searchsorted(pair, heads), kept.take(pa.array(order[pair])))],
        names=["id", "firsts", "run", "kept_ids"])


def _later(runs: DataFrame, size: int, fields: list[str], kind: str) -> DataFrame:
    """Runs that stand earlier, too, by document: id, firsts, run (the smallest), kept_ids; a document
    has several rows. A run that overlaps its own first place stays. One shuffle; a task reads its
    runs in order, holds the current one's first and gathers about ``GATHERED`` before it sends them
    on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None  # of the rows before: run, id and first word of its first place
        for part in joined_batches(batches):
            runs_, first = part.column(0).to_numpy(), part.column(part.num_columns - 1).to_numpy()
            ids = pa.StructArray.from_arrays(part.columns[1:-1], names=fields)
            new = np.r_[last is None or runs_[0] != last[0], runs_[1:] != runs_[:-1]]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            heads = np.maximum(head, 0)
            kept_first = np.where(head >= 0, first[heads], 0 if last is None else last[2])
            carried = int(np.count_nonzero(head < 0))  # the run began in an earlier part
            kept = ids.take(pa.array(heads))
            if carried:
                kept = pa.concat_arrays([pa.array([last[1]] * carried, ids.type),
                                         kept.slice(carried)])
            same = np.equal(*(x.field("key").to_numpy() for x in (ids, kept)))
            out = np.flatnonzero(~new & ~(same & (first < kept_first + size)))
            at = int(heads[-1])
            last = (runs_[-1], last[1] if head[-1] < 0 else ids[at].as_py(), int(kept_first[-1]))
            if len(out):
                chosen = pa.array(out)
                yield runs_[out], ids.take(chosen), first[out], kept.take(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out() -> pa.RecordBatch:
            runs_, ids, first, kept = zip(*held, strict=True)
            return _gathered(np.concatenate(runs_), pa.concat_arrays(ids), np.concatenate(first),
                             pa.concat_arrays(kept))

        for part in read(batches):
            held.append(part)
            count += len(part[0])
            if count >= GATHERED:
                yield out()
                held, count = [], 0
        if held:
            yield out()
        give_back()

    ordered = runs.repartition("run").sortWithinPartitions(*runs.columns)
    return ordered.mapInArrow(run, f"id {kind}, firsts array<int>, run long, kept_ids array<{kind}>")


def exact_runs(docs: DataFrame, size: int = RUN, gram: int = GRAM) -> DataFrame:
    """(id, text) to stretches whose every run of ``size`` words stands earlier: id, first, stop
    (words), run (the smallest hash), kept_ids. ``id`` is a struct with a field ``key`` that tells
    texts apart. A run that overlaps its own first place stays.

    Only runs around an anchor that occurs twice are listed. Those that stand earlier are gathered
    by document as bare numbers, at most one a word, already by the task that finds them.
    """
    texts = docs.select("id", text_or_empty("text").cast("binary").alias("text"))
    marks = stored(_anchored(texts, size, gram))
    each = marks.select("id", F.explode("anchors").alias("anchor"))
    twice = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    known = each.join(twice, "anchor", "left_semi").groupBy("id").agg(
        F.collect_set("anchor").alias("known"))
    again = texts.join(known, "id").select("id", "text", "known")
    kind = docs.schema["id"].dataType.simpleString()
    fields = docs.schema["id"].dataType.names
    gone = stored(_later(_listed(again, size, gram), size, fields, kind).groupBy("id").agg(
        F.flatten(F.collect_list("firsts")).alias("firsts"), F.min("run").alias("run"),
        F.array_distinct(F.flatten(F.collect_list("kept_ids"))).alias("kept_ids")))
    released(marks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, first, stop = [], [], []
        for k, places in enumerate(batch.column(1)):
            at = np.unique(places.values.to_numpy()).astype(np.int64)
            edge = np.nonzero(np.r_[True, at[1:] > at[:-1] + size])[0]
            first.append(at[edge])
            stop.append(at[np.r_[edge[1:], len(at)] - 1] + size)
            rows.append(np.full(len(edge), k))
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        take = pa.array(flat(rows), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), pa.array(flat(first)), pa.array(flat(stop)),
             batch.column(2).take(take), batch.column(3).take(take)],
            names=["id", "first", "stop", "run", "kept_ids"])

    return map_batches(gone.select("id", "firsts", "run", "kept_ids"), run,
                       f"id {kind}, first long, stop long, run long, kept_ids array<{kind}>", 1024)


def _between(units: DataFrame, gone: DataFrame) -> DataFrame:
    """Of the paragraphs that are not compared those that follow one of ``gone`` and stand in the
    kept text at the same distance from its first; with the columns of ``gone``."""
    short = units.where(F.size("bands") == 0)
    last = F.last(F.when(F.col("class").isNotNull(), F.struct("place", "class", "kept_id",
                                                              "kept_place")), True)
    rows = short.drop("bands").unionByName(gone.drop("bands"), allowMissingColumns=True)
    led = rows.withColumn("lead", last.over(Window.partitionBy("id").orderBy("place"))).where(
        "class IS NULL AND lead IS NOT NULL").select(
        "id", "place", "first", "stop", "digest", F.col("lead.class").alias("class"),
        F.col("lead.kept_id").alias("kept_id"),
        (F.col("lead.kept_place") + F.col("place") - F.col("lead.place")).alias("kept_place"))
    kept = short.select(F.col("id").alias("k_id"), F.col("place").alias("kept_place"), "digest"
                        ).distinct()
    return led.join(kept, (led.kept_place == kept.kept_place) & (led.digest == kept.digest)
                    & led.kept_id.eqNullSafe(kept.k_id), "left_semi")


def _colliding(units: DataFrame) -> DataFrame:
    """(place, bucket, node) of the buckets in which different paragraphs meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in key_runs(batches, 2):
            node = table.column("node").to_numpy()
            run_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            new = np.r_[True, (node[1:] != node[:-1]) | (run_of[1:] != run_of[:-1])]
            distinct = np.bincount(run_of[new], minlength=len(starts) - 1)
            chosen = np.nonzero(new & (distinct[run_of] > 1))[0]
            if len(chosen):
                yield from table.take(pa.array(chosen)).to_batches()

    ship(units.sparkSession)
    # Equal paragraphs become one before they are sent to their buckets.
    distinct = (units.where(F.size("bands") > 0).groupBy(F.col("digest").alias("node"))
                .agg(F.first("bands").alias("bands")))
    rows = distinct.select(F.posexplode("bands").alias("place", "bucket"), "node")
    ordered = rows.repartition("place", "bucket").sortWithinPartitions("place", "bucket", "node")
    return ordered.mapInArrow(run, "place int, bucket long, node long")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, text) to (node, items) of its compared paragraphs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, items = [], [], []
        for raw in batch.column(1).to_pylist():
            cut = Cut(raw)
            chosen = np.nonzero(cut.stop - cut.first >= words)[0]
            if len(chosen):
                shingles, starts = _shingled(cut, chosen)
                for k, part in zip(chosen, np.split(shingles, starts[1:]), strict=True):
                    nodes.append(cut.digest[k])
                    items.append(np.unique(signed(part)))
                    sizes.append(len(items[-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)),
                pa.array(np.concatenate(items) if items else np.zeros(0, np.int64)))],
            names=["node", "items"])

    return map_batches(docs.select("id", text_or_empty("text").cast("binary").alias("text")), run,
                       "node long, items array<long>", 256)


def _spans(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """Removals with the characters they begin and end at; texts are read for those alone."""
    wanted = removals.groupBy("id").agg(F.collect_list(F.struct("first", "stop")).alias("runs"))
    rows = docs.select("id", text_or_empty("text").cast("binary").alias("text")).join(
        wanted, "id").select("id", "text", "runs")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, columns = [], [[] for _ in range(4)]
        for k, (raw, runs) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2),
                                            strict=True)):
            first, stop = (runs.values.field(i).to_numpy() for i in range(2))
            starts, ends = word_spans(raw)
            # Characters before a byte: bytes that do not continue a character.
            before = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
            row.append(np.full(len(first), k))
            for held, part in zip(columns, (first, stop, before[starts[first]],
                                            before[ends[stop - 1]]), strict=True):
                held.append(part)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        ids = batch.column(0).take(pa.array(np.concatenate(row) if row else [], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in flat)],
                                          names=["id", "first", "stop", "begin", "end"])

    found = map_batches(rows, run, f"id {kind}, first long, stop long, begin long, end long", 256)
    return removals.join(found.distinct(), ["id", "first", "stop"])


def _row_key(id_column: Column, text: Column) -> Column:
    """What a row is known by inside: rows that share an id keep apart by their texts."""
    return F.struct(id_column.alias("id"), F.xxhash64(id_column, text_or_empty(text)).alias("key"))


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             words: int = WORDS, similarity: float = SIMILARITY,
             passage: int = PASSAGE, run: int = RUN) -> DataFrame:
    """One row per removal: id, begin, end (characters of the text), words, kept_ids (documents
    that keep the passage's paragraphs) and classes (their components).

    Documents are read as lower case for A-Z. Null and empty texts have no paragraph. Of rows that
    repeat an id and a text one counts. A null id comes before any other. An empty table gives an
    empty result; other columns are ignored. Paragraphs below ``words`` words are not compared; one
    beside a removal goes with it if the kept document has the same one there. ``run`` is the length
    of exact repeats that are found wherever they begin. A removal that holds such repeats has the
    smallest of their hashes among its classes.
    """
    named = docs.select(_row_key(F.col(id_column), F.col(text_column)).alias("id"),
                        F.col(text_column).alias("text"))
    removals = _removals(named, words, similarity, passage, run)
    return _spans(named, removals).select(
        F.col("id.id").alias("id"), "begin", "end", "words",
        F.array_sort(F.array_distinct(F.transform("kept", lambda k: k["id"]))).alias("kept_ids"),
        "classes")


def _removals(named: DataFrame, words: int, similarity: float, passage: int,
              run: int) -> DataFrame:
    """(id, text) to id, first, stop (words), words, kept (ids) and classes."""
    units = stored(paragraphs(named, words))
    met = stored(_colliding(units))
    nodes = met.select("node").distinct()
    # One document that holds the paragraph is enough to read its shingles from.
    holders = (units.join(nodes, units.digest == nodes.node, "left_semi").groupBy("digest")
               .agg(F.min("id").alias("id")).select("id").distinct())
    again = named.join(holders, "id", "left_semi")
    sets = stored(_shingle_sets(again, words).join(nodes, "node", "left_semi")
                  .dropDuplicates(["node"]))
    links = stored(verified_links(met, sets, similarity))
    released(met)
    released(sets)
    roots = components(links)
    classed = (units.where(F.size("bands") > 0).drop("bands")
               .join(roots, units.digest == roots.node, "left")
               .select("id", "place", "first", "stop", "digest",
                       F.coalesce("root", "digest").alias("class")))
    firsts = (classed.groupBy("class").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "place")).alias("kept"))
        .where("copies > 1"))
    gone = stored(classed.join(firsts, "class").where(
        ~F.struct("id", "place").eqNullSafe(F.col("kept"))).select(
        *classed.columns, F.col("kept.id").alias("kept_id"), F.col("kept.place").alias("kept_place")))
    parts = ["id", "first", "stop", "class", "run", "kept_ids"]
    none = F.lit(None).cast("long")
    near = stored(gone.unionByName(_between(units, gone)).withColumn("run", none).withColumn(
        "kept_ids", F.array("kept_id")).select(parts))
    for done in (gone, units, links):
        released(done)
    every = near.unionByName(
        exact_runs(named, run, run // 2).withColumn("class", none).select(parts))
    ordered = Window.partitionBy("id").orderBy("first")
    upto = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first") > upto, F.lit(True)).cast("int")
    joined = every.withColumn("apart", apart).withColumn("part", F.sum("apart").over(
        ordered.rowsBetween(Window.unboundedPreceding, 0)))
    removals = joined.groupBy("id", "part").agg(
        F.min("first").alias("first"), F.max("stop").alias("stop"),
        F.array_distinct(F.flatten(F.collect_list("kept_ids"))).alias("kept"),
        F.sort_array(F.array_distinct(F.array_compact(F.concat(
            F.collect_set("class"), F.array(F.min("run")))))).alias("classes"))
    return stored(removals.withColumn("words", F.col("stop") - F.col("first"))
                  .where(F.col("words") >= passage).drop("part"))


def remove(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           words: int = WORDS, similarity: float = SIMILARITY, passage: int = PASSAGE,
           run: int = RUN) -> DataFrame:
    """The documents without their removals; other columns as they were. Ids may repeat: every row
    loses what ``repeated`` finds in its own text."""
    key = lambda prefix: _row_key(F.col(f"{prefix}`{id_column}`"),
                                  F.col(f"{prefix}`{text_column}`"))
    named = docs.select(key("").alias("id"), F.col(f"`{text_column}`").alias("text"))
    spans = _spans(named, _removals(named, words, similarity, passage, run)).groupBy("id").agg(
        F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    text = F.col(f"row.`{text_column}`")
    rows = wrapped(docs).withColumn("id", key("row.")).join(spans, "id", "left")
    shorter = F.aggregate(F.reverse("spans"), text, lambda t, s: F.concat(
        F.substr(t, F.lit(1), s["begin"].cast("int")),
        F.substr(t, s["end"].cast("int") + 1)))
    return unwrapped(rows.withColumn("row", F.struct(*[
        (F.when(F.col("spans").isNull(), text).otherwise(shorter) if c == text_column
         else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])), docs.columns)
