"""Quality rules: counts within a document, and line frequency across a host's documents.

Lines are normalised (words joined by one space, A-Z in lower case) and hashed. A line goes when
more than ``DOCUMENTS`` distinct documents of its host hold it, however large the host is; exact
copies of a document count as one. A document that fails a base rule, or of whose words less than
``LEFT`` stand on the lines that stay, is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aislewise.llm.common import map_batches, ship, text_or_empty, unwrapped, wrapped
from aislewise.session import stored

DOCUMENTS = 20       # a line on more distinct documents of its host goes
LEFT = 0.5           # share of its words a document must keep
MIN_WORDS = 50
REPEATED = 50        # per cent of words in repeated windows, at most
_SYMBOLS = list(b"#*$%&|<>")
_SPACE = [32, 9, 10, 11, 12, 13]
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_hash(line: bytes) -> int:
    """Hash of a normalised line, signed."""
    value = xxhash.xxh64_intdigest(b" ".join(line.split()).lower())
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pair = ids[:-1] * len(number) + ids[1:]
    pair = np.unique(pair, return_inverse=True)[1]  # dense again, so that the next product fits
    _, place, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True,
                                return_counts=True)
    found = count[place] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:n - 2 + k] |= found
    return int(covered.sum())


def base_counts(raw: bytes) -> tuple[list[int], dict[int, int]]:
    """The counts of ``_BASE`` and the words of each normalised line by its hash."""
    words = raw.split()
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(codes[128:192].sum())  # bytes that begin a character
    seen, repeats, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        inside = line.split()
        if inside:
            repeats += line in seen
            seen.add(line)
            key = line_hash(line)
            lines[key] = lines.get(key, 0) + len(inside)
    return [len(words), points - int(codes[_SPACE].sum()), int(codes[_SYMBOLS].sum()), repeats,
            repeated_words(words)], lines


def described(docs: DataFrame) -> DataFrame:
    """(id, host, text) to id, host, digest, the base counts and ``lines`` (hash, words)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, words, offsets, digests = [], [], [], [0], []
        for raw in batch.column(2).to_pylist():
            base, lines = base_counts(raw)
            counts.append(base)
            hashes.extend(lines.keys())
            words.extend(lines.values())
            offsets.append(len(hashes))
            digests.append(xxhash.xxh128_digest(raw))
        lines = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(words, pa.int64())], names=["h", "words"]))
        columns = zip(*counts, strict=True) if counts else [[]] * len(_BASE)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary()),
             *(pa.array(list(c), pa.int64()) for c in columns), lines],
            names=["id", "host", "digest", *_BASE, "lines"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("id", "host")}
    return map_batches(
        docs.select("id", "host", text_or_empty("text").cast("binary").alias("text")), run,
        f"id {kinds['id']}, host {kinds['host']}, digest binary, "
        + ", ".join(f"{c} long" for c in _BASE) + ", lines array<struct<h: long, words: long>>")


def frequent_lines(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(host, digest, h), one row per document and line, to the (host, h) above the limit."""
    return (lines.select("host", "h", "digest").distinct().groupBy("host", "h")
            .agg(F.count(F.lit(1)).alias("documents"))
            .where(F.col("documents") > documents).select("host", "h"))


def assess(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           host_column: str = "source", documents: int = DOCUMENTS,
           left: float = LEFT) -> DataFrame:
    """One row per document: id, the base counts, removed_words, base_failed, kept, and
    ``removed``, the hashes of its lines that go.

    A null text has no word and fails. A null host is a host of its own. Repeated rows all stay
    and count as one document. An empty table gives an empty result; other columns are ignored.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(host_column).alias("host"),
                        F.col(text_column).alias("text"))
    base = stored(described(named).withColumn("key", F.monotonically_increasing_id()))
    return _judged(base, documents, left).select(
        "id", *_BASE, "removed_words", "base_failed", "kept", "removed")


def _judged(base: DataFrame, documents: int, left: float) -> DataFrame:
    """Described documents, each with a ``key`` of its own, with the verdicts on them."""
    lines = base.select("key", "host", "digest", F.explode("lines").alias("line")).select(
        "key", "host", "digest", "line.h", "line.words")
    frequent = stored(frequent_lines(lines, documents))
    hit = (lines.alias("l").join(frequent.alias("f"), F.col("l.host").eqNullSafe(F.col("f.host"))
                                 & (F.col("l.h") == F.col("f.h")))
           .groupBy("key").agg(F.sum("words").alias("removed_words"),
                               F.collect_list("l.h").alias("removed")))
    n, failed = F.col("n_words"), F.col("base_failed")
    return (base.join(hit, "key", "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
            .withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words")
                                                          > REPEATED * n))
            .withColumn("kept", ~failed & (n - F.col("removed_words") >= n * left)))


def clean(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          host_column: str = "source", documents: int = DOCUMENTS,
          left: float = LEFT) -> DataFrame:
    """The kept documents without the lines that go; all columns as they were but the text.

    Verdicts are matched by host and text, so ids may repeat or be null: equal texts of a host have
    equal verdicts, and every row is judged once.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(host_column).alias("host"),
                        F.col(text_column).alias("text"))
    # One row per text of a host; copies are judged alike, and count as one document anyway.
    base = stored(described(named).drop("id").dropDuplicates(["host", "digest"])
                  .withColumn("key", F.monotonically_increasing_id()))
    verdicts = _judged(base, documents, left).where("kept").select("host", "digest", "removed")
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def without(texts, removed):
        import pandas as pd
        out = []
        for text, gone in zip(texts, removed, strict=True):
            gone = set() if gone is None else set(gone)
            out.append("\n".join(x for x in text.split("\n")
                                 if not gone or line_hash(x.encode()) not in gone))
        return pd.Series(out)

    @F.pandas_udf("binary")
    def digested(texts):
        return texts.map(xxhash.xxh128_digest)

    text = F.col(f"row.`{text_column}`")
    rows = wrapped(docs).select("row", F.col(f"row.`{host_column}`").alias("host"),
                                digested(text_or_empty(text).cast("binary")).alias("digest"))
    joined = rows.alias("r").join(verdicts.alias("v"), F.col("r.host").eqNullSafe(F.col("v.host"))
                                  & (F.col("r.digest") == F.col("v.digest")))
    shorter = F.when(F.col("removed").isNull(), text).otherwise(
        without(text_or_empty(text), F.col("removed")))
    changed = joined.withColumn("row", F.struct(*[
        (shorter if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
    return unwrapped(changed, docs.columns)
