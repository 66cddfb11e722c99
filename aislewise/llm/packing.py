"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document is cut into full sequences and one remainder. A sequence's cost is linear in its
tokens plus quadratic in the length of each piece, as attention inside the piece is. Remainders
are dealt by hash into groups of bounded size, and each group is packed on its own: in descending
length, every piece goes to the sequence of lowest cost that still has room for it. A group opens
as many sequences as its tokens fill; a piece without room opens one more.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from aislewise.llm.common import map_batches, ship, text_or_empty
from aislewise.session import stored

LENGTH = 2048        # tokens of a sequence
END_ID = 1           # ends every document
LINEAR, QUADRATIC = 1.0, 1.0 / 1024   # cost of a token, and of a pair of tokens of one piece
GROUP = 30_000       # remainders packed together, about
MOST = 65_536        # remainders packed together, at most
WORDS, PIECES = 200_000, 500_000      # entries of a worker's caches, at most

#: Letters whose NFC form is themselves and whose lower case is one letter.
_PLAIN = regex.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([^\s\p{L}\p{M}\p{N}]*)")
_ASCII_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TOKENIZERS: dict[str, WordTokenizer] = {}


def _byte_letters() -> dict[int, int]:
    """The character a byte-level tokenizer writes for each byte: printable ones stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class _Cache(dict):
    """A dictionary that computes a missing value, and starts anew when it is full."""

    def __init__(self, compute: Callable[[bytes], bytes], most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key: bytes) -> bytes:
        value = self.compute(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Token ids of a text, word by word, for a BPE with word ends that drops white space.

    Such a tokenizer never joins over white space, so a text's ids are those of its words. Words
    repeat, so their ids are kept, in two bounded caches: by word as written, and by its lower-case
    letters or its marks. What is not known is encoded by the ``tokenizers`` library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.pieces = _Cache(self._piece, PIECES)
        self.words = _Cache(self._word, WORDS)

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a lower-case run of letters, or of marks: one unit of the tokenizer's own split,
        so its model alone is asked, with the bytes as the characters it stands for them with."""
        found = self.model.tokenize(piece.decode("latin-1").translate(_BYTE_LETTERS))
        return np.array([t.id for t in found], dtype="<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        letters = word.rstrip(_ASCII_MARKS)
        if letters.isalpha():  # on bytes: A-Z and a-z only
            marks, letters = word[len(letters):], letters.lower()
        elif match := _PLAIN.fullmatch(word.decode()):
            letters, marks = match[1].lower().encode(), match[2].encode()
        else:
            ids = self.encoder.encode(word.decode(), add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        return self.pieces[letters] + self.pieces[marks] if marks else self.pieces[letters]

    def encode(self, text: bytes) -> bytes:
        """A UTF-8 text's ids as little-endian unsigned 32-bit numbers."""
        words = self.words
        return b"".join([words[w] for w in text.split()])


def _tokenizer(name: str) -> WordTokenizer:
    """One per worker and file: a path, or the name of a file of ``public_tokenizers``."""
    if name not in _TOKENIZERS:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers
            path = public_tokenizers.path(name)
        _TOKENIZERS[name] = WordTokenizer(str(path))
    return _TOKENIZERS[name]


PIECE = "id {0}, start long, length long, crc long, tokens long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(id, text) to pieces of at most ``length`` tokens: id, start, length, crc, tokens."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0)
        texts = batch.column(1).to_pylist()
        row, start, size, crc, total = [], [], [], [], []
        end = np.array([END_ID], dtype="<u4").tobytes()
        encode = _tokenizer(tokenizer).encode
        for k, text in enumerate(texts):
            data = memoryview(encode(text) + end)
            count = len(data) // 4
            for begin in range(0, count, length):
                part = data[begin * 4:(begin + length) * 4]
                row.append(k)
                start.append(begin)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(count)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64())
                                                    for x in (start, size, crc, total))],
            names=["id", "start", "length", "crc", "tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", text_or_empty("text").cast("binary").alias("text")), cut,
                       PIECE.format(kind))


class _Lowest:
    """Lowest cost among the sequences with at least so much room: a tree over the room left."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.tree = [float("inf")] * (2 * self.base)
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def _set(self, room: int) -> None:
        heap, tree = self.heaps.get(room), self.tree
        node = room + self.base
        tree[node] = heap[0][0] if heap else float("inf")
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, sequence))
        self._set(room)

    def take(self, need: int) -> tuple[int, float, int] | None:
        """(room, cost, sequence) of the cheapest with room for ``need``, or None."""
        tree, best, at = self.tree, float("inf"), 0
        left, right = need + self.base, 2 * self.base
        while left < right:
            if left & 1:
                if tree[left] < best:
                    best, at = tree[left], left
                left += 1
            if right & 1:
                right -= 1
                if tree[right] < best:
                    best, at = tree[right], right
            left >>= 1
            right >>= 1
        if not at:
            return None
        while at < self.base:
            at = 2 * at if tree[2 * at] == best else 2 * at + 1
        room = at - self.base
        cost, sequence = heapq.heappop(self.heaps[room])
        self._set(room)
        return room, cost, sequence


def pack(lengths: list[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Descending lengths to (sequence, offset) of each."""
    open_, sequences = _Lowest(length), -(-sum(lengths) // length)
    for k in range(sequences):
        open_.put(length, 0.0, k)
    where, offsets = [], []
    for size in lengths:
        found = open_.take(size)
        if found is None:
            found, sequences = (length, 0.0, sequences), sequences + 1
        room, cost, sequence = found
        where.append(sequence)
        offsets.append(length - room)
        open_.put(room - size, cost + LINEAR * size + QUADRATIC * size * size, sequence)
    return where, offsets


def packed(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
           length: int = LENGTH) -> DataFrame:
    """One row per piece: id, start, length, crc, tokens, sequence_id, offset.

    Null texts count as empty and are their end id alone. Repeated rows are packed as often as
    they come, null ids too. An empty table gives no piece; other columns are ignored. Sequences
    have no gap before their last token; what is left is padding.
    """
    cut = stored(pieces(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")),
                        tokenizer, length))
    whole = cut.where(F.col("length") == length).select(
        "*", (F.monotonically_increasing_id() * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // GROUP))
    grouped = rest.withColumn("group", F.pmod(F.xxhash64("id", "start", "crc"), F.lit(groups)))
    ordered = grouped.repartition("group").sortWithinPartitions(
        "group", F.col("length").desc(), "id", "crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, round_of = [], {}

        def work(group: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for start in range(0, rows.num_rows, MOST):  # a hot group in several rounds
                some = rows.slice(start, MOST)
                number = round_of[group] = round_of.get(group, -1) + 1
                where, offsets = pack(some.column("length").to_pylist(), length)
                base = (group << 24 | number) << 17
                ids = (np.array(where, dtype=np.int64) + base) * 2 + 1
                out = some.drop_columns("group").append_column("sequence_id", pa.array(ids)) \
                    .append_column("offset", pa.array(offsets, pa.int64()))
                yield from out.to_batches()

        def flush() -> Iterator[pa.RecordBatch]:
            if part:
                yield from work(part[0].column("group")[0].as_py(), pa.Table.from_batches(part))
                part.clear()

        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = np.r_[0, np.nonzero(group[1:] != group[:-1])[0] + 1, len(group)]
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                piece = batch.slice(low, high - low)
                if part and (part[0].column("group")[0].as_py() != group[low]
                             or sum(b.num_rows for b in part) >= MOST):
                    yield from flush()
                if piece.num_rows:
                    part.append(piece)
        yield from flush()

    ship(docs.sparkSession)
    kind = cut.schema["id"].dataType.simpleString()
    return whole.unionByName(ordered.mapInArrow(
        run, PIECE.format(kind) + ", sequence_id long, offset long"))
