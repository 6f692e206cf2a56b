"""Token ids on disk: documents encoded in doc_id order, compressed in independent blocks, and read back.

Format. A token file is a folder of Parquet files, which any Hadoop file system
takes under Spark's commit protocol; Parquet is the container, its own
compression off. A row is a segment: whole documents, together at least
``segment_ids`` ids but for the last of a part.

    part         the range of doc_ids, numbered in order
    first        ids of the part before this segment
    doc_ids      the segment's documents, in order
    counts       ids of each, end id included
    table        the segment's frequencies of order 0
    sizes        ids of each block: BLOCK, but for the last
    bytes        coded bytes of each block
    checksums    crc32 of each block's ids as little-endian unsigned 32-bit integers
    payload      the coded blocks, one after another

Blocks are coded by ``range_coder``, each from a fresh model, and end anywhere in
a document. Documents are dealt by ranges of doc_id, so parts are written in
parallel, and a document's place in the whole is the ids of the parts before
its own (one sum a part), plus ``first``, plus its place in the segment.

Rules: null and empty texts have the end id only. Rows that repeat a doc_id are
documents of their own, next to each other, in order of a hash of their texts.
Rows with a null doc_id come first. A block whose ids differ from its checksum
raises an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm import words as W
from gristmill.llm.common import scratch_path, set_worker_threads
from gristmill.llm.range_coder import BLOCK, checksum, decode_blocks, encode_blocks

#: Pieces a worker remembers, about; beyond that it forgets those met in one batch only.
REMEMBERED = 800_000
#: Bytes of text encoded at once: the more, the fewer distinct pieces in all.
AT_ONCE = 1 << 23
SEGMENTS = "part int, first long, doc_ids array<long>, counts array<long>, table binary, sizes array<int>, bytes array<int>, checksums array<long>, payload binary"

#: Classes of bytes. SPACE is the Unicode property White_Space, LETTER the letters to U+023F, all of them fixed; MARK the rest of ASCII.
SPACE, LETTER, MARK, FAR = range(4)
_CLASS = np.full(256, FAR, np.uint8)
_CLASS[:128] = MARK
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
#: Lead bytes of the other spaces, with what may follow.
_SPACES = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [*(bytes([0x80, k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"], 0xE3: [b"\x80\x80"]}
_WORD = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u023f]+")


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte, that of a character's first byte in all its bytes where it is SPACE or LETTER."""
    found = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return found
    byte = data[lead]
    second, third = (data.take(lead + k, mode="clip") for k in (1, 2))
    own = (byte >= 0xC3) & (byte <= 0xC8) & ~((byte == 0xC3) & ((second == 0x97) | (second == 0xB7)))
    found[lead[own]] = found[lead[own] + 1] = LETTER
    for first, rest in _SPACES.items():
        at = np.flatnonzero(byte == first)
        if not len(at):
            continue
        size = 1 + len(rest[0])
        code = second[at].astype(np.int64) << 8 | (third[at] if size == 3 else 0)
        at = lead[at[np.isin(code, [int.from_bytes(r.ljust(2, b"\0"), "big") for r in rest])]]
        for k in range(size):
            found[at + k] = SPACE
    return found


def _pieces(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that lie one after another and start at ``texts``, none of them empty.

    A run without white space is a piece, or two where its first letters end
    before a MARK. A run of white space is a piece but for its last character
    if more text follows: that goes to the next piece if it is " ", and is a
    piece by itself if not.
    """
    n, found = len(data), _classes(data)
    begin = np.zeros(n, bool)
    begin[texts] = True
    space, letter = found == SPACE, found == LETTER
    piece = begin.copy()
    piece[1:] |= space[1:] & ~space[:-1]
    # White space before other text: its last character, then the text.
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~begin[1:]) + 1
    before = data[after - 1]
    size = np.where(before < 0x80, 1, np.where(data[after - 2] >= 0xC2, 2, 3))
    piece[after - size] = True
    piece[after] = before != 0x20
    # Letters that begin a run and end before a mark.
    edge = begin[1:] | (letter[1:] != letter[:-1])
    first = np.flatnonzero(np.append(True, edge) & letter)
    last = np.flatnonzero(np.append(edge, True) & letter)
    open_run = (begin[first] | space[first - 1]) & (last + 1 < n)
    ends = last[open_run] + 1
    piece[ends[(found[ends] == MARK) & ~begin[ends]]] = True
    return np.flatnonzero(piece)


def _byte_letters() -> np.ndarray:
    """The code point by which a byte-level model writes each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, "<u4")
    table[own] = own
    table[sorted(set(range(256)) - set(own))] = np.arange(256, 256 + 256 - len(own))
    return table


_LETTERS = _byte_letters()


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class Encoder:
    """A tokenizers-library file, asked for each distinct piece once.

    A byte-level model with its usual word pattern never makes a token across
    the pieces of _pieces (letters before an ASCII character that is no
    letter, or what white space bounds, with one space before it), so the ids of
    a text are those of its pieces. A piece of letters alone is one word of that
    pattern, so the library's model is asked for these without its pattern.
    Texts with a special token's string, and files of another kind, are encoded
    whole.
    """

    def __init__(self, path: str):
        set_worker_threads()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.line_ids = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = self.line_ids[0] if self.line_ids else -1
        # The same model, given words in a byte-level model's letters, one a line.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(chr(_LETTERS[10]), "removed")
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(t) for t in vocab]
        self.place: dict[str, int] = {}
        self.ids, self.start, self.count, self.met = np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Forgets pieces met in one batch only, or all if they are most."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > REMEMBERED // 2:
            kept = kept[:0]
        names = list(self.place)
        self.place = {names[i]: k for k, i in enumerate(kept.tolist())}
        count, start = self.count[kept], self.start[kept]
        self.ids, self.start, self.count = self.ids[_ranges(start, count)], np.cumsum(count) - count, count
        self.met = np.ones(len(kept), np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of pieces of letters and how many each has, unless the model's tokens don't make up just these."""
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        text = _LETTERS[data].tobytes().decode("utf-32-le")
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        made = np.cumsum(self.sizes[ids])
        ends = np.append(np.flatnonzero(data == 10), len(data)) - np.arange(len(words))
        last = np.searchsorted(made, ends)
        if not len(made) or made[-1] != ends[-1] or (made[last] != ends).any():
            return None
        return ids, np.diff(last, prepend=-1)

    def _lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of pieces without white space but one before them, given to the library in lines, whose ends are tokens of their own."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
        if len(self.line_ids) != 1 or len(ends) != len(lines):
            return None
        return ids[ids != self.line_end], np.diff(ends, prepend=-1) - 1

    def _places(self, pieces: np.ndarray) -> np.ndarray:
        """Where the distinct pieces are remembered."""
        if len(self.place) > REMEMBERED:
            self.forget()
        places = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(places < 0)
        if len(at):
            new = pieces[at].tolist()
            self._learn(new)
            places[at] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        self.met[places] += 1
        return places

    def _learn(self, new: list[str]) -> None:
        words, lines, rest = [], [], []
        for p in new:
            (words if _WORD.fullmatch(p) else rest if p.isspace() else lines).append(p)
        for some, ask in ((words, self._words), (lines, self._lines), (rest, None)):
            if not some:
                continue
            found = ask(some) if ask else None
            if found is None:
                apart = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                found = np.concatenate(apart), np.array([len(x) for x in apart], np.int64)
            ids, count = found
            self.place.update(zip(some, range(len(self.place), len(self.place) + len(some))))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
            self.met = np.concatenate([self.met, np.zeros(len(some), np.int64)])

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts are encoded whole."""
        whole = np.full(len(texts), not self.by_piece)
        for token in self.special if self.by_piece else ():
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return whole

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. A null text has none."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        whole = self._whole(texts)
        cut = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        ids, counts = self._by_piece(cut)
        if not whole.any():
            return ids, counts
        apart = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(whole).tolist():
            apart[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(apart), np.array([len(x) for x in apart], np.int64)

    def _by_piece(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        if not pc.sum(pc.binary_length(texts)).as_py():
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        offsets, data = offsets - first, texts.buffers()[2][first:last]
        starts = _pieces(np.frombuffer(data, np.uint8), offsets[:-1][offsets[1:] > offsets[:-1]])
        bounds = np.append(starts, last - first)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), data).dictionary_encode()
        at = self._places(found.dictionary.to_numpy(zero_copy_only=False))[found.indices.to_numpy()]
        count = self.count[at]
        return self.ids[_ranges(self.start[at], count)], np.diff(np.append(0, np.cumsum(count))[np.searchsorted(starts, offsets)])


_encoders: dict[str, Encoder] = {}


def _segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray, part: int, first: int) -> pa.RecordBatch:
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    table, out = encode_blocks(blocks)
    columns = {
        "part": pa.array([part], pa.int32()),
        "first": pa.array([first], pa.int64()),
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
        "counts": pa.array([counts], pa.list_(pa.int64())),
        "table": pa.array([table], pa.binary()),
        "sizes": pa.array([[len(b) for b in blocks]], pa.list_(pa.int32())),
        "bytes": pa.array([[len(b) for b in out]], pa.list_(pa.int32())),
        "checksums": pa.array([[checksum(b) for b in blocks]], pa.list_(pa.int64())),
        "payload": pa.array([b"".join(out)], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _write(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        doc_ids, counts, held, n, first, part = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            return _segment(doc_ids, np.concatenate(counts), np.concatenate(held), part, first)

        for batch in batches:
            for piece in W.runs(batch, "text", AT_ONCE):
                part = piece.column("part")[0].as_py()
                ids, count = encoder.encode(piece.column("text"))
                ids = np.insert(ids, np.cumsum(count), end_id).astype(np.int32, copy=False)
                doc_ids += piece.column("doc_id").to_pylist()
                counts.append(count + 1)
                held.append(ids)
                n += len(ids)
                if n >= segment_ids:
                    yield segment()
                    doc_ids, counts, held, n, first = [], [], [], 0, first + n
        if held:
            yield segment()

    return run


def write_token_file(docs: DataFrame, to: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", *, segment_ids: int = 1 << 22, part_bytes: int | None = None) -> None:
    """Writes the documents to a new token file. ``tokenizer`` must be readable on every executor.

    A part holds about ``part_bytes`` of text: as much as gives each core eight
    parts, 8 MiB at least and 256 MiB at most, where that is not given.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    part_bytes = part_bytes or min(256 << 20, max(8 << 20, total // (8 * cores)))
    order = ["doc_id", "_order"]
    dealt = texts.withColumn("_order", F.xxhash64("text")).repartitionByRange(int(1 + total // part_bytes), *order)
    dealt = dealt.sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    dealt.mapInArrow(_write(tokenizer, end_id, segment_ids), SEGMENTS).write.option("compression", "uncompressed").parquet(to)


def _read(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _documents({c: batch.column(c)[i].as_py() for c in batch.schema.names}, digests)

    return run


def _documents(row: dict, digests: bool) -> pa.RecordBatch:
    ends = np.cumsum([0, *row["bytes"]]).tolist()
    own = decode_blocks(row["table"], [row["payload"][a:b] for a, b in zip(ends, ends[1:])], row["sizes"])
    if [checksum(b) for b in own] != row["checksums"]:
        raise ValueError(f"a block of part {row['part']} differs from its checksum")
    ids, counts = np.concatenate(own), np.array(row["counts"], np.int64)
    ends = np.cumsum(counts)
    start = ends - counts
    if digests:
        value = pa.array([checksum(ids[a:b]) for a, b in zip(start.tolist(), ends.tolist())], pa.int64())
    else:
        value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + start), pa.array(counts), value], ["part", "doc_id", "start", "n_tokens", "value"])


def read_token_file(spark: SparkSession, path: str, *, digests: bool = False) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids``; with ``digests`` the ids' crc32 instead, as ``ids_crc32``."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # One number a part, each of which stands for part_bytes of text.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))
    name, kind = ("ids_crc32", "long") if digests else ("ids", "array<int>")
    found = segments.mapInArrow(_read(digests), f"part int, doc_id long, start long, n_tokens long, value {kind}")
    return found.join(offsets, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", F.col("value").alias(name))


def token_digests(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Writes the documents to a scratch token file and reads it back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_file(docs, path, tokenizer, end_id, **options)
    return read_token_file(docs.sparkSession, path, digests=True)
