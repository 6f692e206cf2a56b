"""BPE encoding and decoding with batched numpy merge rounds.

The tokenizer file gives the vocabulary, the merges and the word pattern. Texts
are normalised, cut at white space, and each distinct piece of a batch is
encoded once: its words are cut by the pattern, their byte symbols laid into
one flat array for all words together, and merge rounds run over that array. In
a round the pairs of neighbours are looked up in the sorted keys of all merges
by binary search, each word's lowest-ranked pair is found by a segmented
minimum, and all its occurrences merge at once, left to right. Rounds end when
no pair of any word can merge. Pieces already met by the worker are remembered,
up to a bound on their number; what is forgotten is encoded again.

The supported files are BPE models without byte fallback, unknown token or
dropout, normalised by any of NFC, a replacement of white space and
lower-casing, split by one pattern of which the matches are words, then mapped
byte by byte to symbols, with an end-of-word suffix or none, and without a
decoder. Strings of added special tokens in a text become those tokens.

Rules: null and empty texts have no tokens and decode to the empty text. Every
input row, repeated or with a null id, gives a row.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.llm.common import worker_state
from gristmill.llm.words import runs

#: Pieces a worker remembers.
REMEMBERED = 250_000
#: Characters that Python's str.split cuts at and the White_Space property does not hold.
_ONLY_PYTHON_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: its own where that is visible Latin-1, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Merges:
    """The vocabulary and merges as arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str):
        symbols = byte_symbols()
        self.plain = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, pairs[order, 2]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, flat, and the n + 1 bounds of the words in them. No word is empty."""
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        ids = self.plain[data]
        ids[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_word = [], []
        while len(ids) > 1:
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            can = (self.keys[at] == key) & (word[:-1] == word[1:])
            if not can.any():
                break
            rank = np.full(len(ids), len(self.keys))
            rank[:-1][can] = self.rank[at[can]]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(ids)))
            # Words that have no pair left leave the flat array.
            live = best < len(self.keys)
            merge = can & (rank == best)[:-1]
            # Of overlapping occurrences (x x x) every second one of a run merges, from the left.
            run_start = merge & ~np.concatenate([[False], merge[:-1]])
            position = np.arange(len(merge))
            since = position - np.maximum.accumulate(np.where(run_start, position, 0))
            merge &= since % 2 == 0
            left = np.flatnonzero(merge)
            ids[left] = self.made[at[left]]
            stay = np.ones(len(ids), bool)
            stay[left + 1] = False
            done_ids.append(ids[~live])
            done_word.append(word[~live])
            ids, word = ids[stay & live], word[stay & live]
        done_ids.append(ids)
        done_word.append(word)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(words) + 1))


class Tokenizer:
    """A tokenizer file read for the method above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token") or model.get("dropout") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("this kind of tokenizer file is not supported")
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"))
        self.merges = Merges(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], suffix)
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with flags are not supported")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        self.cut = re.compile("|".join(map(re.escape, added))) if added else None
        self.token = {i: t for t, i in (model["vocab"] | added).items()}
        self.path, self.library, self.byte_of = path, None, {c: b for b, c in enumerate(byte_symbols())}
        self.known: dict[str, tuple[int, str, str]] = {}
        # Pieces hold no white space, so a space before a special token's text tells it from a piece that reads the same.
        for text, i in added.items():
            self.known[" " + text] = (1, str(i), text)

    def normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        # Lower-casing goes character by character, without the final-sigma rule of str.lower.
        return "".join(map(str.lower, text)) if self.lower and "Σ" in text else text.lower() if self.lower else text

    def pieces(self, text: str) -> list[str]:
        """The white-space-free pieces of the normalised text; special tokens are pieces of their own, with a space before."""
        if self.cut and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(" " + m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = self.normalised(text)
        return [p for p in _SPACES.split(text) if p] if _ONLY_PYTHON_SPACE.search(text) else text.split()

    def words(self, piece: str) -> list[bytes]:
        """The words of a normalised piece.

        Characters that Python's tables do not know (assigned since, or never)
        are normalised and split as the tokenizers library's tables say.
        """
        if piece.isascii() or not any(unicodedata.category(c) == "Cn" for c in piece):
            return [w.encode() for w in self.pattern.findall(piece)]
        from tokenizers import Tokenizer as Library

        if self.library is None:
            self.library = Library.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in found]

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces: (token count, decimal ids joined by spaces, decoded tokens joined by spaces)."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            keep = {p: self.known[p] for p in pieces if p in self.known} | {" " + t: self.known[" " + t] for t in self.special}
            self.known = keep
        if not new:
            return
        words, counts = [], []
        for p in new:
            own = self.words(p)
            counts.append(len(own))
            words += own
        if words:
            ids, bounds = self.merges.encode(words)
        at = 0
        ids_of = ids.tolist() if words else []
        for p, n in zip(new, counts):
            own = ids_of[bounds[at] : bounds[at + n]] if n else []
            at += n
            self.known[p] = (len(own), " ".join(map(str, own)), " ".join(self.token[i] for i in own))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: token count, decimal ids joined by one space, decoded text."""
        cut = [self.pieces(t) for t in texts]
        self.learn({p for c in cut for p in c})
        get, out = self.known.__getitem__, []
        for c in cut:
            own = [x for x in map(get, c) if x[0]]
            n, ids, decoded = zip(*own) if own else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(decoded)))
        return out


def load(path: str) -> Tokenizer:
    return worker_state(("bpe", path), lambda: Tokenizer(path))


def _encode(path: str, digests: bool, keep: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for part in runs(batch, "text"):
                n, ids, decoded = zip(*tokenizer.encode([t or "" for t in part.column("text").to_pylist()]))
                n = pa.array(n, pa.int64())
                if digests:
                    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(map(sha, ids), pa.string()), pa.array(map(sha, decoded), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    numbers = pa.array([list(map(int, t.split())) for t in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, numbers, pa.array(decoded, pa.string()), *(part.column(c) for c in keep)], ["doc_id", "n_tokens", "ids", "decoded", *keep])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids, decoded`` and the columns to ``keep``; one of them that has a name of the former is called ``input_`` and that name, with ``input_`` repeated until no other column has it. ``path`` must be readable on every executor."""
    schema = StructType.fromDDL("doc_id long, n_tokens long, ids array<int>, decoded string")
    taken, kept = {*schema.names, *(c.lower() for c in keep)}, {}
    for i, c in enumerate(keep):
        name = c
        while name.lower() in schema.names or name != c and name.lower() in taken:
            name = f"input_{name}"
        kept[f"_gm_{i}"] = name
        taken.add(name.lower())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)])
    out = rows.mapInArrow(_encode(path, False, tuple(kept)), StructType([*schema, *(rows.schema[k] for k in kept)]))
    return out.select(*schema.names, *[F.col(k).alias(c) for k, c in kept.items()])


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests made in the same pass: of the decimal ids joined by one space, and of the decoded text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

