"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves.

An edit touches one half of a word only. So if v is one edit from w, either w's first half
stands at the start of v or its second half at the end. Automata hold both halves of
all words; all words are scanned, an occurrence counts if it stands at the start
or the end and the lengths are at most one apart, and then the distance is verified
on what is left of both words: common start plus common end must cover all but the
edit.

Halves are dealt to automaton shards by their hash. A word goes to the shards of the
heads and tails it has at the lengths that fit, four at most, since no other
shard can hold a half of a word near it. A half that more than ``hot`` words share (and one
in a thousand of all halves) has shards of its own: its words and those that scan
for it are each dealt into parts, and each pair of parts is a task, so no task
gathers a half's words alone. What a task finds is summed by word before it is
shuffled; pairs are never written.

Rules: null texts have no words. Rows with equal ids are counted each; a run of a row
with a null id is never altered. A word is near to another at one inserted, deleted or
replaced code point, never to itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ascii_lower, durable

#: Segments an automaton holds on average.
SHARD = 40_000
#: Pairs whose remainders are compared at once, in eight-byte units.
BLOCK = 1 << 19


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = 7, least_n: int = 2, one_in: int = 31) -> DataFrame:
    """``word, n``: the altered runs of Latin letters with at least so many code points and occurrences."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    h, at = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.col("h") % F.char_length("run")
    word = F.when(F.col("h") % one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = runs.select("run", h.alias("h")).select(word.alias("word")).where(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def halves() -> Column:
    """Both halves of ``word``, the first the shorter: an array of (side, segment)."""
    size = F.char_length("word")
    cut = F.floor(size / 2).cast("int")
    return F.array(_segment(0, F.substring("word", F.lit(1), cut)), _segment(1, F.substring("word", cut + 1, size)))


def ends() -> Column:
    """The heads and tails of ``word`` that can be a half of a word at most one code point longer or shorter."""
    size = F.char_length("word")
    head = lambda n: _segment(0, F.substring("word", F.lit(1), F.floor(n / 2).cast("int")))
    tail = lambda n: _segment(1, F.substring("word", size - F.floor(n / 2).cast("int") + 1, size))
    return F.array_distinct(F.array(head(size - 1), head(size + 1), tail(size), tail(size + 2)))


def _segment(side: int, text: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), text.alias("segment"))


def _packed(texts: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(8 * size, b"\0") for t in texts), np.uint64).reshape(len(texts), size)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of the rows of two packed arrays."""
    out = np.zeros(len(a), np.int32)
    open_ = np.ones(len(a), bool)
    for k in range(a.shape[1]):
        x = a[:, k] ^ b[:, k]
        out += np.where(open_, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3, 0).astype(np.int32)
        open_ &= x == 0
    return out


def one_edit(held: list[bytes], scanned: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``held`` x ``scanned`` exactly one edit apart."""
    size = max(1, -(-max(map(len, [*held, *scanned])) // 8))
    forward, backward = ((_packed([t[::d] for t in held], size), _packed([t[::d] for t in scanned], size)) for d in (1, -1))
    n_held, n_scanned = (np.array([*map(len, x)], np.int32) for x in (held, scanned))
    found, step = [], max(1, BLOCK // (size * len(held)))
    for at in range(0, len(scanned), step):
        h, s = (x.ravel() for x in np.meshgrid(np.arange(len(held)), np.arange(at, min(at + step, len(scanned))), indexing="ij"))
        start = _common(forward[0][h], forward[1][s])
        end = _common(backward[0][h], backward[1][s])
        a, b = n_held[h], n_scanned[s]
        near = np.where(a == b, start + end == a - 1, (np.abs(a - b) == 1) & (start + end >= np.minimum(a, b)))
        found.append((h[near], s[near]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _scan(table: pa.Table) -> pa.Table:
    """One shard: an automaton over the halves it holds, all its words scanned; per word with near words ``word, n_near, best_n, best``."""
    import ahocorasick

    side, segment, word, n = (table.column(c).to_pylist() for c in ("side", "segment", "word", "n"))
    holders: dict[tuple[int, str], list[int]] = {}
    scanners: dict[str, int] = {}
    words: list[str] = []
    for k, (s, g, w, m) in enumerate(zip(side, segment, word, n)):
        if m is not None:
            holders.setdefault((s, g), []).append(k)
        elif w not in scanners:
            scanners[w] = len(words)
            words.append(w)
    if not holders or not words:
        return _found([], [], [], [])
    automaton = ahocorasick.Automaton()
    for _, g in holders:
        automaton.add_word(g, g)
    automaton.make_automaton()
    meets: dict[tuple[int, str], list[int]] = {}
    for k, w in enumerate(words):
        for last, g in automaton.iter(w):
            if last + 1 == len(g) and (0, g) in holders:
                meets.setdefault((0, g), []).append(k)
            if last + 1 == len(w) and (1, g) in holders:
                meets.setdefault((1, g), []).append(k)
    rank = np.empty(len(word), np.int64)
    order = sorted((k for ks in holders.values() for k in ks), key=lambda k: (-n[k], word[k]))
    rank[order] = np.arange(len(order))
    n_near, best = np.zeros(len(words), np.int64), np.full(len(words), len(order))
    for (s, g), ks in meets.items():
        by_size: dict[int, list[int]] = {}
        for k in ks:
            by_size.setdefault(len(words[k]), []).append(k)
        held: dict[int, list[int]] = {}
        for k in holders[s, g]:
            held.setdefault(len(word[k]), []).append(k)
        for size, hs in held.items():
            near = [k for d in (size - 1, size, size + 1) for k in by_size.get(d, ())]
            if near:
                cut = slice(len(g), None) if s == 0 else slice(None, -len(g))
                h, k = one_edit([word[x][cut].encode("latin-1") for x in hs], [words[x][cut].encode("latin-1") for x in near])
                h, k = np.array(hs)[h], np.array(near)[k]
                if s == 1:  # a word whose first half stands too has been found by that half
                    new = np.array([not words[y].startswith(word[x][: size // 2]) for x, y in zip(h.tolist(), k.tolist())], bool)
                    h, k = h[new], k[new]
                n_near += np.bincount(k, minlength=len(words))
                np.minimum.at(best, k, rank[h])
    some = np.flatnonzero(n_near).tolist()
    chosen = [order[best[k]] for k in some]
    return _found([words[k] for k in some], n_near[some].tolist(), [n[k] for k in chosen], [word[k] for k in chosen])


def _found(*columns: list) -> pa.Table:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, hot: int = 4096) -> DataFrame:
    """``word, n_near, best_n, best`` for words with a near word; ``best`` is the near word of largest n, the smallest of equals."""
    total = words.count()
    shards, hot = 1 + 2 * total // SHARD, max(hot, 2 * total // 1000)
    held = words.select("word", "n", F.inline(halves()))
    sought = words.select("word", F.lit(None).cast("long").alias("n"), F.inline(ends()))
    key = ["side", "segment"]
    # Fewer than 1,000 halves pass ``hot``.
    parts = F.broadcast(held.groupBy(*key).count().where(F.col("count") > hot).select(*key, F.ceil(F.col("count") / hot).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = lambda rows, a, b: rows.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(a, own).withColumn(b, every)
    rows = dealt(held, "i", "j").unionByName(dealt(sought, "j", "i"))
    place = F.xxhash64(*key)
    rows = rows.withColumn("shard", F.when(F.col("parts") > 1, -1 - F.pmod(place, F.lit(1 << 40))).otherwise(F.pmod(place, F.lit(shards))))
    found = rows.groupBy("shard", "i", "j").applyInArrow(_scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ratio: int = 10, least_chars: int = 7, least_n: int = 2, hot: int = 4096) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the form is the commonest near word if at least ``ratio`` times as common, the root the last form of a chain."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could run in a circle")
    words = durable(vocabulary(docs, id_col, text_col, least_chars=least_chars, least_n=least_n), "words")
    best = F.col("best_n") >= ratio * F.col("n")
    whole = words.join(near_words(words, hot), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(best, F.col("best")).alias("form"), F.when(best, F.col("best_n")).alias("form_n"))
    whole = durable(whole, "forms")
    forms = whole.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to"))
    # A chain's counts grow by ``ratio`` a step, so its length is at most the logarithm of the largest count.
    steps = durable(forms.select(F.col("from").alias("word"), F.col("to").alias("root")), "roots")
    while True:
        on = steps.join(forms, steps.root == forms["from"], "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("on"))
        steps = durable(on, "roots")
        if steps.where("on").isEmpty():
            break
    return whole.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
