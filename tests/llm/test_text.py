"""Decontamination, tokens, archives: brute force, the tokenizers library, exact round trips."""

import gzip
import hashlib
import io
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cases import ODD, corpus
from gristmill.llm.bpe import Merges, Tokenizer, encode, encode_digests
from gristmill.llm.decontaminate import apply_decontamination, contamination
from gristmill.llm.loser_tree import merge
from gristmill.llm import range_coder, token_file
from gristmill.llm.range_coder import BLOCK, decode_blocks, encode_blocks
from gristmill.llm.token_file import Encoder, read_token_file, write_token_file
from gristmill.llm.wu_manber import tables
from gristmill.llm.warc import archive_and_index, parse, write_archives
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def hits_by_hand(rows, items, size=10):
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    own |= windows[key]
        out.append((i, len(w), sorted(hit), sorted(str(x) for x in own if x is not None)))
    return out


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


ITEMS = [(1, "one two three"), (2, "..."), (3, None), (4, ""), (5, "É"), (6, "w1 w2 w3 W4 w5 w6 w7 w8 w9 w10 w11"), (7, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "123"), (1, "one two three")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 16])
def test_contamination(spark, odd, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(i, t) for i, t, _ in ODD]
    got = [tuple(r) for r in contamination(odd, items, block_bytes=block_bytes).collect()]
    same(got, hits_by_hand(rows, ITEMS))
    kept = apply_decontamination(odd, items, block_bytes=block_bytes)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not h for _, _, h, _ in hits_by_hand(rows, ITEMS))


@pytest.mark.parametrize("size", [1, 2, 4, 10])
def test_contamination_of_random_texts(spark, size):
    rows = corpus(5, 60)
    items = [(k, " ".join((rows[k][1] or "").split()[2:16])) for k in range(8)]
    got = contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=size)
    same([tuple(r) for r in got.collect()], hits_by_hand(rows, items, size))


def test_contamination_without_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(none, items).count() == 0
    assert all(not r["hits"] for r in contamination(odd, items.limit(0)).collect())


STRANGE = ["", " ", "  a  b", "don't I'LL 's", "aaaa" * 400, "Σ ΑΣ İ ǅ ẞ", "x\x1cy \x1f", "½ Ⅳ ² ٣٤", "日本語 한국어 😀👍🏽", "é ﬁ", "a b c\u0085d​e", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "\r\n\r\n  x \t", "  <|endoftext|>  "]


def test_bpe_equals_the_library():
    library, own = Library.from_file(WORD_BPE), Tokenizer(WORD_BPE)
    texts = STRANGE + [t or "" for _, t, _ in ODD] + [t or "" for _, t in corpus(6, 40)]
    for text, (n, ids, decoded) in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), text
        assert decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    if not hasattr(test_any_text, "pair"):
        test_any_text.pair = Library.from_file(WORD_BPE), Tokenizer(WORD_BPE), Library.from_file(BYTE_BPE), Encoder(BYTE_BPE)
    library, own, byte_library, byte_own = test_any_text.pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode([text])[0][1] == " ".join(map(str, ids))
    assert byte_own.encode([text])[0].tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_overlapping_merges():
    with open(WORD_BPE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges, library = Merges(model["vocab"], model["merges"], "</w>"), Library.from_file(WORD_BPE)
    words = ["l" * k for k in range(1, 40)] + ["ab" * k for k in range(1, 20)]
    ids, bounds = merges.encode([w.encode() for w in words])
    for w, a, b in zip(words, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(w, add_special_tokens=False).ids


def test_bpe_rows(odd, none):
    library = Library.from_file(WORD_BPE)
    got = encode(odd, WORD_BPE, keep=["lang", "rep"])
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded", "lang", "rep"]
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in ODD]
    same([(r["doc_id"], r["ids"]) for r in got.collect()], want)
    digests = {r["doc_id"]: r["ids_sha256"] for r in encode_digests(odd, WORD_BPE).collect()}
    assert all(digests[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for i, ids in want)
    assert encode(none, WORD_BPE).count() == 0


def blocks(seed, kinds, n=30):
    r = np.random.default_rng(seed)
    few = r.integers(0, kinds, 12)
    return [np.where(r.random(k) < 0.7, r.choice(few, k), r.integers(0, kinds, k)) for k in [0, 1, 2, 300, *r.integers(1, 80, n)]]


def test_bpe_keeps_columns_with_its_own_names(spark):
    docs = spark.createDataFrame([(1, "two words", "a", 5, "b")], "doc_id long, text string, ids string, n_tokens int, source string")
    out = encode(docs, WORD_BPE, keep=["ids", "n_tokens", "source"])
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded", "input_ids", "input_n_tokens", "source"]
    assert out.select("input_ids", "input_n_tokens", "source").first() == ("a", 5, "b")
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, n_tokens int, input_n_tokens int, input_input_n_tokens int")
    out = encode(docs, WORD_BPE, keep=["n_tokens", "input_n_tokens", "input_input_n_tokens"])
    assert len({c.lower() for c in out.columns}) == 7 and out.first()[4:] == (5, 6, 7)


def test_search_tables_of_a_large_benchmark_are_small():
    """A block of 4 MiB takes less than 125 MB, so the largest of 16 MiB stays under 500 MB."""
    r = random.Random(1)
    words = [f"w{r.randrange(10**5)}" for _ in range(20_000)]
    items = [(i, " ".join(r.choice(words) for _ in range(200))) for i in range(3_000)]
    built = tables(items, 10)
    size = sum(x.nbytes for t in built for x in (t.words.data, t.words.starts, t.words.ends, t.blocks, t.steps, t.suffix, t.firsts, t.owners))
    assert size / sum(len(t) for _, t in items) < 125 / 4


@pytest.mark.parametrize("most", [1 << 17, 20])
@pytest.mark.parametrize("kinds", [1, 2, 50_257, 65_536, 65_537, 2**31])
def test_range_coder_round_trip(kinds, most, monkeypatch):
    monkeypatch.setattr(range_coder, "MOST", most)
    some = blocks(kinds % 97, kinds)
    table, coded = encode_blocks(some)
    assert all(np.array_equal(a, b) for a, b in zip(some, decode_blocks(table, coded, list(map(len, some)))))
    one = decode_blocks(table, [coded[5]], [len(some[5])])[0]
    assert np.array_equal(one, some[5])


def test_range_coder_uses_context():
    text = np.tile(np.arange(40) * 1000, 50)[:2000]
    table, coded = encode_blocks([text])
    assert len(table) + len(coded[0]) < len(text) * 2 / 4


def test_range_coder_beats_plain_coders():
    """Fewer bytes an id, with its tables, than zlib over 16-bit ids and than the entropy of the ids' own frequencies."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    ids, counts = Encoder(BYTE_BPE).encode([t or "" for t in texts])
    assert counts.sum() == len(ids) > 500_000
    table, coded = encode_blocks([ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)])
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(table) + sum(map(len, coded)) < min(len(zlib.compress(ids.astype("<u2").tobytes(), 6)), -(share * np.log2(share)).sum() / 8 * len(ids))


def test_range_coder_carries_and_damage():
    """Ids whose shares lie at the top of the range bring carries; a damaged block ends, with other ids."""
    r = np.random.default_rng(3)
    some = [np.where(r.random(k) < p, 50_000, r.integers(0, 50_001, k)).astype(np.int32) for k, p in [(3_000, 0.999), (2_000, 0.5), (1, 1.0), (0, 0.5), (700, 0.0)] * 20]
    table, coded = encode_blocks(some)
    sizes = list(map(len, some))
    assert all(np.array_equal(a, b) for a, b in zip(some, decode_blocks(table, coded, sizes)))
    bad = [b"\xff" * len(c) if k % 2 else c[: len(c) // 2] for k, c in enumerate(coded)]
    assert [len(x) for x in decode_blocks(table, bad, sizes)] == sizes


def test_words_are_asked_of_the_model_alone(monkeypatch):
    """Words need no pattern of the library's, so only the other pieces pay for it; and each is asked for once."""
    asked = []

    class Counted:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.own.encode_batch_fast(texts, **options)

    encoder, library = Encoder(BYTE_BPE), Library.from_file(BYTE_BPE)
    encoder.tokenizer = Counted(encoder.tokenizer)
    texts = ["Eine größere Straße, où l'été finit. ciónrallado", "größere Straße"] * 3
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert not any("Straße" in t or "rallado" in t for t in asked)
    before = len(asked)
    encoder.encode(texts)
    assert len(asked) == before


def test_pieces_met_often_are_remembered(monkeypatch):
    monkeypatch.setattr(token_file, "REMEMBERED", 40)
    encoder, library = Encoder(BYTE_BPE), Library.from_file(BYTE_BPE)
    for k in range(12):
        texts = pa.array([None, "often met, these words", "", *(f"n{chr(97 + k)}{chr(97 + j)} w{k}.{j}" for j in range(8)), None, "<|endoftext|> met"]).slice(k % 3)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        ids, counts = encoder.encode(texts)
        assert (ids.tolist(), counts.tolist()) == ([i for w in want for i in w], [len(w) for w in want])
        assert k == 0 or k % 3 == 2 or " these" in encoder.place
    assert len(encoder.place) < 12 * 16


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab'sZ \n\t,.1\x1c\x85\xa0\xaaé×÷ßĀȿɀ\u0301\u1680\u2003\u2028\u202f\u205f\u3000\u200b日😀", max_size=12), max_size=8))
def test_pieces_of_many_texts(texts):
    if not hasattr(test_pieces_of_many_texts, "pair"):
        test_pieces_of_many_texts.pair = Library.from_file(BYTE_BPE), Encoder(BYTE_BPE)
    library, own = test_pieces_of_many_texts.pair
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = own.encode(texts)
    assert (ids.tolist(), counts.tolist()) == ([i for w in want for i in w], [len(w) for w in want])


def test_token_file(spark, odd, none, tmp_path):
    library = Library.from_file(BYTE_BPE)
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(STRANGE)] + [(1000 + i, t) for i, t in corpus(7, 30)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(extra).repartition(5)
    path = f"file://{tmp_path}/tokens"
    write_token_file(docs, path, BYTE_BPE, 2, segment_ids=500, part_bytes=30_000)
    rows = sorted(read_token_file(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    at, text = 0, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        want = [*library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(want), want)
        at += len(want)
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in read_token_file(spark, path, digests=True).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}
    write_token_file(none, path + "-none", BYTE_BPE, 2)
    assert read_token_file(spark, path + "-none").count() == 0


def test_loser_tree():
    r = random.Random(3)
    for k in [0, 1, 2, 3, 7, 16]:
        runs = [sorted(r.randrange(20) for _ in range(r.choice([0, 1, 5, 30]))) for _ in range(k)]
        got = list(merge(runs))
        assert [runs[a][b] for a, b in got] == sorted(x for run in runs for x in run)
        assert got == sorted(got, key=lambda x: (runs[x[0]][x[1]], x[0], x[1]))


PAGES = [
    (1, "http://www.example.com/b?x=1", "<p>é" + "y" * 200), (2, "https://example.com:8080/a", "<p>é" + "y" * 200), (3, "http://example.com/b?x=1", "short"), (4, None, "short"),
    (5, "http://u@a.org/\r\nX-Page: 9", None), (6, "no url", ""), (None, "http://example.com/", "<p>é" + "y" * 200), (0, "http://example.com/z", "z" * 99 + "\r\n\r\nWARC/1.1\r\n"), (7, "http://example.com/z", "z" * 99 + "\r\n\r\nWARC/1.1\r\n"), (7, "http://example.com/z", "z" * 99 + "\r\n\r\nWARC/1.1\r\n"),
]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "t", 1) for p in PAGES], "page_id long, url string, html string, archive string, first int")
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        again = i is not None and h in first and i > first[h]
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    got = archive_and_index(pages, archive_bytes=200).collect()
    same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], want)
    ordered = sorted(got, key=lambda r: (r["part"], r["place"]))
    keys = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in ordered]
    assert keys == sorted(keys)
    assert "com,example)/b?x=1" in {r["url_key"] for r in got}
    write_archives(pages, f"file://{tmp_path}/warc")
    bodies = []
    for file in (tmp_path / "warc").glob("part-*"):
        for headers, block, _, _ in parse(gzip.open(io.BytesIO(file.read_bytes()))):
            if headers["warc-type"] == "response":
                bodies.append(block.partition(b"\r\n\r\n")[2].decode())
    assert sorted(bodies) == sorted(h or "" for (_, _, h), w in zip(PAGES, want) if w[3] == "response")
    assert archive_and_index(pages.limit(0)).count() == 0


def test_a_broken_archive():
    with pytest.raises(ValueError):
        list(parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(parse(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))
