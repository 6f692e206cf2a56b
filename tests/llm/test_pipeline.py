"""The pipeline against its stages by hand; only language predictions come from the operator."""

import hashlib

import public_tokenizers
from gristmill.llm.language_id import identify
from test_dedup import lines_by_hand, near_by_hand
from test_text import hits_by_hand
from tokenizers import Tokenizer

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "123", None, "s", 3)], docs.schema)
    docs = docs.where("doc_id < 120").union(odd)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{source}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}

    lang = {r["doc_id"]: r["lang_pred"] for r in identify(docs).where("lang_pred <> 'und' and score >= 0.3").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in lang]
    rows = [(i, t) for i, _, _, t in lines_by_hand(rows)]
    keep = {i for i, _, _, kept in near_by_hand(rows) if kept}
    rows = [(i, t) for i, t in rows if i in keep]
    clean = {i for i, _, hits, _ in hits_by_hand(rows, [(r["item_id"], r["text"]) for r in items.collect()]) if not hits}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: " ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for i, t in rows if i in clean}
    assert set(got) == set(want) and len(want) < 120
    for i, t in rows:
        if i in clean:
            assert got[i]["ids_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()
            assert (got[i]["lang"], got[i]["n_chars"]) == (lang[i], len(t))
