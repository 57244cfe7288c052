import public_tokenizers
import pytest

from stratafile.llm import token_counts as op

ODD = ["a<|endoftext|>b x'sy 'S don't 12 3４ é e\u0301 \u0301a \u00a0x\u2003y İI ﬁ", "<|startoftext|> <|endoftext", "", None, " \n", "日本語 text\x85a\x1cb\x1d c", "a\x00b", "word " * 30_000, "x" * 5_000, "a  b", "a b", "a\tb", "\u2028", "İstanbul ΣΑΣ ς"]


def direct(path, texts):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(x) for x in p.encode([x or "" for x in texts], num_threads=1)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys_and_the_cache_is_used(spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, t, 7, "k") for i, t in enumerate(ODD * 2)] + [(3, ODD[0], 7, "k"), (None, ODD[1], 7, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, digest string")
    cache = op.scratch(spark, "test-cache")
    want = sorted(((r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, direct(path, [r[1] for r in rows]))), key=str)
    first = sorted((tuple(r) for r in op.token_counts(docs.limit(9), path, cache).collect()), key=str)
    assert set(first) <= set(want)
    size = op.read_cache(spark, cache).count()
    assert sorted((tuple(r) for r in op.token_counts(docs, path, cache).collect()), key=str) == want
    grown = op.read_cache(spark, cache).count()
    assert sorted((tuple(r) for r in op.token_counts(docs, path, cache).collect()), key=str) == want
    assert size < grown == op.read_cache(spark, cache).count() == op.read_cache(spark, cache).distinct().count()
    assert op.token_counts(docs.limit(0), path, cache).collect() == []


def test_ids_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_IDS", 0)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in op.token_counts(docs, path).collect()) == [(1, 3, 2), (2, 3, 2), (3, 0, 0), (4, 1, 1)]


def test_pieces_are_forgotten_and_taken_over(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"the cat {i} word{i % 7} other{i}" for i in range(200)]
    monkeypatch.setattr(op, "REMEMBERED", 20)
    count = op.Counter(path)
    assert count(texts) == direct(path, texts) and len(count.seen) <= 30 and count.old


def test_a_repeated_append_does_not_multiply_documents(spark):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), op.scratch(spark, "test-cache")
    docs = spark.createDataFrame([(1, "a b c"), (2, "d"), (2, "another text of the same id"), (None, "x " * 200_000)], "doc_id long, text string")
    first = sorted((tuple(r) for r in op.token_counts(docs, path, cache).collect()), key=str)
    op.read_cache(spark, cache).coalesce(1).write.mode("append").parquet(cache)  # a second writer that saw the same misses
    assert sorted((tuple(r) for r in op.token_counts(docs, path, cache).collect()), key=str) == first and len(first) == 4
    assert [r[2] for r in first] == [n for _, n in sorted(zip(map(str, [(r[0], len(r[1].encode())) for r in docs.collect()]), direct(path, [r[1] for r in docs.collect()])))]
