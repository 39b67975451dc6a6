import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from softseek.llm import token_files, word_ids
from softseek.llm.token_counts import Counter, pieces, token_count
from softseek.llm.queries import op1_token_counts, op6_token_files
from softseek.session import scratch_path

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["a", "B", " ", "  ", "\n", "\t", "\r", "é", "İ", "ſ", "K", "1", "²", "!", "$$$", "<|endoftext|>", "<|startoftext|>", "'s", "'", "'LL",
         "\x1c", "\x85", "\xa0", "　", "̈", "中", "😀", "the", "\n\n", " \n", "\x00", "​"]


def texts(n=5000):
    random.seed(5)
    return ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(n)]


def test_pieces_join_to_the_text():
    assert all("".join(pieces(t)) == t for t in texts())


def test_counts_equal_the_library():
    whole, counter = Tokenizer.from_file(BYTES), Counter(BYTES, 64)
    for t in [*texts(), "word " * 50_000, "x" * 20_000]:
        assert counter.count([t]) == [len(whole.encode(t, add_special_tokens=False).ids)]


def test_ids_equal_the_library():
    whole, encoder = Tokenizer.from_file(WORDS), word_ids.WordEncoder(WORDS)
    for t in [*texts(), "word " * 50_000, "x" * 20_000]:
        assert np.frombuffer(encoder.encode([t])[0], np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_ids_of_columns_with_little_memory():
    whole, encoder = Tokenizer.from_file(WORDS), word_ids.WordEncoder(WORDS, max_bytes=20_000)
    some = [*texts(2000), None, "", "x" * 300_000, "The THE the the"]
    for _ in range(2):
        for at in range(0, len(some), 37):
            part = some[at : at + 37]
            ids, counts = encoder.encode_column(pa.array(part, pa.string()))
            want = [whole.encode(t or "", add_special_tokens=False).ids for t in part]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
            assert encoder.memory.nbytes() < 20_000 + 10_000
    ids, counts = encoder.encode_column(pa.array([], pa.string()))
    assert len(ids) == len(counts) == 0


def test_memory_is_bounded():
    counter = Counter(BYTES, 64)
    memo = counter.memo
    memo.size = 10
    for t in texts(300):
        counter.count([t])
        assert len(memo.young) < 60 and len(memo.old) < 60


def test_query_counts(spark, sf):
    whole = Tokenizer.from_file(BYTES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(whole.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


@pytest.mark.parametrize("path", [BYTES, PIECES])
def test_odd_rows(odd, none, path):
    got = odd.select("text", token_count("text", path).alias("n")).collect()
    if path == PIECES:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        assert all(r.n == (len(model.encode(r.text)) if r.text else 0) for r in got)
    assert all((r.n == 0) == (not r.text) for r in got if r.text is None or not r.text.isspace())
    assert none.select(token_count(F.col("text"), path)).count() == 0


def check(rows, docs, end=2):
    whole = Tokenizer.from_file(WORDS)
    want, start = [], 0
    for doc_id, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, end]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_query_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    check(op6_token_files(spark, sf).collect(), [(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("dictionary", [True, False])
def test_files_round_trip(spark, odd, dictionary):
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(odd, folder, WORDS, dictionary=dictionary, page_bytes=1024)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")
    docs = [(r.doc_id, r.text) for r in sorted(odd.collect(), key=key)]
    back = token_files.read_tokens(spark, folder)
    check(token_files.checksums(back).collect(), docs)
    one = back.where("doc_id = 6").first()
    assert one.tokens == [*Tokenizer.from_file(WORDS).encode("one two", add_special_tokens=False).ids, 2]
    plan = back.where("doc_id = 6").select("n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("Physical Plan")[1].split("ReadSchema")[1].split("\n")[0]


def test_no_files(spark, none):
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(none, folder, WORDS)
    assert token_files.read_tokens(spark, folder).count() == 0
