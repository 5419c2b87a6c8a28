import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from qualityframe.llm import bpe, token_files
from qualityframe.llm.pieces import PieceEncoder

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = list("abcdeaaa  \n\t'stre1234.,!?éüñ漢字🙂\x1c\x85<|>#\r\x0b") + ["  ", "the", "ing", " a", "'s", "'ll", " ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 120))) for _ in range(600)]
    return [*made, "", " ", "a" * 5000, "aab" * 2000, "\n" * 500, "abcabc" * 700, "x" + " " * 300 + "y", "".join(rng.choices("etaoin", k=9000))]


@pytest.fixture(scope="module")
def tiktoken_ids(texts):
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    return [e.encode_ordinary(t) for t in texts]


def test_rank_queue_equals_tiktoken(texts, tiktoken_ids):
    got = []
    for ids, bounds in PieceEncoder(bpe._make_encoder(RANKS, P.PATTERN)).encode(texts):
        got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == tiktoken_ids


def test_rank_queue_with_ranks_that_fall_after_a_merge():
    # "abc" ranks below "ab" but can only be reached through it here, so ranks must be revisited
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"abab": 258, b"cab": 259, b"aa": 260, b"aaa": 261}
    reference = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    merger, rng = bpe.RankMerger(ranks), random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(800)]
    ids, bounds = merger.encode([w.encode() for w in words])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [reference.encode_ordinary(w) for w in words]


def test_rank_queue_bitmap_finds_the_lowest():
    queue, rng, held = bpe.RankQueue(50_256), random.Random(1), {}
    for r in rng.sample(range(50_256), 500) + [0, 63, 64, 4095, 4096, 50_255]:
        queue.put(r, np.array([r]))
        queue.put(r, np.array([r + 1]))
        held[r] = 1
    order = []
    while (got := queue.take_first()) is not None:
        order.append(got[0])
        assert got[1].tolist() == [got[0], got[0] + 1]
    assert order == sorted(held)


def test_digests_of_documents(spark, texts, tiktoken_ids):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, None), (None, "a b", "y"), (0, texts[0], "again")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3), RANKS, P.PATTERN).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, ids in enumerate(tiktoken_ids):
        assert by_id[i]["n_tokens"] == len(ids)
        assert by_id[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by_id[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()
    assert by_id[-1]["n_tokens"] == 0 and by_id[None]["n_tokens"] == 2


def test_encode_keeps_other_columns(spark):
    got = bpe.encode(spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, n long"), RANKS, P.PATTERN)
    assert got.columns == ["doc_id", "text", "n", "ids"] and got.first()["n"] == 7
    assert bpe.encode(got.filter("n < 0").drop("ids"), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("vocabulary", [3, 20, 50_257])
@pytest.mark.parametrize("n", [0, 1, 2, 50, 60_000])
def test_repair_round_trip(n, vocabulary):
    ids = np.random.default_rng(n).zipf(1.3, n) % vocabulary
    seq, rules, alive = token_files.compress(ids, vocabulary)
    assert np.array_equal(token_files.expand(seq, rules, vocabulary), ids)
    assert alive.sum() == len(seq)
    lengths = np.concatenate([np.ones(vocabulary, np.int64), token_files.expansion_lengths(rules, vocabulary)])
    assert lengths[seq].sum() == n
    assert not (rules == token_files.END).any()
    if n > 1000:
        assert len(seq) < n


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(8)
    passage = rng.integers(3, 500, 600)
    ids = np.concatenate([np.append(np.concatenate([passage, rng.integers(3, 500, 50)]), token_files.END) for _ in range(40)])
    seq, rules, _ = token_files.compress(ids, 500)
    assert np.array_equal(token_files.expand(seq, rules, 500), ids)
    pairs: dict = {}
    last = {}
    for k, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist())):
        if token_files.END not in pair and last.get(pair) != k - 1:  # uses that do not overlap
            pairs[pair] = pairs.get(pair, 0) + 1
            last[pair] = k
    assert max(pairs.values()) < token_files.MIN_USES


def test_token_files_against_the_library(spark, texts, tmp_path):
    tokenizer = Tokenizer.from_file(JSON)  # as the library is by default
    own = "<|endoftext|>"
    odd = [f"x {own} y", own, f"{own}{own} a  {own} ", f"  {own}\n\n b", f"é{own}é {own[:-1]}", "<|endoftext |>", f"word {own}" * 50]
    assert tokenizer.encode(odd[0], add_special_tokens=False).ids == [87, 220, 50256, 331]
    rows = [(3 * i, t, "x") for i, t in enumerate([*texts, *odd])] + [(-5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    token_files.write_tokens(docs, JSON, str(tmp_path / "a"), shard_tokens=5000)
    got = {r["doc_id"]: r for r in token_files.read_tokens(spark, str(tmp_path / "a")).collect()}
    assert len(got) == len(rows)
    start = 0
    for doc_id, text, _ in sorted(rows):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        row = got[doc_id]
        assert (row["start"], row["n_tokens"]) == (start, len(want))
        assert zlib.crc32(row["ids"]) == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    shards = spark.read.parquet(str(tmp_path / "a")).orderBy("part", "shard").collect()
    assert len(shards) > 3
    for s in shards[:4]:
        names = np.frombuffer(s["doc_ids"], "<i8")
        for k in (0, len(names) - 1):
            alone = token_files.read_document(s.asDict(), k)
            assert np.array(alone, "<u4").tobytes() == bytes(got[names[k]]["ids"])


def test_token_files_with_null_ids_repeats_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    token_files.write_tokens(docs, JSON, str(tmp_path / "a"))
    got = sorted(((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in token_files.read_tokens(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == [(0, 0, 1), (0, 1, 2), (1, 3, 2), (1, 5, 2)]
    token_files.write_tokens(docs.limit(0), JSON, str(tmp_path / "b"))
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0
