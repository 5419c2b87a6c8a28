"""Resampling, conversation trie and line dedup against plain Python on odd rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from qualityframe.llm import lines, resampling, trie

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text):
    ws = WORD.findall((text or "").translate(UPPER))
    return len(ws), [zlib.crc32(" ".join(ws[i: i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def plain_resample(rows, target, percent, min_words):
    s, t = Counter(), Counter()
    for text in target:
        t.update(grams(text)[1])
    for _, text in rows:
        s.update(grams(text)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    out = []
    for ident, text in rows:
        n, g = grams(text)
        h = int(hashlib.sha256(f"42:{'null' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        out.append([ident, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(fit):
        r.append(k + 1 if k < len(fit) * percent // 100 else None)
    return sorted((tuple(r[:1] + r[2:5] + (r[5:] or [None])) for r in out), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "ñandú", "日本", "x9", "9", "É", "longword" * 40]
    made = [rng.choice([" ", "\n", "\x00", "-", "  "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    return [(k, t) for k, t in enumerate(made)] + [(200, None), (201, ""), (202, made[0]), (202, made[0]), (None, made[1]), (203, " ".join(vocabulary) * 3000)]


def test_resampling_equals_plain_python(spark, texts, monkeypatch):
    target = ["alpha BETA x9", None, "", "ñandú ñandú É"]
    df = spark.createDataFrame([(i, t, "a", 7) for i, t in texts], "doc_id long, text string, weight string, rank int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain_resample(texts, target, 30, 5)
    for group, block in ((4_000_000, 1 << 17), (300, 3)):
        monkeypatch.setattr(resampling, "GROUP_BYTES", group)
        monkeypatch.setattr(resampling, "BLOCK_WORDS", block)
        got = resampling.importance_resample(df, goal, percent=30, min_words=5)
        assert {"text", "n_words"} <= set(got.columns)
        assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == want


def test_resampling_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_resample(df, df).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [(r["n_features"], r["rank"]) for r in resampling.importance_resample(one, df, percent=100).collect()] == [(87, 1)]


def plain_trie(rows, block=20, openings=4):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % openings
        model = c - int(math.fmod(c, block))
        turns = tuple(own.get(model, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * words
    return sorted(
        ((m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()),
        key=str,
    )


@pytest.mark.parametrize("height", [2, 8])
def test_trie_equals_plain_python(spark, height):
    rng = random.Random(3)
    says = ["hi there", "a  b c", "", None, "ok\nok", "é x"]
    rows = [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(says)) for c in range(45) if c not in (20, 7) for t in range(rng.randint(1, 6))]
    rows += [(3, 50 + k, "user", f"w{k} x") for k in range(40)]  # long
    rows += [(4, 9, "user", "same"), (4, 9, "user", "same"), (4, 9, "tool", "other"), (None, 1, "user", "lost"), (-5, 1, "user", "minus"), (101, 0, "user", "alone")]
    rows += [(c, k, "user", "copy") for c in range(400, 420) for k in range(5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, key int")
    got = trie.prefix_trie(*trie.with_shared_openings(trie.numbered_turns(df)), height=height)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.with_shared_openings(trie.numbered_turns(empty))).count() == 0


def test_end_lists_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rows = [(k, "user", "same") for k in range(11)]
    df = spark.createDataFrame(rows, "conv_id long, role string, text string").selectExpr("conv_id", "1 turn", "role", "text")
    turns = trie.numbered_turns(df)
    got = {r["depth"]: r["ends_sha256"] for r in trie.prefix_trie(turns, turns.select("conv_id").distinct()).collect()}
    assert got == {0: hashlib.sha256(b"").hexdigest(), 1: hashlib.sha256(",".join(map(str, range(11))).encode()).hexdigest()}


def plain_lines(rows, min_docs, min_chars):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for ident, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if len(key(x)) < min_chars or held[key(x)] < min_docs]
        out.append((ident, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("index_bytes", [lines.INDEX_BYTES, 0])
def test_line_dedup_equals_plain_python(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(lines, "PROBES", 5)
    rng = random.Random(8)
    pool = ["Share this", " share THIS\t", "é", "É", "", "  ", "x", "日本語 text", "a\rb", *(f"line {k}" for k in range(30))]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, rows[0][1]), (73, rows[0][1]), (None, "share this"), (74, "\n".join(f"own {k}" for k in range(20000)))]
    rows += [(100 + k, "the same\ntext") for k in range(40)]  # a group of copies
    df = spark.createDataFrame([(i, t, "a", "b", 3) for i, t in rows], "doc_id long, text string, kept string, mark string, gone int")
    for min_docs, min_chars in ((10, 1), (3, 2), (1, 1)):
        got = lines.drop_common_lines(df, min_docs=min_docs, min_chars=min_chars, index_bytes=index_bytes, shard_keys=3)
        assert got.columns == ["doc_id", "mark", "gone", "n_lines", "n_dropped", "kept"]
        assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == plain_lines(rows, min_docs, min_chars)


@pytest.mark.parametrize("index_bytes", [lines.INDEX_BYTES, 0, -1])
def test_line_dedup_without_rows_or_common_lines(spark, index_bytes):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_common_lines(empty, index_bytes=index_bytes).count() == 0
    one = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert [tuple(r) for r in lines.drop_common_lines(one, index_bytes=index_bytes).collect()] == [(1, 2, 0, "a\nb")]


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(-2**63, 2**63 - 1, (5000, 2)), axis=0)
    h = np.concatenate([h, np.stack([np.full(50, h[0, 0]), np.arange(50)], axis=1)])
    n = rng.integers(1, 70000, len(h))
    index = lines.LineIndex.unpack(**lines.LineIndex.build(h, n).pack())
    assert len(index.prints) == len(h) == int(np.bitwise_count(index.words).sum())
    assert (index.count(h) == n).all()
    assert not index.count(h + 1).any() and not lines.LineIndex.build(h[:0], n[:0]).count(h).any()
