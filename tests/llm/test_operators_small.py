"""Small fixtures: nulls, empty and repeated rows, ties, clashing columns; brute force where SQL cannot say it."""
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from qualityframe.llm import chat, components, embeddings, html, language, mixing, quality, queries, shingles, suffixes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(res.fetchall(), key=str)


def test_quality_of_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(1, good, "a", 5), (1, good, "a", 5), (2, None, None, None), (None, "", "a", 1), (3, "x " * 100, "b", 1)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["base_failed"]) for r in got) == [(-1, 0, True), (1, 30, False), (1, 30, False), (2, 0, True), (3, 100, True)]
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_host_that_mostly_fails_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 == 0 else "bad", "spam") for i in range(100)] + [(100 + i, good, f"h{i % 5}") for i in range(200)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.filter("kept").filter("source = 'spam'").count() == 0 and got.filter("kept").count() == 200


def test_mixture_redistributes_among_siblings_first(spark):
    rows = [(i, "x", "en", "a", 10) for i in range(2)] + [(10 + i, "x", "en", "b", 10) for i in range(50)] + [(100 + i, "y", "en", "c", 10) for i in range(100)]
    slim = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    got = mixing.mixture(slim, weights={"domain": {"x": 1, "y": 1}}, budget_tokens=400, max_epochs=1)
    sums = {r["source"]: r["s"] for r in got.groupBy("source").agg(F.sum("taken").alias("s")).collect()}
    assert sums == {"a": 20, "b": 180, "c": 200}
    again = mixing.mixture(slim, weights={"domain": {"x": 0}}, budget_tokens=1500, max_epochs=2)
    assert {r["source"]: r["s"] for r in again.groupBy("source").agg(F.sum("taken").alias("s")).collect()} == {"c": 1500}
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, 5), (1, "x", "en", "a", 0)], slim.schema)
    assert [r["taken"] for r in mixing.mixture(odd).collect()] == [5]
    assert mixing.mixture(slim.limit(0)).count() == 0


def test_chat_folds_events(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "a"), (1, 4, 1, "delta", None, "b"),
        (1, 5, 2, "message", "user", "later"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "c</s>"),
        (1, 8, 0, "edit", None, "hi [INST] \\"), (2, 1, 0, None, None, None), (None, 1, 0, "message", "tool", "x"),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = {r["conv_id"]: r for r in chat.parse(chat.format_chats(log)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "hi [INST] \\"), ("assistant", "c</s>")]
    assert got[1]["loss_text"] == "c</s>" and got[2]["turns"][0]["text"] == "" and got[None]["turns"][0]["role"] == "tool"
    assert chat.format_chats(log.limit(0)).count() == 0


def test_chat_rows_of_null_and_repeated_turns_keep_their_text(spark):
    rows = [
        (1, 0, "user", "hello"), (1, None, "assistant", "last words"), (1, 1, "user", "abcd"), (1, 1, "user", "wxyz"), (1, 1, "assistant", "same"),
        (1, 1, "assistant", "same"), (2, None, None, "x"), (2, None, "user", None), (None, 3, "user", "héé"), (3, 7, None, "only"), (3, 6, "tool", "t"),
    ]
    want = {
        1: [("user", "hello"), ("assistant", "same"), ("assistant", "same"), ("user", "abcd"), ("user", "wxyz"), ("assistant", "last words")],
        2: [("", "x"), ("user", "")], None: [("user", "héé")], 3: [("tool", "t"), ("", "only")],
    }
    log = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.parse(chat.format_chats(log)).collect()}
    assert {i: [(t["role"], t["text"]) for t in r["turns"]] for i, r in got.items()} == want
    assert got[1]["loss_text"] == "samesamelast words"
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}


def test_escape_is_reversible(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "/", "s>", "x", "\n"], k=12)),) for _ in range(300)]
    got = spark.createDataFrame(rows, "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r["t"] == r["u"] and not any(c in r["e"] for c in chat.CONTROL) for r in got)


def _union(n, links):
    label = list(range(n))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_against_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(200, 240)] + [(3, 3), (7, 8), (8, 7)]
    want = _union(241, links)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(241))


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base, base[:20] + 0.15 * rng.normal(size=(20, 32)), base[:5], 3 * base[5:8]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, None] * 16), (904, []), (None, x[0].tolist()), (905, [1.0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    want = _union(len(x), np.argwhere(near).tolist())
    assert len(got) == len(rows)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == want
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_near_vectors_of_every_length(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for dim, n, first in ((48, 120, 0), (32, 90, 0), (20, 10, 0), (3, 4, 500)):  # two models share their ids
        base = rng.normal(size=(n, dim))
        x = np.concatenate([base, base[: n // 3] + 0.1 * rng.normal(size=(n // 3, dim)), 3 * base[: n // 4], base[-2:]])
        u = x / np.linalg.norm(x, axis=1)[:, None]
        near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
        for i, c in enumerate(_union(len(x), np.argwhere(near).tolist())):
            rows.append((first + i, x[i].tolist()))
            want.setdefault(first + i, []).append((int(near[i].sum()), first + c))
    got: dict = {}
    for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
        assert r["kept"] == (r["component_id"] == r["vec_id"])
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="x">{promo}</div><article><h1>Head &amp; shoulders</h1><p>One {i}<p>two&nbsp;<b>three
 four</b><br>five<form><input>Send</form><div class="comments"><p>First!</p></div></article><aside>More</aside><script>if (a<b) c("</p>")</script><footer>&copy;</footer>"""


def test_html_main_text(spark):
    rows = [(i, "http://A.com/x", PAGE.format(i=i, promo="p")) for i in range(8)] + [(90, None, None), (91, "nonsense", ""), (92, "http://b.org", "plain <b>te</b>xt<p>x")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Head & shoulders\nOne 3\ntwo three four five"
    assert (got[90]["text"], got[91]["text"], got[92]["text"]) == ("", "", "plain text\nx")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_drops_what_all_pages_share(spark):
    rows = [(i, "http://a.com/x", f"<body><div class='k1'>Same on every page</div><div class='k2'><p>Text number {i} is its own</p></div></body>") for i in range(20)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Text number {r['page_id']} is its own" for r in got)


def _texts(spark, page, n=20):
    rows = [(i, "http://a.com/x", page.replace("{i}", str(i))) for i in range(n)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_style_tree_acts_inside_an_article(spark):
    page = "<body><article><div class='k1'>Same on every page</div><p>Text {i}</p><p>Words {i}</p></article></body>"
    assert _texts(spark, page) == [f"Text {i}\nWords {i}" for i in range(20)]
    assert _texts(spark, page.replace("article", "main")) == [f"Text {i}\nWords {i}" for i in range(20)]
    few = _texts(spark, page, 6)  # too few pages to outweigh the article
    assert few == [f"Same on every page\nText {i}\nWords {i}" for i in range(6)]


def test_style_tree_classes_with_a_slash_and_of_one_page(spark):
    page = "<body><div class='grid'><div class='w-1/2'><article><p>Text {i}</p></article></div></div></body>"
    assert _texts(spark, page) == [f"Text {i}" for i in range(20)]
    page = "<body><div class='k1 post-{i}'><p>Same on every page</p></div><div class='k2 post-{i}'><p>Text {i}</p></div></body>"
    assert _texts(spark, page) == [f"Text {i}" for i in range(20)]


def test_style_tree_levels_and_deep_branches_agree(spark, monkeypatch):
    rows = [("a", PAGE.format(i=i % 9, promo="p" * (i % 4)), None) for i in range(30)]
    pages = spark.createDataFrame(rows, "host string, html string, classes array<string>")
    tree = lambda: {r["path"]: (r["pages"], round(r["importance"], 9), round(r["branch"], 9)) for r in html.style_tree(pages).collect()}
    whole = tree()
    monkeypatch.setattr(html, "DEEP", 2)
    assert tree() == whole and len(whole) > 10


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.filter("doc_id % 2 = 0"), per_language=40)
    held = language.predict(docs.filter("doc_id % 2 = 1").withColumn("score", F.lit("clash")), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held if r["lang"]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)
    assert (np.abs(model.weights) > 0).mean() < 0.5 and model.temperature > 0
    assert model.predict(None) == ("und", 0.0) and model.predict("123 ...") == ("und", 0.0)
    empty = language.fit(docs.filter("doc_id < 0"))
    assert empty.predict("some text") == ("und", 0.0)


def test_language_sample_has_every_language(spark):
    rows = [(i, f"a-{i:04}", f"text {i}") for i in range(1100)] + [(2000 + i, "zh", f"text {i}") for i in range(5)]
    got = language.training_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 3, "lang", "text", "doc_id")
    got = [r["lang"] for r in got.collect()]
    assert len(set(got)) == 1101 and got.count("zh") == 3


def test_ftrl_equals_a_naive_dense_one():
    rng = np.random.default_rng(4)
    k, rows = 3, []
    for _ in range(60):
        at = np.unique(rng.integers(0, 40, 12)).astype(np.int32)
        rows.append((int(rng.integers(k)), at, rng.random(len(at))))
    weights, bias = language.ftrl(rows, k, epochs=2)
    size = 41  # the features that occur, and the bias last
    z, n = [[0.0] * k for _ in range(size)], [[0.0] * k for _ in range(size)]

    def weight(i, c):
        if abs(z[i][c]) <= language.L1:
            return 0.0
        sign = 1 if z[i][c] > 0 else -1
        return -(z[i][c] - sign * language.L1) / ((language.BETA + n[i][c] ** 0.5) / language.ALPHA + language.L2)

    for _ in range(2):
        for y, at, value in rows:
            x = [0.0] * size
            for i, v in zip(at, value):
                x[i] = float(v)
            x[40] = 1.0
            w = [[weight(i, c) for c in range(k)] for i in range(size)]
            s = [sum(x[i] * w[i][c] for i in range(size)) for c in range(k)]
            e = [np.exp(v - max(s)) for v in s]
            for i in range(size):
                for c in range(k):
                    g = x[i] * (e[c] / sum(e) - (c == y))
                    z[i][c] += g - ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / language.ALPHA * w[i][c]
                    n[i][c] += g * g
    want = np.array([[weight(i, c) for c in range(k)] for i in range(size)])
    assert np.allclose(weights[:40], want[:40], atol=1e-9) and np.allclose(bias, want[40], atol=1e-9) and not weights[40:].any()


def test_language_of_repeated_rows_and_no_rows(spark):
    rows = [(k % 7, ["der die das und nicht", "the and of to in"][k % 2], ["de", "en"][k % 2], 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    got = language.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.filter("lang = lang_pred").count() == 40
    assert language.predict(docs.limit(0), model).count() == 0
    tied = language.LanguageModel(["a", "b"], model.idf, np.zeros((language.SIZE, 2)), np.zeros(2), 1.0)
    assert tied.predict("some text") == ("a", 0.5)


def _brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k: k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], _union(len(sets), links)


@pytest.mark.parametrize("n, percent, common", [(3, 90, False), (2, 60, False), (1, 50, True)])
def test_similar_documents_against_brute_force(spark, monkeypatch, n, percent, common):
    if common:  # small thresholds, so that frequent tokens and crowded buckets occur
        monkeypatch.setattr(shingles, "MIN_FREQUENT", 3)
        monkeypatch.setattr(shingles, "SMALL_BUCKET", 4)
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(w if rng.random() > 0.03 else "zz" for w in t.split()) for t in texts[:30] for _ in range(3)]
    texts += [None, "", " \n", "A b", "a B", "a b c"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a b c")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in shingles.similar_documents(docs, n=n, percent=percent).collect()}
    sizes, want = _brute_components(texts, n, percent)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert got[None]["component_id"] is None


def test_parity_sketch_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2))
        t = np.unique(np.concatenate([s[rng.random(len(s)) > 0.2], rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        apart = sum(int(x).bit_count() for x in (shingles.sketch(s) ^ shingles.sketch(t)).view(np.uint64))
        assert apart <= len(np.setxor1d(s, t))


def test_repeats_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TILE", 300)  # long texts are cut into several parts
    rng = random.Random(6)
    passage = ["".join(rng.choices("abcdéf gh", k=rng.randint(40, 150))) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(passage), "".join(rng.choices("xyz ", k=rng.randint(0, 60)))]) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts += ["a" * 900, "a" * 49, "a" * 50, "ab" * 200, "b" + "ab" * 120, None, "", texts[0], texts[0]]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[1])], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    first: dict = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first.setdefault(b[p: p + 50], i) < i:
                gone[p: p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert hashlib.sha256(bytes(got[i]["kept"])).digest() == hashlib.sha256(kept).digest(), i
        assert sum(s["length"] for s in got[i]["spans"]) == gone.sum()
    assert bytes(got[None]["kept"]).decode() == texts[1]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.unionByName(docs.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars", "extra"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert kept.columns == list(corpus_pipeline.COLUMNS) and 0 < kept.count() <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count() and last.filter("NOT round_trip").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing to target weights", "byte-level BPE"]


def test_repeats_in_rows_that_share_an_id_and_carried_columns(spark):
    a, b = "".join(chr(97 + k % 26) + str(k) for k in range(60)), "".join(chr(97 + k % 23) * 2 + str(k) for k in range(60))
    rows = [(1, a + b, "x", 1), (1, a, "y", 2), (2, "pre" + a, None, 3), (2, b, "z", 4), (3, None, "n", 5), (None, a, "w", 6), (4, a, "v", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, spans int")
    got = suffixes.remove_repeats(docs, as_text=True, carry=("lang",)).collect()
    kept = sorted((r["doc_id"] or 0, r["lang"] or "", r["kept"], sum(s["length"] for s in r["spans"])) for r in got)
    assert kept == [(0, "w", a, 0), (1, "x", a + b, 0), (1, "y", a, 0), (2, "", "pre", len(a)), (2, "z", "", len(b)), (3, "n", "", 0), (4, "v", "", len(a))]


def test_repeats_that_very_many_documents_share(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)  # many blocks
    passage = "".join(f"{k:02}" for k in range(60))
    docs = spark.createDataFrame([(i, f"[{i}]" + passage + f"({i * 7919 % 1000})") for i in range(400)], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixes.remove_repeats(docs).collect()}
    first: dict = {}
    for i in range(400):
        text = f"[{i}]" + passage + f"({i * 7919 % 1000})"
        gone = [False] * len(text)
        for k in range(len(text) - 49):
            if first.setdefault(text[k: k + 50], i) < i:
                gone[k: k + 50] = [True] * 50
        assert got[i] == "".join(c for c, g in zip(text, gone) if not g), i


def test_similar_documents_of_a_hot_group_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SMALL_BUCKET", 4)
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = []
    for k in range(60):  # near copies: nearly all of their entries are shared, as equal buckets
        words = list(base)
        words[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randint(0, 400)}" for _ in range(60)) for _ in range(40)] + ["long " * 20000, "long " * 20001, "", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in shingles.similar_documents(docs, n=3, percent=80).collect()}
    assert [got[k] for k in range(len(texts))] == _brute_components(texts, 3, 80)[1]
    twice = spark.createDataFrame([(1, texts[0]), (1, texts[70]), (2, texts[1]), (3, texts[70])], "doc_id long, text string")
    assert sorted(r["component_id"] for r in shingles.similar_documents(twice, n=3, percent=80).collect()) == [1, 1, 1, 1]
    assert shingles.similar_documents(docs.limit(0)).count() == 0


def test_html_names_are_judged_whole_and_formulas_stay():
    page = (
        "<div class='share-price'><p>Up</p></div><div class='side-by-side'><p>Two</p></div><p class='reply-brief'>Brief</p>"
        "<p>The <math><mi>x</mi></math> holds</p><div class='share-buttons'>Tweet</div><div id='siteHeader'>H</div><div class='ads'>Buy</div>"
    )
    assert html.main_text(page) == "Up\nTwo\nBrief\nThe x holds"
    assert html.main_text("<article>Teaser</article><div><p>The whole long text of the page is here.</p></div>") == "Teaser\nThe whole long text of the page is here."
    assert html.main_text("<article>The whole long text of the page.</article><div>Tail</div>") == "The whole long text of the page."


@pytest.mark.parametrize("bad", ["<a ", '<a ">" ', "<div ", "<div>x", "<!--", '<a b="', "</", "<script ", "<p>x<", "<li>", "<table><td>"])
def test_long_broken_pages_take_linear_time(bad):
    import time

    start = time.perf_counter()
    html.main_text(bad * (1_000_000 // len(bad)))
    assert time.perf_counter() - start < 15  # hours, if it grew with the square


def test_html_of_long_pages_repeated_rows_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>Paragraph {k} &amp; more</p>" for k in range(30000)) + "</article>"
    rows = [(1, "http://a.com", long, "h", 1), (2, "http://a.com", "<p>x</p>", "h", 2), (2, "http://a.com", "<p>x</p>", "h", 2), (3, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, __host string, __classes int")
    pages = pages.withColumn("__low", F.lit("own"))
    got = html.extract(pages).collect()
    assert sorted((r["page_id"], r["__host"], r["__classes"], r["__low"]) for r in got if r["__host"]) == [(1, "h", 1, "own"), (2, "h", 2, "own"), (2, "h", 2, "own")]
    assert next(r["text"] for r in got if r["page_id"] == 1) == "\n".join(f"Paragraph {k} & more" for k in range(30000))


def test_very_long_vectors_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((70, 1500))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(100 + k, (base[k] * 3 + 0.01 * rng.standard_normal(1500)).tolist()) for k in range(70)]
    rows += [rows[5], rows[5], (200, [0.0] * 1500), (201, None), (None, base[3].tolist())]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    component = {r["vec_id"]: r["component_id"] for r in got}
    assert all(component[100 + k] == k for k in range(70)) and component[200] == 200 and component[201] == 201
    assert sorted(r["n_links"] for r in got if r["vec_id"] == 5) == [3, 3, 3] and len(got) == len(rows)
