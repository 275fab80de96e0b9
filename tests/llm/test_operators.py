"""Each operator against a brute-force version, a library, a round trip or held-out accuracy, and its defined cases."""

import hashlib
import io
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmill.llm import ann, chat, decontam, htmltext, langid, packing, pfor, quality, queries, simhash, tokencount, tokens

ODD = [None, "", " ", "\n", "a", "a", "The the THE!! the,", "x" * 3000, "word " * 20000, "é́ 日本語 🙂 ▁ \x00", "<|endoftext|> I'll </s>"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", 1, 2.0) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", 1, 2.0), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, fp double")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")


@pytest.fixture(scope="session")
def encoder():
    return tokens.WordEncoder(queries.tokenizer("word_bpe_49k.json"))


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


ALPHABET = st.text(st.sampled_from("abTHé e\n▁.,'!<|>s0日🙂\t ́"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=8))
def test_encoder_equals_library(encoder, texts):
    offsets, ids = encoder.encode_ended(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library_ids(texts)


def test_encoder_makes_room(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    small, sizes = tokens.WordEncoder(queries.tokenizer("word_bpe_49k.json")), []
    for k in range(60):
        texts = [f"the same words, again {chr(97 + k % 26)}q{k}x zz{'abc'[k % 3] * (k % 9)} end.", None, "", f"{k} b!{k}"]
        offsets, ids = small.encode_ended(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library_ids(texts)
        sizes.append(len(small.known))
    assert max(sizes) < 60 and any(b < a for a, b in zip(sizes, sizes[1:]))


@pytest.fixture(scope="session")
def counter():
    return tokencount.MergeCounter(queries.tokenizer("piece_bpe_32k.model"))


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=8))
def test_counts_equal_library(counter, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    assert counter.count_texts(pa.array(texts)).tolist() == [len(x) for x in sp.encode(texts)]


def test_op8(spark, sf_dir, docs, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    found = queries.op8_token_counts(spark, sf_dir).toPandas().sort_values("doc_id")
    assert found.n_tokens.tolist() == [len(x) for x in sp.encode(docs.text.tolist())]
    assert found.n_bytes.tolist() == [len(t.encode()) for t in docs.text]
    got = tokencount.count_tokens(odd, queries.tokenizer("piece_bpe_32k.model")).collect()
    assert len(got) == len(ODD) + 2 and {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] is not None} == {i: len(sp.encode(t or "")) for i, t in enumerate(ODD)}
    assert tokencount.count_tokens(none, queries.tokenizer("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [7] * 1024, [0, 2**32 - 1] * 700, list(range(3000)), [3] * 1000 + [70000] * 60])
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    counts = np.array([0, len(ids) // 3, len(ids) - len(ids) // 3, 0])
    out = io.BytesIO()
    w = pfor.ShardWriter(out)
    w.add(np.arange(4), np.array([1, 0, 0, 0]), counts, ids)
    w.close()
    got = list(pfor.read_shard(out, len(out.getvalue())))
    assert [(d, n) for d, n, _ in got] == list(zip([None, 1, 2, 3], counts.tolist())) and np.concatenate([x for *_, x in got]).tolist() == ids.tolist()


def test_op2(spark, sf_dir, docs, odd, none):
    found = queries.op2_token_files(spark, sf_dir).toPandas().sort_values("doc_id")
    ids = library_ids(docs.text)
    assert found.ids_crc32.tolist() == [crc(x) for x in ids] and found.n_tokens.tolist() == [len(x) for x in ids]
    assert found.start.tolist() == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()
    got = pfor.token_files(odd, queries.tokenizer("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    assert [r["ids_crc32"] for r in got if r["doc_id"] not in (None, 3)] == [crc(x) for i, x in enumerate(library_ids(ODD)) if i != 3]
    assert pfor.token_files(none, queries.tokenizer("word_bpe_49k.json")).count() == 0


def check_packed(rows, capacity):
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"] and r["offset"] + r["length"] <= capacity
        by[r["sequence_id"]] = r["offset"] + r["length"]
    return len(by)


def test_op4(spark, sf_dir, docs, odd, none):
    found = queries.op4_best_fit_packing(spark, sf_dir).collect()
    ids = dict(zip(docs.doc_id, library_ids(docs.text)))
    want = Counter((d, k // 4096, k, len(x[k : k + 4096]), crc(x[k : k + 4096])) for d, x in ids.items() for k in range(0, len(x), 4096))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    total = sum(r["length"] for r in found)
    assert check_packed(found, 4096) <= -(-total // 4096) + 2
    got = packing.pack_documents(odd, queries.tokenizer("word_bpe_49k.json"), with_ids=True).collect()
    assert {r["doc_id"] for r in got} == {None, *range(len(ODD))} and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    check_packed(got, 4096)
    assert packing.pack_documents(none, queries.tokenizer("word_bpe_49k.json")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sweep_is_best_fit(lengths):
    bins, gaps = [], []
    for x in sorted(lengths, reverse=True):  # plain best-fit-decreasing
        fits = [i for i, g in enumerate(gaps) if g >= x]
        i = min(fits, key=lambda i: gaps[i]) if fits else len(gaps)
        if i == len(gaps):
            gaps.append(20)
        gaps[i] -= x
    placed = []
    for length, rank, n, first, fit, offset in packing.sweep(dict(Counter(lengths)), 20):
        placed += [{"length": length, "sequence_id": first + k // fit, "offset": offset + k % fit * length} for k in range(n)]
    assert Counter(p["length"] for p in placed) == Counter(lengths) and check_packed(placed, 20) == len(gaps)


def test_op5(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = queries.op5_chat_format(spark, sf_dir)
    want = db.sql(queries.ORACLE_SQL["op5_chat_format"])
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(want.fetchall())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a|b", "<|says|>"]), st.text(st.sampled_from("ab<|>\\/[]é🙂 \nturnsayed"), max_size=20)), max_size=6))
def test_chat_round_trip(turns):
    t = chat.chat_tokenizer(queries.tokenizer("byte_bpe_50k.json"))
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    offsets = np.array(t.encode(text, add_special_tokens=False).offsets).reshape(-1, 2)
    assert chat.masked_text(text, offsets, chat.mask_tokens(offsets, spans)) == "".join(x for r, x in turns if r == "assistant")


def test_chat_cases(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (2, None, "assistant", "<|end|>"), (2, None, "assistant", "<|end|>"), (None, 0, "user", "u")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.tokenizer("byte_bpe_50k.json"))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nq\nassistant\n\n").hexdigest() and got[1]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert got[2]["loss_sha256"] == hashlib.sha256(b"<|end|><|end|>").hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty, queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_op1(spark, sf_dir, docs, odd, none):
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id").lang
    held = found[found.held_out]
    assert len(held) > 150 and (held.lang_pred == lang[held.index]).mean() > 0.97 and found.score.between(0, 1).all()
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in range(4)) and got[4]["lang_pred"] != "und"
    assert langid.identify(none, model).count() == 0 and langid.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_op1_rejects_far_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.pmod(queries.id_crc32("doc_id"), F.lit(4)) == 2
    model = langid.fit(docs, ~out)
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (200, 500, 2000)] + ["".join(rng.choice(list("0123456789abcdef"), 2000)), "x" * 3000]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    assert model.predict(pa.array([*noise, polish, finnish]))[2].all()
    held = docs.where(out & F.col("text").isNotNull()).toPandas().text.tolist()
    assert model.predict(pa.array(held))[2].mean() < 0.01
    short = [" ".join(t.split()[:k]) for t in held for k in (1, 2, 4, 8)]
    assert model.predict(pa.array([t for t in short if any(c.isalpha() for c in t)]))[2].mean() < 0.02


def test_op6(spark, odd, none):
    found = queries.op6_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")
    held = found[found.held_out & found.index.isin(labels.index)]
    assert (held.predicted == labels.quality[held.index]).mean() > 0.9 and found.score.between(0, 1).all()
    assert all(r["score"] == 0.5 for r in quality.score(odd, None).collect())
    model = quality.fit(odd, spark.createDataFrame([(4, 1), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int"), F.lit(True))
    assert quality.score(odd, model).count() == len(ODD) + 2 and quality.score(none, model).count() == 0
    assert quality.fit(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)) is None


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    u = sorted(set(prints))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for d, p in zip(ids, prints):
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return [least.get(find(p)) for p in prints]


def test_op9(spark, sf_dir, docs, odd, none):
    found = queries.op9_simhash_dedup(spark, sf_dir).toPandas().sort_values("doc_id")
    prints = [plain_fingerprint(t) for t in docs.text]
    assert found.fingerprint.tolist() == [f"{p:016x}" for p in prints] and found.component_id.tolist() == plain_components(docs.doc_id, prints)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) + 2 and {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {0}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (0, 1, 2, 3)").count() == 1 and kept.where("doc_id IS NULL").count() == 1


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for _ in range(6):  # chains and clouds around them
        for x in list(fps)[:150]:
            for b in rng.choice(64, rng.integers(1, 3), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    prints = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    mine = [found.get(int(np.uint64(p).astype(np.int64)), int(np.uint64(p).astype(np.int64))) for p in prints]
    want = plain_components(range(len(prints)), prints)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_op7(spark, sf_dir, docs, none):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    found = queries.op7_decontamination(spark, sf_dir).toPandas()
    holding = {d for d, t in zip(docs.doc_id, docs.text) if any(x.lower() in t.lower() for x in bench.text)}
    assert holding and holding == set(found.doc_id)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
    near = item.replace("seven ", "SEVEN!! ", 1).replace("eighteen", "changed", 1)
    rows = [(1, "before " * 50 + item + "after " * 50), (2, "x y z " + near), (3, "seven eight nine ten eleven twelve"), (4, None), (5, ""), (6, item[: len(item) // 3]), (7, "hi there"), (7, "hi there")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (None, "a b"), (13, "hi there"), (13, "hi there")], "item_id long, text string")
    got = decontam.contaminations(df, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 10), (2, 10), (7, 13), (7, 13)]
    kept = decontam.drop_contaminated(df, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == df.columns
    assert decontam.contaminations(none, items).count() == 0 and decontam.contaminations(df, items.limit(0)).count() == 0


def test_op7_edited_passages():
    rng = np.random.default_rng(11)
    lost = planted = 0
    for _ in range(1500):
        n = int(rng.integers(45, 100))
        item = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        edited, m = list(item), n - 4
        for k in range(int(rng.integers(1, 5))):  # replaced words, few enough for a similarity of 0.8 to 0.9
            trial = list(edited)
            trial[int(rng.integers(0, n))] = f"e{k}x{rng.integers(0, 10**9)}"
            shared = sum(trial[i : i + 5] == item[i : i + 5] for i in range(m))
            if shared >= 0.8 * m:
                edited = trial
        shared = sum(edited[i : i + 5] == item[i : i + 5] for i in range(m))
        if not 0.8 * m <= shared <= 0.9 * m:
            continue
        planted += 1
        text = " ".join([*(f"b{x}" for x in rng.integers(0, 10**9, 8)), *edited, "after", "it"])
        words = decontam.word_hashes(pa.array([text]))[1]
        lost += not decontam.Items([(1, " ".join(item))]).find(words)
    assert planted > 700 and lost == 0


def test_op3(spark):
    found = queries.op3_nearest_neighbours(spark, "/root/testdata/sf0.01").toPandas()
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids, hit = np.array(e.embedding.tolist(), dtype=np.float64), e.vec_id.to_numpy(), 0
    for q, g in found.sort_values("rank").groupby("query_id"):
        s = x @ x[ids == q][0]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hit += len(set(order) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g.score) <= 0).all()
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_op3_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 0.0, 2.0]) for i in range(40)] + [(i, (rng.normal(size=3) * (1 + i % 3)).tolist()) for i in range(40, 60)]
    rows += [(60, None), (80, []), (100, [0.0] * 3), (120, [1.0, None, 1.0]), (140, [float("nan"), 1.0, 1.0]), (160, [1.0, 1.0]), (None, [1.0] * 3), (0, [1.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = ann.search(df).toPandas()
    x = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows[:60]}
    assert set(got.query_id) == {0, 20, 40}
    for q, g in got.sort_values("rank").groupby("query_id"):
        want = sorted((i for i in x if i != q), key=lambda i: (-float(x[i] @ x[q]), i))[:20]
        assert g.vec_id.tolist() == want
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 20")).count() == 0
    assert ann.search(df.where("vec_id IN (20, 41, 42)")).count() == 2


ARTICLE = "The cat sat on the mat and it was the best of the mats that we have seen in all of our days."


def test_op10(spark, sf_dir):
    html = f"""<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site name</header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies and that is what you have to know about it all.</div>
    <article><h1>Head &amp; line</h1><p><b>{ARTICLE}<br>more&nbsp;of<p>Short.<form>Sign up</form><p>{ARTICLE} end</article>
    <div id="comments"><p>{ARTICLE} says a reader</p></div><aside>{ARTICLE}</aside><footer>&copy; us</footer>"""
    assert htmltext.main_text(html) == f"Head & line\n{ARTICLE} more of\nShort.\n{ARTICLE} end"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>plain words"), (3, "u", "<p>plain words"), (4, "u", "<div><p>" * 2000 + ARTICLE), (5, "u", "&amp"), (6, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r["page_id"], r["text"]) for r in htmltext.extract(df).collect()]
    assert sorted(got) == [(1, ""), (2, ""), (3, "plain words"), (3, "plain words"), (4, ARTICLE), (5, "&"), (6, "")]
    found = queries.op10_html_text(spark, sf_dir).collect()
    assert all(r["text"] and r["n_chars"] == len(r["text"]) and "©" not in r["text"] for r in found)
