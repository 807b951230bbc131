"""The stages of the pipeline and the row-wise operators against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quaero.llm import bpe, language_id, mixing, ngram_join, sharding, suffix_dedup, toxicity
from tests.llm.test_ngram_join import brute as brute_components
from tests.llm.test_ngram_join import corpus as near_corpus
from tests.llm.test_repeats import brute_bytes

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, row string"


def frame(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"s{(i or 0) % 3}"), len(t or ""), "k", "r") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# ---------------------------------------------------------------- BPE

def test_bpe_equals_the_library(spark):
    r = random.Random(1)
    texts = ["", None, "<|endoftext|>x <|endo", "a" * 700, " " * 200, "the" * 300, "don't \n\n  you  ", "x<|endoftext|>", "é ​"]
    texts += ["".join(r.choice("abeinst hr\n\t 'sé漢字🙂0129.-") for _ in range(r.randint(0, 90))) for _ in range(300)]
    lib = Tokenizer.from_file(VOCAB)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (1, "twice")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_decode(df, VOCAB).filter("doc_id <> 1").collect()}
    for i, t in enumerate(texts):
        if i != 1:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            assert bytes(got[i].ids) == np.array(ids, np.uint32).tobytes() and got[i].n_tokens == len(ids)
            assert got[i].decoded == lib.decode(ids, skip_special_tokens=False) == (t or "")
    back = bpe.decode(bpe.encode(df, VOCAB), VOCAB)
    assert back.filter("doc_id = 3").first().decoded == "a" * 700
    assert bpe.encode(df.limit(0), VOCAB).count() == 0


# ---------------------------------------------------------------- sharding

def test_sharding_splits_only_what_is_too_large(spark):
    r = random.Random(2)
    texts = {i: "x" * r.choice([1, 10, 100, 2000]) for i in range(300)} | {300: None, 301: "y" * 9000}
    df = frame(spark, texts).unionByName(frame(spark, {None: "z" * 5}))
    got = sharding.shard_documents(df, 4000).collect()
    assert len(got) == len(texts) + 1
    bits = lambda i: bin(int(hashlib.md5(b"null" if i is None else str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    size = collections.Counter()
    for i, t in [*texts.items(), (None, "z" * 5)]:
        for d in range(61):
            size[bits(i)[:d]] += len(t or "")
    for g in got:
        address = bits(g.doc_id)
        depth = next((d for d in range(61) if size[address[:d]] <= 4000), 60)
        assert (g.shard, g.depth, g.shard_bytes, g.oversized) == (address[:depth], depth, size[address[:depth]], depth == 60)
    assert [g.doc_id for g in got if g.oversized] == [301]
    assert sharding.shard_documents(df.limit(0), 10).count() == 0
    assert {g.shard for g in sharding.shard_documents(df, 10**9).collect()} == {""}


# ---------------------------------------------------------------- mixing

@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.62, "b": 0.3, "c": 0.08}, {"a": 5, None: 2, "c": 0.001}])
def test_mixing_stays_within_a_block(spark, weights):
    r = random.Random(3)
    names = list(weights)
    rows = [(i, r.choice(names), 0, "x", 1) for i in range(2500)] + [(None, names[0], 0, "x", 1), (7, names[0], 0, "x", 1), (7, names[0], 0, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot long, block string, part int")
    got = mixing.mix_sources(df, weights, block_docs=4, frame_blocks=50).collect()
    assert len(got) == len(rows)
    slots = {}
    for g in got:
        slots.setdefault(g.slot, set()).add((g.source, g.block, g.release, g.deadline))
        assert g.release <= g.slot < g.deadline
    assert all(len(s) == 1 for s in slots.values())
    assert [g.slot for g in sorted(got, key=lambda g: g.position)] == sorted(g.slot for g in got)
    assert sorted(g.position for g in got) == list(range(len(rows)))
    total = sum(weights.values())
    given = collections.Counter()
    end = max((g.slot for g in got if g.in_mixture), default=-1)
    for slot in range(end + 1):
        given[next(iter(slots[slot]))[0]] += 1
        for s in weights:
            assert abs(given[s] - weights[s] * (slot + 1) / total) < 1
    assert any(-(-sum(x[1] == s for x in rows) // 4) == given[s] for s in weights)
    for s in weights:  # ranks of a source have no gap and go by id
        own = sorted((g for g in got if g.source == s), key=lambda g: g.source_rank)
        assert [g.source_rank for g in own] == list(range(sum(x[1] == s for x in rows)))
        ids = [10**9 if g.doc_id is None else g.doc_id for g in own]
        assert ids == sorted(ids)


def test_deviation_from_unrounded_weights_over_a_million_slots():
    weights = {"a": 0.62346, "b": 0.30012, "c": 0.0764, "d": 0.00002}
    share = mixing.shares(weights)
    exact, total = list(share.values()), sum(share.values())
    assert [n / total for n in exact] == pytest.approx([w / sum(weights.values()) for w in weights.values()], rel=1e-15)
    given, done = [0] * 4, [0] * 4
    for i, j, release, deadline, slot in mixing.run_frame(0, 10**6, exact, [10**9] * 4, done):
        given[i] += 1
        assert release <= slot < deadline and j == given[i]
        assert abs(given[i] * total - exact[i] * (slot + 1)) < total
    assert slot == 10**6 - 1 and all(abs(g * total - w * 10**6) < total for g, w in zip(given, exact))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_frames_side_by_side_give_the_schedule_of_one_run(spark, seed):
    r = random.Random(seed)
    n = r.choice([2, 5, 40])
    share, sizes = [r.randint(1, 1000) ** 2 for _ in range(n)], [r.randint(0, 300) for _ in range(n)]
    plan, docs = mixing.schedule(spark, share, sizes, 3, 17)
    blocks = [-(-s // 3) for s in sizes]
    want = list(mixing.run_frame(0, 10**9, share, blocks, [0] * n))
    got = sorted((p.slot, p.source, p.j, p.release, p.deadline) for p in plan.collect())
    assert got == [(t, i, j, a, b) for i, j, a, b, t in want]
    assert sum(docs) == sum(sizes)


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"b": 1.0})
    assert mixing.mix_sources(df.limit(0), {"a": 1.0}).count() == 0
    assert [g.position for g in mixing.mix_sources(df, {"a": 1.0, "b": 2.0}).collect()] == [0]
    many = spark.createDataFrame([(i, f"host{i % 3000}") for i in range(4000)], "doc_id long, source string")
    got = mixing.mix_sources(many, mixing.tempered(mixing.source_sizes(many), 0.5), block_docs=1).collect()
    assert sorted(g.position for g in got) == list(range(4000))
    assert all(g.release <= g.slot < g.deadline for g in got)


def test_mixture_stage_keeps_every_document_beside_a_small_source(spark):
    sources = {i: f"s{i % 4}" for i in range(4000)} | {4000 + i: "tiny" for i in range(3)} | {4003: None}
    docs = frame(spark, {i: str(i) for i in sources}, sources=sources)
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == [*docs.columns, "mixture_position"]
    got = mixed.collect()
    assert {r.doc_id: r.text for r in got} == {i: str(i) for i in sources}
    assert sorted(r.mixture_position for r in got) == list(range(len(sources)))
    out = {r.doc_id: r.mixture_position for r in corpus_pipeline.tokens(spark, mixed, "").collect()}
    assert out == {r.doc_id: r.mixture_position for r in got}
    twice = docs.filter("doc_id < 50").unionByName(docs.filter("doc_id < 5"))
    assert corpus_pipeline.mixture(spark, twice, "").count() == 55
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


# ---------------------------------------------------------------- toxicity and language

def words(r, alphabet, n):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_toxicity_catches_disguises_and_spares_exceptions(spark):
    r = random.Random(4)
    bad = ["idiot", "moron", "scum", "clown"]
    rows, labels = [], []
    for i in range(600):
        t = words(r, "aeinrst", r.randint(5, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                t.insert(r.randrange(len(t)), r.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    extra = ["you 1d10t there", "such a mоrоn now", "plain words here", "a clown fish swims", None, "", "what an ÍDIOT he is", "i-d-i o t"]
    rows += [(1000 + i, t) for i, t in enumerate(extra)] + [(None, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks)
    got = {g.doc_id: g for g in toxicity.score(docs, lexicon).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) >= 0.97
    assert [got[1000 + i].predicted for i in range(8)] == [1, 1, 0, 0, 0, 0, 1, 0]
    assert all(0 <= g.score <= 1 for g in got.values())
    empty = toxicity.learn(docs, marks.limit(0))
    assert toxicity.score(docs.limit(3), empty).filter("predicted = 1").count() == 0


def test_exceptions_are_learned_from_clean_texts(spark):
    r = random.Random(3)
    plain = lambda n: " ".join(r.choice(["field", "river", "stone", "tree", "cloud", "road"]) for _ in range(n))
    rows = [(i, f"{plain(6)} you vile grobnik {plain(5)}", 1) for i in range(120)] + [(200 + i, f"{plain(6)} the grobnik museum {plain(5)}", 0) for i in range(25)] + [(300 + i, plain(12), 0) for i in range(300)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert "grobnik museum" in lexicon.exceptions and "vile grobnik" not in lexicon.exceptions
    asked = spark.createDataFrame([(1, "a grobnik museum by the river"), (2, "a vile grobnik by the river")], "doc_id long, text string")
    assert {x.doc_id: x.predicted for x in toxicity.score(asked, lexicon).collect()} == {1: 0, 2: 1}


def test_lexicon_matches_as_a_naive_search():
    r = random.Random(11)
    entries = {"idi": 2.0, "idiot": 5.0, "mor": 1.0, "scum": 3.0, "é": 0.5, "éa": 0.7, "sc": 0.25}
    lexicon = toxicity.Lexicon(entries, ("pond scum", "sc b"))

    def naive(text):
        folded = toxicity.fold(text)
        plain, found = toxicity.bare(folded), {}
        starts = [i for i in range(len(folded)) if i == 0 or not folded[i - 1].isalpha()]
        spared = [(i, i + len(p)) for p in ("pond scum", "sc b") for i in starts for t in (folded, plain) if t.startswith(p, i) and not t[i + len(p) : i + len(p) + 1].isalpha()]
        for i in starts:
            own = max((e for e in entries for t in (folded, plain) if t.startswith(e, i)), key=len, default=None)
            if own and not any(a <= i < b for a, b in spared):
                found[toxicity._WORD.match(plain, i)[0]] = entries[own]
        return sum(found.values()), len(found)

    for _ in range(400):
        text = "".join(r.choice(["idiot", "1d10t", "scum", "pond ", "mor", "é", "éa", "a", " ", " ", "-", "sc b", "x", "ＩＤＩ", "𝐢𝐝𝐢𝐨𝐭", "ⓢⓒⓤⓜ"]) for _ in range(r.randint(0, 14)))
        assert lexicon.total(toxicity.fold(text)) == pytest.approx(naive(text))


def test_labels_are_pooled_over_all_positions(spark):
    r = np.random.default_rng(2)
    net = language_id.Network.fresh(["a", "b", "c"], 3, 4)
    for p in net.params:
        p[...] = r.standard_normal(p.shape) * 0.7
    texts = {0: "kort", 1: "é" * 50 + "xyz " * 40, 2: "q" * language_id.STEPS, 3: "z" * (language_id.STEPS + 1), 4: None, 5: "12 34", 6: "kort"}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def naive(text):
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), language_id.STEPS):
            cells = [*raw[at : at + language_id.STEPS]]
            cells += [256] * (language_id.STEPS - len(cells))
            states = []
            for d in (0, 1):
                h, out = np.zeros(3), {}
                for t in range(len(cells)) if d == 0 else reversed(range(len(cells))):
                    inp, rec = net.x[d, cells[t]], h @ net.u[d]
                    z, gate = sigmoid(inp[:3] + rec[:3]), sigmoid(inp[3:6] + rec[3:6])
                    h = (1 - z) * np.tanh(inp[6:] + gate * (rec[6:] + net.b[d])) + z * h
                    out[t] = h
                states.append(out)
            for t, c in enumerate(cells):
                if c < 256:
                    y = np.exp(np.concatenate([states[0][t], states[1][t]]) @ net.v + net.c)
                    total += y / y.sum()
        return total / len(raw)

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for g in language_id.predict(docs, net).collect():
        if g.doc_id in (4, 5):
            assert (g.lang_pred, g.score) == ("und", 0.0)
        else:
            want = naive(texts[g.doc_id])
            assert g.lang_pred == "abc"[int(want.argmax())] and g.score == pytest.approx(want.max(), abs=1e-4)


def test_gradients_are_right():
    r = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b"], 3, 1)
    for p in net.params:
        p[...] = r.standard_normal(p.shape) * 0.5
    net.x, net.u, net.b, net.v, net.c = (p.astype(np.float64) for p in net.params)
    data = r.integers(97, 100, (7, 4))
    data[5:, 1] = 256
    lang = np.array([0, 1, 1, 0])
    _, grads = net.gradients(data, lang)
    for p, g in zip(net.params, grads):
        for at in [tuple(r.integers(0, s) for s in p.shape) for _ in range(4)] + ([(0, 98, 2), (1, 97, 5)] if p.ndim == 3 and p.shape[1] == 257 else []):
            old, eps = p[at], 1e-3
            p[at] = old + eps
            up = net.gradients(data, lang)[0]
            p[at] = old - eps
            down = net.gradients(data, lang)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3 + 0.02 * abs(g[at])


def test_language_id_held_out_accuracy(spark):
    r = random.Random(5)
    alphabets = {"aa": "aeiouth ", "bb": "äöüsch ", "cc": "éèêlux "}
    rows = [(i, words(r, alphabets[lang], r.randint(3, 80)), lang) for i in range(450) for lang in [sorted(alphabets)[i % 3]]]
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "123 456", "aa"), (903, "thou", None), (None, "aei", "aa")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {g.doc_id: g for g in language_id.predict(docs, language_id.learn(docs, per_language=100)).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) >= 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert language_id.predict(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.learn(docs.limit(0)) is None


# ---------------------------------------------------------------- stages

def test_stages(spark):
    texts = {i: (t or "").replace("x " * 900, "x") or None for i, t in near_corpus(6).items()}
    docs = frame(spark, texts)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute_components(texts).items() if i == c}
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == want and all(rows[i] == texts[i] for i in want)

    long = {i: t for i, t in rows.items()} | {500: "é" * 60 + rows[max(rows, key=lambda i: len(rows[i] or ""))], 501: None}
    done = {r.doc_id: r for r in suffix_dedup.rewrite(frame(spark, long)).collect()}
    for i, (_, _, _, left) in brute_bytes(long, 100).items():
        assert done[i].text is None if long[i] is None else done[i].text == left.decode("utf-8", "ignore")
        assert done[i].n_chars == (None if long[i] is None else len(done[i].text))
        assert (done[i].k, done[i].row) == ("k", "r")

    mixed = mixing.whole_mixture(frame(spark, {i: str(i) for i in range(400)}, sources={i: "a" if i % 4 else "b" for i in range(400)}), 0.0, 4)
    count = collections.Counter(r.source for r in mixed.filter("mixture_position < 200").collect())
    assert abs(count["a"] - count["b"]) <= 8
    assert mixed.columns == [*docs.columns, "mixture_position"]


def test_run_from_end_to_end(spark, tmp_path):
    """All stages over a small table, each held against brute force on what the stage before has kept."""
    r = random.Random(12)
    text = lambda lang, n: words(r, {"aa": "aeiouth", "bb": "äöüsch"}[lang], n)
    rows = [(i, text(lang, r.randint(20, 60)), lang, f"s{i % 3}") for i in range(160) for lang in ["ab"[i % 2] * 2]]
    rows += [(200 + i, rows[i][1], rows[i][2], "s0") for i in range(5)]  # copies
    rows += [(210 + i, rows[20 + i][1] + " " + text("aa", 1), "aa", "s1") for i in range(4)]  # near copies
    passage = text("aa", 70)
    rows += [(220 + i, f"{text('aa', 40)} {passage} {text('aa', 40)}", "aa", None) for i in range(4)]
    rows += [(230, None, "aa", "s0"), (231, "", "aa", "s0"), (232, "12 34", None, "s2"), (0, rows[1][1], "bb", "s0"), (None, text("bb", 30), "bb", "s1")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        held[name] = docs.collect()
        if name not in ("mixture", "tokens"):
            assert docs.columns == before.columns
    texts = lambda name: sorted((x.text or "") for x in held[name])
    # language: what has letters stays, whole
    assert texts("language") == sorted(t for _, t, *_ in rows if t and any(c.isalpha() for c in t))
    # near duplicates: one of each group, the one with the smallest id; ids are unique but for 0 and null
    ids = {n: (x.doc_id, x.text) for n, x in enumerate(sorted(held["language"], key=lambda x: (x.doc_id is None, x.doc_id or 0, x.text)))}
    group = {n: c for n, (_, c) in brute_components({n: t for n, (_, t) in ids.items()}).items()}
    assert len(held["near_duplicates"]) == len(set(group.values()))
    assert {x.text for x in held["near_duplicates"] if x.doc_id not in (0, None)} == {ids[c][1] for n, c in group.items() if n == c and ids[n][0] not in (0, None)}
    # repeats: bytes of the windows that occur earlier
    left = sorted(held["near_duplicates"], key=lambda x: (x.doc_id is None, x.doc_id or 0))
    if len([x for x in left if x.doc_id == 0]) == 1:
        cut = brute_bytes({n: x.text for n, x in enumerate(left)}, 100)
        assert texts("repeats") == sorted(c[3].decode("utf-8", "ignore") for c in cut.values())
    assert sum(passage in x.text for x in held["repeats"]) == 1
    # mixture: every row, a place for each
    assert texts("mixture") == texts("repeats") and sorted(x.mixture_position for x in held["mixture"]) == list(range(len(held["repeats"])))
    # tokens: as the library has them
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {x.mixture_position: x.text for x in held["mixture"]}
    for x in held["tokens"]:
        ids_ = library.encode(by[x.mixture_position], add_special_tokens=False).ids
        assert np.frombuffer(x.ids, "<u4").tolist() == ids_ and x.decoded_sha256 == hashlib.sha256(library.decode(ids_, skip_special_tokens=False).encode()).hexdigest()


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids_keep_one_row(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, t, "a"), (None, None, "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0) for r in ngram_join.keep_one(df).collect()) == [0, 1]
    assert suffix_dedup.rewrite(df).count() == 4


def test_language_stage_keeps_clean_documents(spark):
    r = random.Random(7)
    texts = {i: words(r, "aeiouth" if i % 2 else "äöüsch", 30) for i in range(200)} | {200: None, 201: "12 34"}
    docs = frame(spark, texts, {i: "aa" if i % 2 else "bb" for i in texts})
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(200))
    assert kept.select(F.sum("n_chars")).first()[0] == sum(len(texts[i]) for i in range(200))
