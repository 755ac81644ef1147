"""The ten operators against brute force on a small table with every awkward case."""

import collections
import gzip
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import attention, fingerprint, lm, mixing, near_dedup, piece_codec, quality, sharding, token_counts, toxicity, warc
from folioscope.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, node long, n_words string, id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_texts():
    rng = np.random.default_rng(1)
    vocabulary = ["the", "of", "and", "river", "stone", "Ünder", "winter", "light", "ééçà", "naïve", "quiet", "letters", "▁odd", "日本語", "x"]
    long = " ".join(rng.choice(vocabulary, 3000))
    near = [" ".join(rng.choice(vocabulary, 60)) for _ in range(8)]
    changed = [t.rsplit(" ", 3)[0] + " other words here" for t in near[:4]]
    return [None, "", "  \t\n ", "a", "one two", *near, *changed, *near[:3], long, long + " end", "same\nsame\nsame line\n\nx", "tab\tand\x0bmore", "emoji 😀 ok", "\x00nul"]


@pytest.fixture(scope="module")
def texts():
    return base_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 7, 1, "h", 2, "n", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0).cache()


@pytest.fixture(scope="module")
def repeated(docs, spark):
    odd = spark.createDataFrame([(None, "one two", "en", None, 1, 1, "h", 2, "n", 3)], SCHEMA)
    return docs.unionByName(docs).unionByName(odd)


def words(text):
    return WORD.findall(text or "")


def test_token_counts(docs, empty, texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    lengths = sorted(len(own.encode(t or "")) for t in texts)
    hist = token_counts.length_histogram(token_counts.token_lengths(docs, piece_model())).cache()
    assert {r.length: r.docs for r in hist.collect()} == collections.Counter(lengths)
    for r in hist.collect():
        assert r.truncated_total == sum(min(n, r.length) for n in lengths) and r.tokens_ge == sum(n for n in lengths if n >= r.length)
    assert token_counts.truncated_total(hist, 10).first()[0] == sum(min(n, 10) for n in lengths)
    assert token_counts.quantile(hist, 0.5).first()[0] == lengths[math.ceil(0.5 * len(lengths)) - 1]
    assert token_counts.length_histogram(token_counts.token_lengths(empty, piece_model())).count() == 0


def test_sentencepiece(docs, empty, texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for r in piece_codec.digest_documents(docs, piece_model()).collect():
        ids = own.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()
    for r in piece_codec.encode_documents(docs, piece_model()).collect():
        raw, spans = (texts[r.doc_id] or "").encode(), list(zip(r.begins, r.ends))
        assert list(r.ids) == own.encode(texts[r.doc_id] or "") and all(a <= b for a, b in spans)
        assert b"".join(raw[a:b] for a, b in spans) == raw
    assert piece_codec.digest_documents(empty, piece_model()).count() == 0


def spans_digest(begins, ends):
    return hashlib.sha256(np.array([*begins, *ends], "<i4").tobytes()).hexdigest()


def test_spans_of_digests_are_those_of_the_encoder(docs):
    spans = {r.doc_id: spans_digest(r.begins, r.ends) for r in piece_codec.encode_documents(docs, piece_model(), add_end=True).collect()}
    assert {r.doc_id: r.spans_sha256 for r in piece_codec.digest_documents(docs, piece_model()).collect()} == spans


def test_compiled_character_map_against_the_library(tmp_path):
    """The public vocabulary with the library's own nmt_nfkc map: ids and spans as the library gives them."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    source = pb.ModelProto()
    source.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto = pb.ModelProto()
    with open(piece_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = source.normalizer_spec.precompiled_charsmap
    for trim in (False, True):
        proto.normalizer_spec.remove_extra_whitespaces = trim
        path = tmp_path / f"mapped{trim}.model"
        path.write_bytes(proto.SerializeToString())
        own, want = piece_codec.PieceCodec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
        assert not own.cuttable
        texts = ["", "ﬁne ﬂuff №5", "  ①② ｆｕｌｌ　ｗｉｄｔｈ  ", "e\u0301te\u0301 Å", "plain words", "ｶﾞｷﾞ ㍿ ½ tab\tend", "日本語 ㌔ x" * 40]
        got = own.encode(pa.array(texts))
        for k, text in enumerate(texts):
            proto_out = want.encode(text, return_type="proto")
            at = slice(got.first[k], got.first[k + 1])
            assert got.ids[at].tolist() == [p.id for p in proto_out.pieces]
            # the library counts bytes here
            assert got.begin[at].tolist() == [p.begin for p in proto_out.pieces]
            assert got.end[at].tolist() == [p.end for p in proto_out.pieces]


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(2)
    plain = ["river", "stone", "winter", "light", "quiet", "letters", "garden", "window", "market", "paper", "the", "of", "and"]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(plain, 40))
        toxic = i % 4 == 0
        if toxic:
            text[rng.integers(40)] = ["blorgface", "zixnut", "blorg-face", "z i x n u t", "blorgxface"][i // 4 % 5 if i % 3 else 0]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].predicted == dict(labels)[i] for i in held]) > 0.95
    tests = ["a blorrgface b", "z.i.x.n.u.t", "z-i-x-nut and", "a quiet garden", "", None, "   "]
    out = [r.predicted for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert out == [1, 1, 1, 0, 0, 0, 0]
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(docs, marks.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.clean_documents(docs, model).columns == docs.columns


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Many rows of one labelled id don't come to the driver."""
    rows = [(0, f"bad zixnut {i}") for i in range(3000)] + [(0, "bad zixnut 1")] * 500 + [(i, f"plain words {i} zixnut" if i % 2 else f"plain words {i}") for i in range(1, 200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i == 0 or i % 2)) for i in range(200)], "doc_id long, toxic int")
    seen = []
    stored = toxicity._spark.stored
    monkeypatch.setattr(toxicity._spark, "stored", lambda df, name: seen.append((name, stored(df, name))) or seen[-1][1])
    toxicity.fit(table, marks, toxic_rows=50, clean_rows=60)
    assert dict(seen)["sample"].count() <= 110


def test_kernel_against_brute_force():
    """The machine's decision by kernels with all training units, from the dual of its own squared-hinge problem.

    With every unit a landmark the Nystrom space holds the kernel exactly, so the folded weights have to give
    what the kernel machine gives.
    """
    name = lambda w: "".join(chr(ord(c) - 96 + 48) for c in w)
    positive, negative = ["zix", "blo"], ["river", "stone", "light", "market", "paper"]
    units = [*positive, *negative]
    model = toxicity.fit_units({name(w): 1.0 for w in positive}, [name(w) for w in negative], landmarks=14)

    def mapped(word):
        word, out = "<" + word + ">", collections.Counter()
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i <= toxicity.SPAN:
                out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i)
        # the root of the summed squares of single occurrences
        norm = math.sqrt(sum(toxicity.DECAY ** (2 * (k - i)) for i, j, k in itertools.combinations(range(len(word)), 3) if k - i <= toxicity.SPAN))
        return {key: v / norm for key, v in out.items()}

    kernel = lambda a, b: sum(v * b.get(key, 0.0) for key, v in a.items())
    maps = [mapped(w) for w in units]
    gram = np.array([[kernel(a, b) for b in maps] for a in maps])
    y = np.array([1.0, 1.0, *[-1.0] * len(negative)])
    c = 20.0 * np.array([4.0, 4.0, *[1.0] * len(negative)])
    # the primal in the kernel's span, by Newton steps on the active set; the bias is penalised by 1e-3
    a, bias = np.zeros(len(y)), 0.0
    for _ in range(50):
        on = y * (gram @ a + bias) < 1
        m = np.block([[gram + gram[:, on] @ np.diag(c[on]) @ gram[on], gram[:, on] @ c[on][:, None]], [(c[on] @ gram[on])[None], np.array([[1e-3 + c[on].sum()]])]])
        sol = np.linalg.lstsq(m, np.append(gram[:, on] @ (c[on] * y[on]), (c[on] * y[on]).sum()), rcond=None)[0]
        a, bias = sol[:-1], sol[-1]
    for word in ["zix", "ziix", "riverstone", "blos", "light", "garden"]:
        own = toxicity.units(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
        want = sum(x * kernel(m, mapped(word)) for x, m in zip(a, maps)) + bias
        assert abs(toxicity.unit_scores(own, model.weights, model.bias)[0] - want) < 0.02


def test_toxicity_with_many_copies_of_one_text(spark):
    rng = np.random.default_rng(7)
    plain = ["river", "stone", "winter", "light", "quiet", "letters", "garden", "window", "market", "paper"]
    insults = ["blorgface", "zixnut", "quomper", "vexhund", "drabwick", "jolbrek", "mizzlop", "gruntax", "fleembo", "skarnog"]
    text = lambda *more: " ".join(rng.permutation([*rng.choice(plain, 20), *more]))
    copy = text("wurgle")
    rows = [(i, text(insults[i % 10]), 1) for i in range(150)] + [(i, copy, 1) for i in range(150, 2150)] + [(i, text(), 0) for i in range(2150, 3150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4).cache()
    model = toxicity.fit(table, table, toxic_rows=200, clean_rows=400)
    got = {r.doc_id: r.predicted for r in toxicity.score(table, model).collect()}
    assert np.mean([got[i] for i in range(150)]) > 0.95 and np.mean([got[i] for i in range(2150, 3150)]) < 0.05


def test_lm(docs, empty, texts, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)  # so that most words take the way of rare words
    got = {r.doc_id: r for r in lm.score(docs, piece_model()).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in got}
    tokens = {i: [*words((t or "").translate(A_Z)), "\0end"] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(c.values()), len(c)
    for i, r in got.items():
        want = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens[i])
        assert r.held_out == held[i] and r.n_tokens == len(tokens[i]) and r.n_known == sum(c[w] > 0 for w in tokens[i])
        assert r.train_tokens == total and abs(r.base_score - want) < 1e-6 and r.score < 0
    assert lm.score(empty, piece_model()).count() == 0


def test_lm_knows_contexts_outside_the_sample(spark, monkeypatch):
    """Pairs of words that the few sampled documents don't hold are learned from the counts of all documents."""
    monkeypatch.setattr(lm, "TRAIN_BLOCKS", 8)
    rng = np.random.default_rng(8)
    plain = ["the", "of", "and", "river", "stone", "winter", "light"]
    left = ["garden", "window", "market", "paper", "letter", "village", "father", "mother", "doctor", "teacher"]
    right = ["green", "yellow", "heavy", "little", "strong", "ancient", "modern", "silent", "open", "narrow"]
    rows = []
    for i in range(300):
        text = list(rng.choice(plain, 30))
        for _ in range(2):
            k = rng.integers(10)
            text[rng.integers(10) : 0] = [left[k], right[k]]
        rows.append((i, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    scorer, _, _ = lm.fit(table, piece_model())
    context = scorer.context
    x = int(context.keys[np.argmax(context.n)] // context.size)
    assert abs(context.given(x * context.size + np.arange(context.size)).sum() - 1) < 1e-3
    assert context.n.sum() == context.seen.sum()
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    own = [f"{left[k]} {right[k]}" for k in range(10)] + [f"{left[k]} {right[(k + 3) % 10]}" for k in range(10)]
    got = {r.doc_id: r.score for r in lm.score(table.unionByName(spark.createDataFrame(list(zip(held, own)), "doc_id long, text string")), piece_model()).collect()}
    assert np.mean([got[i] for i in held[:10]]) > np.mean([got[i] for i in held[10:]]) + 0.7


@pytest.mark.parametrize("blocks", [30, 1, 44_000])
def test_lm_learns_from_every_training_block(spark, monkeypatch, blocks):
    """Every piece that training texts hold, and no other, moves its embedding, and every token weighs the mixture:
    where the driver begins and learners go on, where learners do all, and where the driver does all."""
    monkeypatch.setattr(lm, "TRAIN_BLOCKS", blocks)
    monkeypatch.setattr(lm, "PER_LEARNER", 200, raising=False)
    ratios, own = [], lm.Context.fit_weight
    monkeypatch.setattr(lm.Context, "fit_weight", lambda self, got, *more: ratios.append(got) or own(self, got, *more))
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = [(i, " ".join("".join(rng.choice(letters, rng.integers(1, 8))) for _ in range(rng.integers(0, 40)))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    scorer, _, _ = lm.fit(table, piece_model())
    at_first = np.random.default_rng(4).normal(0, 0.3, scorer.net.p["e"].shape).astype(np.float32)
    assert np.array_equal((scorer.net.p["e"] != at_first).any(1), scorer.context.seen > 0)
    assert all(np.isfinite(v).all() for v in scorer.net.p.values())
    assert sum(r.sum() for r in ratios) == scorer.context.seen.sum()


def test_steps_follow_the_gradient_and_meet_each_block_once():
    rng = np.random.default_rng(2)
    classes, share = rng.integers(0, attention.CLASSES, 40), np.zeros(40, np.float32)
    strips, fresh, y, used = rng.integers(0, 40, (3, 5, 16)), rng.random((3, 4)) < 0.3, rng.integers(0, 40, (3, 4, 16)), rng.random((3, 4, 16)) < 0.8
    start = attention.initial(np.ones(40), classes, share).p

    def step(p):
        learner = attention.Learner(attention.Attention({k: v.copy() for k, v in p.items()}, classes, share))
        return -learner.step(strips, fresh, y, used, 0.0)[used].astype(float).mean(), learner

    gradient = step(start)[1].m
    for name, value in start.items():
        toward, far = rng.normal(size=value.shape).astype(np.float32), 2e-3
        slope = (step({**start, name: value + far * toward})[0] - step({**start, name: value - far * toward})[0]) / (2 * far)
        assert abs(slope - 10 * (gradient[name] * toward).sum()) < 0.02 * abs(slope) + 4e-3
    for n in (1, 15, 16, 17, 300, 1000):
        own = np.concatenate([at[:, 1:].ravel() for at in attention.strips_of(n, rng)])
        assert sorted(own[own < n]) == list(range(n))


def test_highest_outputs_are_taken_off_only_where_exponents_may_leave_the_range():
    rng = np.random.default_rng(3)
    for low, high, told in ((-70, 70, False), (-70, 500, True), (-500, -300, True), (-500, 500, True)):
        z = rng.uniform(low, high, (50, 32)).astype(np.float32)
        want = np.exp(z.astype(float) - z.max(1, keepdims=True))
        assert attention.steady(z) == told
        got = np.exp(z)
        assert np.allclose(got / got.sum(1, keepdims=True), want / want.sum(1, keepdims=True), rtol=1e-3, atol=1e-30)


def test_attention_is_a_distribution_and_scores_each_token_once():
    rng = np.random.default_rng(0)
    n = 300
    counts = rng.integers(1, 50, n).astype(float)
    ids = rng.integers(0, n, 500)
    classes, share = attention.make_classes(counts, np.arange(n) % 2 == 0, ids[:-1], ids[1:])
    first = np.array([0, 0, 5, 40, 500])
    x, y, fresh, place = attention.layout(first, ids.astype(np.int32), 1)
    used = np.zeros(x.size, bool)
    used[place] = True
    net = attention.train(x, np.roll(x, 1, 0), fresh, y, used.reshape(x.shape), counts, classes, share, epochs=1)
    whole = net.score(x, y, fresh).reshape(-1)[place]
    assert len(whole) == 500
    # what follows a token doesn't change its score
    x2, y2, fresh2, place2 = attention.layout(np.array([0, 5, 30]), np.concatenate([ids[:5], ids[5:30]]).astype(np.int32), 1)
    assert np.allclose(net.score(x2, y2, fresh2).reshape(-1)[place2], whole[:30], atol=1e-4)
    every = np.array([net.score(x[:1], np.full_like(y[:1], k), fresh[:1])[0, 3] for k in range(n)])
    assert abs(np.exp(every).sum() - 1) < 1e-3


def test_attention_against_brute_force():
    """Every token by loops over positions, groups and members, in double precision."""
    rng = np.random.default_rng(11)
    n = 60
    counts = rng.integers(1, 50, n).astype(float)
    ids = rng.integers(0, n, 70)
    classes, share = attention.make_classes(counts, np.arange(n) % 2 == 0, ids[:-1], ids[1:])
    first = np.array([0, 3, 70])
    x, y, fresh, place = attention.layout(first, ids.astype(np.int32), 1)
    used = np.zeros(x.size, bool)
    used[place] = True
    net = attention.train(x, np.roll(x, 1, 0), fresh, y, used.reshape(x.shape), counts, classes, share, epochs=3)
    p = {k: v.astype(float) for k, v in net.p.items()}
    got = net.score(x, y, fresh).reshape(-1)[place]
    for d in range(2):
        own = [1, *ids[first[d] : first[d + 1]].tolist()]
        for t in range(len(own) - 1):
            since = max(0, (t // attention.BLOCK - 1) * attention.BLOCK)
            seen = range(since, t + 1)
            q = p["e"][own[t]] @ p["q"]
            a = np.array([q @ (p["e"][own[j]] @ p["k"]) / math.sqrt(attention.WIDTH) + p["near"][t - j] for j in seen])
            a = np.exp(a - a.max())
            o = sum(w * (p["e"][own[j]] @ p["v"]) for w, j in zip(a / a.sum(), seen))
            h = np.clip(p["e"][own[t]] @ p["x"] + o @ p["o"] + p["h"], 0, attention.TOP)
            g, m = divmod(int(classes[own[t + 1]]), attention.MEMBERS)
            want = share[own[t + 1]]
            for z, k in ((h @ p["c"] + p["b"], g), (h @ p["c2"][g] + p["b2"][g], m)):
                want += z[k] - math.log(np.exp(z).sum())
            assert abs(want - got[first[d] + t]) < 1e-3


def test_most_frequent_pieces_are_classes_of_their_own():
    rng = np.random.default_rng(6)
    counts = np.arange(2000, 0, -1).astype(float)
    ids = rng.integers(0, 2000, 40_000)
    classes, share = attention.make_classes(counts, np.arange(2000) % 2 == 0, ids[:-1], ids[1:])
    alone = np.bincount(classes, minlength=attention.CLASSES)[classes] == 1
    single = attention.SINGLES
    assert alone[:single].all() and np.allclose(share[:single], 0) and len(np.unique(classes)) > single + 300


def test_fingerprints(docs, empty, repeated, texts):
    got = {r.doc_id: r for r in fingerprint.edited(docs).collect()}
    order = sorted(got, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]]):
        a, b = texts[i] or "", texts[j] or ""
        cut = len(a) // 3
        want = a[: len(a) - cut] + b[:cut]
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        one, two = (bytes.fromhex(got[k].fingerprint) for k in (i, j))
        assert abs(got[i].near_next - fingerprint.likeness(one, two)) < 1e-9
        assert got[i].edited_fingerprint == fingerprint.pack(fingerprint.Signer().whole(want.encode())).hex()
    assert fingerprint.edited(empty).count() == 0 and fingerprint.edited(repeated).count() == repeated.count()
    assert [r.near_next for r in fingerprint.edited(docs.filter("doc_id = 5")).collect()] == [1.0]
    classes = {r.doc_id: r.class_id for r in fingerprint.similar_classes(docs, 95)[0].collect()}
    assert classes[17] == 5 and classes[21] == 20


def grams(text):
    data = (text or "").encode()
    return {data[k : k + 8] for k in range(len(data) - 7)} or ({data} if data else set())


def test_similar_texts_against_brute_force(spark):
    """A family of one template: pairs lie between 0.5 and 0.9, and buckets have hubs that link with few of them."""
    rng = np.random.default_rng(4)
    part = lambda: [f"{x:05d}" for x in rng.integers(0, 10**5, 40)]
    template, variants = part(), [part() for _ in range(6)]
    rows = []
    for i in range(60):
        own = list(variants[i % 6][:20])
        for k in rng.choice(20, 3, replace=False):
            own[k] = f"{rng.integers(10**5):05d}"
        rows.append((i, " ".join(template + own)))
    sets = {i: grams(t) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}
    found, links = fingerprint.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = {r.doc_id: r.class_id for r in found.collect()}
    root = {i: i for i in sets}
    for a, b in sorted(want):
        x, y = root[a], root[b]
        root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert len(want) > 100 and np.mean([classes[a] == classes[b] for a, b in want]) >= 0.9
    assert all(root[i] == root[c] for i, c in classes.items())
    node = {r.node: r.doc_id for r in found.collect()}
    for r in links.collect():
        a, b = sets[node[r.a]], sets[node[r.b]]
        assert abs(r.jaccard - len(a & b) / len(a | b)) < 1e-9


BIG = 2**60


def test_large_and_null_ids_stay_what_they_are(spark):
    """Ids beyond 2**53 that only differ in their last digits, together with null ids and repeated rows."""
    rows = [(BIG + i, f"text number {i} " * (1 + i % 5), f"s{i % 2}") for i in range(1500)]
    rows += [(None, "no id", "s0"), (None, "no id either", "s1"), (None, "no id", "s0"), rows[0], rows[0]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    ids = collections.Counter(r[0] for r in rows)
    for out in (fingerprint.edited(table), mixing.mix(table), sharding.shard(table), near_dedup.groups(table), quality.judge(table), toxicity.score(table, None), piece_codec.digest_documents(table, piece_model()), token_counts.token_lengths(table, piece_model())):
        assert collections.Counter(r.doc_id for r in out.select("doc_id").collect()) == ids
    got = {r.doc_id: r for r in fingerprint.edited(table).collect()}
    text = {r[0]: r[1] for r in rows}
    for i in range(1, 1500):
        a, b = text[BIG + i], text[BIG + i - 1]
        cut = len(a) // 3
        assert got[BIG + i].edited_sha256 == hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()
    mixed = collections.Counter(r.doc_id for r in mixing.mixed_documents(table).collect())
    want = collections.Counter()
    for r in mixing.mix(table).collect():
        want[r.doc_id] += r.copies
    assert mixed == +want


def test_extra_columns_with_clashing_names(spark):
    names = ["__key", "__uid", "__h", "__nth", "__copy", "__id", "__copies", "row", "h", "copies", "key", "uid", "c0", "__text", "run", "id", "h2"]
    rows = [(i, f"text number {i % 7} with some more words", "s", *[f"{n}{i}" for n in names]) for i in range(20)]
    table = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for out in (near_dedup.deduplicated(table), mixing.mixed_documents(table), quality.kept_documents(table), toxicity.clean_documents(table, None)):
        assert out.columns == table.columns
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in table.collect()}
    for out in (fingerprint.edited(table), mixing.mix(table), sharding.shard(table), near_dedup.groups(table), quality.judge(table), toxicity.score(table, None), piece_codec.digest_documents(table, piece_model())):
        assert out.count() == 20


def test_fingerprint_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    rows = spark.createDataFrame([(f"k{i:03}" if i else None, f"text number {i} " * 3) for i in range(20)], "doc_id string, text string")
    got = {r.doc_id: r for r in fingerprint.edited(rows).collect()}
    order = [*sorted((k for k in got if k), reverse=True), None]
    texts = {r.doc_id: r.text for r in rows.collect()}
    for i, j in zip(order, [*order[1:], order[0]]):
        a, b = texts[i], texts[j]
        assert got[i].edited_sha256 == hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()


def test_quality(docs, empty, repeated, texts):
    for r in quality.judge(docs).collect():
        t = texts[r.doc_id] or ""
        ws = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        windows = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        repeat = {i + k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == len(repeat)
        assert r.base_failed == (len(ws) < 10 or 100 * len(repeat) > 20 * len(ws)) and not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == 0 and quality.kept_documents(empty).count() == 0
    kept = quality.kept_documents(repeated)
    assert kept.columns == repeated.columns and kept.count() == 2 * quality.judge(docs).filter("kept").count()


def test_quality_learns_from_one_kind_of_junk(spark):
    rng = np.random.default_rng(3)
    plain = lambda k: [f"w{x}" for x in rng.integers(0, 500, k)]
    rows = [(i, " ".join(plain(60))) for i in range(180)] + [(i, " ".join(f"{w}%%%" for w in plain(60))) for i in range(180, 200)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i < 180) for i in got)


def test_expectation_maximisation_against_brute_force():
    """One loop a document, rule and class, from the same start."""
    rng = np.random.default_rng(13)
    patterns = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    got = quality.expectation_maximisation(patterns, counts, rounds=7)
    start = ([0.01, 0.49, 0.5], [0.3, 0.5, 0.2])
    theta = [[list(start[y]) for _ in range(3)] for y in (0, 1)]
    share, total, prior = [0.8, 0.2], counts.sum(), 0.02
    for _ in range(7):
        post = []
        for row in patterns:
            like = [share[y] * math.prod(theta[y][j][row[j] + 1] for j in range(3)) for y in (0, 1)]
            post.append([x / sum(like) for x in like])
        for y, base in enumerate((0.8, 0.2)):
            mass = sum(p[y] * n for p, n in zip(post, counts))
            for j in range(3):
                for v in range(3):
                    own = sum(p[y] * n for p, n, row in zip(post, counts, patterns) if row[j] + 1 == v)
                    theta[y][j][v] = (own + prior * total * base * start[y][v]) / (mass + prior * total * base)
            share[y] = (mass + prior * total * base) / (total * (1 + prior))
    assert np.allclose(got, [p[0] for p in post])


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        ws = words((t or "").translate(A_Z))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 70 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_dedup(docs, empty, repeated, texts, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(docs).collect()}
    assert got == brute_groups(list(enumerate(texts)))
    assert near_dedup.groups(empty).count() == 0 and near_dedup.deduplicated(empty).count() == 0
    one = near_dedup.deduplicated(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, (_, c) in got.items() if i == c}
    assert near_dedup.deduplicated(repeated.filter("doc_id is not null")).count() == one.count()


def test_near_dedup_chains(spark):
    """A chain in which neighbours link and ends don't, among texts near the threshold."""
    rng = np.random.default_rng(5)
    base = [f"t{x}" for x in rng.integers(0, 10**6, 100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        base = base[4:] + [f"n{i}x{k}" for k in range(4)]
        rows.append((i, " ".join(base)))
    for i in range(40, 80):
        rows.append((i, " ".join(rows[0][1].split()[: 100 - (i - 40)])))
    rng.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_near_dedup_of_a_crowded_bucket(spark, monkeypatch):
    """Many texts of one template at 0.5 to 0.65, and among them a few that link: buckets are told apart, no link is lost."""
    rng = np.random.default_rng(9)
    template = [f"t{x}" for x in rng.integers(0, 10**6, 100)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(32)])) for i in range(300)]
    for i in range(300, 320):
        rows.append((i, rows[i - 200][1] + f" more{i} words{i}"))
    monkeypatch.setattr(near_dedup, "CROWD", 16)
    joined = []
    across = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda *a: joined.append(across(*a).cache()) or joined[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    assert 0 < joined[0].count()


def test_warc_text_ids(spark):
    ids = [" a", "c ", "b\r\nX-Page-ID: 1", "ü%41", ""]
    frame = spark.createDataFrame([(i, "u", "z" * 150) for i in ids], "page_id string, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.round_trip(frame).collect()}
    assert set(got) == set(ids) and {v for k, v in got.items() if k != min(ids)} == {min(ids)}


def test_inflating_is_bounded(monkeypatch):
    monkeypatch.setattr(warc, "INFLATED", 1000)
    raw = b"x" * 100_000
    out = list(warc.inflated([gzip.compress(raw), gzip.compress(b"tail")]))
    assert b"".join(out) == raw + b"tail" and max(map(len, out)) <= 1000


def test_warc(spark, tmp_path):
    big = "é" * 120
    pages = [(5, "http://a", big), (3, "http://b", big), (9, None, "small"), (10, "u", "small"), (11, "u", None), (12, "u", ""), (3, "http://b", big), (14, "x\ny", "WARC/1.1\r\n\r\n" + "z" * 200)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, first int")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect())
    want = sorted((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 5 else "response", 3 if i == 5 else None) for i, _, h in pages)
    assert [x[:4] for x in got] == [x[:4] for x in want] and [x[4] for x in got] == [x[4] for x in want]
    assert warc.round_trip(frame.limit(0)).count() == 0
    records = [warc.record(i, "u", f"body {i}".encode(), hashlib.sha256(f"body {i}".encode()).hexdigest(), None) for i in range(5)]
    source, target = tmp_path / "m.warc.gz", tmp_path / "n.warc.gz"
    source.write_bytes(gzip.compress(b"".join(records)))
    assert warc.normalise(f"file://{source}", f"file://{target}") == 5
    assert gzip.decompress(target.read_bytes()) == b"".join(records)
    for line, record in zip((tmp_path / "n.warc.gz.idx").read_text().splitlines(), records):
        at, n = map(int, line.split())
        assert zlib.decompress(target.read_bytes()[at : at + n], 31) == record


def brute_targets(sizes):
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, held = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in held}
        left = total - sum(held.values())
        over = {s for s in free if left * free[s] / sum(free.values()) > 3 * sizes[s]}
        if not over:
            return held | {s: left * w / sum(free.values()) for s, w in free.items()}
        held |= {s: 3 * sizes[s] for s in over}


def test_mixing(docs, empty, repeated, texts):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = collections.Counter()
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        sizes[r.source] += r.size
    want = brute_targets(dict(sizes))
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max([r.size for r in own])
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(repeated).count() == repeated.count()


def brute_mix(rows, targets, max_repeat=3.0):
    """Expected copies by bisection, then the order sample by sorting; rows of one source: (row, size, u)."""
    low, high = 0.0, 1e9
    for _ in range(200):
        r = (low + high) / 2
        low, high = (r, high) if sum(min(max_repeat, r * math.sqrt(s)) * s for _, s, _ in rows) < targets else (low, r)
    copies, drawn, left = {}, [], targets
    for k, s, u in rows:
        e = min(max_repeat, high * math.sqrt(s)) if s else 0.0
        copies[k] = math.floor(e + 1e-9)
        left -= copies[k] * s
        p = e - copies[k]
        if p > 0 and s:
            drawn.append((u / (1 - u) / max(p / max(1 - p, 1e-12), 1e-12), k, s))
    for _, k, s in sorted(drawn):
        if left <= s / 2:
            break
        copies[k] += 1
        left -= s
    return copies


def test_mixing_is_the_order_sample(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 3}") for i, n in enumerate(rng.integers(1, 60, 900))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = mixing.mix(table).collect()
    monkeypatch.setattr(mixing, "BIN", 10)
    assert {(r.doc_id, r.copies) for r in mixing.mix(table).collect()} == {(r.doc_id, r.copies) for r in own}
    u = {r.doc_id: r.u for r in table.select("doc_id", F.xxhash64(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(0).cast("long")).alias("x")).selectExpr("doc_id", "(shiftrightunsigned(x, 11) + 0.5D) / 9007199254740992D AS u").collect()}
    for k in range(3):
        mine = [r for r in own if r.doc_id % 3 == k]
        assert {r.doc_id: r.copies for r in mine} == brute_mix([(r.doc_id, r["size"], u[r.doc_id]) for r in mine], mine[0].target)
        # longer documents are likelier to be taken
        odds = np.corrcoef([r["size"] for r in mine], [r.copies for r in mine])[0, 1]
        assert odds > 0.2 and len({round(r.expected, 9) for r in mine}) > 20


def test_groups_of_equal_texts_stay_whole(spark):
    """Unless one fits into no shard; rows of one id are told apart."""
    rows = [(i, f"group {i % 400} " * (1 + i % 40)) for i in range(2000)]
    got = collections.defaultdict(set)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for r in sharding.shard(table).join(table, "doc_id").collect():
        got[r.text].add(r.shard)
    assert all(len(x) == 1 for x in got.values())
    hot = spark.createDataFrame([(None, "the same text")] * 600 + [(i, f"other {i} text") for i in range(1200)], "doc_id long, text string")
    sizes = collections.Counter()
    for r in sharding.shard(hot).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_sharding(docs, empty, repeated, spark):
    big = spark.createDataFrame([(i, "same text here" if i % 3 == 0 else f"text {i} " * (1 + i % 7)) for i in range(3000)], "doc_id long, text string")
    for table in (docs, repeated, big):
        rows = sharding.shard(table).collect()
        assert len(rows) == table.count()
        for s in range(8):
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots)))
    totals = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(totals) < 1.05 * min(totals)
    assert sharding.shard(empty).count() == 0
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in sharding.shard(docs).collect():
        assert r["size"] == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())


def test_pieces_of_words_join_to_the_text():
    reader = lm.Pieces(piece_model())
    column = pa.array(["Hello World again", "", None, "one"])
    from folioscope.llm import _text

    data, at = _text.buffers(column)
    run = lm.read_run(data, at, reader)
    entries = np.array([3, 0, 1, 3])
    sizes, flat = reader.of(entries)
    assert flat.tolist() == [i for k in entries for i in reader.flat[reader.start[k] : reader.start[k] + reader.size[k]]]
    assert sizes.tolist() == [reader.size[k] for k in entries] and reader.of(entries[:0])[1].tolist() == []
    again = lm.Run.unpacked([pa.scalar(b) for b in run.packed()])
    ids, first = again.pieces()
    assert np.array_equal(ids, run.pieces()[0])
    assert reader.codec.decode(ids[: first[1]].tolist()) == "hello world again" and np.diff(first).tolist()[1:3] == [1, 1]
    assert F is not None
