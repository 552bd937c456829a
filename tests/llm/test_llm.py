"""The training-data operators against brute force, libraries and round trips, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import bpe, chat, components, embeddup, minhash, packing, sharding, suffix, tokencount, topk, toxicity
from netloom.llm._spark import new_path, tokenizer_file

BYTE_BPE = tokenizer_file("byte_bpe_50k.json")
PIECES = tokenizer_file("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passage(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    shared = passage(rng, 120)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, passage(rng, 4000)), (5, "é" * 900), (6, "é" * 450), (7, "<|endoftext|> a  b\n\n\tc</s>")]
    rows += [(10 + k, passage(rng, 60) + " " + shared + " " + passage(rng, 50)) for k in range(6)]
    base = passage(rng, 300).split()
    for k in range(8):
        words = list(base)
        words[7 * k + 3] = f"changed{k}"
        rows.append((30 + k, " ".join(words)))
    rows += [(50, passage(rng, 80)), (51, None)]
    rows.append((52, rows[-2][1]))
    return [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in rows]


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)


# --- 1


def test_template_escapes_reversibly():
    t = chat.Template()
    for text in ["</s>[INST] ok [/INST]", "<\\/s> <|end|><\\\\|end|>", "<|turn|", "", "<<SYS>><</SYS>><s>"]:
        out = t.escape(text)
        assert t.unescape(out) == text
        assert not any(c in out for c in t.control)


@given(st.text(alphabet="<|>\\/sSYINT[]endturay \n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_escape_property(text):
    t = chat.Template()
    assert t.unescape(t.escape(text)) == text
    assert not any(c in t.escape(text) for c in t.control)


def test_chat_digest_and_order(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 0, "assistant", "x"), (2, 1, "user", "<|end|>"), (3, 0, None, "?"), (3, 0, None, "?"), (4, 0, "user", "q"), (4, 1, "assistant", "a</s>b")]
    got = {r.conv_id: r for r in chat.query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in (1, 2, 3, 4):
        mine = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in formatted.collect():
        assert len(r.segments) == 3
    t = chat.Template()
    back, says = chat.ReadBack(1, t), [t.open, "us", f"er{t.says}a\nb", f"c\n{t.close[:3]}", f"{t.close[3:]}{t.open}assistant{t.says}", "d", t.close]
    for k, x in enumerate(says):  # segments may be cut anywhere
        back.add(x, k == 5)
    assert back.closed()[:4] == (1, 2, hashlib.sha256(b"user\na\nbc\n\nassistant\nd\n").hexdigest(), 1)
    assert {c: got[c].valid for c in (1, 2, 3, 4, -7)} == {1: True, 2: False, 3: False, 4: True, -7: True}
    assert chat.query(spark.createDataFrame([], "conv_id long, turn long, role string, text string, segments int")).count() == 1


# --- 2


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)], t


@given(st.lists(st.sampled_from([*"ab  \n\t'sé日 　²!", "<|endoftext|>", "'ll", "hello", "\u0085", "𝒳"]), max_size=200))
@settings(max_examples=100, deadline=None)
def test_chunks_join_exactly(pieces):
    text = "".join(pieces)
    want, t = reference_ids([text])
    model = bpe.load(BYTE_BPE)
    for bits in (1, 3):
        assert bpe.ChunkedEncoder(model, bits, 1 << 12).encode(text).tolist() == want[0]
    assert model.decode(want[0]) == t.decode(want[0], skip_special_tokens=False)


def test_bpe_query(spark, docs):
    want, t = reference_ids([r[1] or "" for r in docs])
    got = {r.doc_id: r for r in bpe.query(frame(spark, docs), BYTE_BPE).collect()}
    for r, ids in zip(docs, want):
        assert got[r[0]].n_tokens == len(ids)
        assert got[r[0]].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r[0]].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.query(frame(spark, []), BYTE_BPE).count() == 0
    clash = bpe.encode_documents(frame(spark, docs).withColumnRenamed("source", "ids"), BYTE_BPE)
    assert clash.columns.count("ids") == 1


@pytest.mark.parametrize("bits", [6, bpe.CHUNK_BITS])
def test_chunks_are_reused(bits):
    """Two texts that share a passage share its chunks, but for those at its ends."""
    rng = random.Random(1)
    e = bpe.ChunkedEncoder(bpe.load(BYTE_BPE), bits)
    shared = passage(rng, 12000)
    first, second = (f"{passage(rng, 40)} {shared} {passage(rng, 40)}" for _ in range(2))
    assert e.encode(first).tolist() == e.bpe.encode(first)
    chunks, before = e.misses, e.misses
    assert chunks > 15
    assert e.encode(second).tolist() == e.bpe.encode(second)
    assert e.misses - before < 25  # chunks of the 80 other words, and windows around them


# --- 3 and 8


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        c = rng.normal(size=16)
        rows += [(c + rng.normal(size=16) * 0.16).tolist() for _ in range(9)]
    rows += [rows[0], rows[0], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], []]
    return [(3 * i, v, None if i % 17 == 5 else i % 2) for i, v in enumerate(rows)]


def test_embedding_links(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3)
    ok = {}
    for i, v, l in vectors:
        if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[i] = (x / np.linalg.norm(x), l)
    links = {i: [j for j in ok if j != i and ok[j][1] == ok[i][1] and len(ok[j][0]) == len(ok[i][0]) and ok[i][0] @ ok[j][0] >= 0.93] for i in ok}
    for block in (2048, 4):
        got = {r.vec_id: r for r in embeddup.near_duplicates(df, block=block).collect()}
        assert len(got) == len(vectors)
        assert sum(map(len, links.values())) > 100
        for i, _, _ in vectors:
            seen, todo = {i}, [i]
            while todo:
                for j in links.get(todo.pop(), ()):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(seen), min(seen) == i)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, v int")
    assert embeddup.query(empty).count() == 0 and topk.query(empty).count() == 0


def test_top_k(spark, vectors):
    rows = [(50 * (i // 3) if i % 9 == 0 else i, v, l) for i, v, l in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    base = topk.valid_vectors(df, "vec_id", "embedding")
    from pyspark.sql import functions as F

    base = base.withColumn("v", F.transform("v", lambda x: F.floor(256 * x).cast("double")))
    got = collections.defaultdict(list)
    for r in topk.top_k(base.filter("id % 50 = 0"), base, 5, query_tile=4, shard=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, int(r.score)))
    want = collections.defaultdict(list)
    for q, x in ok:
        if q % 50 == 0:  # each row with a repeated id has a list of its own
            want[q] += [(c, -s) for s, c in sorted((-int(sum(a * b for a, b in zip(x, y))), c) for c, y in ok if c != q)[:5]]
    assert max(map(len, want.values())) > 5
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    one = base.filter("id = 0").limit(1)
    assert sorted(r["rank"] for r in topk.top_k(one.union(one), base, 3).collect()) == [1, 1, 2, 2, 3, 3]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, None)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


# --- 4


def test_probability_jaccard_estimate():
    a = {k: 1 + k % 3 for k in range(200)}
    b = {k: 1 + k % 3 for k in range(40, 230)}
    exact = minhash.probability_jaccard(collections.Counter(a), collections.Counter(b))
    direct = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    assert exact == pytest.approx(direct)
    doc = np.repeat([0, 1], [len(a), len(b)])
    element = minhash.mix(np.array([*a, *b], np.uint64))
    sig = minhash.prob_minhash(doc, element, np.array([*a.values(), *b.values()], float), 2, 4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicate_classes(spark, docs):
    got = {r.doc_id: r for r in minhash.query(frame(spark, docs)).collect()}
    counts = {r[0]: minhash.shingle_counts(r[1] or "") for r in docs}
    parent = {i: i for i in counts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in counts:
        for j in counts:
            if i < j and minhash.probability_jaccard(counts[i], counts[j]) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i in counts}
    assert got[3].class_id == 2 and got[37].class_id == 30
    assert minhash.query(frame(spark, [])).count() == 0
    twice = frame(spark, docs + docs)
    assert minhash.query(twice).count() >= len(docs)


def test_near_duplicate_recall(spark):
    """Families of texts changed more and more, chains among them: classes equal those of all links, whatever the size of blocks."""
    rng = random.Random(12)
    texts = []
    for f in range(30):
        words = passage(rng, 150, 5000).split()
        for _ in range(8):
            if f % 3:
                words = list(words)  # a chain: each text changes the last one
            mine = words if f % 3 else list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(mine))
    counts = [minhash.shingle_counts(x) for x in texts]
    n = len(texts)
    links = [(i, j) for i in range(n) for j in range(i) if i // 8 == j // 8 and minhash.probability_jaccard(counts[i], counts[j]) >= 0.8]
    want = components.roots(n, *np.array(links).T)
    assert len(links) > 200 and len(set(want.tolist())) > 40
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (minhash.BLOCK, 3):
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(d, block=block).collect()}
        found = sum(got[i] == got[j] for i, j in links)
        assert found >= 0.98 * len(links)
        assert all(want[i] == want[c] for i, c in got.items())  # nothing is linked that isn't


@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=12), min_size=1, max_size=8), st.sampled_from([0.2, 0.5, 0.8]))
@settings(max_examples=100, deadline=None)
def test_similar_to_the_first(docs, similarity):
    texts = [" ".join(x) for x in docs]
    texts[0] = texts[0] or "a"
    counts = [minhash.shingle_counts(x) for x in texts]
    want = [minhash.probability_jaccard(counts[0], c) >= similarity - 1e-9 for c in counts]
    assert minhash.like_first(texts, similarity, minhash.WordHashes()).tolist() == want


# --- 5


def brute_repeats(rows, length):
    seen = collections.Counter()
    for _, x in rows:
        seen.update(x[k : k + length] for k in range(len(x) - length + 1))
    out = {}
    for i, x in rows:
        gone = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out[i] = (len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,group", [(400, 32768), (24, 32768), (24, 2)])
def test_repeated_bytes(spark, docs, length, group):
    want = brute_repeats([(r[0], (r[1] or "").encode()) for r in docs], length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.query(frame(spark, docs), length, group).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_repeats_small_alphabet(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))) for k in range(40)] + [(100, "a" * 300), (101, "ab" * 100)]
    want = brute_repeats([(i, x.encode()) for i, x in rows], 12)
    for group in (32768, 3):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.query(spark.createDataFrame(rows, "doc_id long, text string"), 12, group).collect()}
        assert got == want


def without_passages(texts, n):
    """Each text without the words that n words in a row cover which also start elsewhere, and how many words these are."""
    seen = collections.Counter()
    for x in texts:
        w = (x or "").split()
        seen.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for x in texts:
        at = [m.span() for m in re.finditer(r"\S+", x or "")]
        w = (x or "").split()
        gone = np.zeros(len(w) + 1, bool)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = True
        step = np.diff(np.concatenate([[0], gone.astype(int)]))
        spans = [(at[a][0], at[b - 1][1]) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
        edges = [0, *(e for s in spans for e in s), len(x or "")]
        out.append(("".join((x or "")[a:b] for a, b in zip(edges[::2], edges[1::2])) if x is not None else None, int(gone.sum())))
    return out


@pytest.mark.parametrize("group", [32768, 2])
def test_repeated_words(spark, docs, group):
    """Passages of 50 words repeat whatever their bytes: short words, letters of two bytes, other white space between."""
    rng = random.Random(21)
    short = [rng.choice("abcdéü") + rng.choice(["", "x", "y"]) for _ in range(60)]
    rows = [r[:2] for r in docs]
    rows += [(100 + k, f"{passage(rng, 30, 9000)} {' '.join(short)} {passage(rng, 30, 9000)}") for k in range(3)]
    rows += [(110, " ".join(short[:49]) + " " + passage(rng, 20, 9000)), (111, "  " + "\n\t".join(short) + " "), (112, "ed " * 300), (113, "ed " * 200), (114, "ed " * 49)]
    rows += [(115, rows[4][1]), (115, " ".join(short)), (None, " ".join(short[5:])), (None, None)]
    want = without_passages([x for _, x in rows], 50)
    d = frame(spark, rows, "doc_id long, text string")
    key = lambda x: (repr(x[0]), repr(x[1]))
    got = suffix.remove_repeats(d, group=group, words=True, removed_col=None).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((i, t) for (i, _), (t, _) in zip(rows, want)), key=key)
    assert sum(n > 0 for _, n in want) > 10 and want[[i for i, _ in rows].index(110)][1] == 0
    counts = suffix.query(d, 24, group).select("doc_id", "passage_words").collect()
    assert collections.Counter(map(tuple, counts)) == collections.Counter((i, n) for (i, _), (_, n) in zip(rows, want))


def test_repeats_clashing_columns(spark, docs):
    """Columns of any name pass through with their values."""
    rows = [(*r[:2], "a", "b", "c", "d", "e") for r in docs]
    names = ["doc", "tag", "removed", "starts", "_doc"]
    d = frame(spark, rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = suffix.remove_passages(d)
    assert out.columns == d.columns
    assert {tuple(r[2:]) for r in out.collect()} == {tuple("abcde")}
    assert suffix.query(d).count() == len(rows)


def test_repeats_edges(spark, docs):
    assert suffix.query(frame(spark, [])).count() == 0
    text = passage(random.Random(9), 200)
    same = [(1, text), (1, text), (None, "x")]
    got = suffix.query(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, len(text), len(text)]
    out = suffix.remove_repeats(frame(spark, docs).withColumn("removed", F_lit())).select("doc_id", "text", "n_chars").collect()
    assert len(out) == len(docs) and all(r.n_chars == len(r.text or "") for r in out)


def F_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


# --- 6


@given(st.lists(st.sampled_from([*"abc  \n▁éü日🙂", "the", "ing", " the", "##"]), max_size=80), st.booleans())
@settings(max_examples=150, deadline=None)
def test_token_counts_equal_the_library(pieces, fallback):
    from tokenizers import Tokenizer, models

    text = "".join(pieces)
    vocabulary = [("<unk>", 0.0), *([(f"<0x{b:02X}>", -5.0) for b in range(256)] if fallback else []), ("▁", -4.0), ("▁▁", -7.0), ("a", -2.0), ("b", -3.0), ("ab", -5.0), ("abc", -9.0), ("c", -4.0), ("bc", -7.0), ("▁the", -3.0), ("th", -2.0), ("e", -2.0), ("the", -4.0), ("i", -3.0), ("n", -3.0), ("g", -3.0), ("ing", -9.0), ("é", -6.0), ("h", -5.0), ("t", -5.0)]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    normal = "▁" + text.replace(" ", "▁") if text else ""
    want = len(library.encode(normal, add_special_tokens=False).ids)
    plain = [v for v in vocabulary if not v[0].startswith("<")]
    counter = tokencount.UnigramCounter(plain, min(s for _, s in vocabulary), fallback)
    assert counter.apart
    assert counter.count(text) == want
    counter.apart = False
    assert counter.count(text) == want


def test_token_count_query(spark, docs):
    from tokenizers import Tokenizer, models

    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(m.id_to_piece(i), float(m.get_score(i))) for i in range(m.vocab_size())]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    got = {r.doc_id: r.n_tokens for r in tokencount.query(frame(spark, docs), PIECES).collect()}
    for i, text, *_ in docs:
        # the library would match the names of special pieces in a text, too
        if text and "<" not in text:
            assert got[i] == len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids)
    assert got[0] == got[1] == 0
    assert tokencount.query(frame(spark, []), PIECES).count() == 0


# --- 7


def plain_score(model, text):
    """A convolution written out: every filter at every place of the padded text, the best place of each, a logistic output."""
    words = toxicity.words_of(text)
    v = [model.embedding[list(toxicity.features(w))].astype(float).sum(axis=0) for w in words] + [np.zeros(toxicity.WIDTH)] * max(toxicity.SPANS)
    z, column = float(model.offset), 0
    for span, filters in zip(toxicity.SPANS, model.filters):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(v[i + o] @ filters[o, :, f].astype(float)) for o in range(span) if i + o < len(v)) for i in range(len(v)))
            z += max(best + float(model.bias[column]), 0.0) * float(model.weight[column])
            column += 1
    return 1 / (1 + np.exp(-z))


def test_scorer_equals_a_plain_convolution():
    rng = np.random.default_rng(3)
    shape = lambda *n: rng.normal(0, 0.5, n).astype(np.float32)
    n = toxicity.FILTERS * len(toxicity.SPANS)
    model = toxicity.Model(shape(toxicity.BUCKETS + 1, toxicity.WIDTH), [shape(s, toxicity.WIDTH, toxicity.FILTERS) for s in toxicity.SPANS], shape(n), shape(n), -0.4)
    r = random.Random(6)
    texts = ["", "one", "one two", "é ü ß", "  !! ", *(passage(r, k) for k in (1, 2, 3, 7, 40, 300)), passage(r, 50) * 3]
    want = [plain_score(model, x) for x in texts]
    assert toxicity.Scorer(model)(texts) == pytest.approx(want, abs=1e-5)
    scorer = toxicity.Scorer(model, limit=8)  # a table that is emptied time and again
    assert [float(scorer([x])[0]) for x in texts] == pytest.approx(want, abs=1e-5)
    vectors = [np.array([toxicity.features(w) for w in toxicity.words_of(x)], np.int32).reshape(-1, 3) for x in texts]
    assert toxicity.score_features(model, vectors) == pytest.approx(want, abs=1e-5)


def test_toxicity_learns(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        words = passage(rng, 40).split()
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(40)] = rng.choice(["rotten", "vileness", "vilest"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, None, None), (5001, "", "xx", None, None)]
    labels += [(0, 0, None), (1, 0, labels[1][2]), (9999, 0, 1)]
    d, l = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.query(d, l).collect()}
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels[:1200]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in truth if got[i].held_out} == set(held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    clean = toxicity.keep_clean(spark, d, l)
    assert clean.columns == d.columns and clean.count() > 900
    clash = d.selectExpr("doc_id", "text", "lang", "'a' as score", "'b' as threshold", "'c' as rejected", "'d' as _score", "n_chars as n_chars")
    kept = toxicity.keep_clean(spark, clash, l)
    assert kept.columns == clash.columns and {tuple(r[3:7]) for r in kept.collect()} == {tuple("abcd")}
    odd = frame(spark, [(None, rows[0][1], None, None, None), (None, passage(rng, 200_000), "en", None, None), *rows])
    assert [r.held_out for r in toxicity.query(odd, l).filter("doc_id is null").collect()] == [False, False]
    assert toxicity.fit(d, l, max_words=40 * 20).embedding.shape and toxicity.query(d, l).count() == len(rows)
    assert toxicity.query(frame(spark, []), l).count() == 0
    assert toxicity.query(d, l.limit(0)).filter("predicted = 1").count() == 0


# --- 9


def check_pieces(pieces, docs, window=2048):
    want, _ = reference_ids([r[1] or "" for r in docs])
    ids = {r[0]: [*w, 1] for r, w in zip(docs, want)}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, x in ids.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(x)
            assert p.ids_crc32 == zlib.crc32(np.array(x[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(x)
    padding = 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(map(len, ids.values()))


def test_packing(spark, docs):
    assert check_pieces(packing.query(frame(spark, docs, parts=2), BYTE_BPE).collect(), docs) < 0.02
    assert packing.query(frame(spark, []), BYTE_BPE).count() == 0


@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), min_size=1, max_size=14))
@settings(max_examples=200, deadline=None)
def test_cuts_are_optimal(parts):
    window = 16
    ends = np.cumsum([n for n, _ in parts])
    penalty = np.array([0.0 if b else 0.75 for _, b in parts])
    penalty[-1] = 0
    pad = lambda n: 0 if n & (n - 1) == 0 else window - n
    pos = [0, *ends.tolist()]
    best = [0.0] + [float("inf")] * len(parts)
    for j in range(1, len(pos)):
        best[j] = min(best[i] + pad(pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= window) + penalty[j - 1]
    cuts = packing.choose_cuts(ends, penalty, window)
    cost = {e: p for e, p in zip(ends.tolist(), penalty.tolist())}
    assert sum(pad(b - a) + cost[b] for a, b in zip([0, *cuts], cuts)) == pytest.approx(best[-1])


# --- 10


def test_sharding(spark, docs):
    df = frame(spark, docs + docs[:3] + [(None, "x", None, None, None)])
    store = sharding.shard_arrivals(df, arrivals=6)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(map(tuple, df.collect()), key=key)
    assert len(store.runs()) < 6
    assert len(store.versions()) > 4
    got = sharding.query(df)
    assert got.count() == df.count()
    assert sharding.query(frame(spark, [])).count() == 0


def test_manifest_is_atomic(spark, docs):
    store = sharding.ShardStore(spark, new_path(spark, "shards"), fanout=3)
    df = frame(spark, docs)
    base = store.append(df)
    before = store.versions()
    with pytest.raises(sharding.CommitConflict):
        store.commit(store.runs(), base - 1)
    assert store.versions() == before and store.read().count() == len(docs)
    store._write(df)  # a writer that dies before its commit
    assert store.read().count() == len(docs)
    assert store.vacuum() == 0  # it may be alive
    assert store.vacuum(older_than=0) == 1
    for _ in range(2):
        store.append(df)
    store.compact()
    assert len(store.runs()) == 1 and store.read().count() == 3 * len(docs)
    assert store.vacuum(older_than=0) == 0
    assert [store.read(v).count() for v in store.versions()] == [len(docs) * n for n in (1, 2, 3, 3)]
    assert store.vacuum(keep=1, older_than=0) == 3
    assert len(store.versions()) == 1 and [store.read(v).count() for v in store.versions()] == [3 * len(docs)]


def test_one_of_many_writers_commits(spark, docs):
    from concurrent.futures import ThreadPoolExecutor

    store = sharding.ShardStore(spark, new_path(spark, "shards"))
    base = store.append(frame(spark, docs))

    def attempt(k):
        try:
            return store.commit([sharding.Run(f"{store.root}/runs/{k}", 1, 1, 1)], base)
        except sharding.CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(attempt, range(24)))
    assert [v for v in got if v] == [base + 1]
    assert store.runs()[0].path.endswith(f"/{[bool(v) for v in got].index(True)}")


def test_rename_does_not_overwrite(spark, docs):
    """The way of stores that aren't local: a rename without options."""
    store = sharding.ShardStore(spark, new_path(spark, "shards"))
    base = store.append(frame(spark, docs))
    store._fs = FarStore(store._fs)
    assert store.commit([], base) == base + 1
    with pytest.raises(sharding.CommitConflict):
        store.commit([], base)


class FarStore:
    def __init__(self, fs):
        self.fs = fs

    def getScheme(self):
        return "far"

    def __getattr__(self, name):
        return getattr(self.fs, name)


# --- pipeline


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    from netloom.llm._spark import cut

    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = cut(stages["toxicity"](spark, d, str(tmp_path)))
    assert clean.count() == len(docs)
    kept = cut(stages["minhash"](spark, clean, str(tmp_path)))
    assert {r.doc_id for r in kept.collect()} & set(range(30, 38)) == {30}
    final = stages["suffix"](spark, kept, str(tmp_path)).collect()
    rows = kept.collect()
    assert {r.doc_id: r.text for r in final} == {r.doc_id: t for r, (t, _) in zip(rows, without_passages([r.text for r in rows], 50))}
    assert all(r.n_chars == len(r.text or "") for r in final)
    check_pieces(pieces, [(r.doc_id, r.text) for r in final])


def test_pipeline_repeated_rows(spark, tmp_path):
    """Of equal rows one stays whole; further texts under one doc_id are documents of their own, and their near copies go."""
    import corpus_pipeline

    from netloom.llm._spark import cut

    rng = random.Random(9)
    twice, other, more = passage(rng, 300), passage(rng, 300, 90), passage(rng, 300, 2000)
    near = more.split()
    near[150] = "changed"
    rows = [(1, twice), (1, twice), (2, other), (2, more), (3, " ".join(near)), (4, None), (4, None)]
    d = frame(spark, rows, "doc_id long, text string")
    kept = cut(corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)))
    key = lambda x: (x[0], x[1] or "")
    want = sorted([(1, twice), (2, other), (2, more), (4, None)], key=key)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == want
    final = corpus_pipeline.drop_repeated_passages(spark, kept, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in final), key=key) == want
    got = minhash.query(d).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in got) == [(1, 1, False), (1, 1, True), (2, 2, True), (2, 2, True), (3, 2, False), (4, 4, False), (4, 4, True)]


def test_pipeline_null_ids(spark, tmp_path):
    """Rows without a doc_id stay like others, and near copies among them go."""
    import corpus_pipeline

    rng = random.Random(10)
    alone, copied, known = passage(rng, 300), passage(rng, 300, 2000), passage(rng, 300, 900)
    near = [x.replace(x.split()[150], "changed") for x in (copied, known)]
    rows = [(None, alone), (None, copied), (None, near[0]), (7, known), (None, near[1]), (None, None), (8, None)]
    d = frame(spark, rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()]
    assert len(got) == 5 and {(None, alone), (7, known), (None, None), (8, None)} < set(got)
    assert len({(None, copied), (None, near[0])} & set(got)) == 1
    classes = collections.Counter((r.doc_id, r.class_id, r.kept) for r in minhash.query(d).collect())
    assert classes == {(None, None, True): 3, (None, None, False): 1, (None, 7, False): 1, (7, 7, True): 1, (8, 8, True): 1}
