import math
import mmap
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapline.llm import jaccard, language, mixing, ngram_lm, packing, queries, toxicity
from gapline.llm.elias_fano import MISS, EliasFano, Reader, Trie, Writer
from gapline.llm.shared import BATCH, crc_fold, drop, small_batches, word_count, written
from gapline.llm.text import words

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "long words " * 60_000
#: Nulls everywhere, empty and very long texts, repeated rows and ids, columns with names that operators use.
ODD = [
    (1, None, "en", "a", 0.5, "x"), (2, "", "en", None, 0.5, "x"), (3, " \t\n\x0b", None, "a", 0.5, "x"), (4, "one", "en", "b", 0.5, "x"),
    (4, "one", "en", "b", 0.5, "x"), (5, LONG, "en", "b", 0.5, "x"), (6, LONG, "de", None, 0.5, "x"), (None, "no id here at all", "en", "c", None, None),
    (7, "Une phrase courte et claire", "fr", "a", 0.5, "x"), (7, "another text with that id", "en", "a", 0.5, "x"), (8, "12 34 !!", "en", "", 0.5, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, component_id string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_words_are_those_of_the_pattern(spark, odd):
    texts = [r[1] for r in ODD] + ["  A B c\x1cd \r\n", "É É"]
    flat, counts = words(pa.array(texts, pa.string()))
    wanted = [tokens(t) for t in texts]
    assert flat.to_pylist() == [w for t in wanted for w in t] and counts.tolist() == [len(t) for t in wanted]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [len(t) for t in wanted]


def model_score(texts, held, mu):
    """Brute force of the language model."""
    lists = [tokens(t) + [""] for t in texts]
    one, two = Counter(), Counter()
    for t, h in zip(lists, held):
        if not h:
            one.update(t)
            two.update(zip(["", *t], t))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (n + v + 1)
    base = [sum(math.log10(p(w)) for w in t) for t in lists]
    score = [sum(math.log10((two[b, w] + mu * p(w)) / (one[b] + mu)) for b, w in zip(["", *t], t)) for t in lists]
    return [(len(t), sum(one[w] > 0 for w in t), n, b, s) for t, b, s in zip(lists, base, score)]


def check_model(df, rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    wanted = sorted(((i if i is not None else -1, h, *m) for (i, _), h, m in zip(rows, held, model_score([t for _, t in rows], held, 100.0))), key=repr)
    got = ngram_lm.score(df, crc_fold(F.col("doc_id"), 7) == 2, shards=3, block_bytes=1 << 16).collect()
    got = sorted(((r["id"] if r["id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=repr)
    for g, w in zip(sorted(got, key=lambda r: (r[0], r[2])), sorted(wanted, key=lambda r: (r[0], r[2])), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], abs=5e-5 * w[2])  # codes have steps


def test_language_model_is_brute_force(docs):
    check_model(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_shards_from_the_bytes_of_text_change_no_score(docs):
    few, many = ({r["id"]: r for r in ngram_lm.score(docs, crc_fold(F.col("doc_id"), 7) == 2, shard_bytes=b).collect()} for b in (1 << 30, 1 << 14))
    assert few.keys() == many.keys()
    for i, r in few.items():
        assert r[:6] == many[i][:6] and r["score"] == pytest.approx(many[i]["score"], abs=5e-5 * r["n_tokens"])


def test_language_model_on_odd_and_empty_tables(odd, empty):
    check_model(odd, [r[:2] for r in ODD])
    assert ngram_lm.score(empty, F.lit(False)).count() == 0
    nothing_learned = ngram_lm.score(odd, F.lit(True)).collect()
    assert {(r["score"], r["base_score"], r["train_tokens"]) for r in nothing_learned} == {(0.0, 0.0, 0)}


@pytest.mark.parametrize("n, universe", [(0, 5), (1, 1), (1, 10**12), (1000, 1000), (5000, 10**9), (70000, 10**7)])
def test_elias_fano_round_trip_and_successor(n, universe):
    values = np.sort(np.random.default_rng(n).integers(0, universe, n))
    out = Writer()
    EliasFano.write(out, values, universe)
    ef = EliasFano(Reader(np.frombuffer(out.dump(), np.uint8)))
    assert np.array_equal(ef.values(np.arange(n)), values)
    x = np.concatenate([values[:50], np.random.default_rng(1).integers(0, universe, 50)])
    place, found = ef.successor(x, 0, n)
    assert np.array_equal(place, np.searchsorted(values, x)) and np.array_equal(found, np.isin(x, values))
    if n * 20 < universe:
        assert len(out.dump()) < 240 + n * (np.log2(max(2, universe / max(n, 1))) + 3) / 8  # at most five arrays' heads, a block


def held_bytes(x):
    """The bytes that an open sequence or trie holds outside of its file."""
    inner = [x, *getattr(x, "levels", []), *getattr(x, "pointers", []), *getattr(x, "codes", [])]
    arrays = [a for y in inner for a in (vars(y).values() if hasattr(y, "__dict__") and not isinstance(y, np.ndarray) else [y]) if isinstance(a, np.ndarray)]

    def mapped(a):
        while a is not None and not isinstance(a, mmap.mmap):
            a = getattr(a, "base", None)
        return a is not None

    return sum(a.nbytes for a in arrays if not mapped(a))


def test_an_open_trie_stays_in_its_file(tmp_path):
    text = np.random.default_rng(3).zipf(1.3, 400_000) % 5000
    grams = [np.unique(np.stack([text[i : len(text) - 2 + i] for i in range(k)], 1), axis=0) for k in (1, 2, 3)]
    (tmp_path / "t").write_bytes(Trie.build(5000, grams, [np.full(len(g), -1.0) for g in grams]))
    trie = Trie(str(tmp_path / "t"))
    assert held_bytes(trie) == 0
    assert (tmp_path / "t").stat().st_size < sum(len(g) for g in grams) * 8  # a sorted array of 64-bit n-grams, without probabilities
    assert (trie.find(grams[2]) != MISS).all()


def test_long_runs_and_far_groups():
    # a group of more ones than a word holds, then groups without any
    values = np.concatenate([np.zeros(500, np.int64), np.full(70, 9), np.array([4000, 4000, 9999])])
    out = Writer()
    EliasFano.write(out, values, 10_000)
    ef = EliasFano(Reader(np.frombuffer(out.dump(), np.uint8)))
    x = np.array([0, 1, 8, 9, 10, 3999, 4000, 4001, 9999])
    place, found = ef.successor(x, 0, len(values))
    assert np.array_equal(place, np.searchsorted(values, x)) and np.array_equal(found, np.isin(x, values))
    assert ef.successor(np.array([9]), np.array([510]), np.array([520]))[0].tolist() == [510]


def test_trigram_trie(tmp_path):
    text = np.random.default_rng(2).integers(0, 12, 600)
    grams = [np.unique(np.stack([text[i : len(text) - 2 + i] for i in range(k)], 1), axis=0) for k in (1, 2, 3)]
    logs = [-np.random.default_rng(k).random(len(g)) * 5 for k, g in enumerate(grams)]
    (tmp_path / "t").write_bytes(Trie.build(12, grams, logs))
    trie = Trie(str(tmp_path / "t"))
    for g, log in zip(grams, logs):
        assert np.abs(trie.log10(trie.find(g)) - log).max() < 1e-4
    every = np.stack(np.meshgrid(*[np.arange(12)] * 3), -1).reshape(-1, 3)
    there = {tuple(r) for r in grams[2]}
    assert [c != MISS for c in trie.find(every)] == [tuple(r) in there for r in every]


def jaccard_classes(texts, size, num, den):
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def families():
    """Texts that differ in a few words, at all sizes, with links near the threshold, shared passages and a chain."""
    draw, out = np.random.default_rng(9), []
    passage = " ".join(f"p{i}" for i in range(40))
    for n in (1, 3, 4, 7, 10, 13, 25, 40, 60, 100, 200, 420):
        base = [f"w{draw.integers(10**6)}" for _ in range(n)]
        out.append(" ".join(base))
        for changed in (0, 1, 2, 3, 5, 8):
            w = list(base)
            for at in draw.integers(0, n, changed):
                w[at] = f"x{draw.integers(10**6)}"
            out += [" ".join(w), " ".join(w[: max(1, n - changed)])]
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):
        out.append(" ".join(chain[step * 4 :] + [f"d{i}" for i in range(step * 4)]))
    out += [f"{passage} tail{i} " + " ".join(f"{i}y{k}" for k in range(8)) for i in range(40)]
    return out


@pytest.mark.parametrize("size, num, den, large", [(4, 85, 100, 4096), (5, 80, 100, 3)])
def test_jaccard_join_is_brute_force(spark, size, num, den, large):
    texts = families()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes, roots = jaccard_classes(texts, size, num, den)
    got = {r["id"]: r for r in jaccard.join(df, size=size, num=num, den=den, large=large).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert sum(r["first"] for r in got.values()) == len(set(roots))


@pytest.mark.parametrize("size, num, den, block", [(4, 85, 100, 1024), (5, 80, 100, 4)])
def test_jaccard_join_counts_every_link(spark, size, num, den, block):
    texts = families()
    texts += texts[::5]
    sets = [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset() for w in map(tokens, texts)]
    linked = lambda a, b: bool(a) and bool(b) and den * len(a & b) >= num * len(a | b)
    wanted = [sum(linked(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.duplicates(df, size=size, num=num, den=den, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == wanted and max(wanted) > 3


def test_jaccard_links_on_odd_and_empty_tables(odd, empty):
    got = sorted(((r["doc_id"] or 0, r["n_links"]) for r in jaccard.duplicates(odd).collect()))
    assert got == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 1), (6, 1), (7, 0), (7, 0), (8, 0)]
    assert jaccard.duplicates(empty).columns == ["doc_id", "n_shingles", "n_links", "component_id"]


def test_jaccard_join_on_odd_and_empty_tables(odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.duplicates(odd).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 4 - 2, 5), (6, 2, 5), (None, 2, None), (7, 2, 7), (7, 2, 7), (8, 1, 8)], key=repr)
    kept = jaccard.one_of_each(odd).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept) == sorted([(1, 0), (2, 0), (3, 4), (4, 3), (5, len(LONG)), (0, 17), (7, 27), (7, 25), (8, 8)])
    assert kept[0].__fields__ == [f.split()[0] for f in SCHEMA.split(", ")]
    assert jaccard.duplicates(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_blocks_survive_empty_ones():
    """Sets whose blocks are often empty are dealt again, so that any pair has a name in common."""
    draw = np.random.default_rng(4)
    for n in range(7, 60):
        for _ in range(30):
            a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
            d = max(x[1] for x in jaccard.ladders(n, 85, 100))
            change = 2 * n * 15 // 185 // 2
            b = np.unique(np.concatenate([a[change:], draw.integers(0, 2**63, change).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (2 * n - common) and d:
                assert len(np.intersect1d(jaccard.names(a, 85, 100), jaccard.names(b, 85, 100)))
                sketches, at = [jaccard.sketch(x) for x in (a, b)], np.array([0])
                assert jaccard.distances(sketches, at, at + 1)[0] <= len(np.setxor1d(a, b))


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by rounds: what is over goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix_reaches_its_targets(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [(i, "w " * int(draw.integers(0, 400)), [None, "", "a", "b", "hot", "é", "𝒳"][min(6, int(draw.exponential(2)))]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(df, block=64, shard_slots=512)).toPandas()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    wanted = fill({(None if s is None or s != s else s): int(n) for s, n in sizes.items()})
    assert (got["taken"] <= 2 * got["size"]).all() and (got["size"] == [len(tokens(t)) for _, t, _ in sorted(rows)]).sum() >= 0
    for s, of in got.groupby("source", dropna=False):
        target = wanted[None if s is None or s != s else s]
        assert of["target"].iloc[0] == pytest.approx(target) and (of["source_size"] == of["size"].sum()).all()
        assert abs(of["taken"].sum() - target) <= max(0.05 * target, 4 * 64)
    again = mixing.taken(mixing.mix(df.repartition(7, "source"), block=64, shard_slots=512)).toPandas()
    assert dict(zip(got["doc_id"], got["taken"])) == dict(zip(again["doc_id"], again["taken"]))


def test_permutation_is_one(spark):
    df = spark.createDataFrame([(n, p) for n in (1, 2, 5, 10, 17, 100, 1000) for p in range(n)], "n long, p long")
    got = df.select("n", mixing._permuted(F.col("p"), F.col("n"), F.lit(3)).alias("x")).toPandas()
    for n, of in got.groupby("n"):
        assert sorted(of["x"]) == list(range(n))


def test_mix_on_odd_and_empty_tables(odd, empty):
    got = mixing.taken(mixing.mix(odd, block=8)).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 2 * got["size"]).all()
    assert mixing.taken(mixing.mix(empty)).count() == 0
    mixed = mixing.mixed_documents(odd, odd.columns, block=8)
    assert mixed.columns == odd.columns
    assert sum(len(tokens(r["text"])) for r in mixed.collect()) == got["taken"].sum()
    assert mixing.mixed_documents(empty, empty.columns).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_places_every_word_once(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = [(64,), (32, 64, 128), (5, 50), (128, 256)][seed]
    rows = [(i, " ".join(["w"] * int(n))) for i, n in enumerate(draw.integers(0, 3 * sizes[-1], 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df, sizes=sizes, group_rows=100).toPandas()
    for i, text in rows:
        of = got[got["doc_id"] == i].sort_values("start")
        assert of["words"].sum() == len(tokens(text)) and list(of["start"]) == list(of["words"].cumsum() - of["words"])
    for _, of in got.groupby("bin"):
        of = of.sort_values("slot")
        assert of["capacity"].iloc[0] == min(s for s in sizes if s >= of["words"].sum()) and of["used"].iloc[0] == of["words"].sum()
        assert list(of["offset"]) == list(of["words"].cumsum() - of["words"]) and list(of["slot"]) == list(range(len(of)))


def test_best_fit_takes_the_least_room_and_the_cheapest_size():
    bins = packing.pack([6, 5, 4, 3, 2], (10,))
    assert sorted(sorted([6, 5, 4, 3, 2][i] for i in b) for _, _, b in bins) == [[2, 3, 5], [4, 6]]
    # two of 5 fill a sequence of 10; one of 20 would stay half empty
    assert [c for c, _, _ in packing.pack([5, 5], (10, 20))] == [10]
    assert [c for c, _, _ in packing.pack([7], (8, 32))] == [8]
    best = packing.pack([20] * 8, (40, 100), cost=0)
    assert sum(c for c, _, _ in best) == 160 and packing.pack([], (8,)) == []


def test_every_opening_takes_the_cheapest_size_of_what_is_left(monkeypatch):
    chosen, choose = [], packing.opening_size
    monkeypatch.setattr(packing, "opening_size", lambda *a: chosen.append(choose(*a)) or chosen[-1])
    bins = packing.pack([60] * 40 + [30] * 20 + [7] * 11, (64, 128, 256))
    assert len(chosen) == len(bins) > 9 and sum(len(b) for _, _, b in bins) == 71


def test_packing_on_odd_and_empty_tables(odd, empty):
    got = packing.pack_documents(odd.select("*", F.lit(1).alias("Used"), F.lit(2).alias("_row"))).toPandas()
    assert got["words"].sum() == sum(len(tokens(r[1])) for r in ODD)
    assert packing.pack_documents(empty).count() == 0


def test_language_on_held_out_rows(spark):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    out = both[both["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97 and both["score"].between(0, 1).all()
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both["doc_id"]]).all()


def test_language_stage_rejects_an_unlearned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for hidden in ("de", "es", "fr"):
        blind = docs.withColumn("lang", F.when(F.col("lang") != hidden, F.col("lang")))
        kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, blind, "").select("doc_id").collect()}
        rows = docs.filter(F.col("text").rlike(r"\pL")).select("doc_id", "lang").collect()
        unlearned, learned = [r["doc_id"] in kept for r in rows if r["lang"] == hidden], [r["doc_id"] in kept for r in rows if r["lang"] != hidden]
        assert np.mean(unlearned) < 0.1 and np.mean(learned) > 0.97


def test_language_stage_on_odd_and_empty_tables(odd, empty):
    kept = corpus_pipeline.identify_language(None, odd, "")
    assert kept.columns == odd.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}
    assert corpus_pipeline.identify_language(None, empty, "").count() == 0


def naive_labels(net, data):
    """Log probabilities of every byte of one text: the recurrence, a number at a time over single bytes."""
    sigmoid = lambda u: 1 / (1 + np.exp(-u))
    padded, h = [32] * language.CONTEXT + list(data) + [32] * (language.CONTEXT + -len(data) % 32), net.h
    sums = np.zeros((len(padded), len(net.bias))) + net.bias
    for way in (0, 1):
        table, inner, state = net.table[way].astype(float), net.inner[way].astype(float), np.zeros(h)
        for t in range(len(padded)) if way == 0 else reversed(range(len(padded))):
            given = table[padded[t]]
            z = sigmoid(given[:h] + state @ inner[:, :h])
            r = sigmoid(given[h : 2 * h] + state @ inner[:, h : 2 * h])
            state = (1 - z) * state + z * np.tanh(given[2 * h :] + (r * state) @ inner[:, 2 * h :])
            sums[t] += state @ net.out[way]
    sums = sums[language.CONTEXT : language.CONTEXT + len(data)]
    return sums - np.log(np.exp(sums).sum(1, keepdims=True))


def test_every_byte_is_labelled_as_by_the_plain_recurrence():
    net = language.Network(["a", "b", "c"], hidden=5)
    texts = ["Ab  c\n\td", "", "x", "y" * 200, "\u00e9 \u4e2d" * 9]
    logs, plain, n = language.pooled(net, pa.array([*texts, None]))
    for i, text in enumerate(texts):
        data = text.lower().encode()
        want = naive_labels(net, data)
        assert n[i] == len(data)  # white space too
        assert logs[i] == pytest.approx(want.sum(0), rel=1e-4, abs=1e-4) and plain[i] == pytest.approx(np.exp(want).sum(0), rel=1e-4, abs=1e-4)
    assert n[-1] == 0 and not logs[-1].any()


def test_windows_of_long_texts_agree_with_one_pass():
    net = language.Network(["a", "b"], hidden=6)
    draw = np.random.default_rng(2)
    text = "".join(draw.choice(list("abc de\n"), 3000))
    logs, plain, n = language.pooled(net, pa.array(["short", text, "z" * 256]))
    want = naive_labels(net, text.encode())
    assert n.tolist() == [5, 3000, 256]
    # states are warmed up on CONTEXT bytes, which leaves a small difference
    assert logs[1] / 3000 == pytest.approx(want.mean(0), abs=2e-3) and plain[1] / 3000 == pytest.approx(np.exp(want).mean(0), abs=2e-3)
    assert language.pooled(net, pa.array([text]))[0][0] == pytest.approx(logs[1], rel=1e-5)  # whatever is read beside it


def test_gradients_are_those_of_the_loss():
    net = language.Network(["a", "b", "c"], hidden=3)
    for k in language.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    draw = np.random.default_rng(0)
    x, y, counted = draw.integers(0, 256, (5, 4)), draw.integers(0, 3, 4), np.array([[0, 1, 1, 1]] + [[1, 1, 1, 0]] * 4, float)
    _, g = net.gradients(x, y, counted)
    for k, at in (("table", (0, int(x[2, 0]), 1)), ("table", (1, int(x[4, 1]), 7)), ("inner", (0, 1, 2)), ("inner", (1, 2, 7)), ("out", (1, 2, 0)), ("bias", (1,))):
        a, step = getattr(net, k), 1e-3
        a[at] += step
        up = net.gradients(x, y, counted)[0]
        a[at] -= 2 * step
        down = net.gradients(x, y, counted)[0]
        a[at] += step
        assert g[k][at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-4)


def test_texts_of_every_length_teach():
    long = "ab cd " * 60_000
    model = language.fit(iter([(pa.array([long, "xy zw"]), ["aa", "bb"])]), steps=60)
    net = language.Network.load(model)
    assert net.languages == ["aa", "bb"]
    assert language.predict(net, pa.array(["cd ab cd ab", "zw xy xy zw"])).field(0).to_pylist() == ["aa", "bb"]


def test_pieces_have_every_byte_once():
    offsets = np.cumsum([0, 5, 0, 700, 224, 1])
    for alone in (0.0, 0.5, 1.0):
        doc, first, length, by_itself = language.pieces(offsets, 224, alone, np.random.default_rng(1))
        assert sorted(x for a, n in zip(first, length) for x in range(a, a + n)) == list(range(930))
        assert all(offsets[d] <= a and a + n <= offsets[d + 1] for d, a, n in zip(doc, first, length))
        assert length[by_itself].max(initial=0) <= 32 and by_itself.any() == (alone > 0)


def test_every_row_teaches_and_layout_does_not_matter(spark):
    rows = [(i, ("ab ba abba " if i % 2 else "yz zy zyyz ") * 8, ("aa", "bb")[i % 2]) for i in range(60)]
    schema, options = "doc_id long, text string, lang string", {"max_rows": 4, "steps": 20, "shard": 1000}
    df = spark.createDataFrame(rows, schema)
    nets = [language.train_on_all(x, **options) for x in (df, df.repartition(7))]
    assert nets[0] == nets[1]
    # a row that the first sample is without
    for i in range(60):
        changed = spark.createDataFrame([(k, t.replace("b", "c").replace("z", "x") if k == i else t, n) for k, t, n in rows], schema)
        if language.train(changed, max_rows=4, steps=20) == language.train(df, max_rows=4, steps=20):
            break
    assert language.train_on_all(changed, **options) != nets[0]


def test_all_rows_of_odd_and_empty_tables_teach(odd, empty):
    assert language.Network.load(language.train_on_all(odd)).languages == language.Network.load(language.train(odd)).languages
    assert language.train_on_all(empty) == language.train(empty)


def test_least_scores_count_all_rows(spark):
    draw = np.random.default_rng(2)
    word = lambda: "".join(draw.choice(list("abcdefg"), 4))
    rows = [(i, " ".join(word() for _ in range(1 + i % 7)), "aa") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(iter([(pa.array([" ".join(word() for _ in range(50)), "opq rstu opru stuq " * 10]), ["aa", "bb"])]), steps=60)
    net = language.Network.load(model)
    got = language.predict(net, pa.array([t for _, t, _ in rows]))
    scores = np.sort(got.field(1).to_numpy()[np.array(got.field(0).to_pylist()) == "aa"])
    for lost in (0.3, 0.6):
        exact = np.floor(scores[int(lost * len(scores))] * 10_000) / 10_000
        assert exact > 0.75
        assert language.least_scores(docs, model, lost) == {"aa": pytest.approx(exact, abs=1e-4), "bb": 0.75}


def test_language_on_odd_and_empty_tables(odd, empty):
    model = language.train(odd)
    got = [(r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()]
    assert [x[0] for x in got[:3]] == ["und"] * 3 and got[-1] == ("und", 0.0)
    assert got[3] == got[4] and all(0 < s <= 1 for _, s in got[3:10])
    assert language.identify(empty, model).count() == 0
    untaught = language.identify(odd, language.train(empty)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in untaught] == [("und", 0.0)]


def test_toxicity_finds_words_it_learned(spark):
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        w = [f"w{draw.integers(300)}" for _ in range(40)] + (["Vile!", "nasty"] if bad else [])
        draw.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, known.filter("doc_id < 800"), max_rows=400)
    got = toxicity.score(df, model).toPandas()
    out = got[got["doc_id"] >= 800]
    assert (out["predicted"] == (out["doc_id"] % 6 == 0)).mean() > 0.99
    assert len(toxicity.Weights(model).places) < 300


def naive_ftrl(examples, labels, alpha, beta, l1, l2, order):
    """Weights by FTRL-proximal as published, a coordinate at a time in dictionaries; "bias" has no L1."""
    z, n = {}, {}

    def weight(k):
        bound = 0 if k == "bias" else l1
        return 0.0 if abs(z.get(k, 0.0)) <= bound else -(z[k] - np.sign(z[k]) * bound) / ((beta + n[k] ** 0.5) / alpha + l2)

    for i in order:
        present = [*examples[i], "bias"]
        w = {k: weight(k) for k in present}
        gradient = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
        for k in present:
            rate = ((n.get(k, 0.0) + gradient**2) ** 0.5 - n.get(k, 0.0) ** 0.5) / alpha
            z[k], n[k] = z.get(k, 0.0) + gradient - rate * w[k], n.get(k, 0.0) + gradient**2
    return {k: w for k in z if (w := weight(k))}


def naive_features(text):
    """The features of a text by name: words, stems, marks of stems with several words, pairs and skips."""
    w = [x for x in (x.strip(toxicity.PUNCTUATION) for x in tokens(text)) if x]
    out = {("w", x) for x in w} | {("n", *x) for x in zip(w, w[1:])} | {("s", *x) for x in zip(w, w[2:])}
    for size in toxicity.STEMS:
        stems = {}
        for x in w:
            if len(x) > size:
                stems.setdefault(x[:size], set()).add(x)
        out |= {("p", size, k) for k in stems} | {("r", size, many, k) for k, v in stems.items() for many in toxicity.REPEATS if len(v) >= many}
    return out


def test_toxicity_is_the_plain_algorithm():
    draw = np.random.default_rng(4)
    pool = [f"{a}{b}" for a in ("wordone", "wordtwo", "ab", "x!") for b in ("", "a", "bc", "longer")]
    texts = [" ".join(draw.choice(pool, draw.integers(0, 12))) for _ in range(60)] + [None, "!!", "wordone"]
    labels = [int("wordtwoa" in (t or "")) for t in texts]
    options = dict(alpha=1.0, beta=1.0, l1=0.3, l2=0.1)
    model = toxicity.Weights(toxicity.fit(iter([(pa.array(texts[:20]), labels[:20]), (pa.array(texts[20:], pa.string()), labels[20:])]), epochs=2, seed=3, **options))
    turn = np.random.default_rng(3)
    order = [i for _ in range(2) for i in turn.permutation(len(texts))]
    examples = [naive_features(t or "") for t in texts]
    owner, place = toxicity.features(pa.array(texts, pa.string()), 22)
    assert [len(set(place[owner == i])) for i in range(len(texts))] == [len(e) for e in examples]
    want = naive_ftrl(examples, labels, order=order, **options)
    assert len(model.places) == len(want) - 1 and model.bias == pytest.approx(want["bias"], abs=1e-4)
    plain = [1 / (1 + np.exp(-sum(want.get(k, 0.0) for k in [*e, "bias"]))) for e in examples]
    assert toxicity.scores(pa.array(texts, pa.string()), model) == pytest.approx(plain, abs=1e-4)


def test_a_long_labelled_text_teaches(spark):
    rows = [(i, "plain words here", 0) for i in range(40)] + [(100 + i, "filler " * 45_000 + "vileness", 1) for i in range(4)] + [(200, "vileness", 1), (201, "plain", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.filter("doc_id < 200").select("doc_id", "toxic"), l1=0.1)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert got[200] > 0.5 > got[201]


def test_toxicity_learns_from_16000_rows(spark):
    df = spark.range(17_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for known, least, most in ((labels, 15_700, 16_000), (labels.filter("doc_id < 12000"), 12_000, 12_000)):
        rows, _ = toxicity.sample(df, known, "doc_id", "text", "toxic", 16_000)
        assert least <= rows.count() <= most


def test_small_batches_bound_what_a_task_is_given(spark):
    df = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def given(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with small_batches(spark):
        sizes = [r[0] for r in df.mapInArrow(given, "size long").collect()]
    assert sum(sizes) >= 40 << 20 and max(sizes) <= BATCH + (2 << 20)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_reading_written_tables_takes_no_direct_memory(spark):
    def direct():
        pools = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
        return sum(p.getMemoryUsed() for p in pools if p.getName() == "direct")

    rows = spark.range(0, 24, 1, 1).select(F.expr("concat_ws('', transform(sequence(1, 8192), x -> sha2(string(id * 8192 + x), 512)))").alias("text"))
    with small_batches(spark):
        df, path = written(rows)  # 24 MB in one file
        try:
            before = direct()
            assert df.agg(F.sum(F.length("text"))).first()[0] == 24 << 20
            assert spark.read.parquet(path).agg(F.sum(F.octet_length("text"))).first()[0] == 24 << 20
            assert direct() - before < 4 << 20
        finally:
            drop(spark, path)


def test_toxicity_on_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    clashing = odd.withColumn("score", F.lit("mine")).withColumn("Predicted", F.lit("mine"))
    assert sorted(toxicity.score(clashing, model).columns) == sorted({*odd.columns, "score", "predicted"})
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"] == got[2]["score"]
    assert toxicity.score(empty, model).count() == 0
    untaught = toxicity.score(odd, toxicity.train(odd, labels.limit(0))).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in untaught] == [(0.5, 0)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    from tests.oracle import by_sql, same

    same(queries.QUERIES[name](spark, FOLDER).toPandas(), by_sql(queries.ORACLE[name], FOLDER))
