"""Token files, packing, substring deduplication, Jaccard join, LM scores, toxicity, pages, top-k; all by brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fillwise.llm import jaccard as J
from fillwise.llm import packing as K
from fillwise.llm import pages as G
from fillwise.llm import repair as P
from fillwise.llm import substrings as S
from fillwise.llm import toxicity as X
from fillwise.llm.common import Words, grams
from fillwise.llm.components import components
from fillwise.llm import lm
from fillwise.llm.lm import BLOCK_BYTES, BLOCK_ROWS, cross_entropy_difference
from fillwise.llm.substrings import dedup_substrings
from fillwise.llm.tokens import Encoder, tokenizer_path
from fillwise.llm.topk import score_type, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "a  b", " lead", "trail ", "x \n y", "it's  we'll <|endoftext|> b", "tab\tx y\n\nz  ", "line\nline two\n", "\nfirst\nsecond", "a \nb\n c", "it's\n'll", "é́ ́x a\xa0b\x85c", "ΑΣ ΒΣ", "12 34.5 $$$", "\x1c a \x1cb", "日本 語", "w" * 3000, "go " * 3000]


def prose(rng, n, vocabulary=400):
    return " ".join(f"v{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


# --- helpers -------------------------------------------------------------------------------------------------------


def test_words():
    w = Words(pa.array(["a b\x0ba", None, "", " \n", "  b  c "]))
    assert w.lengths.tolist() == [3, 0, 0, 0, 2]
    assert [w.vocabulary[i].as_py() for i in w.codes] == ["a", "b", "a", "b", "c"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 26, 50])
def test_grams_tell_sequences_apart(n):
    rng = random.Random(n)
    ids = [rng.randrange(3) for _ in range(400)]
    h = grams(np.array(ids, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), n)
    seen = {}
    for i in range(len(ids) - n + 1):
        seen.setdefault(tuple(ids[i : i + n]), set()).add(int(h[i]))
    assert len(h) == len(ids) - n + 1 and all(len(s) == 1 for s in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    label = {}

    def root(a):
        while label.setdefault(a, a) != a:
            a = label[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {a: root(a) for a in label}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# --- tokens and files ----------------------------------------------------------------------------------------------


def library_ids(name, texts):
    """What the library's own ``encode`` gives, text by text: (ids, bounds)."""
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    each = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    return np.array([i for e in each for i in e], np.uint32), np.cumsum([0, *map(len, each)])


@pytest.mark.parametrize(("name", "pieces"), [("word_bpe_49k.json", "spaces"), ("byte_bpe_50k.json", "bytes"), ("byte_bpe_50k.json", "none")])
def test_pieces_give_the_tokenizer_s_ids(name, pieces):
    texts = [*ODD, "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> c", "<|endoftext", *(prose(random.Random(i), 50) for i in range(20))]
    e = Encoder(tokenizer_path(name), pieces)
    for k in range(3):
        if k == 2:
            e.most = 10
            texts = [t and t + " new" + str(i) for i, t in enumerate(texts)]
        got, want = e.encode(pa.array(texts)), library_ids(name, texts)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


@pytest.mark.parametrize("most", [3, 100_000])
def test_runs_of_pieces_give_the_tokenizer_s_ids(most, monkeypatch):
    """Texts of characters that may move a cut, with and without room to remember their pieces."""
    rng = random.Random(most)
    letters = [*"aBé字\n\r\t  1!#\xa0\u3000\u0120\u010a😀\x00\x1c", "ß", "'s", "23", "word"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", "x <|endoftext|>y"]
    e = Encoder(tokenizer_path("byte_bpe_50k.json"), "bytes", most)
    runs = []
    run = e._run
    monkeypatch.setattr(e, "_run", lambda words: runs.append(len(words)) or run(words))
    want = library_ids("byte_bpe_50k.json", texts)
    for part in (texts, texts):
        got = e.encode(pa.array(part))
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert sum(runs) > 200
    # a vocabulary in which the starts of pieces can't be told: every word by itself
    other = Encoder(tokenizer_path("byte_bpe_50k.json"), "bytes", most)
    other.starts[:] = False
    got = other.encode(pa.array(texts))
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


@pytest.mark.parametrize("room", [1, 7, 4096])
def test_most_frequent_is_a_stable_order(room):
    count = np.random.default_rng(room).integers(1, 9, 5000).astype(np.int32)
    assert np.array_equal(P.most_frequent(count, room), np.argsort(-count, kind="stable")[:room])


def _last_counts(symbols, ends):
    pairs = Counter()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        pairs.update(zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist()))
    return max(pairs.values(), default=0)


@pytest.mark.parametrize("seed", range(40))
def test_no_frequent_pair_is_left_out_of_a_round(seed, monkeypatch):
    """Small shards with empty documents; rounds of few rules leave frequent pairs to later ones."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(P, "ROUND", int(rng.choice([1, 3, 4096])))
    n = int(rng.integers(0, 3000))
    ids = rng.integers(0, int(rng.choice([1, 2, 8, 60])), n).astype(np.uint32)
    bounds = np.concatenate(([0], np.sort(rng.integers(0, n + 1, int(rng.integers(0, 12)))), [n]))
    base = int(rng.choice([62, 65_530, 70_000]))
    symbols, ends, rules = P.compress(ids, bounds, base)
    assert _last_counts(symbols, ends) < P.LEAST
    shard = P.Shard(P.pack(list(range(len(bounds) - 1)), ids, bounds, base))
    assert np.array_equal(shard.ids(), ids) and np.array_equal(np.diff(shard.starts), np.diff(bounds))


@pytest.mark.parametrize("base", [50, 70_000])
def test_repair_round_trip(base):
    rng = random.Random(base)
    docs = [[rng.randrange(6) for _ in range(rng.choice([1, 5, 40, 300]))] for _ in range(60)] + [[1] * 500, [1, 2] * 200, [2]]
    ids = np.array([x for d in docs for x in d], np.uint32)
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    shard = P.Shard(P.pack([None, *range(1, len(docs))], ids, bounds, base))
    assert np.array_equal(shard.ids(), ids) and shard.doc_ids[0] is None and shard.doc_ids[5] == 5
    assert len(shard.symbols) < 0.6 * len(ids) and shard.lengths.tolist() == [len(x) for x in _expand(shard, base)]
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d
        a = rng.randrange(len(d))
        b = rng.randrange(a, len(d) + 1)
        assert shard.window(k, a, b).tolist() == d[a:b]


def test_repair_ends_when_no_pair_is_frequent():
    """Over more rules than 16 bits hold, with rounds that save little each."""
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 50_000, (6000, 8))[rng.integers(0, 6000, 50_000)].ravel().astype(np.uint32)
    bounds = np.arange(0, len(ids) + 1, 400)
    base = 50_257
    symbols, ends, rules = P.compress(ids, bounds, base)
    assert len(rules) > 65536 - base and _last_counts(symbols, ends) < P.LEAST
    shard = P.Shard(P.pack(list(range(len(bounds) - 1)), ids, bounds, base))
    assert np.array_equal(shard.ids(), ids) and np.array_equal(shard.symbols, symbols) and np.array_equal(shard.rules, rules)
    assert shard.window(5, 17, 230).tolist() == ids[2017:2230].tolist()


def _expand(shard, base):
    out = []
    for left, right in shard.rules.tolist():
        out.append([y for x in (left, right) for y in (out[x - base] if x >= base else [x])])
    return out


def test_token_files(spark):
    rows = [(i, prose(random.Random(i), 30), "x") for i in range(60)] + [(100 + i, t, "x") for i, t in enumerate(ODD)] + [(3, "again", "x"), (None, "no id", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tie string")
    got = P.token_files(docs, tokenizer_path("byte_bpe_50k.json"), "bytes", 2, 50_257, shards=5, shard_ids=400).orderBy("start").collect()
    ids, bounds = library_ids("byte_bpe_50k.json", [r[1] for r in rows])
    want = Counter()
    for r, a, b in zip(rows, bounds[:-1], bounds[1:]):
        one = np.append(ids[a:b], 2).astype("<u4")
        want[(r[0], len(one), zlib.crc32(one.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    order = [(r.doc_id is None, r.doc_id) for r in got]
    assert order[:-2] == sorted(order[:-2]) and all(o[0] for o in order[-2:])
    assert P.token_files(docs.limit(0), tokenizer_path("byte_bpe_50k.json"), "bytes", 2, 50_257, shards=2).count() == 0


def plans_fill(counts, found, capacity):
    total = np.zeros(capacity + 1, int)
    for items, n in found:
        assert sum(items) <= capacity and n > 0
        for x in items:
            total[x] += n
    assert (total == counts).all()
    return sum(n for _, n in found)


def test_plan_beats_best_fit():
    counts = np.zeros(2049, int)
    counts[[700, 683, 1030, 1020, 500]] = 5000
    assert plans_fill(counts, K.plan(counts, 2048), 2048) < plans_fill(counts, K.best_fit(counts, 2048), 2048)
    rng = np.random.default_rng(1)
    many = np.bincount(np.clip(rng.lognormal(3, 1, 4000).astype(int), 1, 256), minlength=257)
    assert plans_fill(many, K.plan(many, 256), 256) <= 1.002 * -(-int((many * np.arange(257)).sum()) // 256) + 1
    assert K.plan(np.zeros(9, int), 8) == []


def test_most_pieces_lie_in_the_program_s_configurations():
    """Thousands of lengths of few pieces each: rounding must not leave the work to best fit."""
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.lognormal(6, 1.1, 9000).astype(int), 1, 2048), minlength=2049)
    columns, covered = K.solve(counts, 2048)
    bound = float((counts * np.arange(2049)).sum()) / 2048
    assert K.value(columns, covered, counts, 2048) < 1.005 * bound
    parts = K.rounded(counts, 2048)
    assert sum(len(items) * n for part in parts for items, n in part) > 0.75 * counts.sum()
    assert plans_fill(counts, K.plan(counts, 2048), 2048) <= min(-(-bound // 1) + 1, plans_fill(counts, K.best_fit(counts, 2048), 2048) + 1)


def test_packing(spark):
    rows = [(i, prose(random.Random(i), 5 + i * 13 % 120), 1) for i in range(150)] + [(7, "same", 1)] * 4 + [(500 + i, t, 1) for i, t in enumerate(ODD)] + [(None, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    got = K.pack(docs, tokenizer_path("word_bpe_49k.json"), "spaces", 0, capacity=128).collect()
    ids, bounds = library_ids("word_bpe_49k.json", [r[1] for r in rows])
    want = Counter()
    for r, a, b in zip(rows, bounds[:-1], bounds[1:]):
        one = np.append(ids[a:b], 0).astype("<u4")
        for k in range(0, len(one), 128):
            want[(r[0], k // 128, k, len(one[k : k + 128]), zlib.crc32(one[k : k + 128].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.03 * -(-sum(r.length for r in got) // 128) + 1
    assert K.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json"), "spaces", 0).count() == 0


# --- duplicates ----------------------------------------------------------------------------------------------------


def brute_substrings(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k : k + window])] = min(i, first.get(tuple(w[k : k + window]), i))
    out = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    return out


def test_factors_follow_any_of_their_references():
    place = np.array([0, 5, 9, 14, 40])
    ref = lambda places, tie=1: np.array([tie << 32 | p for p in places])
    first = (np.array([1, 1, 2, 2, 9]), ref([100, 105, 50, 55, 0]))
    before = (np.array([3, 9, 1, 1, 4]), ref([7, 0, 109, 114, 3]))
    # document 1 holds the first four anchors at one distance, partly as the first, partly as the last reference
    assert S.factors(place, [first, before], 9, 26) == [(0, 40), (40, 66)]
    assert S.factors(place, [first], 9, 26) == [(0, 31), (9, 40)]
    assert S.factors(place, [first, before], 1, 26) == []


@pytest.mark.parametrize(("window", "hot"), [(4, 1), (7, 1000), (50, 2), (50, 1000)])
def test_substrings(spark, window, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    rng = random.Random(window)
    passages = [prose(rng, rng.randrange(window - 1, 3 * window)) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [prose(rng, rng.randrange(0, 2 * window)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            a = rng.randrange(len(p))
            parts.insert(rng.randrange(4), " ".join(p[a:] if rng.random() < 0.5 else p))
        rows.append((rng.randrange(200), "  ".join(parts)))
    rows += [(300 + k, rows[3][1]) for k in range(5)] + [(400, "x " * 5 * window), (401, "x " * 3 * window), (402, None), (403, ""), (404, " \n"), (None, rows[3][1]), (None, None), (5, rows[9][1]), (5, rows[9][1])]
    docs = spark.createDataFrame([(*r, 0, "c0") for r in rows], "doc_id bigint, text string, n_words int, _id string")
    out = dedup_substrings(docs, window)
    assert out.columns == ["doc_id", "text", "_id", "n_words", "n_removed", "kept_sha256"]
    got = out.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(rows, window)
    for r in got:
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == r.kept_sha256
    assert dedup_substrings(docs.limit(0), window).count() == 0


def brute_links(rows, n, threshold):
    sets, label = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a] | sets[b])) >= Fraction(str(threshold)):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    classes = {}
    for a in range(len(rows)):
        classes.setdefault(root(a), []).append(rows[a][0])
    name = {r: min((i for i in ids if i is not None), default=None) for r, ids in classes.items()}
    return Counter((rows[a][0], name[root(a)], links[a]) for a in range(len(rows)))


def near_rows():
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = prose(rng, 120).split()
        for k in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"new{g}{k}"
            rows.append((1000 - len(rows), " ".join(copy)))
    rows += [(5, rows[3][1]), (5, rows[3][1]), (6, "a b"), (7, "a  b"), (8, "a b c"), (9, None), (10, ""), (11, " "), (None, rows[3][1]), (None, "only null"), (12, "go " * 2000)]
    return rows


@pytest.mark.parametrize("block", [3, 384])
def test_jaccard_join(spark, block):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, tie string")
    got = J.similarity_join(docs, block=block)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_links(rows, 5, 0.8)
    assert J.similarity_join(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("threshold", "trees"), [(0.3, 20), (0.5, 20), (0.95, 20)])
def test_recall_at_other_thresholds(spark, threshold, trees):
    rng = random.Random(9)
    rows = []
    for g in range(15):
        base = prose(rng, 60, 5000).split()
        for k in range(8):
            cut = rng.randrange(60)
            rows.append((len(rows), " ".join(base[:cut] + prose(rng, 60 - cut, 5000).split()) if rng.random() < 0.7 else " ".join(base)))
    want = brute_links(rows, 5, threshold)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (4, 384):
        got = J.similarity_join(docs, threshold=threshold, trees=trees, block=block).collect()
        assert sum(r.n_links for r in got) >= 0.99 * sum(k[2] * n for k, n in want.items()) > 0
        assert len(set(Counter((r.doc_id, r.class_id, r.n_links) for r in got)) - set(want)) <= 3


def test_join_refuses_a_recall_that_it_cannot_reach(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="take 31"):
        J.similarity_join(docs, threshold=0.2)


def test_a_tight_group_is_counted_without_comparing(spark, monkeypatch):
    """A group of near copies of one text: nearly all its pairs are certain, so that the compared blocks stay few."""
    rng = random.Random(10)
    base = prose(rng, 300, 5000).split()
    rows = [(k, " ".join(base[: 10 + k % 280] + [f"new{k}"] + base[11 + k % 280 :])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, whole = [], J._large

    def counting(*a):
        dealt, certain, in_tries = whole(*a)
        seen.append((dealt.count(), certain.agg(F.sum("links")).first()[0]))
        return dealt, certain, in_tries

    monkeypatch.setattr(J, "_large", counting)
    got = J.similarity_join(docs, block=50).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 899)}
    assert seen[0] == (0, 900 * 899)


@pytest.mark.parametrize(("blocks", "size"), [(16, 8_000_000), (2, 8_000_000), (16, 2_000)])
def test_a_loose_group_is_copied_once_a_side(spark, monkeypatch, blocks, size):
    """Near copies whose pairs the centre cannot decide: what is joined grows with the group, not with its square."""
    rng = random.Random(13)
    base = prose(rng, 100, 5000).split()
    rows = []
    for k in range(150):
        copy = list(base)
        for i in rng.sample(range(100), rng.choice([1, 2, 3, 4])):
            copy[i] = f"new{rng.randrange(3)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, whole = [], J._large

    def counting(*a):
        out = whole(*a)
        seen.append((a[0].count(), out[0].count()))
        return out

    monkeypatch.setattr(J, "_large", counting)
    monkeypatch.setattr(J, "SIDE_BLOCKS", blocks)
    monkeypatch.setattr(J, "SIDE_BYTES", size)
    got = J.similarity_join(docs, block=4)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_links(rows, 5, 0.8)
    assert seen and seen[0][0] > 100
    if (blocks, size) == (16, 8_000_000):
        assert all(copied <= 6 * n for n, copied in seen)


def test_a_chain_is_compared_by_trie_node(spark):
    """A long chain of texts that overlap with the next ones only is one component; its blocks would be all pairs."""
    rng = random.Random(12)
    words = prose(rng, 4000, 10**6).split()
    rows = [(k, " ".join(words[4 * k : 4 * k + 150])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = J.similarity_join(docs, block=20)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_links(rows, 5, 0.8)


def test_shorter_prefixes_find_what_deep_ones_miss(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    few = J.similarity_join(docs, trees=2, depth=6, least_depth=1, recall=0.999)
    deep = J.similarity_join(docs, trees=2, depth=6, least_depth=6, recall=0.999)
    count = lambda df: df.agg(F.sum("n_links")).first()[0]
    truth = sum(k[2] * n for k, n in brute_links(rows, 5, 0.8).items())
    assert count(deep) <= count(few) <= truth and count(few) >= 0.97 * truth


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, class_id string, _id string")
    kept = J.without_near_copies(docs)
    assert kept.columns == docs.columns
    classes = {}
    for (i, c, n), _ in brute_links(rows, 5, 0.8).items():
        classes.setdefault(c, i)
    got = [r.doc_id for r in kept.collect()]
    with_words = {c for c in classes if c is not None}
    assert with_words <= set(got) and len([g for g in got if g is not None]) == len({g for g in got if g is not None})


# --- search --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("scale", "chunk"), [(1.0, 16_384), (1.0, 3), (1e5, 16_384), (1e7, 16_384)])
def test_top_k(spark, scale, chunk):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in (rng.normal(size=6) * scale).astype(np.float32).round(1)]) for i in range(150)]
    vectors += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (205, [1.0, 2.0]), (None, [1.0] * 6), (7, [0.0] * 6), (20, vectors[40][1]), (220, [0.0] * 6)] + [(40, vectors[40][1])] * 2 + [(60, vectors[61][1])] * 12
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id bigint, embedding array<float>, score int")
    got = top_k(df, F.col("vec_id") % 20 == 0, k=9, chunk=chunk).collect()
    good = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in vectors if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = Counter()
    for at, (q, e) in enumerate(good):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, v)), i) for k, (i, v) in enumerate(good) if k != at)[:9]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_score_types():
    one = np.ones((1, 64), np.int64)
    assert [score_type(one * q, one * q) for q in (64, 5000, 1 << 30)] == [np.float32, np.float64, object]


# --- language model and toxicity -------------------------------------------------------------------------------------


def test_every_word_of_a_large_target_counts(spark):
    wanted = spark.createDataFrame([(" ".join(f"w{i:06}" for i in range(200_100)),)], "text string")
    docs = spark.createDataFrame([(1, "w200099"), (2, "w000001"), (3, "unknown")], "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in cross_entropy_difference(docs, wanted).collect()}
    assert score[1] == score[2] != score[3]


def test_rows_of_a_large_corpus_stay_few():
    """6 GB of words of 4 bytes: a row for each block and range, each with thousands of keys."""
    words, blocks = 1_500_000_000, 6_000_000_000 // BLOCK_BYTES
    assert words // (blocks * lm.n_ranges(words)) >= 3_000


def test_cross_entropy_difference(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 80), 60)) for i in range(40)] + [(3, "v1 v2"), (3, "v1 v2"), (50, None), (51, ""), (None, "v1 v9"), (None, None)]
    target = [(prose(rng, 60, 30),) for _ in range(5)] + [(None,)]
    docs, wanted = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, loss int"), spark.createDataFrame(target, "text string")
    v = {w for t in [t for t, in target] + [t for _, t in rows] for w in WORD.findall(t or "")}

    def counts(texts):
        c = Counter()
        for t in texts:
            w = ["<s>", *WORD.findall(t or "")]
            c.update(zip(w, w[1:]))
        return c

    models = []
    for c in (counts(t for t, in target), counts(t for _, t in rows)):
        one, ctx = Counter(), Counter()
        for (a, b), n in c.items():
            one[b] += n
            ctx[a] += n
        models.append((c, one, ctx, sum(one.values())))

    def p(m, a, b):
        c, one, ctx, n = m
        return (c[(a, b)] + 8.0 * ((one[b] + 1.0) / (n + len(v) + 1))) / (ctx[a] + 8.0)

    for size in (BLOCK_ROWS, 3):
        monkeypatch.setattr(lm, "BLOCK_ROWS", size)
        monkeypatch.setattr(lm, "BLOCK_BYTES", BLOCK_BYTES if size > 3 else 500)
        got = cross_entropy_difference(docs.repartition(3), wanted.repartition(2)).collect()
        want = Counter()
        for i, t in rows:
            w = ["<s>", *WORD.findall(t or "")]
            s = sum(np.log(p(models[1], a, b)) - np.log(p(models[0], a, b)) for a, b in zip(w, w[1:]))
            want[i, len(w) - 1, round(s / (len(w) - 1) if len(w) > 1 else 0.0, 4)] += 1
        assert Counter((r.doc_id, r.n_words, round(r.score, 4)) for r in got) == want
    assert cross_entropy_difference(docs.limit(0), wanted).count() == 0
    assert cross_entropy_difference(docs, wanted.limit(0)).count() == len(rows)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_levenshtein_distance():
    rng = random.Random(6)
    lexicon = X.Lexicon(("loser", "abc", "stupid", "stupor", "über"), ("vequ",))
    automaton = X.Automaton(lexicon)
    tried = {"".join(rng.choice("losertupidabcüv") for _ in range(rng.randrange(9))) for _ in range(3000)}
    for w in lexicon.words:
        for _ in range(300):
            x = list(w)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randrange(2)] = rng.choice(["", "z", "s", "é"])
            tried.add("".join(x))
    tried |= {"vequ", "vequxyz", "veq", "", "losers!"}
    words = sorted(tried)
    for w, got in zip(words, automaton.run(words)):
        want = X.BEGIN if w.startswith("vequ") else X.EXACT if w in lexicon.words else X.FUZZY if any(distance(w, t) == 1 for t in lexicon.words if len(t) >= 5) else 0
        assert got == want, w


def toxic_corpus():
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(5, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumpkin", "blorgface,", "zwakou" + rng.choice(["ste", "n", "lich", "er"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    extra = [(1000, None), (1001, ""), (1002, "you grumpkim there"), (1003, 'he said: "grumpkin" and left'), (None, "x"), (7, rows[7][1])]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows + extra], "doc_id bigint, text string, score double")
    known = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    got = X.score_toxicity(docs, known).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    scored = {r.doc_id: r for r in got}
    wrong = [r for r in got if r.doc_id in truth and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 0.01 * len(rows)
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if r.held_out}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert scored[1003].score < min(r.score for r in got if truth.get(r.doc_id) == 1)
    assert scored[1000].score == scored[1001].score and scored[1000].predicted == 0
    none = X.score_toxicity(docs, known.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert X.score_toxicity(docs.limit(0), known).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted(X.score_toxicity(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


# --- pages ---------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Site</p></header>
<nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>&nbsp;word<br>next<p class="ad">Advert<p>Two &lt;tag&gt; <!-- no --> &#233;<script>var a="</p>";</script>
<aside>More</aside><div class="share-buttons">Share</div><form><input>Name</form><table><tr><td>a<td>b</tr></table><div class=comments><p>First!</div></article>
<div id="sidebar">Side</div><footer>Foot</footer></body></html>"""


def test_lexicon_has_every_significant_term():
    rng = random.Random(4)
    terms = [f"{a}{b}{c}" for a in "bcdfghjk" for b in "aeiouyxw" for c in "lmnpqrst"]
    toxic = [sorted({*rng.sample(terms, 12), *(f"n{rng.randrange(300)}" for _ in range(20))}) for _ in range(1000)]
    clean = [sorted({f"n{rng.randrange(300)}" for _ in range(20)}) for _ in range(3000)]
    assert set(X.learn_terms(toxic, clean).words) == set(terms)


def test_page(spark):
    want = "Head&line\n\nOne bold word next\n\nTwo <tag> é\n\na b"
    rows = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "not a url", ""), (4, "http://[bad", "<p>plain</p>"), (None, "http://a.example/1", PAGE), (5, "http://b.example", "just text & more"), (6, "http://b.example", "<div><p>unclosed <b>x")]
    got = {(r.page_id, r.text, r.n_chars) for r in G.extract_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")).collect()}
    texts = {1: want, 2: "", 3: "", 4: "plain", None: want, 5: "just text & more", 6: "unclosed x"}
    assert got == {(k, t, len(t)) for k, t in texts.items()}
    assert G.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_boilerplate_without_markup():
    """No article element: what stands on several pages of a host goes, unique runs stay; copies count once."""
    notice = "all rights reserved by the owners of this little site since long ago"
    rng = random.Random(3)
    bodies = [prose(rng, 40) for _ in range(6)]
    pages = [G.blocks(f"<div>{b}</div><div>{notice} page {i}</div>") for i, b in enumerate(bodies)]
    for text, body, i in zip(G.main_texts(pages + pages[:1] * 5), bodies, range(6)):
        blocks = text.split("\n\n")
        assert blocks[0] == body and notice not in text and blocks[1:] in ([f"{i}"], [f"page {i}"], [])


def brute_main_texts(pages):
    """The rules in plain words over the parsed blocks of one host's pages: no suffix array, no hashes."""
    n = G.PASSAGE
    passages = lambda w: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or [tuple(w)]
    bodies = [tuple(t for t, zone, _ in p if zone != G.OUTSIDE) for p in pages]
    kinds = [b or ("", *(t for t, _, _ in p)) for b, p in zip(bodies, pages)]
    on = {}
    for kind, p in zip(kinds, pages):
        for t, _, _ in p:
            for x in passages(t.split(" ")):
                on.setdefault(x, set()).add(kind)
    limit = max(G.PAGES_INSIDE, G.SHARE_INSIDE * len({b for b in bodies if b}))
    out = []
    for body, p in zip(bodies, pages):
        kept = []
        for t, zone, _ in p:
            w = t.split(" ")
            if body and zone == G.OUTSIDE:
                continue
            gone = set()
            for k, x in enumerate(passages(w)):
                if len(on[x]) > limit if zone == G.INSIDE and len(w) >= n else zone != G.INSIDE and len(on[x]) >= G.PAGES_OUTSIDE:
                    gone |= set(range(k, k + len(x)))
            left = [x for k, x in enumerate(w) if k not in gone]
            if left:
                kept.append(" ".join(left))
        out.append("\n\n".join(kept))
    return out


def site(rng, host, pages, article):
    """Pages of one host: with menus and notices, marked or not, copies, quotations, doubtful blocks."""
    note, quote, promo, menu = prose(rng, 14, 10**6), prose(rng, 20, 10**6), prose(rng, 9, 10**6), "Home News Contact"
    out = []
    for i in range(pages):
        body = f"<h1>{prose(rng, 5, 10**6)}</h1><p>{prose(rng, 30, 10**6)}{' ' + quote if i % 4 == 0 else ''}</p>"
        body += f"<p class='share-price'>{promo if i % 2 else prose(rng, 12, 10**6)}</p><p>{note if i % 5 else ''}</p>"
        body = f"<article>{body}</article>" if article(i) else f"<div>{body}</div>"
        out.append((f"http://{host}/{i}", f"<nav>{menu}</nav><div>{menu}</div>{body}<div>{promo} {i}</div><div class='ad'>Buy</div><footer>{note}</footer>"))
    return out + out[:2]


@pytest.mark.parametrize("chunk", [7, 256])
def test_pages_match_brute_force(spark, chunk, monkeypatch):
    """The whole query against the rules by brute force; neither the chunks' size nor the order of the rows matters."""
    rng = random.Random(21)
    found = site(rng, "one.example", 40, lambda i: True) + site(rng, "two.example", 30, lambda i: i % 3 > 0) + site(rng, "three.example", 12, lambda i: False)
    rows = [(k, *r) for k, r in enumerate(found)] + [(900, None, None), (901, "http://one.example", "")]
    monkeypatch.setattr(G, "CHUNK", chunk)
    got = {r.page_id: r.text for r in G.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    by_host = {}
    for i, url, page in rows:
        by_host.setdefault(G.host_of(url), []).append((i, page or ""))
    for members in by_host.values():
        want = brute_main_texts([G.blocks(page) for _, page in members])
        assert [got[i] for i, _ in members] == want
    # repetition decides: without it the texts are others
    monkeypatch.setattr(G, "repeated", lambda streams, pages: [np.zeros(len(t), np.int64) for t in streams])
    mine = [G.blocks(page) for _, page in by_host["one.example"]]
    assert sum(a != b for a, b in zip(G.main_texts(mine), brute_main_texts(mine))) > 20


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n, k in ((0, 1), (1, 1), (9, 1), (60, 2), (300, 3), (200, 50)):
        t = rng.integers(0, k, n)
        order, common = G.suffix_array(t)
        want = sorted(range(n), key=lambda i: t[i:].tolist())
        assert order.tolist() == want
        for x, a, b in zip(common[1:].tolist(), want, want[1:]):
            both = [u == v for u, v in zip(t[a:].tolist(), t[b:].tolist())]
            assert x == (both.index(False) if False in both else len(both))


def test_marks_that_say_something_else_do_not_drop():
    page = "<article><section id='related-work'><p>Kept one</p></section><p class='share-price'>Kept two</p><div class='comment-free zone'>Kept three</div><p>x<math><mi>y</mi></math></p><script/>var a</script><p>end<svg><path/></svg></p><div class='share-buttons'>Tweet</div></article>"
    assert [t for t, _, _ in G.blocks(page)] == ["Kept one", "Kept two", "Kept three", "xy", "end"]
    assert [z for _, z, _ in G.blocks(page)] == [G.DOUBTFUL] * 3 + [G.INSIDE] * 2


def test_large_hosts_count_over_all_chunks(spark):
    """As if the host were one chunk: passages on few pages of many, with and without articles, and many copies."""
    rng = random.Random(11)
    few, half, rare = (prose(rng, 12, 10**6) for _ in range(3))
    rows = [(i, "http://bare.example/", f"<div>{prose(rng, 15, 10**6)}</div><div>{few if i % 150 == 0 else 'x'}</div><div>{rare if i < 2 else 'y'}</div>") for i in range(700)]
    rows += [(1000 + i, "http://full.example/", f"<article><p>{prose(rng, 15, 10**6)}</p><p>{half if i % 9 < 5 else rare}</p></article>") for i in range(600)]
    rows += [(3000 + i, "http://bare.example/", rows[0][2]) for i in range(900)]
    got = {r.page_id: r.text for r in G.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for host in ("bare", "full"):
        mine = [r for r in rows if host in r[1]]
        want = G.main_texts([G.blocks(r[2]) for r in mine])
        assert [got[r[0]] for r in mine] == want
    assert not any(few in t or half in t for t in got.values()) and rare in got[0] and rare in got[1005]
    assert len(got) == len(rows)


def test_short_articles_stay():
    long = prose(random.Random(2), 200)
    page = G.blocks(f"<article><p>{long}</p></article><article><p>Update at noon</p></article><article class='teaser'><p>Read on</p></article><p>beside</p>")
    assert G.main_texts([page]) == [f"{long}\n\nUpdate at noon"]


def test_repeated_is_exact():
    rng = random.Random(5)
    streams = [[rng.choice("abc") for _ in range(rng.randrange(60))] for _ in range(12)]
    pages = [k // 2 for k in range(12)]
    where = {}
    for s, p in zip(streams, pages):
        for k in range(len(s) - 7):
            where.setdefault(tuple(s[k : k + 8]), set()).add(p)
    for s, got in zip(streams, G.repeated(streams, pages)):
        want = [max((len(where[tuple(s[k : k + 8])]) for k in range(max(0, i - 7), min(i, len(s) - 8) + 1)), default=0) for i in range(len(s))]
        if len(s) < 8:  # a short block is a passage as a whole
            want = [len({p for t, p in zip(streams, pages) if t == s})] * len(s)
        assert got.tolist() == want


def test_articles_keep_copies_and_shared_passages():
    shared = prose(random.Random(1), 60)
    pages = [G.blocks(f"<article><p>{prose(random.Random(k), 30)}</p><p>{shared if k % 3 == 0 else prose(random.Random(100 + k), 20)}</p></article>") for k in range(30)]
    texts = G.main_texts(pages * 3)
    assert all(t == "\n\n".join(b[0] for b in p) for t, p in zip(texts, pages * 3))
