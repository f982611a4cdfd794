"""Packing, clustering and phrases against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.llm import best_fit_packing, centroid_clusters, phrases

from ..conftest import duck, same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece string, ids string, w1 string, rank int, part int"


def documents(spark, rows):
    """Rows (doc_id, text, lang) with further columns whose names the operators use."""
    return spark.createDataFrame([(*r, "s", 1, "p", "i", "w", 1, 2) for r in rows], DOCS)


def prose(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiourstlnBé9.,'-") for _ in range(r.randint(1, 12))) for _ in range(n))


# -- 11


def least_bins(items: list[int], capacity: int) -> int:
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= items[i] and bins[b] not in bins[:b]:
                bins[b] -= items[i]
                go(i + 1, bins)
                bins[b] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def test_fixed_sets_cost_nothing():
    """What is fixed and the best packing of the rest are together the best packing of all."""
    r, fixed = random.Random(1), 0
    for _ in range(600):
        capacity = r.choice([10, 20, 37])
        items = [r.randint(r.choice([1, capacity // 5, capacity // 4]), capacity) for _ in range(r.randint(1, 9))]
        count = dict(Counter(items))
        sets = best_fit_packing.reduce(count, capacity)
        rest = [w for w, n in count.items() for _ in range(n)]
        n = sum(times for _, times in sets)
        fixed += n
        assert n + least_bins(rest, capacity) == least_bins(items, capacity)
    assert fixed > 600


def test_plan_packs_every_piece_once_and_stays_small():
    r = random.Random(2)
    for _ in range(100):
        capacity = r.choice([10, 50, 100])
        count = {r.randint(1, capacity): r.choice([1, 2, 3, 10**9]) for _ in range(40)}
        packed = Counter()
        for pattern, times in best_fit_packing.plan(count, capacity):
            assert times > 0 and sum(w * n for w, n in pattern.items()) <= capacity
            packed.update({w: n * times for w, n in pattern.items()})
        assert packed == count
    count = {w: 10**9 // w for w in range(1, 2049)}
    plan = best_fit_packing.plan(count)
    assert len(plan) < 4 * 2048
    assert sum(times for _, times in plan) <= 1.001 * sum(w * n for w, n in count.items()) / 2048


ODD = ["Don't STOP, 12345 ...!!!", "İstanbul ΣΑΣ é́ ́x", "a\x1cb \x85z y　日本語", "<|endoftext|>y x<|startoftext|>", "\x0b\x0ca\x1fb", "ﬁ ½ Å 😀"]


def test_runs_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    encoder = best_fit_packing._encoder(open(best_fit_packing.vocabulary_path(), encoding="utf-8").read())
    plain = Tokenizer.from_file(best_fit_packing.vocabulary_path())
    texts = [*ODD, "", "  \n", *ODD, "".join(map(chr, range(33, 127))) + " I'VE we'll they'D x's'T .'s !!'re ''m <|end|> _a_ 1a22b", prose(300)]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode([]) == []
    slow = best_fit_packing._encoder(encoder.tokenizer.to_str(), None)
    assert all((a == b).all() for a, b in zip(encoder.encode([t.encode() for t in texts]), slow.encode([t.encode() for t in texts]), strict=True))


def test_forgetting_changes_nothing(monkeypatch):
    rules = open(best_fit_packing.vocabulary_path(), encoding="utf-8").read()
    want = best_fit_packing.Encoder(rules).encode([prose(50, k).encode() for k in range(40)])
    monkeypatch.setattr(best_fit_packing, "_KNOWN", 100)
    encoder = best_fit_packing.Encoder(rules)
    assert all((encoder.encode([prose(50, k).encode()])[0] == w).all() for k, w in enumerate(want)) and len(encoder.known) <= 100


def test_every_document_ends_with_the_end_id(spark):
    """Also those that share a slice of text with others."""
    got = best_fit_packing.pieces(documents(spark, [(i, "of an", "en") for i in range(7)]).coalesce(1), 64, end=5, with_ids=True).collect()
    assert [x.ids[-1] for x in got] == [5] * 7 and len({x.ids_crc32 for x in got}) == 1


@pytest.mark.parametrize("layout", [1, 5])
def test_packing(spark, layout):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(best_fit_packing.vocabulary_path())
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("an of lorem ipsum x9 token-ising é".split()) for _ in range(r.choice([1, 5, 30, 50, 90]))), None) for i in range(60)]
    rows += [(100 + i, t, "en") for i, t in enumerate([None, "", " \n ", "word " * 100_000, "q" * 300_000, "of " * 63, "of " * 64, "of " * 127, *ODD])]
    rows += [rows[0], rows[0], rows[5], (None, "of " * 20, None), (None, "of " * 20, None), (2**60 + 1, "an", "x")]
    packed = best_fit_packing.pack(documents(spark, rows).repartition(layout), 64, with_ids=True).cache()
    got = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]

    want = Counter()
    for doc_id, text, _ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 64)):
            own = ids[start : start + 64]
            want[doc_id, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, tuple(x.ids)) for x in got) == want

    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(by) <= math.ceil(sum(x.length for x in got) / 64) * 1.02 + 1
    whole = {s.sequence_id: s for s in best_fit_packing.sequences(packed).collect()}
    assert sum(len(s.ids) for s in whole.values()) == sum(x.length for x in got)
    assert all(whole[x.sequence_id].ids[x.offset : x.offset + x.length] == x.ids for x in got)
    packed.unpersist()


# -- 12


def brute_clusters(vectors, k, rounds, dim):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]
    c = [q for _, q in seeds]
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    near = lambda q: min((far(q, x), n) for n, x in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, q in kept:
            own[near(q)[1]].append(q)
        c = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else old for o, old in zip(own, c, strict=True)]
    return Counter((i, near(q)[1], near(q)[0]) for i, q in kept), c


def clouds(n, dim, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, dim))
    return [(int(i), (centre[i % 6] + r.normal(scale=0.3, size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("dim", "n", "k", "block"), [(4, 900, 8, 128), (64, 300, 8, 4096), (2, 500, 3, 100), (4, 5, 8, 64)])
def test_clusters(spark, dim, n, k, block):
    rows = clouds(n, dim, n)
    rows += [(900 + i, v) for i, v in enumerate([None, [], [1.0] * (dim - 1), [1.0] * (dim - 1) + [None], [float("nan")] * dim, [float("inf")] * dim, [-0.5] * dim, [0.0] * dim])]
    rows += [(1000 + i, rows[1][1]) for i in range(300 if n > 100 else 3)] + [rows[2]] * 3 + [(None, rows[3][1]), (None, [0.25] * dim)]
    df = spark.createDataFrame([(i, v, 1, "c", [1], 2) for i, v in rows], "vec_id long, embedding array<float>, label int, cluster string, q array<int>, n int").repartition(3)
    got, centroids = centroid_clusters.cluster(df, k=k, dim=dim, block=block)
    want, c = brute_clusters([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k, 10, dim)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert centroids.tolist() == c


def test_ties_go_to_the_smaller_number_and_whole_nodes_are_assigned():
    points = np.array([[x, 0] for x in range(-200, 201)], np.int64)
    order, tree = centroid_clusters.grow(points, 8)
    points = points[order]
    centroids = np.array([[100, 0], [-100, 0], [100, 0]])
    whole, left = centroid_clusters.filtered(tree, centroids)
    shape = tree["shape"]
    covered = sum(int((shape[nodes, 1] - shape[nodes, 0]).sum()) for nodes, _ in whole + left)
    assert covered == len(points)
    assert sum(int((shape[nodes, 1] - shape[nodes, 0]).sum()) for nodes, _ in whole) > 150  # equal centroids stay open, the far side does not
    at, d = centroid_clusters.nearest(points, np.ones((len(points), 3), bool), centroids)
    assert at[points[:, 0] == 0].tolist() == [0] and set(at) == {0, 1} and d.max() == 10000


def test_repeated_points_are_one_leaf():
    _, tree = centroid_clusters.grow(np.ones((5000, 3), np.int64))
    assert len(tree["shape"]) == 1 and tree["sums"][0].tolist() == [5000] * 3


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroid_clusters.quantised(df).collect()


# -- 13


def brute_phrases(rows, least, share, top):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for sep in ".,;:!?\n\x0b\x0c\r":
            text = (text or "").replace(sep, "\n")
        for piece in text.translate(lower).split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        longer = [b for (g, v), b in cand.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    got = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        got += [(lang, k + 1, *x[1:]) for k, x in enumerate(own)]
    return sorted(got)


def talk(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    common = ["of the", "A B c d", "x y z", "Ünder é😀 w"]
    word = lambda: r.choice(["a", "b", "Of", "the", "é😀", f"w{r.randint(0, 40)}"])
    text = lambda: "".join(r.choice([word(), r.choice(common)]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n"]) for _ in range(r.randint(0, 60)))
    return [(i, text(), r.choice(["en", "de", None])) for i in range(n)]


@pytest.mark.parametrize(("least", "parts"), [(3, 1), (5, 4), (2, 64)])
def test_phrases(spark, least, parts, monkeypatch):
    """With many partitions nearly every prefix is a hot one; with one, none is."""
    monkeypatch.setattr(phrases, "shuffle_partitions", lambda s: parts)
    rows = talk(least, 120)
    rows += [(500, None, "en"), (501, "", None), (502, "one", "en"), (503, "a b " * 20_000, "xx"), (504, "of the " * 300 + "z" * 100_000, "en"), rows[0], rows[0], (None, "of the A B c d", "en")]
    rows += [(None, "very hot pair " + str(i), "hot") for i in range(200)]
    got = phrases.collocations(documents(spark, rows), least=least, top=50)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(rows, least, 80, 50)


def test_phrases_in_many_small_batches(spark, monkeypatch):
    """Groups that go on over slices and batches."""
    monkeypatch.setattr(phrases, "_SLICE", 300)
    rows = talk(9, 150)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in phrases.collocations(documents(spark, rows), least=3).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == brute_phrases(rows, 3, 80, 2000)


def test_query_of_phrases_equals_sql_on_odd_texts(spark, tmp_path):
    rows = [(i, t, g) for i, t, g in talk(4, 80)] * 4
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = phrases.op13_phrases(spark, str(tmp_path))
    assert got.filter(F.col("a") >= 30).count() > 20
    same_rows(got, duck(str(tmp_path)), phrases.SQL["op13_phrases"])
