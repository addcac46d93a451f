"""Collocations, exact top-k search and hard negatives against brute force and on awkward tables."""

import collections
import math
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import connect, difference
from pyspark.sql import functions as F

from tallyloom.llm import phrases, vectors
from tallyloom.llm.ball_tree import BallTree, top_inner_products
from tallyloom.llm.hyperplane_tree import HyperplaneTree, mine_hard_negatives
from tallyloom.llm.oracles import ORACLES
from tallyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
AZ = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_collocations", "op12_top_k", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


# --- collocations ---------------------------------------------------------------------------


def collocations(rows, support, top, most=5):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, min(most, len(w) - i) + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        held = {p[i : i + s] for p, a in often.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if a >= often[p[i : i + s]]}
        rows = []
        for p in often.keys() - held:
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows = sorted(rows)[:top]
        out += [(lang, i, p.decode(), -a, lf, r, n[lang], -s) for i, (s, a, p, lf, r) in enumerate(rows, 1)]
    return sorted(out)


def mined(frame, **kw):
    return sorted(tuple(r) for r in phrases.mine_collocations(frame, **kw).collect())


def test_collocations_of_shards_in_small_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    expected = collocations(rows, 5, 50)
    assert expected and mined(docs.repartition(7), support=5, top=50, shards=3, run_words=3000) == expected
    assert mined(docs, support=5, top=50) == expected


def test_spelled_phrases_do_not_grow_with_the_runs(spark, monkeypatch):
    """The pass that spells phrases makes about a row a phrase, in however many runs each is met."""
    made = spark.sparkContext.accumulator(0)
    frame = type(spark.range(1))
    map_in_arrow = frame.mapInArrow

    def counting(self, function, schema, *args, **kw):
        def run(batches):
            for batch in function(batches):
                made.add(batch.num_rows)
                yield batch

        return map_in_arrow(self, run if "phrase" in schema else function, schema, *args, **kw)

    monkeypatch.setattr(frame, "mapInArrow", counting)
    # Every text is another order of the same five sentences: all runs meet all phrases.
    parts = ["a b c d e", "f g h i", "new york city", "the end", "x"]
    rows = [(". ".join([*parts[i % 5 :], *parts[: i % 5], f"text {i}"]), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    found, _ = phrases.frequent_phrases(docs, support=20, shards=3, run_words=30)
    brute = collections.Counter()
    for text, _ in rows:
        for w in (piece.split() for piece in text.split(". ")):
            brute.update((" ".join(w[i : i + k]), k) for k in range(1, 6) for i in range(len(w) - k + 1))
    expected = {(p, k, f) for (p, k), f in brute.items() if f >= 20}
    assert {(r.phrase, r.k, r.f) for r in found.collect()} == expected
    assert len(expected) <= made.value <= 2 * len(expected)


def test_collocations_of_odd_rows(spark):
    long = "A b\tc d e f. " * 300 + "é a" * 5
    rows = [(1, None, "en"), (1, "", None), (None, "New York, new york. NEW\nYORK new york " * 3, None), (2, "new york", "und"), (2, "new york", "und"),
            (3, "x x x x x x x x", "x"), (4, "é é \x0b\x0c ,,, É é", "fr"), (5, long, "en"), (6, "w" * 300_000 + " w", "en"), (7, "... \n", "")]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, lang string, h string, f int")
    for support in (1, 2, 3):
        expected = collocations([r[1:] for r in rows], support, 9)
        assert mined(frame, support=support, top=9, shards=2, run_words=20) == expected
    assert mined(frame.where("false")) == [] and mined(frame.withColumn("text", F.lit(None))) == []


def test_collocation_arithmetic_beyond_64_bits(spark, monkeypatch):
    a, n, left, right = 3 * 10**12 + 1, 7 * 10**17 + 3, 4 * 10**12 + 7, 5 * 10**12 + 9
    kinds = "lang string, phrase string, k int, f bigint"
    frequent = spark.createDataFrame([("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right)], kinds)
    totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *args: (frequent, totals))
    (row,) = phrases.mine_collocations(frequent).collect()
    assert row.score == 1000 * a * n // (left * right)


def test_words_of_a_huge_text_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 16)
    text = "ab cd, ef gh ij kl mn op qr st; uv. " * 20
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["_lang", "_text"])
    (held,) = phrases.word_runs(iter([batch]), 10**6, spelled=True)
    whole = [held.texts(at, k).to_pylist() for k, at, _ in phrases.levels(held, 5, lambda k, at, value: np.ones(len(at), dtype=bool))]
    pieces = [p.split() for p in re.split("[,;.]", text)]
    assert whole == [[" ".join(p[i : i + k]) for p in pieces for i in range(len(p) - k + 1)] for k in range(1, 6)]


@pytest.mark.parametrize("step", ["mine", "spell"])
def test_memory_of_a_task_by_words_held(spark, monkeypatch, step):
    """Next to its words a task holds one level of phrases; what is looked up or counted comes in spans."""
    held = 1 << 20
    numbers = np.random.default_rng(3).integers(0, 5000, (600, held // 200))
    column = pa.array([" ".join(f"w{i}" for i in row) for row in numbers])
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(column)), column], ["_lang", "_text"])
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    tasks = []
    texts = SimpleNamespace(mapInArrow=lambda run, schema: (tasks.append(run), spark.range(0).selectExpr("id h", "id mark"))[1])
    bits = phrases.Bits(np.full(1, -1).view(np.uint64), 64)
    if step == "mine":
        phrases._locally_frequent(texts, [bits], 5, 100, 3, held)
    else:
        phrases._spelled(texts, bits, [phrases.Bits(np.zeros(1, dtype=np.uint64), 64), bits], 5, held)
    collections.deque(tasks[0](iter([batch.slice(0, 5)])), 0)  # what stays, like imports, is not counted
    tracemalloc.start()
    made = sum(part.num_rows for part in tasks[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bool(made) == (step == "mine") and peak < 80 * held


# --- vectors --------------------------------------------------------------------------------


def whole(vector, scale):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)


def best_products(rows, k, scale):
    rows = [(i, v) for i, x in rows if i is not None and (v := whole(x, scale)) is not None]
    out = []
    for a, (i, v) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((-product(v, w), j) for b, (j, w) in enumerate(rows) if a != b)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def hard_negatives(rows, k, scale, positives=5):
    rows = [(i, c, v) for i, c, x in rows if i is not None and c is not None and (v := whole(x, scale)) is not None]
    out = []
    for a, (i, c, v) in enumerate(rows):
        if i % 100 == 0:
            scored = sorted((-product(v, w), j, d == c) for b, (j, d, w) in enumerate(rows) if a != b)
            for p, j, _ in [s for s in scored if s[2]][:positives]:
                hard = [(s, m) for s, m, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:k]
                out += [(i, j, rank, m, -p, -s) for rank, (s, m) in enumerate(hard, 1)]
    return sorted(out)


def clustered(n, seed, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    values = centres[rng.integers(0, 6, n)] + 0.05 * rng.normal(size=(n, dim))
    values[: n // 3] = values[0]  # a third are copies
    ids = rng.permutation(n)
    return [(int(i), int(rng.integers(0, 3)) if i % 3 else 1, [float(x) for x in np.float32(v)]) for i, v in zip(ids, values)]


KINDS = "vec_id bigint, label int, embedding array<float>"


def top(frame, **kw):
    return sorted(tuple(r) for r in top_inner_products(frame, F.col("vec_id") % 100 == 0, **kw).collect())


def negatives(frame, **kw):
    return sorted(tuple(r) for r in mine_hard_negatives(frame, F.col("vec_id") % 100 == 0, **kw).collect())


def test_search_with_copies_and_split_units(spark):
    rows = clustered(1500, 5)
    frame = spark.createDataFrame(rows, KINDS)
    for unit_rows in (vectors.UNIT_ROWS, 100):
        assert top(frame, unit_rows=unit_rows) == best_products([(i, v) for i, _, v in rows], 10, 1024)
        assert negatives(frame, unit_rows=unit_rows) == hard_negatives(rows, 10, 256)


def test_search_of_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (100, 2, []), (200, None, [1.0]), (None, 1, [9.0, 9.0]), (1, 1, None), (2, 1, [None, 1.0]),
            (3, 1, [inf, 1.0]), (4, 2, [nan]), (5, 1, [3.0, 1.0, 7.0]), (6, 2, [-3.0]), (7, 2, [0.5, 0.25]), (300, 2, [0.0, 0.0]), (8, 1, [1e300, 0.0]),
            (400, 3, [-1e300, 1.0]), (9, 2, [1e8, 1.0]), (500, 1, [3e8, 1e8])]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id bigint, label int, embedding array<double>, _id int, _unit string")
    assert top(frame) == best_products([(i, v) for i, _, v in rows], 10, 1024)
    assert negatives(frame) == hard_negatives(rows, 10, 256)
    assert negatives(frame.withColumn("label", F.concat(F.lit("l"), "label"))) == hard_negatives(rows, 10, 256)
    for none in (frame.where("false"), frame.where("vec_id = 5"), frame.withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert top(none) == [] and negatives(none) == []
    assert top(spark.createDataFrame(rows[:2], KINDS)) == [(0, 1, 0, 5 * 2**20)] * 2


@pytest.mark.parametrize("tree", [BallTree, HyperplaneTree])
def test_trees_leave_out_what_cannot_count(tree):
    """In clustered vectors few leaves are scored; results are those of a full scan."""
    rows = sorted(clustered(6000, 9, 4))
    values = np.floor(1024 * np.array([v for _, _, v in rows]))
    ids = np.array([i for i, _, _ in rows])
    members = vectors.Members(values, ids, ids, np.zeros(len(ids), dtype=np.int64))
    lanes = vectors.Lanes(values[::100], ids[::100], np.zeros(60, dtype=np.int64), None)
    best = vectors.Best(np.full(60, vectors.LOWEST), np.full(60, vectors.HIGHEST), 10)
    scored = []
    offer = best.offer
    best.offer = lambda who, scores, *rest: (scored.append(scores.size), offer(who, scores, *rest))
    built = tree(members, 32)
    built.search(lanes, best)
    whole = values[::100] @ values.T
    whole[np.arange(60), np.arange(60) * 100] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, whole.shape), -whole), axis=1)[:, :10]
    assert (best.ids == ids[order]).all() and sum(scored) < whole.size / 2
