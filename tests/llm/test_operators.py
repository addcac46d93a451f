"""Each training-data operator against a brute-force version, and on awkward tables."""

import collections
import hashlib
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from oracle_check import connect, difference
from public_tokenizers import path
from pyspark.sql import functions as F

from tallyloom.llm import chat, edit_prints, licenses, line_dedup, near_dedup, packing, quality, scoring, segmentation, sharding
from tallyloom.llm.oracles import ORACLES
from tallyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODEL = path("piece_bpe_32k.model")
WORDS = path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {i: i + 32 for i in range(65, 91)}
# Null and empty texts, repeated rows, a null key, odd blanks, special tokens, a text without
# blanks, and a column whose name the operators use themselves.
ROWS = [
    (1, None, 0), (2, "", 0), (3, "One two\tthree\x0bfour  É", 0), (3, "One two\tthree\x0bfour  É", 0),
    (None, "one two three four é", 0), (4, "<|endoftext|> a\x1cb ▁ x Σ. don't", 0), (5, "x" * 5000, 0),
    (6, "a b c d e f g h " * 400, 0), (7, " \n\n ", 0), (8, "under the mit license, CC BY-NC!", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, fp int").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def simhash(text):
    w = (text or "").translate(AZ).encode().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF).collect()}
    prints = {i: simhash(t) for i, t in texts.items()}
    top = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and top[a] != top[b]:
                low, high = sorted((top[a], top[b]))
                top = {i: low if t == high else t for i, t in top.items()}
    assert got == {i: (f"{prints[i]:016x}", top[i]) for i in texts}


def test_bk_tree_links_every_component_across_split_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 20)
    values = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 63, (40, 2))})
    frame = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")), [1]) for v in values], "fp binary, shards array<bigint>")
    for size in (4096, 100):
        links = near_dedup.link(frame, 4, size).collect()
        top = {v: v for v in values}

        def find(v):
            while top[v] != v:
                v = top[v]
            return v

        for r in links:
            a, b = int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")
            assert (a ^ b).bit_count() <= 4
            top[find(a)] = find(b)
        assert all(find(a) == find(b) for a in values for b in values if (a ^ b).bit_count() <= 4)


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.component) for r in near_dedup.near_duplicates(odd, "doc_id", "text").collect()}
    assert {(1, 1), (2, 1), (7, 1), (3, 3)} <= got
    assert near_dedup.near_duplicates(empty, "doc_id", "text").count() == 0
    assert near_dedup.keep_one(empty).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 3, 4, 5, 6, 8}


def test_keep_one_decides_by_jaccard(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for n in range(120):  # an own text and one with changes at either side of the limit, with a repeated line
        own = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = own.copy()
        for at in rng.choice(300, int(rng.integers(2, 12)), replace=False):
            other[at] = "changed"
        line = " again and again the same line" * (n % 3 * 20)
        texts[2 * n], texts[2 * n + 1] = " ".join(own) + line, " ".join(other) + line
    texts[900], texts[901] = "a b c d e f g h", "a b c d e f g h i"  # 4 of 5 shingles

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def similarity(a, b):
        a, b = shingles(texts[a]), shingles(texts[b])
        return len(a & b) / len(a | b)

    pairs = {i: similarity(i, i + 1) for i in texts if i % 2 == 0}
    assert 30 < sum(s < 0.8 for s in pairs.values()) and 30 < sum(s >= 0.8 for s in pairs.values())
    expected = {i for i in texts if i % 2 == 0 or pairs[i - 1] < 0.8}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id for r in near_dedup.keep_one(frame).collect()} == expected
    # Split shards, by number of sets and by bytes, give the same components.
    marked = near_dedup.stage(near_dedup.set_sketches(frame, "doc_id", "text", 5))
    found = [near_dedup.similar_links(frame, marked, "text", 5, 0.8, *sizes).collect() for sizes in ((4096, 1 << 25), (1, 1 << 25), (4096, 100))]
    ends = [{frozenset((bytes(r.a), bytes(r.b))) for r in links} for links in found]
    assert ends[0] == ends[1] == ends[2] and len(ends[0]) == sum(s >= 0.8 for s in pairs.values())


def test_keep_one_tells_rows_apart_by_key_and_text(spark):
    copy, alone, other = "a b c d e f g h", "p q r s t u v w", "k l m n o p q r"
    rows = [(1, copy), (1, copy), (2, copy), (None, copy), (2, alone), (None, other), (None, other), (3, None), (3, ""), (3, None)]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = collections.Counter((r.doc_id, r.text or None) for r in got)
    assert got == collections.Counter([(1, copy), (2, alone), (None, other), (3, None)])


def line(text):
    key = text.encode().strip(b" \t\n\x0b\x0c\r").decode().translate(AZ)
    return key if len(key) >= 40 else None


def test_line_dedup(spark, texts):
    hold = collections.defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            hold[line(x)].add(i)
    expected = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (line(x) and len(hold[line(x)]) >= 5 and max(hold[line(x)]) != i)]
        expected[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op2_line_dedup"](spark, SF).collect()}
    assert got == expected and any(n for _, n, _ in expected.values())


def test_line_dedup_of_odd_rows(spark, empty):
    shared = "the same line of more than forty characters, é"
    upper = shared.upper().replace("É", "é")  # only A to Z are one with their capitals
    rows = [(i, f"{upper if (i or 0) % 2 else shared}\nown {i}") for i in (None, 1, 2, 3, 3, 9)] + [(5, None)]
    got = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    expected = [(9, f"{upper}\nown 9", 0), (5, None, 0), *[(i, f"own {i}", 1) for i in (None, 1, 2, 3, 3)]]
    assert collections.Counter((r.doc_id, r.text, r._n_dropped) for r in got.collect()) == collections.Counter(expected)
    assert line_dedup.drop_shared_lines(empty).count() == 0


def test_sharding(spark, texts, odd, empty):
    rows = QUERIES["op3_sharding"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    shards = collections.defaultdict(list)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        shards[r.shard].append(r)
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert len(shards) == 8 and max(sizes) < 1.1 * sum(sizes) / 8
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    homes = collections.defaultdict(set)
    for r in rows:
        homes[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())
    # Forty texts of 2 % each, too large for bundles and too small to split, are balanced among small ones.
    large = [(i, "w " * 1500 + str(i % 40)) for i in range(80)] + [(i, f"small {i}") for i in range(80, 2000)]
    own = collections.defaultdict(lambda: [0, set()])
    for r in sharding.assign_shards(spark.createDataFrame(large, "doc_id bigint, text string"), bundles=64).collect():
        own[r.shard][0] += r["size"]
        own[r.shard][1].add(large[r.doc_id][1])
    assert max(n for n, _ in own.values()) < 1.35 * sum(n for n, _ in own.values()) / 8
    assert sum(len(t) for _, t in own.values()) == len({t for _, t in large})
    assert sharding.assign_shards(odd).count() == len(ROWS) and sharding.assign_shards(empty).count() == 0


def checked(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    left = collections.Counter()
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        piece = ids[r.start : r.start + r.length]
        assert r.doc_tokens == len(ids) and zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) == r.ids_crc32
        left[r.doc_id] += r.length - len(ids) * (r.start == 0)
    assert not any(left.values())
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences) * 2048 / max(1, sum(r.length for r in rows)) - 1


def test_encoder_table(monkeypatch):
    rng = random.Random(5)
    made = list({"".join(rng.choices("abcdefghij", k=8)) for _ in range(60_000)})
    encoder = packing.ChunkEncoder(WORDS)
    encoder.encode(pa.array([" ".join(made[:100])]))
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for i in range(0, len(made), 5000):
        encoder.encode(pa.array([" ".join(made[i : i + 5000])]))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 70 * len(made)
    # Words that the table has forgotten, or learns anew, have the same ids.
    monkeypatch.setattr(packing, "CACHE", 50)
    encoder = packing.ChunkEncoder(WORDS)
    for _ in range(60):
        text = " ".join(rng.choice(made[:300]) + rng.choice(["", ".", ",", " .", "|", "x.", "\u00e9,"]) for _ in range(40))
        ids, n = encoder.encode(pa.array([text, None, ""]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids), 0, 0]
    assert len(encoder.words) < 300


def test_rows_leave_tasks_in_parts():
    batch = pa.RecordBatch.from_pydict({"_doc": [1, 2, 3, 4], "_text": ["a line of text that is long enough to count\n" * 30_000] * 4})
    run, _ = line_dedup._line_rows(40, "bigint")
    assert [x["_doc"].to_pylist() for x in run(iter([batch]))] == [[1, 2], [3, 4]]
    run = line_dedup._drop_rows("_text", "drop", ("lines", "dropped"), 40)
    drop = pa.array([None] * 4, pa.list_(pa.binary()))
    got = list(run(iter([batch.append_column("drop", drop)])))
    assert [len(x) for x in got] == [2, 2] and pa.Table.from_batches(got)["_text"].to_pylist() == batch["_text"].to_pylist()


def test_packing(spark, texts, odd, empty):
    assert checked(QUERIES["op4_packing"](spark, SF).collect(), texts) < 0.02
    named = {r[0]: r[1] for r in ROWS}
    checked(packing.packed_documents(odd.where("doc_id <> 3 or doc_id is null").dropDuplicates(), WORDS, digest=True).collect(), named)
    assert packing.packed_documents(empty, WORDS).count() == 0


@pytest.mark.parametrize("lengths, most", [
    ([1] * 5000, 0.01), ([11] * 5000, 0.03), ([99] * 3000, 0.04), ([682] * 300, 0.01), ([1, 3, 7, 11, 13, 17, 40, 99, 250] * 400, 0.02), ([], 0.01),
])
def test_short_pieces_leave_little_padding(spark, lengths, most):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "_row bigint, _length bigint")
    sequences = collections.defaultdict(list)
    for r in packing.pack(rows).collect():
        sequences[r._sequence].append((r._offset, r._length))
    assert sorted(n for own in sequences.values() for _, n in own) == sorted(lengths)
    for own in sequences.values():
        own.sort()
        assert [at for at, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(own[-1]) <= 2048
    # The last sequence of a small table is as empty as it must be.
    assert 2048 * (len(sequences) - 1) <= (1 + most) * sum(lengths)


def test_cutting_stock_is_near_its_bound():
    rng = np.random.default_rng(0)
    sizes, counts = np.unique(rng.integers(1, 65, 5000), return_counts=True)
    used = packing.cutting_stock(sizes, counts, 64)
    assert (sum(p * n for p, n in used) == counts).all() and all((p * sizes).sum() <= 64 for p, _ in used)
    assert sum(n for _, n in used) <= 1.02 * (sizes * counts).sum() / 64 + 1


def test_segmentation_round_trip(spark, docs, odd, empty):
    for frame in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        coded = segmentation.encode_sampled(frame, MODEL)
        back = segmentation.decode_pieces(coded, MODEL).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in back))) == sorted(map(str, map(tuple, frame.collect())))
        again = segmentation.encode_sampled(frame.repartition(3), MODEL)
        assert sorted(map(str, coded.collect())) == sorted(map(str, again.collect()))
    other = segmentation.encode_sampled(docs, MODEL, seed=1)
    assert sorted(map(str, other.collect())) != sorted(map(str, segmentation.encode_sampled(docs, MODEL).collect()))
    assert segmentation.encode_sampled(empty, MODEL).count() == 0


def test_segmentations_follow_the_weights_of_the_lattice():
    lattice = segmentation.PieceLattice(MODEL, 1.0)
    weights = collections.Counter()

    def walk(rest, ids, weight):
        if not rest:
            weights[tuple(ids)] += weight
        for n in range(1, len(rest) + 1):
            if rest[:n] in lattice.pieces:
                piece, w = lattice.pieces[rest[:n]]
                walk(rest[n:], [*ids, piece], weight * w)

    walk(" there", [], 1.0)
    drawn = lattice.sample(["there"] * 20_000, segmentation.mix(np.arange(20_000, dtype=np.uint64)))
    seen = collections.Counter(tuple(d.tolist()) for d in drawn)
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    assert all(abs(seen[k] / 20_000 - w / total) < 0.02 for k, w in weights.items())


def test_quality_statistics(spark, texts, odd, empty):
    def statistics(text):
        text = text or ""
        w = WORD.findall(text)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
                len(w) < 20 or 100 * len(covered) > 30 * len(w))

    rows = QUERIES["op6_quality"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {i: statistics(t) for i, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in rows)
    judged = quality.judge_quality(odd).collect()
    assert sorted(r.n_words for r in judged) == sorted(len(WORD.findall(t or "")) for _, t, _ in ROWS)
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).count() == 0


def test_estimated_accuracies_find_the_bad_rule():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    votes = [np.where(rng.random(20_000) < a, 1, -1) * np.where(good, 1, -1) for a in (0.9, 0.9, 0.85, 0.6)]
    counted = collections.Counter(zip(*[v.tolist() for v in votes]))
    share, right = quality.estimate(sorted(counted.items()))
    assert abs(share - 0.8) < 0.03 and np.allclose(right, (0.9, 0.9, 0.85, 0.6), atol=0.05)


def test_scores_beat_single_words_on_held_out_documents(spark, docs, odd, empty):
    rng = np.random.default_rng(2)
    left, right = rng.integers(1, 9, 50_000), rng.integers(1, 9, 50_000)
    own = (left + right) % 8 + 1
    window = (left * scoring.CLASSES + right) * scoring.CLASSES + own
    value, n = np.unique(window[:40_000], return_counts=True)
    table = scoring.WindowNetwork().train(value, n, epochs=300).table()
    assert table[window[40_000:]].mean() > -1.0 > -np.log(8)
    rows = scoring.score_documents(docs).collect()
    assert len(rows) == docs.count() and all(r.log_likelihood <= 0 for r in rows)
    scored = {r.doc_id: r for r in scoring.score_documents(odd).collect()}
    assert scored[1].n_tokens == 0 and scored[1].mean_log_likelihood is None
    assert scoring.score_documents(empty).count() == 0


def test_window_counts_are_of_all_words(spark, odd):
    known = scoring.frequent_words(*scoring.common_words(scoring.word_counts(odd, "text"))[:2])
    total = scoring.window_counts(odd, "text", known).agg(F.sum("n")).first()[0]
    assert total == sum(len(WORD.findall(t or "")) for _, t, _ in ROWS)


@pytest.mark.parametrize("common, part", [(1 << 18, 1 << 22), (200, 1 << 10)])
def test_scores_are_sums_over_every_word(spark, docs, monkeypatch, common, part):
    """Against a sum over Python words; with few common words and many parts, most counts meet by the shuffle."""
    monkeypatch.setattr(scoring, "COMMON", common)
    monkeypatch.setattr(scoring, "WORDS_A_PART", part)
    texts = {r.doc_id: [w.encode() for w in WORD.findall((r.text or "").translate(AZ))] for r in docs.collect()}
    counts = collections.Counter(w for t in texts.values() for w in t)
    model = scoring.fit(docs)
    assert model.parts == max(1, sum(counts.values()) // part)
    table = scoring.WindowNetwork.load(model.raw).table()
    found = {}
    for w in counts:
        data = np.frombuffer(w, dtype=np.uint8)
        found[w] = scoring.words(data, np.array([0, len(data)]), scoring.NOT_BLANK)[3]
    classes = {w: int(scoring.word_classes(h, model.known)[0]) for w, h in found.items()}
    totals = collections.Counter()
    for w, n in counts.items():
        totals[classes[w]] += n
    got = {r.doc_id: r for r in scoring.score_documents(docs).collect()}
    gain = 0
    for i, t in texts.items():
        c = [0, *map(classes.get, t), 0]
        own = [(c[j] * scoring.CLASSES + c[j + 2]) * scoring.CLASSES + c[j + 1] for j in range(len(t))]
        expected = sum(float(table[w]) for w in own) + sum(np.log(counts[w] / totals[classes[w]]) for w in t)
        assert got[i].n_tokens == len(t) and abs(got[i].log_likelihood - expected) < 1e-4 * max(1, len(t))
        gain += expected - sum(np.log(counts[w] / sum(counts.values())) for w in t)
    # Both sides help: better than the same counts without any context.
    assert gain > 0


def test_licenses(spark, texts, odd, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def base(text):
        w, places, labels = word.findall((text or "").translate(AZ)), [], set()
        for label, phrase in licenses.PHRASES.items():
            phrase = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
            places += found
            labels |= {label} if found else set()
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))

    rows = QUERIES["op8_licenses"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {i: base(t) for i, t in texts.items()}
    edited = "intro " + licenses.TEMPLATES["mit"].replace("free of charge", "totally free of charge")
    more = spark.createDataFrame([(1, edited), (2, ("cc by nc " * 50).strip()), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(more).collect()}
    assert (got[1].labels, got[1].n_base, got[2].n_base, got[3].n_words) == ("mit", 0, 50, 0)
    assert got[1].score > 0.9
    assert licenses.scan_licenses(empty).count() == 0
    got = sorted(((r.doc_id or 0), r.n_words) for r in licenses.scan_licenses(odd).collect())
    assert got == sorted((i or 0, len(word.findall((t or "").translate(AZ)))) for i, t, _ in ROWS)


def test_equal_rows_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BLOCK", 4)
    sizes = {(None, None): 9, (1, "cc by nc"): 8, (1, "cc by"): 1, (2, "cc by nc"): 5, (3, ""): 4}
    frame = spark.createDataFrame([row for row, n in sizes.items() for _ in range(n)], "doc_id bigint, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.labels) for r in licenses.scan_licenses(frame.repartition(5)).collect())
    assert got == {(None, 0, ""): 9, (1, 3, "cc-by-nc"): 8, (1, 2, ""): 1, (2, 3, "cc-by-nc"): 5, (3, 0, ""): 4}


def brute_licenses(text, listed, needed, least=0.6):
    """Labels and score by comparing words, one template and one diagonal at a time."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(AZ))
    labels, score = set(), 0.0
    for label, template, exact in [*((n, p, True) for n, p in licenses.PHRASES.items()), *((n, t, False) for n, t in listed)]:
        t, diagonals = template.split(), {}
        for at in range(len(t) - 2):
            for pos in (i for i in range(len(words) - 2) if words[i : i + 3] == t[at : at + 3]):
                diagonals.setdefault(pos - at, []).append(at)
        spans, before = [], None
        for start, d in sorted((d + min(ats), d) for d, ats in diagonals.items()):
            ats = diagonals[d]
            near = before is not None and abs(d - before[0]) <= 3 and min(ats) >= before[1] - 3 and start <= sum(before) + 3
            if near and not exact:
                spans[-1].update(ats)
            else:
                spans.append(set(ats))
            before = d, max(ats) + 3
        for places in spans:
            share = len({p + i for p in places for i in range(3)}) / len(t)
            score = max(score, share)
            must = set()
            for run in [] if exact else needed.get(label, []):
                r = run.split()
                must |= {p for i in range(len(t) - len(r) + 1) if t[i : i + len(r)] == r for p in range(i, i + len(r) - 2)}
            if share == 1 if exact else share >= least and must <= places:
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_labels_and_score_equal_brute_force(spark):
    """Templates with words lost, added and changed, whole and in pieces, between other words."""
    rng = random.Random(11)
    own = "you may do what you like with this text so long as you keep this notice and tell us about it"
    listed, needed = [*licenses.LISTED, ("kind", own)], {**licenses.NEEDED, "kind": ["keep this notice"]}
    sources = [t for _, t in listed] + list(licenses.PHRASES.values())
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(4)):
            part = rng.choice(sources).split()
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(3)] = rng.choices(["the", "and", "zeta", "license"], k=rng.randrange(3))
                part = part or ["license"]
            cut = rng.randrange(len(part)) if rng.random() < 0.3 else 0
            words += part[cut:] + part[:cut] if rng.random() < 0.5 else part[cut:]
            words += rng.choices(["lorem", "the", "license", "software"], k=rng.randrange(6))
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words).title()))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(frame, templates=listed, needed=needed).collect()}
    want = {i: brute_licenses(t, listed, needed) for i, t in rows}
    assert got == want and len({labels for labels, _ in want.values()}) > 15
    with pytest.raises(ValueError):
        licenses.template_grams(spark, [("short", "two words")], {})


def test_like_licenses_are_told_apart(spark):
    lines = [
        ("Licensed under the GNU General Public License version 2.", ""),
        ("Licensed under the GNU General Public License, version 3.0.", "gpl-3"),
        ("Licensed under the GNU General Public License, either version 3 or later.", "gpl-3"),
        ("Licensed under the GNU Lesser General Public License version 3.", ""),
        ("Licensed under the Creative Commons Attribution License.", ""),
        ("Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike License.", ""),
        ("Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("Licensed under the Creative Commons Attribution-Share Alike 3.0 License.", "cc-by-sa"),
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
         "accompanying documentation covered by this license", ""),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
         "Public License", ""),
        ("Redistribution and use in binary form, without modification, are permitted provided that the following conditions are met", ""),
        ("All rights reserved. This publication may be reproduced", ""),
        *[(t, label) for label, t in licenses.TEMPLATES.items()],
    ]
    frame = spark.createDataFrame([(i, "intro words " + t + " and more") for i, (t, _) in enumerate(lines)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame).collect()}
    assert [got[i] for i in range(len(lines))] == [label for _, label in lines]


def test_edit_fingerprints(spark, texts, odd, empty):
    rows = {r.doc_id: r for r in QUERIES["op9_edit_prints"](spark, SF).collect()}
    ids = sorted(texts)
    for here, after in zip(ids, ids[1:] + ids[:1]):
        a, b = texts[here] or "", texts[after] or ""
        half = len(a) // 2
        assert rows[here].n_chars == len(a)
        edited = a[: len(a) - half] + b[:half]
        assert rows[here].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = [edit_prints.Walk().read(t).print() for t in (a, edited, b)]
        assert [rows[here].fingerprint, rows[here].edited_fingerprint] == [p.hex() for p in prints[:2]]
        assert [rows[here].near_edited, rows[here].near_next] == [edit_prints.likeness(prints[0], p) for p in prints[1:]]
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > mean("near_next") + 0.3
    assert len({(texts[i], r.fingerprint) for i, r in rows.items()}) == len(set(texts.values()))
    assert edit_prints.compare_with_next(odd).count() == len(ROWS) and edit_prints.compare_with_next(empty).count() == 0


def test_edit_classes_join_slightly_edited_texts(spark, texts):
    long = [(i, t) for i, t in texts.items() if len(t or "") > 1500][:20]
    rows = long + [(i + 10_000, t[:700] + "?" + t[700:]) for i, t in long]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in edit_prints.edit_classes(edit_prints.edit_fingerprints(frame)).collect()}
    assert sum(got[i] == got[i + 10_000] for i, _ in long) >= 17


def test_edit_links_lose_no_pair_within_the_radius(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2, (150, 256), dtype=np.uint8)
    bits = [c for c in centres]
    for i, c in enumerate(centres):  # a chain of three: 13 to 26 differing bits, or one too many
        for _ in range(2):
            c = c.copy()
            c[rng.choice(256, 13 + i % 15, replace=False)] ^= 1
            bits.append(c)
    values = sorted({int.from_bytes(np.packbits(b).tobytes(), "big") for b in bits})
    frame = spark.createDataFrame([(bytearray(v.to_bytes(32, "big")),) for v in values], "fp binary")
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= edit_prints.RADIUS]
    assert len(near) > 250
    for size in (4096, 2):
        top = {v: v for v in values}

        def find(v, top=top):
            while top[v] != v:
                v = top[v]
            return v

        for r in edit_prints.edit_links(frame, shard_size=size).collect():
            a, b = int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")
            assert (a ^ b).bit_count() <= edit_prints.RADIUS
            top[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in near)


def test_conversations(spark):
    assert difference(QUERIES["op10_chat"](spark, SF), connect(SF), ORACLES["op10_chat"]) is None


def test_line_dedup_equals_sql(spark):
    assert difference(QUERIES["op2_line_dedup"](spark, SF), connect(SF), ORACLES["op2_line_dedup"]) is None
    long = [(9, i, "user", f"t{i}") for i in range(1200)]
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"),
            (4, 0, "user", None), (None, None, None, "x"), *long, *[(10, *r[1:]) for r in long[:1100]]]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.part): r for r in chat.format_conversations(turns).collect()}
    assert set(got) == {(2, 0), (4, 0), (None, 0), (9, 0), (9, 1), (9, 2)}
    assert got[2, 0].copies == 2 and got[9, 0].n_turns == 1200
    whole = "".join(got[9, p].text for p in range(3))
    assert whole == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in long)
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_pipeline(spark, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert 0.6 * len(texts) < len(kept) < len(texts)
    groups = collections.defaultdict(set)
    for i, t in texts.items():
        groups[t].add(i)
    assert all(len(ids & kept) <= 1 for ids in groups.values())


# Names that the operators use inside, or used.
INNER = ["_key", "_hash", "_text", "_doc", "_drop", "_batch", "_n_lines", "_n_dropped", "_k", "_h", "_stays", "_bad", "_rows", "_group",
         "_first", "_least", "_who", "_body", "_part", "_end", "_to", "_v", "key", "keeper", "fp", "node", "component", "id", "n", "kept", "`q", "a.b"]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_stages_take_any_column_name_and_key_type(spark, kind):
    import corpus_pipeline

    shared = "this very line stands in many of the documents of this little table"
    words = np.random.default_rng(6).integers(0, 5000, (9, 40))
    rows = [(i if i else None, f"{shared}\n" + " ".join(f"and w{w}" for w in words[i])) for i in range(9)]
    rows += [rows[3], (None, rows[0][1]), (None, None), (7, ""), (12, rows[4][1])]
    extra = [F.lit(f"own {i}").alias(name) for i, name in enumerate(INNER)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    frame = plain.select("*", *extra)
    for _, stage in corpus_pipeline.STAGES[:3]:
        for table, count in ((plain, None), (frame, None), (frame.where("false"), 0)):
            out = stage(spark, table, SF)
            assert out.columns == table.columns
            got = sorted(map(str, out.select("doc_id", "text").collect()))
            assert count is None or len(got) == count
            if table is plain:
                expected = got
            elif count is None:
                assert got == expected and {r.key for r in out.collect()} == {f"own {INNER.index('key')}"}
    compared = edit_prints.compare_with_next(frame)
    assert compared.count() == len(rows) and edit_prints.compare_with_next(frame.where("false")).count() == 0


def test_near_dedup_stage_keeps_the_least_of_each_component(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()}
    assert kept == {r.component_id for r in QUERIES["op1_simhash"](spark, SF).collect()}


@pytest.mark.parametrize("count", [1, 10**6])
def test_repeated_band_keys_are_counted_whole(spark, count):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    prints = [rng.bytes(4) + bytes(28) for _ in range(3000)]  # many share bands, one key in all of them
    bands = edit_prints.sampled_bands(3000)
    keys = collections.Counter(edit_prints._band_keys(pa.array(prints, pa.binary()), bands).ravel().tolist())
    frame = spark.createDataFrame([(bytearray(p),) for p in prints], "fp binary").repartition(7)
    got = {r.shard: r.n for r in edit_prints.repeated_keys(frame, bands, count).collect()}
    assert got == {k: n for k, n in keys.items() if n > 1} and max(got.values()) >= 3000


def test_bands_meet_nearly_all_pairs_within_the_radius():
    rng = np.random.default_rng(8)
    for prints in (10**3, 10**5, 2 * 10**6):
        bands = edit_prints.sampled_bands(prints)
        for apart, least in ((13, 0.9999), (20, 0.999), (26, 0.995)):
            flips = np.stack([np.isin(np.arange(edit_prints.BITS), rng.choice(edit_prints.BITS, apart, replace=False)) for _ in range(2000)])
            assert np.mean([(~flips[:, b].any(axis=1)) for b in bands], axis=0).astype(bool).mean() >= least
    # Rows dealt per fingerprint grow far more slowly than the table.
    assert len(edit_prints.sampled_bands(2 * 10**6)) < 4 * len(edit_prints.sampled_bands(5 * 10**4))
