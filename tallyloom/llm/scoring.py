"""Document scores of a bidirectional window network by masked pseudo-likelihood."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.gaps import SHORT, bytes_apart, cut, together, uncut
from tallyloom.llm.words import NOT_BLANK, slices, text_bytes, words
from tallyloom.sources.staging import stage

CLASSES = 128
KNOWN = 95
EMBED, HIDDEN, EPOCHS, BLOCK = 16, 48, 40, 2048
AT_ONCE = 1 << 20
COMMON, WORDS_A_PART, STEPS = 1 << 18, 1 << 22, 1 << 24


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("string").alias("_text"))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``_word, n``: how often each word, as its hash, occurs in the whole table.

    Words are counted inside each task before they are sent.
    """

    def run(batches):
        held, room = [], 0

        def counted():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["_word", "_n"])

        for batch in batches:
            for part in slices(batch, "_text"):
                held.append(words(*text_bytes(part["_text"]), NOT_BLANK)[3])
                room += len(held[-1])
                if room > AT_ONCE:
                    yield counted()
                    held, room = [], 0
        if room:
            yield counted()

    return _texts(docs, text).mapInArrow(run, "_word bigint, _n bigint").groupBy("_word").agg(F.sum("_n").alias("n"))


def common_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes, ascending, and counts of the words with more than one in ``COMMON`` of all occurrences, and that total.

    There are fewer than ``COMMON`` of them, so at most 4 MB reach the driver and the tasks.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.where(F.col("n") * COMMON > total).toArrow()
    hashes = found["_word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy()[order], total


def frequent_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ``KNOWN`` most frequent of the common words, ties by hash; ascending."""
    return np.sort(hashes[np.lexsort((hashes, -counts))[:KNOWN]])


def word_classes(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Class of each word: its own for a frequent word, else one of the rest by hash; 0 is no word.

    ``known`` is sorted.
    """
    rest = CLASSES - 1 - len(known)
    out = (1 + len(known) + (hashes >> np.uint64(33)) % np.uint64(rest)).astype(np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        out[hit] = 1 + at[hit]
    return out


def _windows(part: pa.RecordBatch, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every word, and its left neighbour, right neighbour and own class as one number."""
    _, _, rows, hashes = words(*text_bytes(part["_text"]), NOT_BLANK)
    own = word_classes(hashes, known)
    left, right = np.zeros_like(own), np.zeros_like(own)
    if len(own):
        together = rows[1:] == rows[:-1]
        left[1:][together] = own[:-1][together]
        right[:-1][together] = own[1:][together]
    return rows, hashes, (left * CLASSES + right) * CLASSES + own


def window_counts(docs: DataFrame, text: str, known: np.ndarray) -> DataFrame:
    """``_window, n``: how often each word class stands between each two, in the whole table."""

    def run(batches):
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                value, n = np.unique(_windows(part, known)[2], return_counts=True)
                total[value] += n
        value = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(total[value])], ["_window", "n"])

    return _texts(docs, text).mapInArrow(run, "_window bigint, n bigint").groupBy("_window").agg(F.sum("n").alias("n"))


class WindowNetwork:
    """Predicts a word class from the classes on both sides: embeddings, one hidden layer, softmax."""

    def __init__(self, parameters: list[np.ndarray] | None = None, seed: int = 0):
        draw = np.random.default_rng(seed)
        shapes = [(CLASSES, EMBED), (CLASSES, EMBED), (2 * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
        self.p = parameters or [
            (draw.normal(0, 1 / np.sqrt(s[0]) if len(s) > 1 else 0, s)).astype(np.float32) for s in shapes
        ]

    def forward(self, left: np.ndarray, right: np.ndarray):
        a, b, w1, c1, w2, c2 = self.p
        x = np.hstack([a[left], b[right]])
        h = np.tanh(x @ w1 + c1)
        z = h @ w2 + c2
        z -= z.max(axis=1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, left, right, counts):
        """Gradients of the weighted cross-entropy of a block of contexts; counts has a row each."""
        x, h, logp = self.forward(left, right)
        dz = np.exp(logp) * counts.sum(axis=1, keepdims=True) - counts
        dh = (dz @ self.p[4].T) * (1 - h * h)
        dx = dh @ self.p[2].T
        da, db = np.zeros_like(self.p[0]), np.zeros_like(self.p[1])
        np.add.at(da, left, dx[:, :EMBED])
        np.add.at(db, right, dx[:, EMBED:])
        return [da, db, x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]

    def train(self, windows: np.ndarray, counts: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> WindowNetwork:
        """Adam over blocks of contexts. The counts stand for every word, so an epoch is a full pass."""
        table = np.zeros(CLASSES**3, dtype=np.float32)
        table[windows] = counts / max(counts.sum(), 1)
        table = table.reshape(CLASSES**2, CLASSES)
        seen = np.flatnonzero(table.any(axis=1))
        draw, step = np.random.default_rng(1), 0
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for epoch in range(epochs):
            order = draw.permutation(seen)
            for at in range(0, len(order), BLOCK):
                some, step = order[at : at + BLOCK], step + 1
                weights = table[some] / table[some].sum()
                for i, g in enumerate(self.gradients(some // CLASSES, some % CLASSES, weights)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    pace = rate * (1 - epoch / epochs) + rate / 100
                    self.p[i] -= pace * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return self

    def table(self) -> np.ndarray:
        """Log-probability of every window number."""
        out = np.empty((CLASSES**2, CLASSES), dtype=np.float32)
        for at in range(0, CLASSES**2, BLOCK):
            some = np.arange(at, at + BLOCK)
            out[some] = self.forward(some // CLASSES, some % CLASSES)[2]
        return out.reshape(-1)

    def dump(self) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, *self.p)
        return buffer.getvalue()

    @staticmethod
    def load(raw: bytes) -> WindowNetwork:
        stored = np.load(io.BytesIO(raw))
        return WindowNetwork([stored[n] for n in stored.files])


def train_network(counts: DataFrame) -> bytes:
    """The network trained on the counts, in one task: they are at most ``CLASSES`` cubed numbers."""

    def run(batches):
        parts = [(b["_window"].to_numpy(), b["n"].to_numpy()) for b in batches]
        window = np.concatenate([p[0] for p in parts] or [np.zeros(0, dtype=np.int64)])
        n = np.concatenate([p[1] for p in parts] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(window)
        yield pa.RecordBatch.from_arrays([pa.array([WindowNetwork().train(window[order], n[order]).dump()])], ["network"])

    trained = counts.repartition(1).mapInArrow(run, "network binary").first()
    # Without a single word there is no task at all.
    return trained["network"] if trained else WindowNetwork().dump()


class Model:
    """What tasks need to score: the network's table, class totals and the common words."""

    def __init__(self, raw: bytes, known: np.ndarray, totals: np.ndarray, hashes: np.ndarray, counts: np.ndarray, parts: int):
        self.raw, self.known, self.hashes, self.parts = raw, known, hashes, parts
        self.log_totals = np.log(np.maximum(totals, 1))
        self.log_counts = np.log(counts)

    def inside(self, hashes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word in its class, without the count of the rare ones, and which those are."""
        out = -self.log_totals[own]
        rare = np.ones(len(hashes), dtype=bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            rare = self.hashes[at] != hashes
            out[~rare] += self.log_counts[at[~rare]]
        return out, rare


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of the whole table: every word and every window is counted."""
    counts = stage(word_counts(docs, text))
    hashes, n, total = common_words(counts)
    known = frequent_words(hashes, n)
    windows = stage(window_counts(docs, text, known))
    by_class = windows.groupBy((F.col("_window") % CLASSES).alias("c")).agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(CLASSES, dtype=np.int64)
    for own, times in by_class:
        totals[own] = times
    return Model(train_network(windows), known, totals, hashes, n, max(1, total // WORDS_A_PART))


def _rare_packed(first: int, keys: np.ndarray, rows: np.ndarray, parts: int) -> list[tuple]:
    """Rows ``_base, part, keys, rows, times`` of rare words: row numbers count from ``first``."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    keys, rows, times = keys[at], rows[at], np.diff(at, append=len(new))
    return [(first, p, gaps, bytes_apart(rows[s]), bytes_apart(times[s])) for p, s, gaps in cut(keys, parts)]


PACKED = {"_base": pa.int64(), "_part": pa.int64(), "_keys": pa.binary(), "_rows": pa.binary(), "_times": pa.binary()}
SCORED = {"_n": pa.int64(), "_score": pa.float64()}


def _scored(model: Model):
    """Texts to their scores without the counts of rare words, and these words apart, for all counts of a key to meet."""

    def filled(n: int, given: dict, key: pa.DataType) -> pa.RecordBatch:
        kinds = {"_row": pa.int64(), "_key": key} | SCORED | PACKED
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, t)) for c, t in kinds.items()], list(kinds))

    def run(batches):
        table = WindowNetwork.load(model.raw).table()
        first, held, kind = None, [], None

        def sent():
            packed = _rare_packed(first, *map(np.concatenate, zip(*held)), model.parts)
            return filled(len(packed), {c: pa.array(v, t) for (c, t), v in zip(PACKED.items(), zip(*packed))}, kind)

        for batch in batches:
            for part in slices(batch, "_text"):
                kind = part["_key"].type
                places = part["_row"].to_numpy()
                first = int(places[0]) if first is None else first
                rows, hashes, window = _windows(part, model.known)
                inside, rare = model.inside(hashes, window % CLASSES)
                n = np.bincount(rows, minlength=len(part))
                score = np.bincount(rows, weights=table[window] + inside, minlength=len(part))
                given = {"_row": part["_row"], "_key": part["_key"], "_n": pa.array(n, pa.int64()), "_score": pa.array(score, pa.float64())}
                yield filled(len(part), given, kind)
                held.append(((hashes[rare] >> np.uint64(64 - SHORT)).astype(np.int64), places[rows[rare]] - first))
                if sum(len(k) for k, _ in held) > AT_ONCE:
                    yield sent()
                    first, held = None, []
        if held and any(len(k) for k, _ in held):
            yield sent()

    return run


def _rare_scores(parts: int):
    """Packed rare words sorted by part to ``_base, _rows, _worth``: of each row, the summed logarithms of its words' counts.

    They are whole numbers of ``STEPS``, so sums do not depend on their order, and go back packed as they came.
    """

    def summed(held: list[tuple]):
        _, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([h[3] for h in held]))
        worth, out, first = np.round(np.log(n) * STEPS).astype(np.int64), [], 0
        for base, keys, rows, times in held:
            own = worth[at[first : first + len(keys)]] * times
            found, place = _summed(rows, own)
            out.append((base, bytes_apart(found), bytes_apart(np.concatenate([place & 0xFFFFFFFF, place >> 32]))))
            first += len(keys)
        kinds = zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in kinds], ["_base", "_rows", "_worth"])

    def run(batches):
        current, held = None, []
        for batch in batches:
            for base, part, keys, rows, times in zip(*(batch[c].to_pylist() for c in PACKED)):
                if part != current and held:
                    yield summed(held)
                    held = []
                current = part
                held.append((base, uncut(keys, part, parts), together(rows), together(times)))
        if held:
            yield summed(held)

    return run


def _summed(rows: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, ascending, and the sum of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[starts], np.add.reduceat(worth[order], starts)


def _rows_of_base(batches):
    """What all parts say of the rows from one ``_base`` on, sorted by it, to ``_row, _more``."""

    def summed(base: int, held: list[tuple]):
        rows, more = _summed(*map(np.concatenate, zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(base + rows), pa.array(more)], ["_row", "_more"])

    current, held = None, []
    for batch in batches:
        for base, rows, worth in zip(*(batch[c].to_pylist() for c in ("_base", "_rows", "_worth"))):
            if base != current and held:
                yield summed(current, held)
                held = []
            current = base
            low, high = together(worth).reshape(2, -1)
            held.append((together(rows), low + (high << 32)))
    if held:
        yield summed(current, held)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, log_likelihood, mean_log_likelihood`` of every document.

    Tokens are the blank-separated words, ASCII lower-cased. The probability of a word is that of
    its class between its two neighbours' classes, from the network, times that of the word in its
    class, from the counts of all words of the table. The network learns every word: all windows are
    counted, and the counts are all the training needs, so its time is the same at any size while
    every document takes part. The score is the sum of the log-probabilities of the words. Without
    words the sum is 0 and the mean null.

    The network, under 100 KB, and the words with more than one in ``COMMON`` of all occurrences,
    under 4 MB, go to the tasks by value. Rarer words meet their counts by a shuffle: each goes with
    its document to a range of word hashes, whose task holds about ``WORDS_A_PART`` occurrences at
    most, as none of these words has many. Repeated rows and null keys are scored like any other.
    """
    model = fit(docs, text)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    packed = "_base bigint, _part bigint, _keys binary, _rows binary, _times binary"
    scored = stage(rows.mapInArrow(_scored(model), f"_row bigint, _key {kind}, _n bigint, _score double, {packed}"))
    rare = scored.where("_part IS NOT NULL").select(*PACKED).repartition("_part").sortWithinPartitions("_part")
    back = rare.mapInArrow(_rare_scores(model.parts), "_base bigint, _rows binary, _worth binary")
    more = back.repartition("_base").sortWithinPartitions("_base").mapInArrow(_rows_of_base, "_row bigint, _more bigint")
    both = scored.where("_row IS NOT NULL").select("_row", "_key", "_n", "_score").join(more, "_row", "left")
    total = F.col("_score") + F.coalesce("_more", F.lit(0)) / F.lit(float(STEPS))
    return both.select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_tokens"),
        total.alias("log_likelihood"),
        F.when(F.col("_n") > 0, total / F.col("_n")).alias("mean_log_likelihood"),
    )
