"""Token pieces into sequences of one length by cutting-stock column generation."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.ranks import numbered
from tallyloom.llm.words import lean_slices
from tallyloom.sources.staging import stage

LENGTH = 2048
GRID, SLACK = 8, 0.02
CACHE = 300_000
CACHE_BYTES = 1 << 26
AT_ONCE = 2000
SLICE = 1 << 22
MARKS = (".", ",", "|")
GAP = 1e-3
ODD = "[\x1c-\x1f]|<\\|(?:startoftext|endoftext)\\|>"
BREAK = re.compile(r"\s")
PART = 1 << 20


# --- tokens ---------------------------------------------------------------------------------


def _laid_out(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` of every start and length, end to end."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class ChunkEncoder:
    """Token ids of whole texts, from the ids of their blank-separated chunks.

    The tokenizer turns runs of blanks into one, and no token spans a blank, so a text's ids are
    its chunks' ids in a row. Arrow finds the distinct chunks of a slice, and a letter word is
    taken apart from the mark after it; only what a bounded table does not hold goes to the
    tokenizer, and arrays put the ids together. Texts with characters on whose blankness two
    libraries differ, or with the text of a special token, are encoded whole.

    The table has words, their ids end to end, how many ids each has and whether it was used since
    the table was last cleared of unused ones. It is Arrow and numpy arrays, about 30 bytes a word
    where Python objects take 150: a worker keeps it from task to task.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = "<|endoftext|>"
        self.separator_id = self.tokenizer.token_to_id(self.separator)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, dtype="<u4")
        self.n, self.used = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)

    def _ids(self, text: str) -> np.ndarray:
        # The fast call leaves out offsets, which nobody reads here.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _encode_new(self, chunks: list[str]) -> list[bytes]:
        """The ids of every chunk, encoded together, in one call for many."""
        found: dict[str, bytes] = {}
        words = [c for c in chunks if c.isalpha()]
        others = [c for c in chunks if not c.isalpha()]
        for some in (words[at : at + AT_ONCE] for at in range(0, len(words), AT_ONCE)):
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                self._keep(found, some, ids, [0, *ends[:-1].tolist()], ends.tolist())
            else:  # a word that the tokenizer takes for several
                others += some
        for some in (others[at : at + AT_ONCE] for at in range(0, len(others), AT_ONCE)):
            ids = self._ids(self.separator.join(some))
            cuts = np.flatnonzero(ids == self.separator_id)
            self._keep(found, some, ids, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])
        return list(map(found.__getitem__, chunks))

    @staticmethod
    def _keep(found: dict[str, bytes], chunks: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw = ids.tobytes()
        for chunk, a, b in zip(chunks, starts, ends):
            found[chunk] = raw[4 * a : 4 * b]

    def _forget(self) -> None:
        """Leave out the words that were not used since the last time."""
        stay = np.flatnonzero(self.used)
        self.ids = _laid_out(self.ids, (np.cumsum(self.n) - self.n)[stay], self.n[stay])
        self.words, self.n, self.used = self.words.take(pa.array(stay)), self.n[stay], np.zeros(len(stay), dtype=bool)

    def _learned(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For every chunk where its ids start in ``ids`` and how many it has; unknown ones are learned."""
        if np.count_nonzero(self.used) > CACHE or self.words.nbytes > CACHE_BYTES:
            self._forget()
        place = pc.index_in(chunks, value_set=self.words)
        new = chunks.filter(place.is_null()).unique()
        place = pc.coalesce(place, pc.add(pc.index_in(chunks, value_set=new), len(self.words))).to_numpy()
        coded = self._encode_new(new.to_pylist())
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), dtype="<u4")])
        self.n = np.concatenate([self.n, np.fromiter(map(len, coded), dtype=np.int32, count=len(coded)) // 4])
        self.used = np.concatenate([self.used, np.ones(len(coded), dtype=bool)])
        self.used[place] = True
        return (np.cumsum(self.n) - self.n)[place], self.n[place].astype(np.int64)

    @staticmethod
    def _parts(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Of a word and the mark after it: the lower-cased word and 1 + the mark's place; else the chunk and 0.

        The tokenizer lower-cases and never joins letters with marks, so their ids can be put
        together. Letters that its normal form or lower case may turn into letter and mark are
        left out, as is sigma, whose lower case depends on what follows.
        """
        mark = np.zeros(len(chunks), dtype=np.int64)
        for i, m in enumerate(MARKS):
            mark[pc.ends_with(chunks, m).to_numpy(zero_copy_only=False)] = i + 1
        word = pc.if_else(pa.array(mark > 0), pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        plain = pc.and_(pc.utf8_is_alpha(word), pc.equal(pc.utf8_normalize(word, "NFC"), word))
        plain = pc.and_not(plain, pc.match_substring_regex(word, "[\u03a3\u0130]"))
        mark[~plain.to_numpy(zero_copy_only=False)] = 0
        return pc.if_else(plain, pc.ascii_lower(word), chunks), mark

    def _of_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.utf8_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        words, mark = self._parts(chunks.dictionary)
        words = words.dictionary_encode()
        starts, n = self._learned(pa.concat_arrays([words.dictionary, pa.array(["", *MARKS])]))
        # Ids of every distinct chunk: those of its word, then those of its mark or of nothing.
        pairs = np.stack([words.indices.to_numpy().astype(np.int64), len(words.dictionary) + mark], axis=1).ravel()
        ids = _laid_out(self.ids, starts[pairs], n[pairs])
        n = n[pairs].reshape(-1, 2).sum(axis=1)
        codes = chunks.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(n[codes])])
        at = lists.offsets.to_numpy()
        return _laid_out(ids, (np.cumsum(n) - n)[codes], n[codes]), ends[at - at[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each text has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)).tolist()
        ids, counts, at = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)], 0
        for i in [*odd, len(texts)]:
            if at < i:
                found, offsets = self._of_chunks(texts.slice(at, i - at))
                ids.append(found), counts.append(np.diff(offsets))
            if i < len(texts):
                found = self._ids(texts[i].as_py())
                ids.append(found), counts.append(np.array([len(found)]))
            at = i + 1
        return np.concatenate(ids), np.concatenate(counts)

    def encode_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, a part at a time, so that the chunks of a huge text are never held at once."""
        if len(text) <= PART or re.search(ODD, text):
            return self.encode(pa.array([text], pa.string()))
        out, at = [], 0
        while at < len(text):
            stop = BREAK.search(text, min(at + PART, len(text)))
            end = stop.start() if stop else len(text)
            out.append(self.encode(pa.array([text[at:end]], pa.string()))[0])
            at = end if stop else len(text)
        return np.concatenate(out), np.array([sum(map(len, out))])


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def token_pieces(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """``_key, _start, _length, _tokens, _ids``: each document's ids and ``end_id``, cut to size.

    A document is cut only where it is longer than a sequence. ``_ids`` holds the piece's ids as
    little-endian unsigned 32-bit numbers. A null text is empty: its only id is ``end_id``.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = _encoder(tokenizer)
        for part in lean_slices(batches, "_text", SLICE):
            alone = len(part) == 1
            ids, n = encoder.encode_long(part["_text"][0].as_py() or "") if alone else encoder.encode(part["_text"])
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            pieces = -(-n // length)
            at = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(length, n[at] - start)
            edges = np.concatenate([[0], 4 * np.cumsum(size)]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
            columns = [part["_key"].take(pa.array(at)), *map(pa.array, (start, size, n[at])), raw]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_start", "_length", "_tokens", "_ids"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, _start bigint, _length bigint, _tokens bigint, _ids binary")


# --- patterns -------------------------------------------------------------------------------


def _best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern that fits."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(int(sizes[0]), room + 1):
        n = int(np.searchsorted(sizes, c, side="right"))
        worth = best[c - sizes[:n]] + values[:n]
        i = int(np.argmax(worth))
        best[c] = worth[i]
        choice[c] = i
        if best[c - 1] > best[c]:
            best[c], choice[c] = best[c - 1], -2
    pattern, c = np.zeros(len(sizes)), room
    while c > 0 and choice[c] != -1:
        if choice[c] == -2:
            c -= 1
            continue
        pattern[choice[c]] += 1
        c -= int(sizes[choice[c]])
    return float(best[room]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix times vector in one thread: threaded libraries stall on calls this small."""
    return np.einsum("ij,j->i", matrix, vector.astype(float))


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, in one thread."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for c in range(m):
        p = c + int(np.argmax(np.abs(both[c:, c])))
        both[[c, p]] = both[[p, c]]
        both[c] /= both[c, c]
        factor = both[:, c].copy()
        factor[c] = 0
        both -= factor[:, None] * both[c]
    return both[:, m:]


def cutting_stock(sizes: np.ndarray, counts: np.ndarray, room: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering every count exactly.

    The linear program over patterns (fewest sequences for the counts) is solved by the revised
    simplex method; its columns are generated by pricing them with a knapsack. Any basis is a
    valid cover, so ``rounds`` bounds time and never correctness. Whole parts of the solution are
    used as they are; the rest, at most one sequence per pattern, is packed largest first.
    """
    m = len(sizes)
    used: list[tuple[np.ndarray, int]] = []
    left = counts.astype(np.int64).copy()
    if not m:
        return used
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = _times(inverse, counts)
    for turn in range(rounds):
        prices = inverse.sum(axis=0)
        worth, pattern = _best_pattern(prices, sizes, room)
        if worth <= 1 + GAP:
            break
        step = _times(inverse, pattern)
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        basis[:, out] = pattern
        if turn % 64 == 63:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        x = np.maximum(_times(inverse, counts), 0)
    for i, times in enumerate(np.floor(x + 1e-7).astype(np.int64)):
        pattern = np.round(basis[:, i]).astype(np.int64)
        times = min(int(times), int((left[pattern > 0] // pattern[pattern > 0]).min()))
        if times > 0:
            used.append((pattern, times))
            left -= times * pattern
    while left.any():
        pattern, free = np.zeros(m, dtype=np.int64), room
        for i in range(m - 1, -1, -1):
            pattern[i] = min(left[i], free // sizes[i])
            free -= pattern[i] * sizes[i]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        used.append((pattern, times))
        left -= times * pattern
    return used


@lru_cache(maxsize=4)
def bundle_sizes(length: int, grid: int) -> np.ndarray:
    """For each piece length from 0, how many such pieces to round up together.

    A few short pieces lose much if each is rounded up to whole steps of the grid; some number of
    them fills whole steps, and sequences. It is the smallest one that, packed with nothing else,
    comes within ``SLACK`` of the best fill.
    """
    out, room = np.ones(length + 1, dtype=np.int64), length // grid
    for size in range(1, length + 1):
        several = np.arange(1, length // size + 1)
        filled = room // -(-several * size // grid) * several * size
        out[size] = several[int(np.argmax(filled >= filled.max() - SLACK * length))]
    return out


def pack(pieces: DataFrame, length: int = LENGTH, grid: int = GRID) -> DataFrame:
    """``pieces`` with ``_sequence`` and ``_offset``; ``pieces`` needs ``_length`` and a unique ``_row``.

    Items are single pieces or bundles of pieces of one length (see ``bundle_sizes``); what does not
    fill a bundle is single. Items are counted in classes of ``grid`` tokens, rounded up: a histogram
    of at most ``length`` numbers is all that reaches the driver. Pieces are ranked among those of
    their length, or of their class where that never bundles, and take the places of the patterns in
    that order, so a piece is matched to its sequence by its length and rank alone. A sequence is
    padded by under ``grid`` tokens an item, besides what its pattern leaves free. Pass a written
    table: it is read three times.
    """
    grid = grid if length % grid == 0 else 1
    spark, together = pieces.sparkSession, bundle_sizes(length, grid)
    histogram = pieces.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).orderBy("_length").collect()
    # Ranks run through a group: one length that bundles, or all other lengths of a class.
    groups, members = {}, []
    for size, n in histogram:
        several, units = int(together[size]), -(-size // grid)
        group = size if several > 1 else -units
        groups[group] = (several, size, groups.get(group, (0, 0, 0))[2] + n)
        members.append((size, group))
    counts, ranges = np.zeros(length // grid + 1, dtype=np.int64), []
    for group, (several, size, n) in groups.items():
        for first, last, each in ((0, n - n % several, several), (n - n % several, n, 1)):
            if first < last:
                units = -(-size * each // grid)
                ranges.append((group, first, last, each, units, int(counts[units])))
                counts[units] += (last - first) // each
    sizes = np.flatnonzero(counts)
    patterns = cutting_stock(sizes, counts[sizes], length // grid)
    taken, sequences, places = np.zeros(len(sizes), dtype=np.int64), 0, []
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern).tolist():
            each = int(pattern[i])
            places.append((int(sizes[i]), int(taken[i]), int(taken[i]) + each * times, each, sequences))
            taken[i] += each * times
        sequences += times
    groups_of = spark.createDataFrame(members, "_l bigint, _group int")
    items = spark.createDataFrame(ranges, "_g int, _first_rank bigint, _last_rank bigint, _several int, _class int, _before bigint")
    table = spark.createDataFrame(places, "_c int, _from bigint, _to bigint, _each int, _first bigint")
    grouped = pieces.join(F.broadcast(groups_of), F.col("_length") == F.col("_l")).drop("_l")
    ranked = numbered(grouped, "_group", "_row", "_rank")
    # At most two ranges a group; patterns are at most two per class, and places one per pattern and class.
    itemised = ranked.join(
        F.broadcast(items),
        (F.col("_group") == F.col("_g")) & (F.col("_rank") >= F.col("_first_rank")) & (F.col("_rank") < F.col("_last_rank")),
    ).withColumn("_item", F.col("_before") + F.expr("(_rank - _first_rank) div _several"))
    placed = itemised.join(
        F.broadcast(table),
        (F.col("_class") == F.col("_c")) & (F.col("_item") >= F.col("_from")) & (F.col("_item") < F.col("_to")),
    ).withColumn("_sequence", F.col("_first") + F.expr("(_item - _from) div _each"))
    inside = Window.partitionBy("_sequence").orderBy(F.desc("_length"), "_row")
    offset = F.sum("_length").over(inside) - F.col("_length")
    return placed.withColumn("_offset", offset).select(*pieces.columns, "_sequence", "_offset")


def packed_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    length: int = LENGTH,
    digest: bool = False,
) -> DataFrame:
    """``key, start, length, ids, doc_tokens, sequence_id, offset``: every piece and its place.

    ``ids`` are little-endian unsigned 32-bit numbers; ``digest`` keeps their CRC-32 in its place
    as ``ids_crc32``. The pieces are written once. Repeated rows are packed each for itself; null
    keys and other columns do not matter.
    """
    ids = F.crc32("_ids").alias("ids_crc32") if digest else F.col("_ids").alias("ids")
    cut = token_pieces(docs, key, text, tokenizer, end_id, length)
    cut = stage(cut.select("_key", "_start", "_length", "_tokens", ids).withColumn("_row", F.monotonically_increasing_id()))
    return pack(cut, length).select(
        F.col("_key").alias(key),
        F.col("_start").alias("start"),
        F.col("_length").alias("length"),
        "ids_crc32" if digest else "ids",
        F.col("_tokens").alias("doc_tokens"),
        F.col("_sequence").alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )
