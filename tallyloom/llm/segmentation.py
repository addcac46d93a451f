"""Sampled segmentations into the pieces of a vocabulary, and back."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import BASE, mix, slices

ALPHA = 1.0
CHUNKS_AT_ONCE = 1 << 18
IDS_AT_ONCE = 1 << 19
CHUNK = re.compile(" *[^ ]+| +")
SPACE = "▁"
TINY = 1e-200


class PieceLattice:
    """Forward-filtering backward-sampling over the piece lattice.

    A space is part of a piece only at its start, so the lattice of a text falls into those of
    its chunks, each the spaces before a word and the word. The distinct chunks of some texts are
    filtered forwards together, a character of each at a time, and all their chunks are sampled
    backwards together. Nothing is kept from one call to the next.

    The vocabulary has merge ranks in place of probabilities; a piece weighs the inverse of its
    rank to the power ``alpha`` (Zipf's law). A character that is no piece is spelled in bytes.
    """

    def __init__(self, model: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        plain = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i).replace(SPACE, " "): (i, (rank + 2.0) ** -alpha) for rank, i in enumerate(plain)}
        self.longest = max(map(len, self.pieces))
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.rare = (len(plain) + 2.0) ** -alpha
        self.size = len(sp)
        self.bytes = [b""] * self.size
        for i in plain:
            self.bytes[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.letters = pa.array(self.bytes, pa.large_binary())
        self._index_suffixes()

    def _index_suffixes(self) -> None:
        """``ending``: sorted hashes of all ends of pieces; ``whole``: the piece that is just that, or -1."""
        known = {p[-n:] for p in self.pieces for n in range(1, len(p) + 1)}
        found = sorted((self._hash(p), self.pieces.get(p, (-1, 0.0))) for p in known)
        self.ending = np.array([h for h, _ in found], dtype=np.uint64)
        self.whole = np.array([p for _, (p, _) in found], dtype=np.int64)
        self.weight = np.array([w for _, (_, w) in found])

    @staticmethod
    def _hash(part: str) -> int:
        """Polynomial of the characters, the last one first, as ``_edges`` rolls it."""
        value = 0
        for letter in reversed(part):
            value = (value * BASE + ord(letter) + 1) % 2**64
        return value

    def _edges(self, points: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Character, length, piece and weight of every piece that ends at a character.

        ``place`` is 0 at the origin of a chunk and counts its characters. A string is made longer
        to the left only while some piece ends in it.
        """
        at = np.flatnonzero(place > 0)
        value, out, single = np.zeros(len(at), dtype=np.uint64), [], np.zeros(len(points), dtype=bool)
        for n in range(1, self.longest + 1):
            value = value * np.uint64(BASE) + (points[at - (n - 1)].astype(np.uint64) + np.uint64(1))
            row = np.minimum(np.searchsorted(self.ending, value), len(self.ending) - 1)
            alive = self.ending[row] == value
            row, is_piece = row[alive], self.whole[row[alive]] >= 0
            at, value = at[alive], value[alive]
            if n == 1:
                single[at[is_piece]] = True
            out.append((at[is_piece], np.full(is_piece.sum(), n), self.whole[row[is_piece]], self.weight[row[is_piece]]))
            more = place[at] > n
            at, value = at[more], value[more]
        # Other characters are an edge of their own, numbered above the vocabulary.
        at = np.flatnonzero((place > 0) & ~single)
        size = 1 + sum((points[at] > limit).astype(np.int64) for limit in (0x7F, 0x7FF, 0xFFFF))
        out.append((at, np.ones(len(at), dtype=np.int64), self.size + points[at].astype(np.int64), self.rare**size))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _filter(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """First node and length of each chunk, and per node its edges' chances, steps and pieces.

        A node is a place in a chunk: the origin, then one behind each character. ``key`` rises
        over all edges: the node's number in the order of levels, plus the share of the
        segmentations that come there by this edge or one before it.
        """
        points = np.frombuffer(("\0" + "\0".join(chunks)).encode("utf-32-le"), dtype=np.uint32)
        length = np.array([len(c) for c in chunks])
        first = np.cumsum(length + 1) - (length + 1)
        place = np.arange(len(points)) - np.repeat(first, length + 1)
        node, step, piece, weight = self._edges(points, place)
        order = np.lexsort((step, node, place[node]))
        node, step, piece, weight = node[order], step[order], piece[order], weight[order]
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        tails = np.append(heads[1:], len(node)) - 1
        reach, share = np.zeros(len(points)), np.empty(len(node))
        reach[first] = 1.0
        levels = np.flatnonzero(np.diff(place[node[heads]], prepend=0))
        for low, high in zip(levels, np.append(levels[1:], len(heads))):
            a, b = heads[low], tails[high - 1] + 1
            ways = reach[node[a:b] - step[a:b]] * weight[a:b]
            total = np.add.reduceat(ways, heads[low:high] - a)
            share[a:b] = ways / np.repeat(total, tails[low:high] - heads[low:high] + 1)
            here = node[heads[low:high]]
            reach[here] = total
            for i in here[total < TINY].tolist():
                reach[max(i - self.longest, i - place[i]) : i + 1] /= TINY
        number = np.full(len(points), -1)
        number[node[heads]] = np.arange(len(heads))
        summed = np.cumsum(share)
        own = np.repeat(np.arange(len(heads)), tails - heads + 1)
        key = own + np.minimum(summed - (summed - share)[heads][own], 1.0)
        return first, length, number, key, heads, tails, step, piece

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Ids of one segmentation per text, drawn by the text's seed alone."""
        return self._draw([CHUNK.findall(" " + t) if t else [] for t in texts], seeds)

    def sample_long(self, text: str, seeds: np.ndarray) -> np.ndarray:
        """As ``sample`` for one text, some chunks at a time, so that few of a huge text's are held."""
        found = CHUNK.finditer(" " + text if text else "")
        out, start = [np.zeros(0, dtype=np.int64)], 0
        while some := [m.group() for m in islice(found, CHUNKS_AT_ONCE)]:
            out += self._draw([some], seeds, start)
            start += len(some)
        return np.concatenate(out)

    def _draw(self, texts: list[list[str]], seeds: np.ndarray, start: int = 0) -> list[np.ndarray]:
        """Ids of each list of chunks; ``start`` is the place of the first one in its text."""
        known: dict[str, int] = {}
        index = [known.setdefault(p, len(known)) for parts in texts for p in parts]
        if not index:
            return [np.zeros(0, dtype=np.int64) for _ in texts]
        first, length, number, key, heads, tails, back, piece = self._filter(list(known))
        which, counts = np.array(index, dtype=np.int64), np.array([len(parts) for parts in texts])
        row = np.repeat(np.arange(len(texts)), counts)
        place = start + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        origin = first[which]
        node = origin + length[which]
        seed = mix(seeds[row] + mix(place.astype(np.uint64)))
        active, drawn, taken = np.arange(len(which)), [], np.zeros(len(which), dtype=np.int64)
        turn = 0
        while len(active):
            chance = (mix(seed[active] + np.uint64(turn + 1)) >> np.uint64(11)).astype(float) * 2.0**-53
            here = number[node[active]]
            e = np.clip(np.searchsorted(key, here + chance, side="right"), heads[here], tails[here])
            drawn.append((active, piece[e]))
            taken[active] += 1
            node[active] -= back[e]
            active = active[node[active] > origin[active]]
            turn += 1
        ends = np.cumsum(taken)
        out = np.empty(ends[-1], dtype=np.int64)
        for turn, (who, ids) in enumerate(drawn):
            out[ends[who] - 1 - turn] = ids
        cuts = np.cumsum(np.bincount(row, weights=taken, minlength=len(texts)).astype(np.int64))[:-1]
        return [self._spell(x) for x in np.split(out, cuts)]

    def _spell(self, ids: np.ndarray) -> np.ndarray:
        """Ids with spelled characters written out as bytes."""
        strange = ids >= self.size
        if not strange.any():
            return ids
        letters = "".join(map(chr, (ids[strange] - self.size).tolist()))
        times = np.ones(len(ids), dtype=np.int64)
        times[strange] = [len(c.encode()) for c in letters]
        out = np.repeat(ids, times)
        out[np.repeat(strange, times)] = np.array(self.byte)[np.frombuffer(letters.encode(), dtype=np.uint8)]
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of rows of ids: their pieces' bytes end to end, without the space in front."""
        data = self.letters.take(ids.flatten())
        _, offsets, raw = data.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[data.offset : data.offset + len(data) + 1]
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        cuts = ends[np.cumsum([0, *sizes])]
        text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(cuts.astype(np.int64)), raw or pa.py_buffer(b""))
        plain = pc.utf8_slice_codeunits(text, 1)
        return pc.if_else(ids.is_valid(), plain, pa.scalar(None, plain.type)).cast(pa.string())


@lru_cache(maxsize=2)
def _lattice(model: str, alpha: float) -> PieceLattice:
    return PieceLattice(model, alpha)


def encode_sampled(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 0, alpha: float = ALPHA
) -> DataFrame:
    """``key, ids``: one segmentation per text, the same for the same key, text and seed.

    Neither partitions nor order matter. Null texts have null ids, empty ones no ids. Rows with a
    null key share a seed; repeated rows have the same segmentation.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        lattice = _lattice(model, alpha)
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part["_text"].to_pylist()
                seeds = part["_seed"].to_numpy().view(np.uint64)
                long = len(texts) == 1
                ids = [lattice.sample_long(texts[0] or "", seeds)] if long else lattice.sample([t or "" for t in texts], seeds)
                sizes = np.array([0, *map(len, ids)])
                values = pa.array(np.concatenate(ids).astype(np.int32))
                nulls = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values, mask=nulls)
                yield pa.RecordBatch.from_arrays([part["_key"], lists], ["_key", "ids"])

    rows = docs.select(
        F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.xxhash64(F.lit(seed), F.col(key)).alias("_seed")
    )
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def decode_pieces(coded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``coded`` as ``key, ids, text``: the very text each row of ids was drawn for; null stays null."""
    kind = coded.schema[key].dataType.simpleString()

    def run(batches):
        lattice = _lattice(model, ALPHA)
        for batch in batches:
            for part in slices(batch, "_ids", IDS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([part["_key"], part["_ids"], lattice.decode(part["_ids"])], ["_key", "ids", "text"])

    rows = coded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>, text string").withColumnRenamed("_key", key)
