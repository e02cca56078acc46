"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding by concatenation."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEEP, blocks, map_batches, materialize, mix, parts, same_spans, span_hash, text_column

#: Bytes of text whose distinct words are folded together, and the longest word whose boundaries fit the fold's 64 bits.
GROUP_BYTES = 1 << 20
LONG = 62
#: Entries of the tables that find a piece by its hash.
SLOTS = 1 << 20


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary by rank, from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


# ---------------------------------------------------------------- pieces


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, else 0."""
    out = np.zeros(0x110000, dtype=np.uint8)
    kinds = {"L": 1, "N": 2}
    for c in range(0x110000):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k:
            out[c] = k
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = 3
    return out


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces of the pattern begin in a block of texts; empty texts have none.

    The pattern is contractions ('s 't 're 've 'm 'll 'd), then runs of letters, of numbers, or of others, each with
    one space before it, then white space, whose last character is left to what follows.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(cp)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    cls = _classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    space = cls == 3
    # the last character of white space that something else follows in its text
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start = run | last
    joined = np.zeros(n, dtype=bool)
    joined[1:] = last[:-1] & (cp[:-1] == 32)
    start &= ~joined
    quote = np.flatnonzero((cp == 39) & run & ~joined)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(first[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 2), (long, 3)):
            q = quote[hit]
            start[q + 1] = False
            end = q + size
            start[end[end < n]] = True
    return lead[start]


# ---------------------------------------------------------------- merges

_BASE = 0x2545F4914F6CDD1D
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, up to the nth."""
    one = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    return one(_BASE), one(pow(_BASE, -1, 1 << 64))


class Rolling:
    """Hashes of any spans of a block in constant time each. They only propose pieces; bytes decide."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        forth, back = _powers(1 << max(18, (n - 1).bit_length()) if n <= 1 << 20 else n)
        self.back = back[: n + 1]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * forth[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


class Vocabulary:
    """Pieces by rank, with what the fold and its preparation look up.

    For a vocabulary learned by merging, the merges of a word can be taken in one pass over the vocabulary's pieces
    that occur in it, by rank, then by place: a piece merges if it is two parts by then. (While both of its ends are
    boundaries, what lies between them is merged as the piece alone would be, so the piece is whole at its own rank
    or never.) That needs every piece to be built by the merges of ranks below its own; words that hold a piece for
    which this fails (`odd`) are merged step by step instead.
    """

    def __init__(self, pieces: list[bytes]):
        self._build(pieces)
        self.odd = np.zeros(len(pieces), dtype=bool)
        self.odd[[r for r, p in enumerate(pieces) if len(p) > 1 and self.merge(p, r) != [r]]] = True

    def __reduce__(self):
        """Workers get the pieces and build the tables themselves, once."""
        return _revived, (b"".join(self.pieces), self.lengths.astype("<u4").tobytes(), self.odd.tobytes())

    def _build(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        self.ranks = {b: r for r, b in enumerate(pieces)}
        if len(self.ranks) != len(pieces) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("distinct pieces with all single bytes among them are needed")
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum(self.lengths)
        self.known = Rolling(data)(ends - self.lengths, ends)
        if len(np.unique(self.known)) != len(pieces):
            raise ValueError("two pieces have one hash")
        #: Ranks by some bits of the hash, and by others for the few that find their slot taken.
        self.first, self.second = np.full(SLOTS, -1, dtype=np.int32), np.full(SLOTS, -1, dtype=np.int32)
        order = np.arange(len(pieces), dtype=np.int32)
        self.first[self._slot(self.known, 0)] = order
        late = order[self.first[self._slot(self.known, 0)] != order]
        for self.shift in range(20, 44):
            self.second[:] = -1
            self.second[self._slot(self.known[late], self.shift)] = late
            if (self.second[self._slot(self.known[late], self.shift)] == late).all():
                break
        else:
            raise ValueError("too many pieces for the table")
        #: The pieces' bytes, eight by eight.
        self.content = np.zeros((len(pieces), -(-int(self.lengths.max()) // 8)), dtype=np.uint64)
        self.content.view(np.uint8)[np.arange(self.content.shape[1] * 8)[None, :] < self.lengths[:, None]] = data
        self.longest = int(min(self.lengths.max(), LONG))

    @staticmethod
    def _slot(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def find(self, p: np.ndarray, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ranks of spans of parts()' p that are pieces, byte by byte, or -1; h: their Rolling hashes."""
        out = np.full(len(h), -1, dtype=np.int64)
        found = self.first[self._slot(h, 0)]
        other = np.flatnonzero((found >= 0) & (self.known[found] != h))
        found[other] = self.second[self._slot(h[other], self.shift)]
        found[other[self.known[found[other]] != h[other]]] = -1
        at = np.flatnonzero(found >= 0)
        rank = found[at].astype(np.int64)
        hit = self.lengths[rank] == sizes[at]
        at, rank = at[hit], rank[hit]
        good = np.ones(len(at), dtype=bool)
        live = np.arange(len(at))
        for j in range(self.content.shape[1]):
            n = sizes[at[live]]
            good[live] &= p[starts[at[live]] + 8 * j] & KEEP[np.minimum(n - 8 * j, 8)] == self.content[rank[live], j]
            live = live[n > 8 * (j + 1)]
        out[at[good]] = rank[good]
        return out

    def merge(self, word: bytes, limit: int | None = None) -> list[int]:
        """Step by step, least rank first, with a heap: O(n log n). limit: the last rank taken, in a single rising pass."""
        parts = [word[i : i + 1] for i in range(len(word))]
        n = len(parts)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        queue: list[tuple[int, int, bytes]] = []

        def offer(i):
            if i >= 0 and right[i] < n:
                both = parts[i] + parts[right[i]]
                r = self.ranks.get(both)
                if r is not None and (limit is None or r >= reached and r <= limit):
                    heapq.heappush(queue, (r, i, both))

        reached = 0
        for i in range(n - 1):
            offer(i)
        while queue:
            r, i, both = heapq.heappop(queue)
            j = right[i]
            if not alive[i] or j >= n or parts[i] + parts[j] != both:
                continue
            reached = r
            parts[i], alive[j], right[i] = both, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            offer(left[i])
        return [self.ranks[p] for p, a in zip(parts, alive) if a]

    def candidates(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words that lie end to end in data: rank * 256 + place of each piece in them, by rank and place; and counts by word."""
        found, bounds = [], np.concatenate(([0], np.cumsum(sizes)))
        for first in range(0, len(sizes), 20_000):  # some words at a time
            last = min(first + 20_000, len(sizes))
            found.append(self._candidates(data[bounds[first] : bounds[last]], sizes[first:last]))
        return np.concatenate([f[0] for f in found] or [np.zeros(0, np.int32)]), np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])

    def _candidates(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        h, p = Rolling(data), parts(data)
        word = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(data)) - (ends - sizes)[word]
        left = ends[word] - np.arange(len(data))
        at = np.arange(len(data))
        found = []
        for n in range(2, self.longest + 1):
            at = at[left[at] >= n]
            if not len(at):
                break
            r = self.find(p, h(at, at + n), at, np.full(len(at), n))
            hit = r >= 0
            x = at[hit]
            found.append((word[x].astype(np.uint64) << np.uint64(32)) | (r[hit].astype(np.uint64) << np.uint64(8)) | place[x].astype(np.uint64))
        found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        return (found & np.uint64(0xFFFFFFFF)).astype(np.int32), np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=len(sizes))


@lru_cache(maxsize=2)
def _revived(joined: bytes, lengths: bytes, odd: bytes) -> Vocabulary:
    ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
    out = Vocabulary.__new__(Vocabulary)
    out._build([joined[a:b] for a, b in zip([0, *ends], ends)])
    out.odd = np.frombuffer(odd, dtype=bool)
    return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(load_ranks(path))
    return _vocabularies[path]


def _literal(spark: SparkSession, x: np.ndarray) -> Column:
    """An array<bigint> literal that keeps its numbers in one primitive array."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    out = gateway.new_array(jvm.long, len(x))
    jvm.java.nio.ByteBuffer.wrap(bytearray(x.astype("<i8").tobytes())).order(jvm.java.nio.ByteOrder.LITTLE_ENDIAN).asLongBuffer().get(out)
    return Column(jvm.org.apache.spark.sql.functions.lit(out))


def decoded(ids: Column, voc: Vocabulary, spark: SparkSession) -> Column:
    """The bytes of an array of ids: their binary pieces, concatenated. The literal piece list holds them as hex digits, as Spark joins text only."""
    jvm = spark._jvm
    pieces = jvm.java.util.regex.Pattern.compile(",").split(",".join(p.hex() for p in voc.pieces))
    pieces = Column(jvm.org.apache.spark.sql.functions.lit(pieces))
    return F.unhex(F.array_join(F.transform(ids, lambda i: pieces[i]), ""))


def folded(full: Column, candidates: Column, ends: Column, inner: Column) -> Column:
    """The boundaries of each word's ids after its ranked merges, as bits: array<bigint>.

    full has a bit before each byte of a word and one after the last. The fold goes over the word's candidate merges
    by rank; one is taken if both ends of the piece are boundaries and a single boundary lies inside, which it
    clears. ends and inner are the literal rank map: the bits of a piece at place 0, by rank.
    """

    def step(bits: Column, c: Column) -> Column:
        rank, place = F.shiftright(c, 8), c.bitwiseAND(F.lit(255))
        inside = bits.bitwiseAND(F.call_function("shiftleft", inner[rank], place))
        edges = bits.bitwiseAND(F.call_function("shiftleft", ends[rank], place))
        return F.when((F.bit_count(inside) == 1) & (F.bit_count(edges) == 2), bits.bitwiseXOR(inside)).otherwise(bits)

    return F.zip_with(full, candidates, lambda bits, c: F.aggregate(c, bits, step))


# ---------------------------------------------------------------- documents

_GROUP = ("counts", "codes", "data", "sizes", "heap_sizes", "heap_ids")


def encode(docs: DataFrame, voc: Vocabulary, key: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """(key, ids array<int>[, decoded binary]) for every row of docs.

    Whole texts are cut into pieces of the pattern. A piece that is in the vocabulary is its own id; the distinct
    others of each group of texts (GROUP_BYTES, or one longer text) are folded once, where they are, and put back
    by index: no shuffle, and memory for one group; the folded groups lie in a table between. Words are one word only if their bytes are equal. Words of more
    than LONG bytes are merged with a heap, as the fold keeps a word's boundaries in one number. decoded concatenates
    the binary pieces of the ids, in Spark. Null texts are empty, empty texts have no ids; rows repeat as in docs; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    key_type = src.schema["k"].dataType.simpleString()
    size = len(voc.pieces)

    def group(held, keys):
        starts, sizes, counts, bufs, at = [], [], [], [], 0
        for column in held:
            for _, buf, offsets in blocks(column):
                s = piece_starts(buf, offsets)
                e = np.append(s[1:], len(buf))
                counts.append(np.diff(np.searchsorted(s, offsets)))
                starts.append(s + at)
                sizes.append(e - s)
                bufs.append(buf)
                at += len(buf)
        data, starts, sizes = (np.concatenate(x) for x in (bufs, starts, sizes))
        p = parts(data)
        _, example, back = np.unique(span_hash(p, starts, starts + sizes), return_index=True, return_inverse=True)
        # words with one hash are one only if their bytes are
        size_of, first_of = sizes[example[back]], starts[example[back]]
        apart: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((sizes != size_of) | ~same_spans(p, starts, first_of, np.minimum(sizes, size_of))):
            apart.setdefault(data[starts[i] : starts[i] + sizes[i]].tobytes(), []).append(i)
        for k, same in enumerate(apart.values()):
            back[same] = len(example) + k
        example = np.concatenate([example, np.array([same[0] for same in apart.values()], dtype=example.dtype)])

        def cut(which):
            n, first = sizes[example[which]], starts[example[which]]
            return data[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)], n

        taken, n = cut(np.arange(len(example)))
        ends = np.cumsum(n)
        code = voc.find(parts(taken), Rolling(taken)(ends - n, ends), ends - n, n)
        rest = np.flatnonzero(code < 0)
        long = sizes[example[rest]] > LONG
        words, slow = rest[~long], rest[long]
        taken, n = cut(words)
        found, each = voc.candidates(taken, n)
        bad = np.unique(np.repeat(np.arange(len(words)), each)[voc.odd[found >> 8]])
        if len(bad):
            keep = np.ones(len(words), dtype=bool)
            keep[bad] = False
            found = found[np.repeat(keep, each)]
            words, slow, each = words[keep], np.concatenate([slow, words[~keep]]), each[keep]
            taken, n = cut(words)
        merged = [voc.merge(cut(slow[k : k + 1])[0].tobytes()) for k in range(len(slow))]
        code[words], code[slow] = size + np.arange(len(words)), size + len(words) + np.arange(len(slow))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), pa.array(found))
        full = pa.array((np.int64(1) << (n + 1)) - 1)
        keys = pa.chunked_array(keys).combine_chunks()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        blobs = [np.concatenate(counts), code[back], taken, n, np.array([len(m) for m in merged]), np.array([i for m in merged for i in m])]
        blobs = [pa.array([x.astype(np.uint8 if k in (2, 3) else np.int32).tobytes()], pa.binary()) for k, x in enumerate(blobs)]
        return pa.RecordBatch.from_arrays([one(keys), *blobs, one(full), one(lists)], names=["keys", *_GROUP, "full", "candidates"])

    def split(batches):
        held, keys, nbytes = [], [], 0
        for b in batches:
            column = text_column(b.column(1)).fill_null("")
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, int)
            first = 0
            for r in range(len(sizes)):
                nbytes += int(sizes[r])
                if nbytes >= GROUP_BYTES:
                    held.append(column.slice(first, r + 1 - first))
                    keys.append(b.column(0).slice(first, r + 1 - first))
                    yield group(held, keys)
                    held, keys, nbytes, first = [], [], 0, r + 1
            if first < len(sizes):
                held.append(column.slice(first))
                keys.append(b.column(0).slice(first))
        if held:
            yield group(held, keys)

    def ids_of(data, n, masks):
        """The folded words' ids, end to end, and how many each word has."""
        bits = np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : LONG + 1].astype(bool)
        bits &= np.arange(LONG + 1)[None, :] < n[:, None]
        word, place = np.nonzero(bits)
        s = (np.cumsum(n) - n)[word] + place
        e = np.append(s[1:], len(data))
        return voc.find(parts(data), Rolling(data)(s, e), s, e - s), np.bincount(word, minlength=len(n))

    def join(batches):
        for b in batches:
            for row in range(b.num_rows):
                keys = b.column(0).slice(row, 1).flatten()
                counts, codes, data, n, heap_sizes, heap_ids = (np.frombuffer(b.column(1 + k)[row].as_py(), np.uint8 if k in (2, 3) else np.int32) for k in range(6))
                ids, each = ids_of(data, n.astype(np.int64), np.asarray(b.column(7).slice(row, 1).flatten(), dtype=np.int64))
                values = np.concatenate([np.arange(size), ids, heap_ids]).astype(np.int32)
                sizes = np.concatenate([np.ones(size, np.int64), each, heap_sizes])
                starts = np.cumsum(sizes) - sizes
                ends = np.cumsum(counts)
                first = 0
                while first < len(keys):  # some rows at a time
                    base = int(ends[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, base + 400_000, side="right")))
                    c = codes[base : int(ends[last - 1])]
                    m = sizes[c]
                    run = np.cumsum(m)
                    out = values[np.arange(int(m.sum())) - np.repeat(run - m, m) + np.repeat(starts[c], m)]
                    bounds = np.concatenate(([0], run))[np.concatenate(([base], ends[first:last])) - base].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.ListArray.from_arrays(pa.array(bounds), pa.array(out))], names=["k", "ids"])
                    first = last

    blobs = ", ".join(f"{c} binary" for c in _GROUP)
    grouped = map_batches(src, split, f"keys array<{key_type}>, {blobs}, full array<bigint>, candidates array<array<int>>")
    short = np.where(voc.lengths <= LONG, voc.lengths, 1)
    ends, inner = _literal(spark, (np.int64(1) << short) | 1), _literal(spark, ((np.int64(1) << short) - 1) & ~np.int64(1))
    masks = grouped.select("keys", *_GROUP, folded(F.col("full"), F.col("candidates"), ends, inner).alias("masks"))
    # between the two passes lies a table: a stage then has one Python worker a task, which halves what workers hold
    masks = materialize(masks, "folded", "zstd")
    out = map_batches(masks, join, f"k {key_type}, ids array<int>")
    if decode:
        out = out.select("k", "ids", decoded(F.col("ids"), voc, spark).alias("decoded"))
    return out.withColumnRenamed("k", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens and the digests of ids and decoded bytes."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
