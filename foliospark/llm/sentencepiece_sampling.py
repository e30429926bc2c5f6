"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text becomes U+2581 for each space, after one leading space. No piece has a space after another
character, so the lattice of a text falls apart before each run of spaces and around each character that only its
bytes can spell; such chunks are sampled on their own, which is the same as sampling the text as a whole.
All chunks of a slice move in lockstep, as arrays.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.textkernel import U64, mix, power_tables, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
_B = 0x9E3779B97F4A7C15
BEGIN_BITS = 22


@dataclass
class Vocabulary:
    """The pieces of a model as sorted hashes of code points, and its bytes."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    bytes_: np.ndarray
    longest: int
    joined: np.ndarray  # code points (below 0x110001) that occur in pieces of two or more
    pieces: list[bytes]
    seen: np.ndarray  # which leading 20 bits some key has
    begins: np.ndarray  # which leading BEGIN_BITS the proper prefixes of pieces have
    spelled: np.ndarray  # the bytes of all pieces, and where those of each start
    spelled_at: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        byte_ids, normal, pieces = np.full(256, -1, np.int32), [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                pieces.append(int(piece[3:5], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                pieces.append(b"")
            else:
                normal.append((piece, i, model.get_score(i)))
                pieces.append(piece.replace(chr(SPACE), " ").encode())
        if (byte_ids < 0).any():
            raise ValueError(f"{path} has no piece for some byte; decoding would not be lossless")
        if any(chr(SPACE) in p.lstrip(chr(SPACE)) for p, _, _ in normal):
            raise ValueError(f"{path} has pieces with a space inside")
        sizes, begins = np.array([len(p) for p, _, _ in normal]), np.zeros(1 << BEGIN_BITS, bool)
        letters = np.zeros((len(normal), sizes.max()), np.uint32)
        letters[np.arange(sizes.max()) < sizes[:, None]] = np.frombuffer("".join(p for p, _, _ in normal).encode("utf-32-le"), np.uint32)
        hashes = np.zeros(len(normal), U64)
        for i in range(sizes.max()):
            k = np.flatnonzero(sizes > i)
            hashes[k] = mix(hashes[k] * U64(_B) + letters[k, i])
            begins[(hashes[sizes > i + 1] >> U64(64 - BEGIN_BITS)).astype(np.int64)] = True
        order = np.argsort(hashes)
        joined = np.zeros(0x110002, bool)
        for p, _, _ in normal:
            if len(p) > 1:
                joined[[ord(c) for c in p]] = True
        seen = np.zeros(1 << 20, bool)
        seen[(hashes >> U64(44)).astype(np.int64)] = True
        raw = [bytes([p]) if isinstance(p, int) else p for p in pieces]
        spelled_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        return cls(
            hashes[order], np.array([i for _, i, _ in normal], np.int32)[order], np.array([s for _, _, s in normal])[order], byte_ids, int(sizes.max()), joined, raw, seen, begins,
            np.frombuffer(b"".join(raw), np.uint8), spelled_at,
        )

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are keys, and their positions among these."""
        maybe = np.flatnonzero(self.seen[(hashes >> U64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        true = self.keys[at] == hashes[maybe]
        return maybe[true], at[true]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a space before each row, and the rows' offsets. A literal U+2581 becomes 0x110000."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.where(points == SPACE, 0x110000, np.where(points == 32, SPACE, points)).astype(np.uint32)
    full = lead[1:] > lead[:-1]
    out = np.insert(points, lead[:-1][full], SPACE)
    return out, np.concatenate([[0], np.cumsum(np.diff(lead) + full)])


def sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, v: Vocabulary, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows and the rows' offsets into them. keys: one uint64 per row."""
    points, at = _code_points(data, offsets)
    n = len(points)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    # cut the lattice where no piece can reach across
    alone = ~v.joined[points]
    space = points == SPACE
    cut = np.ones(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, n))
    in_row = np.searchsorted(starts, at)
    # equal chunks have equal lattices: filter forward once for each
    up, down = power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(points.astype(U64)) * up[:n], out=sums[1:])
    h = mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(U64) * U64(_B))
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    longest_first = np.argsort(-lengths[first], kind="stable")
    lane = np.empty(len(first), np.int64)
    lane[longest_first] = np.arange(len(first))
    lane = lane[kind]
    lattice = Lattice.filtered(points, starts[first[longest_first]], lengths[first[longest_first]], v, alpha)
    # sample backward, a draw for each piece, all chunks together
    rank = np.arange(len(starts)) - np.repeat(in_row[:-1], np.diff(in_row))
    draws = mix(mix(np.repeat(keys, np.diff(in_row)) + U64(seed)) + rank.astype(U64))
    chunk, piece, where, step = lattice.sampled(lane, lengths, draws)
    count = np.bincount(chunk, minlength=len(starts))
    end = np.cumsum(count)
    ids, inner = np.empty(end[-1], np.int32), np.empty(end[-1], np.int64)
    to = end[chunk] - 1 - step
    ids[to], inner[to] = piece, where
    pieces_to = np.concatenate([[0], end])[in_row]
    spelled = np.flatnonzero(ids == SPELLED)
    if not len(spelled):
        return ids, pieces_to
    # an edge of bytes is 1 to 4 pieces
    code = points[starts[np.searchsorted(end, spelled, "right")] + inner[spelled]].astype(np.int64)
    code[code == 0x110000] = SPACE
    wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    width = np.ones(len(ids), np.int64)
    width[spelled] = wide
    moved = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(ids, width)
    for w in range(1, 5):
        k = wide == w
        c, to = code[k], moved[spelled[k]]
        for j in range(w):
            bits = c >> (6 * (w - 1 - j))
            out[to + j] = v.bytes_[bits if w == 1 else (bits & 0x3F) | 0x80 if j else bits | (0, 0, 0xC0, 0xE0, 0xF0)[w]]
    return out, moved[pieces_to]


#: Stands for a character that is spelled in bytes.
SPELLED = -1
#: Levels and steps with fewer lanes than this go one lane at a time, since arrays would be too short to pay.
FEW = 6


def _uniform(keys: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    return (mix(keys + (np.asarray(step) + 1).astype(U64)) >> U64(40)).astype(np.float64) * 2.0**-24


@dataclass
class Lattice:
    """The piece lattices of distinct chunks, longest first (their lanes). A node is a lane and a depth; nodes are
    numbered by depth, then lane. The edges that end at a node lie together, shortest piece first; key is the
    node's number and the chance that the last piece is this or a shorter one, so that one search draws it."""

    level: np.ndarray  # the first node of each depth, and the end
    key: np.ndarray
    size: np.ndarray
    piece: np.ndarray

    @classmethod
    def filtered(cls, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, v: Vocabulary, alpha: float) -> Lattice:
        deep, many = int(lengths[0]), len(lengths)
        level = np.concatenate([[0], np.cumsum(np.concatenate([[many], np.searchsorted(-lengths, -np.arange(1, deep + 1), "right")]))])
        lane = np.repeat(np.arange(many), lengths)
        depth = np.arange(len(lane)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        begin, left = starts[lane] + depth, lengths[lane] - depth
        h, found = np.zeros(len(lane), U64), []
        bare = np.ones(level[-1], bool)
        for size in range(1, min(v.longest, deep) + 1):
            h = mix(h * U64(_B) + points[begin + (size - 1)])
            k, known = v.find(h)
            if len(k):
                ends = level[depth[k] + size] + lane[k]
                found.append((ends, np.full(len(k), size, np.uint8), v.ids[known], alpha * v.scores[known]))
                if size == 1:
                    bare[ends] = False
            k = np.flatnonzero(v.begins[(h >> U64(64 - BEGIN_BITS)).astype(np.int64)] & (left > size))  # some piece goes on like this
            if not len(k):
                break
            begin, lane, depth, left, h = begin[k], lane[k], depth[k], left[k], h[k]
        bare[:many] = False
        ends = np.flatnonzero(bare)
        found.insert(0, (ends, np.ones(len(ends), np.uint8), np.full(len(ends), SPELLED, np.int32), np.zeros(len(ends))))
        ends, size, piece, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ends, kind="stable")
        ends, size, piece, weight = ends[order], size[order], piece[order], weight[order]
        depth = np.searchsorted(level, ends, "right") - 1
        comes = level[depth - size] + ends - level[depth]
        edge = np.searchsorted(ends, np.arange(level[-1] + 1))
        mass, key = np.zeros(level[-1]), ends.astype(float)
        lanes = np.diff(level)
        few = int(np.searchsorted(-lanes, -FEW, "right"))
        for d in range(1, min(few, deep + 1)):
            a, b = level[d], level[d + 1]
            e, f = edge[a], edge[b]
            cuts = edge[a:b] - e
            fan = np.diff(np.append(cuts, f - e))
            x = weight[e:f] + mass[comes[e:f]]
            top = np.maximum.reduceat(x, cuts)
            y = np.cumsum(np.exp(x - np.repeat(top, fan)))
            before = np.concatenate([[0.0], y])[cuts]
            total = y[cuts + fan - 1] - before
            mass[a:b] = top + np.log(total)
            key[e:f] += (y - np.repeat(before, fan)) / np.repeat(total, fan)
        if few <= deep:
            cls._one_by_one(level[max(1, few)], level[-1], edge, comes, weight, mass, key)
        key[edge[many + 1 :] - 1] = np.arange(many + 1, level[-1] + 1)  # the last edge's chance is 1, whatever was rounded
        return cls(level, key, size, piece)

    @staticmethod
    def _one_by_one(a: int, b: int, edge: np.ndarray, comes: np.ndarray, weight: np.ndarray, mass: np.ndarray, key: np.ndarray) -> None:
        for lo in range(a, b, 1 << 14):  # lists of bounded size
            hi = min(b, lo + (1 << 14))
            cuts, off = edge[lo : hi + 1].tolist(), int(edge[lo])
            come, w, back = comes[cuts[0] : cuts[-1]].tolist(), weight[cuts[0] : cuts[-1]].tolist(), {}
            shares: list[float] = []
            for i in range(hi - lo):
                x = []
                for j in range(cuts[i] - off, cuts[i + 1] - off):
                    c = come[j]
                    x.append(w[j] + (back[c] if c in back else float(mass[c])))
                top = max(x)
                part, total = [], 0.0
                for t in x:
                    total += math.exp(t - top)
                    part.append(total)
                back[lo + i] = top + math.log(total)
                shares += [p / total for p in part]
            mass[lo:hi] = [back[i] for i in range(lo, hi)]
            key[cuts[0] : cuts[-1]] += shares

    def sampled(self, lane: np.ndarray, lengths: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, piece, where it starts in its chunk, and which from the end it is, of all pieces of the chunks."""
        live, depth, step, taken = np.arange(len(lane)), lengths.copy(), 0, []
        while len(live) >= FEW or (len(live) and step < 64):
            e = self.key.searchsorted(self.level[depth[live]] + lane[live] + _uniform(draws[live], step), "right")
            depth[live] -= self.size[e]
            taken.append((live, self.piece[e], depth[live], np.full(len(live), step)))
            live = live[depth[live] > 0]
            step += 1
        for i in live.tolist():
            edges, d, at, level = [], int(depth[i]), step, self.level
            u: list[float] = []
            while d > 0:
                if at - step >= len(u):
                    u += _uniform(draws[i : i + 1], np.arange(at, at + 4096)).tolist()
                e = int(self.key.searchsorted(int(level[d]) + int(lane[i]) + u[at - step], "right"))
                edges.append(e)
                d -= int(self.size[e])
                at += 1
            e = np.array(edges)
            taken.append((np.full(len(e), i), self.piece[e], depth[i] - np.cumsum(self.size[e], dtype=np.int64), np.arange(step, at)))
        chunk, piece, where, steps = (np.concatenate(x) for x in zip(*taken, strict=True))
        return chunk, piece, where, steps


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of the ids; the leading space of encoding goes."""
    raw = b"".join(bytes([p]) if isinstance(p := v.pieces[i], int) else p for i in ids)
    return raw.decode("utf-8", "surrogatepass")[1:]


def spelled_rows(ids: np.ndarray, to: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the pieces of all rows spell, and the rows' offsets into them."""
    size = v.spelled_at[ids + 1] - v.spelled_at[ids]
    ends = np.cumsum(size)
    where = np.repeat(v.spelled_at[ids + 1] - ends, size) + np.arange(ends[-1] if len(ends) else 0)
    return v.spelled[where], np.concatenate([[0], ends])[to]


def same_rows(ids: np.ndarray, to: np.ndarray, v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the pieces of each row spell a space and its bytes; an empty row has no pieces."""
    got, at = spelled_rows(ids, to, v)
    full = np.diff(offsets) > 0
    same = np.diff(at) == np.diff(offsets) + full
    lead = at[:-1][full & same]
    same[full & same] = got[lead] == 32
    start, end = (at[:-1] + full)[same], at[1:][same]
    size = end - start
    row = np.repeat(np.flatnonzero(same), size)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    wrong = got[np.repeat(start, size) + inner] != data[np.repeat(offsets[:-1][same], size) + inner]
    same[row[wrong]] = False
    return same


def _encoder(model: str, alpha: float, seed: int, n: int):
    """Columns 0 to n - 1 are carried, n is the key, n + 1 the text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for rows, data, offsets in sliced(batches, n + 1):
            keys = rows.column(n).to_numpy(zero_copy_only=False).astype(np.int64).astype(U64)
            ids, to = sample(data, offsets, keys, v, alpha, seed)
            pieces = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int32()))
            out = [*rows.columns[:n], pieces, pa.array(np.diff(to), pa.int64()), rows.column(n + 1).is_null(), pa.array(same_rows(ids, to, v, data, offsets))]
            yield pa.RecordBatch.from_arrays(out, names=[*(f"_c{i}" for i in range(n)), "pieces", "n_pieces", "gone", "lossless"])

    return encode


def encode_sampled(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, alpha: float = 1e-3, seed: int = 0) -> DataFrame:
    """docs without text, and pieces array<int>, n_pieces long, lossless boolean; columns so named go.

    Pieces are drawn from the segmentations of a text with chances in proportion to exp(alpha * sum of the
    scores). Draws depend on seed, the row key and the place in the text alone, so they are the same on any
    cluster and at each repetition. A character without a piece, and a literal U+2581, is spelled in bytes, so
    decode() gives every text back; lossless says that it did. An empty text has no pieces; a null text has
    null pieces. Rows that repeat a key and text get the same pieces; a null key counts as a key of its own.
    """
    own = [c for c in docs.columns if c not in (text, "pieces", "n_pieces", "lossless")]
    rows = docs.select(*[f"`{c}`" for c in own], F.xxhash64(key).alias("_key"), F.col(text).alias("_text"))
    kinds = [docs.schema[c] for c in own]
    schema = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds))
    out = rows.mapInArrow(_encoder(os.fspath(model), alpha, seed, len(own)), f"{schema + ', ' if own else ''}pieces array<int>, n_pieces long, gone boolean, lossless boolean")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], F.when(~F.col("gone"), F.col("pieces")).alias("pieces"), F.when(~F.col("gone"), F.col("n_pieces")).alias("n_pieces"), "lossless")


def decode_pieces(encoded: DataFrame, model: str = MODEL, pieces: str = "pieces", text: str = "text") -> DataFrame:
    """encoded with a column text decoded from pieces; null pieces give null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def spell(ids):
        v = vocabulary(model)
        return ids.map(lambda x: None if x is None else decode(x, v))

    return encoded.withColumn(text, spell(F.col(pieces)))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_sampled(docs)
