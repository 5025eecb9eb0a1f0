"""Pieces of highest total score for every text, and texts from pieces; giant texts as a max-plus scan over chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from karavel.llm.common import chunks, freed, mix, same_document, stage, with_column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 16_384  # texts with more characters are cut into chunks of so many
BLOCK_CHUNKS = 128  # transfer matrices that one row of the scan's first level combines
MEMORY = 32_000_000  # bytes of segments that a worker remembers, about, in two generations
AT_ONCE = 16  # chunks that a worker holds the ids of
IDS_AT_ONCE = 1 << 18  # ids that are decoded in one piece, but for a text with more
SHORT, SEGMENTS_AT_ONCE = 64, 4096  # segments of up to so many characters are cut so many at a time
SPACE = "▁"  # fixed value: the mark that stands for a space in pieces
LITERAL = "\ud800"  # stands for such a mark in the text itself; no text can hold it, it has no piece and goes by bytes
UNKNOWN_PENALTY = 10  # fixed value: what a character without a piece scores below the worst piece
NEVER = -(1 << 60)
BYTES, PREFIX = -1, -2  # no ids: a character that goes by its bytes; the beginning of a piece


@dataclass(frozen=True)
class Trie:
    """The beginnings of pieces as arrays. A node is its number, the root 0; ``keys`` is an open hash table of node * 2^21 + character, -1 where free."""

    keys: np.ndarray
    children: np.ndarray
    ids: np.ndarray  # of each node, PREFIX if it is no piece
    scores: np.ndarray

    def step(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The node after each of some nodes by a character, 0 if there is none."""
        key = (nodes << 21) + characters
        at = self.slots(key, len(self.keys))
        found = self.keys[at]
        out = np.where(found == key, self.children[at], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.children[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    @staticmethod
    def slots(key: np.ndarray, size: int) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def make_trie(table: dict[str, tuple[int, int]]) -> Trie:
    order = sorted(table, key=len)
    node = {"": 0} | {x: i for i, x in enumerate(order, 1)}
    key = np.array([(node[x[:-1]] << 21) + ord(x[-1]) for x in order], np.int64)
    size = 1 << (8 * len(order) + 8).bit_length()
    keys, children = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    for i, (k, at) in enumerate(zip(key.tolist(), Trie.slots(key, size).tolist()), 1):
        while keys[at] >= 0:
            at = (at + 1) % size
        keys[at], children[at] = k, i
    return Trie(keys, children, np.array([PREFIX, *(table[x][0] for x in order)], np.int64), np.array([0, *(table[x][1] for x in order)], np.int64))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with whole-number scores. ``byte_ids`` has the pieces that stand for single bytes."""

    table: dict[str, tuple[int, int]]  # piece -> (id, score); what only begins a piece has the id PREFIX
    byte_ids: tuple[int, ...]
    texts: tuple[bytes | None, ...]  # what each id decodes to, None for control ids
    longest: int
    unknown: int  # score of a character without a piece
    trie: Trie  # of ``table``
    id_scores: np.ndarray  # of each id; a character that goes by its bytes has its score at the first one


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, byte_ids, texts = {}, [0] * 256, []
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
            texts.append(None)
        else:
            scores[piece] = (i, int(p.get_score(i)))
            texts.append(piece.replace(SPACE, " ").encode())
    return make_vocabulary(scores, tuple(byte_ids), tuple(texts))


def make_vocabulary(scores: dict[str, tuple[int, int]], byte_ids: tuple[int, ...], texts: tuple[bytes | None, ...]) -> Vocabulary:
    if any(SPACE in x.lstrip(SPACE) for x in scores):
        raise ValueError("a piece holds a space after another character: segments can't end before spaces")
    table = {x[:k]: (PREFIX, 0) for x in scores for k in range(1, len(x))} | scores
    unknown = min((s for _, s in scores.values()), default=0) - UNKNOWN_PENALTY
    id_scores = np.zeros(len(texts), np.int64)
    id_scores[[byte_ids[b] for b in range(256) if b & 0xC0 != 0x80]] = unknown
    for i, score in scores.values():
        id_scores[i] = score
    return Vocabulary(table, byte_ids, texts, max(map(len, scores), default=1), unknown, make_trie(table), id_scores)


def marked(text: str, first: bool = True) -> str:
    """A text, or a part of one, as pieces see it: spaces as marks, and one more in front of the whole."""
    return (SPACE if first and text else "") + text.replace(SPACE, LITERAL).replace(" ", SPACE)


@dataclass(frozen=True)
class Rest:
    """A chunk without what lies between its first and last sure cut, whose pieces are known: their score and ids.

    ``length``: characters of the text that are the chunk's own; ``head``: where the part is left out, -1 if nothing is.
    """

    text: str
    length: int
    head: int
    middle: int
    ids: np.ndarray


SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Segmenter:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)

    def edges(self, s: str, i: int, stop: int) -> list[tuple[int, int, int]]:
        """(end, id, score) of the pieces that begin at i and end by ``stop``, longest last."""
        v, out, single = self.v, [], False
        for j in range(i + 1, min(stop, i + v.longest) + 1):
            found = v.table.get(s[i:j])
            if found is None:
                break
            if found[0] != PREFIX:
                out.append((j, *found))
                single |= j == i + 1
        if not single:
            out.append((i + 1, BYTES, v.unknown))
        return out

    def path(self, s: str, entry: int, end: int) -> tuple[int, list[int]]:
        """Score and ids of the best way from ``entry`` to ``end``; of equal ways the one whose last piece is longest.

        ``s`` may go on after ``end``; pieces may not.
        """
        table, longest, unknown = self.v.table, self.v.longest, self.v.unknown
        best, back = [NEVER] * (end + 1), [None] * (end + 1)
        best[entry] = 0
        for i in range(entry, end):
            at = best[i]
            if at > NEVER:
                single = False
                for j in range(i + 1, min(end, i + longest) + 1):
                    found = table.get(s[i:j])
                    if found is None:
                        break
                    piece, score = found
                    if piece != PREFIX:
                        single |= j == i + 1
                        if at + score > best[j]:
                            best[j], back[j] = at + score, (i, piece)
                if not single and at + unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = at + unknown, (i, BYTES)
        ids: list[int] = []
        j = end
        while j > entry:
            i, piece = back[j]
            ids.extend(reversed(self.bytes_of(s[i])) if piece < 0 else (piece,))
            j = i
        return best[end], ids[::-1]

    def bytes_of(self, c: str) -> tuple[int, ...]:
        return tuple(self.v.byte_ids[b] for b in (SPACE if c == LITERAL else c).encode())

    def short_paths(self, segments: list[str]) -> list[bytes]:
        """The ids of ``path`` for whole segments, packed, for all of them at once: each step is one character further in every segment."""
        v, n = self.v, np.array([len(s) for s in segments], np.int64)
        text = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(n) - n
        stop = np.repeat(first + n, n)
        at, node, found = np.arange(len(text)), np.zeros(len(text), np.int64), []
        for size in range(1, v.longest + 1):
            node = v.trie.step(node, text[at + size - 1])
            piece = v.trie.ids[node]
            whole = piece != PREFIX
            found.append((at[whole], np.full(whole.sum(), size), piece[whole], v.trie.scores[node[whole]]))
            if size == 1:  # what has no piece of its own goes by its bytes
                alone = at[~whole]
                found.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), BYTES), np.full(len(alone), v.unknown)))
            more = (node > 0) & (at + size < stop[at])
            at, node = at[more], node[more]
        start, size, piece, score = (np.concatenate(x) for x in zip(*found))
        step = start - np.repeat(first, n)[start]
        order = np.argsort(step.astype(np.uint16), kind="stable")
        start, size, piece, score = start[order], size[order], piece[order], score[order]
        bounds = np.searchsorted(step[order], np.arange(n.max(initial=0) + 1)).tolist()
        # places of a segment are its characters and its end; no two edges of a step lead to one place
        place = start + np.repeat(np.arange(len(n)), n)[start]
        end = place + size
        best, back = np.full(len(text) + len(n), NEVER), np.zeros(len(text) + len(n), np.int64)
        best[first + np.arange(len(n))] = 0
        for i, j in zip(bounds, bounds[1:]):
            ways, to = best[place[i:j]] + score[i:j], end[i:j]
            better = np.flatnonzero(ways > best[to])
            best[to[better]], back[to[better]] = ways[better], better + i
        chosen = np.full(len(text), PREFIX, np.int64)
        begin = first + np.arange(len(n))
        left, begin = (begin + n)[n > 0], begin[n > 0]
        while len(left):
            edge = back[left]
            chosen[start[edge]] = piece[edge]
            open_ = place[edge] > begin
            left, begin = place[edge][open_], begin[open_]
        where = np.flatnonzero(chosen != PREFIX)
        ids = chosen[where]
        raw = np.flatnonzero(ids == BYTES)
        if len(raw):
            spelt = [self.bytes_of(chr(c)) for c in text[where[raw]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[raw] = [len(x) for x in spelt]
            where, ids, is_raw = np.repeat(where, times), np.repeat(ids, times), np.repeat(ids == BYTES, times)
            ids[is_raw] = list(chain.from_iterable(spelt))
        packed = ids.astype(np.int32).tobytes()
        cuts = (4 * np.searchsorted(where, np.append(first, len(text)))).tolist()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])]

    def learn(self, segments: Iterable[str]) -> None:
        """See to it that the ids of all these segments are known. What was used since the last change of generation, or before it, is remembered."""
        if self.held > MEMORY // 2:
            self.older, self.known, self.held = self.known, {}, 0
        missing = set(segments).difference(self.known)
        self.known.update((s, self.older[s]) for s in missing & self.older.keys())
        self.known.update((s, np.array(self.path(s, 0, len(s))[1], np.int32).tobytes()) for s in missing if len(s) > SHORT and s not in self.known)
        new = list(missing.difference(self.known))
        for at in range(0, len(new), SEGMENTS_AT_ONCE):
            some = new[at : at + SEGMENTS_AT_ONCE]
            self.known.update(zip(some, self.short_paths(some)))
        self.held += 200 * len(missing) + 2 * sum(map(len, missing)) + sum(map(len, map(self.known.__getitem__, missing)))

    def forget(self) -> None:
        """Workers live on through other stages, which need their memory."""
        self.known, self.older, self.held = {}, {}, 0
        pa.default_memory_pool().release_unused()

    def packed(self, segments: list[str]) -> np.ndarray:
        """The ids of segments in a row that ``learn`` has seen."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, segments)), np.int32)

    def score(self, ids: np.ndarray) -> int:
        return int(self.v.id_scores[ids].sum())

    def encode_all(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """Score and ids of whole texts. No piece holds a space after another character, so segments end before spaces."""
        segments = [SEGMENT.findall(marked(x)) for x in texts]
        self.learn(chain.from_iterable(segments))
        return [(self.score(ids), ids) for ids in map(self.packed, segments)]

    def encode(self, text: str) -> tuple[int, list[int]]:
        score, ids = self.encode_all([text])[0]
        return score, ids.tolist()

    def sure_cuts(self, s: str, length: int) -> tuple[int, int] | None:
        """First and last place inside a chunk that no piece crosses and that lies beyond any piece from before."""
        # a segment begins where spaces do; runs of spaces are passed over
        first = s.find(SPACE, self.v.longest, length)
        while first > 0 and s[first - 1] == SPACE:
            first = s.find(SPACE, first + 1, length)
        last = s.rfind(SPACE, max(first, 0), length)
        while last > first and s[last - 1] == SPACE:
            last = s.rfind(SPACE, first, last)
        return (first, last) if first >= 0 else None

    def fans(self, s: str, start: int, end: int, entries: int) -> np.ndarray:
        """Best scores from each of ``entries`` places after ``start`` to ``end`` and up to longest-1 beyond it."""
        k = self.v.longest
        best = np.full((end - start + k, entries), NEVER, np.int64)
        for a in range(min(entries, end - start + k)):
            best[a, a] = 0
        for i in range(start, end):
            at = best[i - start]
            for j, _, score in self.edges(s, i, len(s)):
                row = best[j - start]
                np.maximum(row, np.where(at > NEVER, at + score, NEVER), out=row)
        return best[end - start :]

    def transfer(self, s: str, length: int) -> tuple[np.ndarray, Rest]:
        """Matrix [in][out] of a chunk: best score if its first ``in`` characters belong to a piece from before and its last piece takes ``out`` of the next; and what ``backtrace`` needs."""
        return self.transfers([(s, length)])[0]

    def transfers(self, chunks_: list[tuple[str, int]]) -> list[tuple[np.ndarray, Rest]]:
        cuts = [self.sure_cuts(s, length) for s, length in chunks_]
        middles = [SEGMENT.findall(s[slice(*at)]) if at else [] for at, (s, _) in zip(cuts, chunks_)]
        self.learn(chain.from_iterable(middles))
        return [self._transfer(s, length, at, self.packed(middle)) for (s, length), at, middle in zip(chunks_, cuts, middles)]

    def _transfer(self, s: str, length: int, cuts: tuple[int, int] | None, ids: np.ndarray) -> tuple[np.ndarray, Rest]:
        k = self.v.longest
        if cuts is None:
            return self.fans(s, 0, length, k).T.copy(), Rest(s, length, -1, 0, ids)
        first, last = cuts
        head = self.fans(s, 0, first, k)[0]
        middle = self.score(ids)
        tail = self.fans(s, last, length, 1)[:, 0]
        return plus(plus(head[:, None], np.int64(middle)), tail[None, :]), Rest(s[:first] + s[last:], length - (last - first), first, middle, ids)

    def backtrace(self, rest: Rest, entry: int, over: int) -> tuple[int, np.ndarray]:
        """Score and ids of the pieces that begin in a chunk, entered ``entry`` characters in and left ``over`` beyond its end."""
        end = rest.length + over
        if rest.head < 0:
            score, ids = self.path(rest.text, entry, end) if entry < end else (0, [])
            return score, np.array(ids, np.int32)
        first_score, first_ids = self.path(rest.text, entry, rest.head)
        last_score, last_ids = self.path(rest.text[rest.head :], 0, end - rest.head)
        return first_score + rest.middle + last_score, np.concatenate([np.array(first_ids, np.int32), rest.ids, np.array(last_ids, np.int32)])


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b where NEVER stays NEVER."""
    return np.where((a <= NEVER) | (b <= NEVER), NEVER, a + b)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: transfer of two neighbouring pieces of text. It is associative."""
    return plus(a[:, :, None], b[None, :, :]).max(axis=1)


def trace(matrices: list[np.ndarray], entry: int, over: int) -> list[int]:
    """States at the boundaries of neighbouring pieces on the best way from ``entry`` to ``over``, both included."""
    size = matrices[0].shape[0]
    v = np.full(size, NEVER, np.int64)
    v[entry] = 0
    steps = []
    for m in matrices:
        all_ = plus(v[:, None], m)
        steps.append(all_.argmax(axis=0))
        v = all_.max(axis=0)
    states = [over]
    for step in reversed(steps):
        states.append(int(step[states[-1]]))
    return states[::-1]


def _packed(matrix: np.ndarray) -> bytes:
    return matrix.astype("<i8").tobytes()


def _matrix(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, "<i8")
    return flat.reshape(int(len(flat) ** 0.5), -1)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _ids_batch(part: pa.RecordBatch, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, _lists([x[1] for x in found]), pa.array([x[0] for x in found], pa.int64())], [*part.schema.names, "ids", "score"])


_segmenters: dict[int, Segmenter] = {}


def _segmenter(shared) -> Segmenter:
    """One for each vocabulary and Python worker; tasks empty it when they end."""
    vocabulary = shared.value
    if id(vocabulary) not in _segmenters:
        _segmenters.clear()
        _segmenters[id(vocabulary)] = Segmenter(vocabulary)
    return _segmenters[id(vocabulary)]


def _share(spark: SparkSession, vocabulary: Vocabulary | str):
    return spark.sparkContext.broadcast(load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)


def encode(docs: DataFrame, vocabulary: Vocabulary | str = MODEL, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, th (hash of the text), ids, score of every document.

    Of all ways to cut the marked text into pieces the one with the highest total score is taken, as the
    unigram model of the library does; characters without a piece go by their bytes, so decoding gives
    every text back. Null and empty texts have no ids. Rows that agree in doc_id and text get equal rows.
    Of several best ways the same one is taken in every run; which, may change with ``chunk_chars``.
    Texts of up to ``chunk_chars`` characters are cut in place, longer ones as chunks on any executor:
    first a transfer matrix for each, then a scan over the matrices in two levels, then each chunk alone.
    """
    if chunk_chars < 64:
        raise ValueError("chunks must be longer than any piece")
    spark = docs.sparkSession
    shared = _share(spark, vocabulary)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(shared)
        for batch in batches:
            for part in chunks(batch, limit=1 << 19):
                yield _ids_batch(part.drop_columns("text"), segmenter.encode_all(part.column("text").to_pylist()))
        segmenter.forget()

    out_schema = f"doc_id {kind}, th long, ids array<int>, score long"
    small = docs.where(F.length("text") <= chunk_chars).mapInArrow(freed(whole), out_schema)
    giant = docs.where(F.length("text") > chunk_chars)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = shared.value.longest - 1
        for batch in batches:
            for doc, th, x in zip(batch.column("doc_id"), batch.column("th"), batch.column("text")):
                s = x.as_py()
                for n, at in enumerate(range(0, len(s) + 1, chunk_chars)):  # places in the marked text, which has one character more
                    length = min(chunk_chars, len(s) + 1 - at)
                    columns = [pa.array([doc.as_py()], batch.schema.field("doc_id").type), pa.array([th.as_py()], pa.int64()), pa.array([n], pa.int32())]
                    columns += [pa.array([length], pa.int32()), pa.array([s[max(at - 1, 0) : at - 1 + length + over]], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n", "length", "part"])

    parts = giant.mapInArrow(freed(cut), f"doc_id {kind}, th long, n int, length int, part string")
    parts = parts.dropDuplicates(["doc_id", "th", "n"])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = segmenter.transfers([(marked(s, n == 0), length) for s, length, n in zip(*(part.column(c).to_pylist() for c in ("part", "length", "n")))])
                kinds = {"text": pa.binary(), "length": pa.int32(), "head": pa.int32(), "middle": pa.int64()}
                rest = [pa.array([x.text.encode("utf-8", "surrogatepass") if c == "text" else getattr(x, c) for _, x in found], kind) for c, kind in kinds.items()]
                matrix = pa.array([_packed(m) for m, _ in found], pa.binary())
                arrays = [part.column(0), part.column(1), part.column(2), matrix, *rest, _lists([x.ids for _, x in found])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "n", "matrix", *kinds, "ids"])
        segmenter.forget()

    rest_schema = f"doc_id {kind}, th long, n int, matrix binary, text binary, length int, head int, middle long, ids array<int>"
    parts = stage(parts.mapInArrow(freed(transfers), rest_schema), "pieces_chunks")
    matrices = parts.select("doc_id", "th", "n", "matrix")
    block = F.floor(F.col("n") / BLOCK_CHUNKS).cast("int").alias("block")
    row = F.sort_array(F.collect_list(F.struct("n", "matrix"))).alias("row")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chain in batch.column("row").to_pylist():
                total = _matrix(chain[0]["matrix"])
                for x in chain[1:]:
                    total = combine(total, _matrix(x["matrix"]))
                out.append(_packed(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "th", "n", "matrix"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, th, entry, over, chain = (batch.column(c)[i].as_py() for c in ("doc_id", "th", "entry", "over", "row"))
                at = trace([_matrix(x["matrix"]) for x in chain], entry, over)
                columns = [pa.array([doc] * len(chain), batch.schema.field("doc_id").type), pa.array([th] * len(chain), pa.int64()), pa.array([x["n"] for x in chain], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:-1], pa.int32()), pa.array(at[1:], pa.int32())], ["doc_id", "th", "n", "entry", "over"])

    state_schema = f"doc_id {kind}, th long, n int, entry int, over int"
    blocks = matrices.groupBy("doc_id", "th", block).agg(row)
    summed = blocks.mapInArrow(freed(products), f"doc_id {kind}, th long, n int, matrix binary")
    ends = summed.groupBy("doc_id", "th").agg(row).withColumn("entry", F.lit(0)).withColumn("over", F.lit(0)).mapInArrow(freed(states), state_schema)
    ends = ends.withColumnRenamed("n", "block")
    inside = blocks.join(ends, same_document(blocks, ends) & (blocks["block"] == ends["block"])).select(blocks["doc_id"], blocks["th"], "row", "entry", "over")
    found = inside.mapInArrow(freed(states), state_schema)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                ids = [x.values.to_numpy() for x in part.column("ids")]
                rows = zip(*(part.column(c).to_pylist() for c in ("text", "length", "head", "middle")), ids, *(part.column(c).to_pylist() for c in ("entry", "over")))
                found = [segmenter.backtrace(Rest(text.decode("utf-8", "surrogatepass"), *rest), entry, over) for text, *rest, entry, over in rows]
                yield _ids_batch(part.select(["doc_id", "th", "n"]), found)

    chosen = parts.join(found, same_document(parts, found) & (parts["n"] == found["n"]))
    chosen = chosen.select(parts["doc_id"], parts["th"], parts["n"], "text", "length", "head", "middle", "ids", "entry", "over")
    pieces = chosen.mapInArrow(freed(back), f"doc_id {kind}, th long, n int, ids array<int>, score long")
    joined = pieces.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("all"), F.sum("score").alias("score"))
    joined = joined.select("doc_id", "th", F.flatten(F.col("all.ids")).alias("ids"), "score")
    keys = giant.select("doc_id", "th")
    large = keys.join(joined, same_document(keys, joined)).select(keys["doc_id"], keys["th"], "ids", "score")
    return small.unionByName(large)


def decode(encoded: DataFrame, vocabulary: Vocabulary | str = MODEL) -> DataFrame:
    """The columns of ``encoded`` and ``text`` (replaced if there is one), the text its ids stand for. Null ids give null; control ids stand for nothing."""
    shared = _share(encoded.sparkSession, vocabulary)
    encoded = encoded.drop("text")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [x or b"" for x in shared.value.texts]
        size = np.array([len(x) for x in known], np.int64)
        raw, first = np.frombuffer(b"".join(known), np.uint8), np.cumsum(size) - size
        for batch in batches:
            held = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + IDS_AT_ONCE, "right")))
                part, out = batch.slice(at, to - at), []
                ids = part.column("ids").flatten().to_numpy()
                n = size[ids]
                text = raw[np.repeat(first[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()
                ends = np.append(0, np.cumsum(n))[held[at:to] - (held[at - 1] if at else 0)].tolist()
                for begin, end, valid in zip([0, *ends], ends, part.column("ids").is_valid().to_pylist()):
                    out.append(text[begin:end].removeprefix(b" ").decode("utf-8", "replace") if valid else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "text"])
                at = to

    return encoded.mapInArrow(freed(texts), with_column(encoded, "text", "string"))


def round_trip(docs: DataFrame, vocabulary: Vocabulary | str = MODEL) -> DataFrame:
    """doc_id, n_tokens, score, ids, and whether decoding the ids gives the text back."""
    back = decode(encode(docs, vocabulary), vocabulary)
    return back.select("doc_id", F.size("ids").alias("n_tokens"), "score", "ids", (F.xxhash64("text") == F.col("th")).alias("round_trip"))
