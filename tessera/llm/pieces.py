"""SentencePiece encoding and decoding through a relational lattice.

A text's words (spaces go with the word after them) meet the piece table by joins:

1. Each partition's documents form chunks. A document becomes the numbers of its
   words in the chunk's own list; one pass over the texts writes a table of numbered
   documents and of (chunk, number, word) rows, in buckets by chunk.
2. Each distinct word is exploded into its substrings of at most the longest
   piece's length, these are equi-joined to the piece table (broadcast: it has a
   fixed size), and the edges are grouped by word: the word's lattice.
3. A higher-order `aggregate` folds the lattice into pieces. For unigram models that
   is Viterbi. The scores of a BPE model are the ranks of its merges and not log
   probabilities, so that Viterbi over them finds other pieces than the model; for
   BPE models the fold applies the lattice's edges as merges, best rank first, with
   the bounds of a word's pieces as the bits of one number.
4. The words' pieces go back to their chunks, packed, and documents are put together.

Words repeat, so steps 2 and 3 run once for each word of the corpus, and what is
shuffled are distinct words by chunk and their packed pieces, never a row for each
word of each document, and never the documents, which wait in their buckets.

Words of over FOLD_CHARS characters, and words with a character that no piece is,
leave the relational path: they are spelled by the same rules where pieces are packed.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: A chunk's text: what a task holds at a time, with its words and their numbers.
CHUNK_BYTES = 32_000_000
#: Rows of words that are packed together on their way back.
PACK_ROWS = 200_000
#: A word's place is its chunk and its number in the chunk's list, which has fewer than 2^26 words.
NUM_BITS = 26
#: Longer words are folded outside the JVM, by the same rules and a heap.
FOLD_CHARS = 48
SPACE = "▁"  # the character that stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class PieceModel:
    """pieces: (text, cost, id) of ordinary pieces, the least cost is best; bytes_: id of each byte, if there are such."""

    pieces: list[tuple[str, float, int]]
    surface: list[bytes]  # of each id, for decoding
    byte_ids: list[int] | None
    unknown: int
    bpe: bool
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that rewrite their input are not supported")
        kinds = [p.type for p in proto.pieces]
        pieces = [(p.piece, -float(p.score), i) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
            raise ValueError("a piece runs over the start of a word")
        surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        return cls(pieces, surface, [ids[f"<0x{b:02X}>"] for b in range(256)] if ids else None, kinds.index(UNKNOWN), proto.trainer_spec.model_type == 2, n.add_dummy_prefix)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    def cuts(self) -> np.ndarray:
        """For each pair of bytes (the first times 256 and the second): whether words part between them.

        They do where a character starts and no piece holds the pair, so that no piece
        can run over the bound; spaces stand for themselves. "word," and "word." then
        bring no words of their own.
        """
        table = np.ones(1 << 16, bool)
        table.reshape(256, 256)[:, 0x80:0xC0] = False  # within a character
        for piece, _, _ in self.pieces:
            b = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8).astype(np.int64)
            table[b[:-1] * 256 + b[1:]] = False
        return table

    def split(self, text: str | None) -> list[str]:
        return split_texts(pa.array([text or ""]), self.cuts(), self.dummy_prefix)[0].to_pylist()

    def alone(self, ch: str) -> list[int]:
        """Ids of a character that no piece is."""
        return [self.byte_ids[b] for b in ch.encode()] if self.byte_ids else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """The fold's result for one word, in plain Python: for words of any length."""
        table, w = self.table(), word.replace(" ", SPACE)
        return self._merge(w, table) if self.bpe else self._viterbi(w, table)

    def costs(self) -> list[float]:
        """Cost of each id; 0 where it is no ordinary piece."""
        by_id = {i: c for _, c, i in self.pieces}
        return [by_id.get(i, 0.0) for i in range(len(self.surface))]

    def table(self) -> dict[str, tuple[float, int]]:
        if not hasattr(self, "_table"):
            self._table = {p: (c, i) for p, c, i in self.pieces}
        return self._table

    def _merge(self, w: str, table: dict) -> list[int]:
        n, after, before, end, alive = len(w), list(range(1, len(w) + 1)), list(range(-1, len(w) - 1)), list(range(1, len(w) + 1)), [True] * len(w)
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (hit := table.get(w[i : end[j]])):
                heapq.heappush(heap, (hit[0], i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                hit = table.get(w[i : end[i]])
                out += [hit[1]] if hit else self.alone(w[i : end[i]])
        return out

    def _viterbi(self, w: str, table: dict) -> list[int]:
        worst = max(c for c, _ in table.values()) + UNKNOWN_COST
        best: list[tuple[float, int, int]] = [(0.0, -1, -1)]
        for e in range(1, len(w) + 1):
            options = [(best[s][0] + hit[0], s, hit[1]) for s in range(max(0, e - self.longest), e) if (hit := table.get(w[s:e]))]
            if w[e - 1] not in table:
                options.append((best[e - 1][0] + worst, e - 1, -1))
            best.append(min(options, key=lambda x: (x[0], x[1])))
        out, e = [], len(w)
        while e:
            _, s, i = best[e]
            out.append([i] if i >= 0 else self.alone(w[s:e]))
            e = s
        return list(chain.from_iterable(out[::-1]))

    def decode(self, ids: list[int]) -> str:
        return bytes(self.decoded(np.asarray(ids, np.int32))).decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray) -> pa.Buffer:
        """The bytes of the ids' text."""
        if not len(ids):
            return pa.py_buffer(b"")
        if not hasattr(self, "_surface"):
            self._surface = pa.array(self.surface, pa.large_binary())
        text = self._surface.take(pa.array(ids)).buffers()[2]
        return text.slice(1) if self.dummy_prefix and text.size and text[0] == 32 else text


#: Over the worst piece's cost: what a character without a piece costs in Viterbi.
UNKNOWN_COST = 10.0


#: An edge in one number: rank of its piece's cost, start, end, id; it sorts by cost and then by start.
ID_BITS, PLACE_BITS = 20, 6
E_AT, S_AT, RANK_AT = ID_BITS, ID_BITS + PLACE_BITS, ID_BITS + 2 * PLACE_BITS


def _places(edge: Column) -> tuple[Column, Column]:
    """(start, end) of an edge."""
    mask = F.lit((1 << PLACE_BITS) - 1).cast("long")
    return F.shiftright(edge, S_AT).bitwiseAND(mask).cast("int"), F.shiftright(edge, E_AT).bitwiseAND(mask).cast("int")


def lattices(words: DataFrame, model: PieceModel) -> DataFrame:
    """(word, edges) for rows of distinct `word`; s and e count characters from 0. Words of over FOLD_CHARS characters have no spans, and so no row.

    The exchange that made the words distinct is the only one: a word is joined to
    the spans of its length and each substring to its piece, both of fixed size and
    broadcast, which keeps each word's rows together. For BPE models only edges that
    merge are listed, of two characters and more; words without any have no row.
    """
    import pandas as pd  # only where it is used: workers that just split words do without

    spark = words.sparkSession
    ranks = {c: i for i, c in enumerate(sorted({c for _, c, _ in model.pieces}))}
    table = pd.DataFrame([(p, ranks[c] << RANK_AT | i) for p, c, i in model.pieces], columns=["piece", "code"])
    pieces = F.broadcast(spark.createDataFrame(table, "piece string, code long"))  # a row for each piece of the model
    longest, least = model.longest, 2 if model.bpe else 1
    spans = pd.DataFrame([(n, s, e) for n in range(1, FOLD_CHARS + 1) for s in range(n) for e in range(s + least, min(n, s + longest) + 1)], columns=["n", "s", "e"])
    spans = F.broadcast(spark.createDataFrame(spans, "n int, s int, e int"))  # at most FOLD_CHARS^2 * longest rows
    rows = words.select("word", F.translate("word", " ", SPACE).alias("w"), F.length("word").alias("n")).join(spans, "n")
    rows = rows.select("word", "s", "e", F.expr("substring(w, s + 1, e - s)").alias("piece")).join(pieces, "piece")
    edge = F.col("code") + F.shiftleft(F.col("s").cast("long"), S_AT) + F.shiftleft(F.col("e").cast("long"), E_AT)
    return rows.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def follows(ends: Column, s: Column, e: Column) -> Column:
    """Whether s is one of the ends and e the one after it; null counts as no."""
    at = F.array_position(ends, s).cast("int")
    return (F.get(ends, at) == e) & (at > 0)


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _merged(lattice: DataFrame, model: PieceModel) -> DataFrame:
    """The fold for BPE models: bounds between pieces are the bits of a number, and a merge clears the one within it."""
    n, ids_mask, three = F.length("word"), F.lit((1 << ID_BITS) - 1), F.lit(3).cast("long")
    # ids of single characters by code point; 0: no piece
    single = {ord(" " if p == SPACE else p): i for p, _, i in model.pieces if len(p) == 1 and ord(p) <= 0xFFFF}
    alone = F.split(F.lit(",".join(str(single.get(c, 0)) for c in range(max(single, default=0) + 1))), ",").cast("array<int>")  # folded to a constant

    def edge(x: Column) -> Column:
        s, e = _places(x)
        placed = F.shiftleft(s, ID_BITS).bitwiseOR(x.bitwiseAND(ids_mask.cast("long")).cast("int"))
        return F.struct(placed.alias("placed"), (_bit(s) + _bit(e)).alias("ends"), (_bit(e) - _bit(s + 1)).alias("inner"))

    def pieces(edges: Column) -> Column:
        # an edge merges two neighbours if its ends are bounds with one bound between; the best such edge goes first
        def step(bounds: Column, _: Column) -> Column:
            fits = lambda x: (bounds.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(bounds.bitwiseAND(x["inner"])) == 1)
            best = F.get(F.filter(edges, fits), F.lit(0))
            return F.coalesce(bounds.bitwiseAND(F.bitwise_not(best["inner"])), bounds)

        def listed(bounds: Column) -> Column:
            merged = F.filter(edges, lambda x: (bounds.bitwiseAND(x["ends"]) == x["ends"]) & (bounds.bitwiseAND(x["inner"]) == 0))
            left = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftrightunsigned", bounds, i).bitwiseAND(three) == three)
            id_of = lambda i: F.coalesce(F.get(alone, F.ascii(F.substring("word", i + 1, F.lit(1)))), F.lit(0))
            placed = F.sort_array(F.concat(F.transform(merged, lambda x: x["placed"]), F.transform(left, lambda i: F.shiftleft(i, ID_BITS).bitwiseOR(id_of(i)))))
            return let(F.transform(placed, lambda x: x.bitwiseAND(ids_mask)), lambda ids: F.when(~F.array_contains(ids, F.lit(0)), ids))

        rounds = F.slice(F.sequence(F.lit(0), n), F.lit(1), F.least(n - 1, F.size(edges)))
        return let(F.aggregate(rounds, _bit(n + 1) - 1, step), listed)

    return lattice.select("word", let(F.transform("edges", edge), pieces).alias("ids"))


def fold(lattice: DataFrame, model: PieceModel) -> DataFrame:
    """(word, ids) from (word, edges); ids are null if a character of the word has no piece."""
    if model.bpe:
        return _merged(lattice, model)
    n = F.length("word")
    ends_of = F.transform("edges", lambda x: F.struct(_places(x)[0].alias("s"), _places(x)[1].alias("e"), x.bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long")).cast("int").alias("id")))
    costs = F.split(F.lit(",".join(str(c) for c in model.costs())), ",").cast("array<double>")
    # best: for each place the least cost to reach it, and the start of the piece that ends there
    place = lambda cost, s: F.struct(cost.alias("cost"), s.alias("s"))
    never = place(F.lit(float("inf")), F.lit(-1))

    def cover(edges: Column) -> Column:
        def reach(best: Column, e: Column) -> Column:
            into = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: place(F.element_at(best, x["s"] + 1)["cost"] + F.element_at(costs, x["id"] + 1), x["s"]))
            return F.concat(best, F.array(F.coalesce(F.array_min(into), never)))

        def traced(best: Column) -> Column:
            back = lambda path, _: F.when(path[0] > 0, F.concat(F.array(F.element_at(best, path[0] + 1)["s"]), path)).otherwise(path)
            return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)

        return let(F.aggregate(F.sequence(F.lit(1), n), F.array(place(F.lit(0.0), F.lit(0))), reach), traced)

    def chosen(edges: Column) -> Column:
        taken = let(cover(edges), lambda b: F.filter(edges, lambda x: follows(b, x["s"], x["e"])))
        whole = lambda p: F.aggregate(p, F.lit(0), lambda t, x: t + x["e"] - x["s"]) == n
        return let(F.sort_array(taken), lambda p: F.when(whole(p), F.transform(p, lambda x: x["id"])))

    return lattice.select("word", let(ends_of, chosen).alias("ids"))


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """(word, ids) for rows of `word` without repeats; words of over FOLD_CHARS characters and those without any edge are left out."""
    return fold(lattices(words, model), model)


def split_texts(texts: pa.Array, cuts: np.ndarray, prefix: bool) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts one after the other, the number of words of each text); joined, a text's words give the text."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, SPACE)).as_py():
        texts = pc.replace_substring(texts, SPACE, " ")
    if prefix:
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
    data = texts.buffers()[2].slice(first, last - first) if last > first else pa.py_buffer(b"")
    raw = np.frombuffer(data, np.uint8)
    part, step = np.zeros(len(raw) + 1, bool), 1 << 20
    part[bounds - first] = True
    for lo in range(1, len(raw), step):  # in blocks: the pairs take no more than a few MB
        hi = min(lo + step, len(raw))
        part[lo:hi] |= cuts[raw[lo - 1 : hi - 1].astype(np.uint16) << 8 | raw[lo:hi]]
    starts = np.flatnonzero(part[:-1])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), data)
    return words, np.diff(np.searchsorted(starts, bounds - first))


def _chunks(batches: Iterator[pa.RecordBatch], cuts: np.ndarray, prefix: bool, limit: int) -> Iterator[tuple[int, list, list, np.ndarray, np.ndarray, pa.Array]]:
    """(chunk, ids, checks of the texts, words of each document, numbers of all words, the chunk's distinct words by number)."""
    part, k = TaskContext.get().partitionId(), 0
    ids, marks, counts, words, total = [], [], [], [], 0

    def chunk():
        coded = pa.chunked_array(words).dictionary_encode()
        coded = coded.combine_chunks() if coded.num_chunks else words[0].dictionary_encode()  # a chunk of empty texts has no words
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        return (part << 12) + k, ids, marks, np.concatenate(counts), coded.indices.to_numpy(), coded.dictionary

    for b in batches:
        sizes, lo = np.asarray([len(t) if t is not None else 0 for t in map(pa.StringScalar.as_buffer, b.column("text"))]), 0
        while lo < b.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), limit - total, "left")) + 1)
            texts = b.column("text").slice(lo, hi - lo)
            ids += b.column("doc_id").slice(lo, hi - lo).to_pylist()
            marks += [zlib.crc32(t.as_buffer() or b"") for t in texts]
            w, n = split_texts(texts, cuts, prefix)
            words.append(w)
            counts.append(n)
            total += int(sizes[lo:hi].sum())
            if total >= limit:
                yield chunk()
                ids, marks, counts, words, total, k = [], [], [], [], 0, k + 1
            lo = hi
    if ids:
        yield chunk()
    ids, marks, counts, words = [], [], [], []
    pa.default_memory_pool().release_unused()  # a worker waits for its next task beside the executor's heap


def _pack(a: np.ndarray) -> bytes:
    """Numbers below 2^32, byte plane by byte plane, compressed."""
    return len(a).to_bytes(4, "little") + (pa.compress(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(a) else b"")


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.frombuffer(pa.decompress(blob[4:], 4 * n, "zstd"), np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel() if n else np.empty(0, np.uint32)


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) for every row.

    ids: array<int>; round_trip: whether decoding gives the text back (it does not
    only for texts that hold the character ▁ itself). Null and empty texts: no
    pieces, true. Rows that repeat keep a row each; ids may be null. An empty table
    gives an empty one. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    cuts, prefix = model.cuts(), model.dummy_prefix
    fields = pa.schema([("chunk", pa.int64()), ("num", pa.int32()), ("word", pa.string()), ("doc_id", id_type), ("nums", pa.binary()), ("mark", pa.int64())])

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for chunk, ids, marks, counts, nums, kinds in _chunks(batches, cuts, prefix, chunk_bytes):
            rank = np.empty(len(kinds), np.uint32)  # frequent words get the low numbers, which pack better
            rank[np.argsort(-np.bincount(nums, minlength=len(kinds)), kind="stable")] = np.arange(len(kinds))
            ends = np.cumsum(counts)
            for lo in range(0, len(ids), 256):
                hi = min(lo + 256, len(ids))
                blobs = [_pack(rank[nums[e - n : e]]) for e, n in zip(ends[lo:hi], counts[lo:hi], strict=True)]
                yield batch(hi - lo, chunk=pa.array(np.full(hi - lo, chunk)), doc_id=pa.array(ids[lo:hi], id_type), nums=pa.array(blobs, pa.binary()), mark=pa.array(marks[lo:hi], pa.int64()))
            order = pc.sort_indices(kinds)
            kinds, rank = kinds.take(order), rank[order.to_numpy()]
            for lo in range(0, len(kinds), 50_000):
                part = kinds.slice(lo, 50_000)
                yield batch(len(part), chunk=pa.array(np.full(len(part), chunk)), num=pa.array(rank[lo : lo + 50_000].astype(np.int32)), word=part)

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _bucketed(rows.mapInArrow(numbered, f"chunk long, num int, word string, doc_id {kind}, nums binary, mark long"), "chunk", parts)
    # the number is given, as the rows of an exchange are small beside the work on a word
    place = F.shiftleft("chunk", NUM_BITS) + F.col("num")
    # this and the join below read one exchange: both ask for both columns, and for the filter that the lattice's join brings
    dealt = table.filter("word is not null and length(word) is not null").select(place.alias("place"), "word").repartition(parts, "word")
    kinds = dealt.groupBy("word").agg(F.max("place").alias("last")).filter("last is not null").select("word")
    coded = encode_words(kinds, model).select(F.col("word").alias("coded"), "ids")
    joined = dealt.join(coded, F.col("word") == F.col("coded"), "left").select("place", "ids", F.when(F.col("ids").isNull(), F.col("word")).alias("rest"))
    shared = spark.sparkContext.broadcast(model)
    back = joined.mapInArrow(lambda batches: _packed(batches, shared.value), "chunk long, packed binary")
    schema = pa.schema([("doc_id", id_type), ("n_pieces", pa.int32()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, flat = _unpacked(right.column("packed").to_pylist())
        starts = np.concatenate(([0], np.cumsum(sizes)))
        lengths, ids, same = [], [], []
        for blob, mark in zip(left.column("nums").to_pylist(), left.column("mark").to_pylist(), strict=True):
            nums = _unpack(blob)
            n = sizes[nums]
            own = flat[np.repeat(starts[nums] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(nums) else flat[:0]
            ids.append(own)
            lengths.append(len(own))
            same.append(zlib.crc32(shared.value.decoded(own)) == mark)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
        return pa.table([left.column("doc_id"), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(same, pa.bool_())], schema=schema)

    texts = table.filter("nums is not null").select("chunk", "doc_id", "nums", "mark")
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(put, f"doc_id {kind}, n_pieces int, ids array<int>, round_trip boolean")


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """`df` as a table in the shared checkpoint folder, in buckets by `key`: what needs a key's rows together reads them so, without an exchange.

    The name in the catalog is only needed to write; the files stay, as those of a checkpoint do.
    """
    spark, name = df.sparkSession, f"pieces_{uuid.uuid4().hex}"
    path = f"{common.checkpoint_folder(spark)}/tables/{name}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _packed(batches: Iterator[pa.RecordBatch], model: PieceModel) -> Iterator[pa.RecordBatch]:
    """(place, ids, rest) -> (chunk, packed): numbers, sizes and ids of a chunk's words among PACK_ROWS rows, compressed.

    rest: a word that the fold left (over FOLD_CHARS, without any edge, or with a
    character that has no piece); it is spelled here by the same rules.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        place, sizes, flat = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        starts, order = np.cumsum(sizes) - sizes, np.argsort(place)
        place, sizes, starts = place[order], sizes[order], starts[order]
        flat = flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))]
        chunk, num = place >> NUM_BITS, place & (1 << NUM_BITS) - 1
        bounds, ends = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)])), np.concatenate(([0], np.cumsum(sizes)))
        blobs = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            ids = flat[ends[lo] : ends[hi]]
            blobs.append(_pack(np.concatenate(([hi - lo, len(ids)], np.diff(num[lo:hi], prepend=0), sizes[lo:hi], ids))))
        return pa.RecordBatch.from_arrays([pa.array(chunk[bounds[:-1]]), pa.array(blobs, pa.binary())], names=["chunk", "packed"])

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(1)
        if ids.null_count:
            rest = b.column(2).to_pylist()
            ids = pa.array([x if w is None else model.encode_word(w) for x, w in zip(ids.to_pylist(), rest, strict=True)], pa.list_(pa.int32()))
        # copies: the batch's own memory goes back
        held.append((b.column(0).to_numpy().copy(), ids.value_lengths().to_numpy().astype(np.int64), ids.flatten().to_numpy().astype(np.int32)))
        rows += b.num_rows
        if rows >= PACK_ROWS:
            yield flush()
            rows = 0
    if held:
        yield flush()


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes by number, ids in that order) of a whole chunk."""
    nums, sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for a in map(_unpack, blobs):
        n, m = int(a[0]), int(a[1])
        nums.append(np.cumsum(a[2 : 2 + n].astype(np.int64)))
        sizes.append(a[2 + n : 2 + 2 * n].astype(np.int64))
        ids.append(a[2 + 2 * n : 2 + 2 * n + m].astype(np.int32))
    num, size, flat = np.concatenate(nums), np.concatenate(sizes), np.concatenate(ids)
    starts, order = np.cumsum(size) - size, np.argsort(num, kind="stable")
    size, starts = size[order], starts[order]
    return size, flat[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(flat))]


def decode(encoded: DataFrame, model: PieceModel, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """`encoded` with the text of its ids, as `out_col` (JVM only); null ids: null. Bytes that are no UTF-8 become U+FFFD."""
    surface = F.split(F.lit(",".join(s.hex() for s in model.surface)), ",")  # folded to a constant
    text = F.decode(F.unhex(F.array_join(F.transform(ids_col, lambda i: F.element_at(surface, i + 1)), "")), "UTF-8")
    if model.dummy_prefix:  # one space that encoding put first
        text = F.regexp_replace(text, r"^ ", "")
    return encoded.withColumn(out_col, F.when(F.col(ids_col).isNotNull(), text))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), PieceModel.load(default_model()))
