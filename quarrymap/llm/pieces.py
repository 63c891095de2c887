"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

A byte-pair segmentation is the only one of a text in which every two
neighbouring pieces are what the pair alone is encoded to (and every piece
encodes to itself). So a text's encoding is its best path when a step from
piece to piece weighs 0 if the pair is compatible and minus infinity if not, and
the path can be found chunk by chunk. A state at a chunk border is the piece
that reaches up to or over it and the number of characters it goes beyond. Each
chunk yields, on its own, the transfer matrix from entry states to exit states;
matrices combine associatively under (max, +); the scan fixes one state at each
border; and each chunk backtraces its pieces between its two states, on its
own. The scan has two levels: ``SEGMENT`` chunks are combined to one matrix, the
segments of a text give the states at their borders, and each segment is scanned
between its own, so no task has more than a segment's matrices or a text's
segments. At the start of a word all states of a chunk meet (no piece crosses
it), so only the broken words at the chunk's ends need the states.

Texts up to ``chunk`` characters are one chunk with one state at either end, and
are encoded directly.

Defined results: a null or empty text has one row with no ids; repeated rows are
encoded each; ids and texts equal the public library's; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_columns, release, sliced, stage
from .tokens import PieceBpe, piece_bpe, tokenizer_file

CHUNK, AROUND, SEGMENT = 16384, 64, 256
#: A border state: the piece's text and how far it goes over the border. The start of a word is ("", 0).
State = tuple[str, int]
FREE: State = ("", 0)
_NONE = float("-inf")


class Segmenter:
    """Pieces of text as steps from state to state."""

    def __init__(self, bpe: PieceBpe):
        self.bpe, self.pairs, self.alone = bpe, {}, {}

    def merged(self, text: str) -> tuple[str, ...]:
        """The pieces of a short text, by best merge first (leftmost of equals)."""
        parts, scores, ids = list(text), self.bpe.score, self.bpe.id_of
        while len(parts) > 1:
            best, at = _NONE, -1
            for i in range(len(parts) - 1):
                piece = ids.get((parts[i] + parts[i + 1]).replace(" ", "▁"))
                if piece is not None and scores[piece] > best:
                    best, at = scores[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def stands(self, piece: str) -> bool:
        known = self.alone.get(piece)
        if known is None:
            known = len(piece) == 1 or (piece.replace(" ", "▁") in self.bpe.id_of and self.merged(piece) == (piece,))
            if len(self.alone) < 200_000:
                self.alone[piece] = known
        return known

    def follows(self, a: str, b: str) -> bool:
        """Whether ``b`` may come right after ``a``: 0 or minus infinity in the matrix."""
        if not a:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merged(a + b) == (a, b)
            if len(self.pairs) < 500_000:
                self.pairs[a, b] = known
        return known

    def steps(self, text: str, at: int) -> list[str]:
        """Pieces of ``text`` that start at ``at``."""
        return [text[at : at + n] for n in range(1, min(self.bpe.longest, len(text) - at) + 1) if self.stands(text[at : at + n])]


def word_start(text: str, at: int) -> bool:
    """Whether a word starts here: a space that none precedes."""
    return text[at] == " " and (at == 0 or text[at - 1] != " ")


class ChunkPaths:
    """The paths through ``text[begin:end]``, of which ``text`` shows the surroundings."""

    def __init__(self, seg: Segmenter, text: str, begin: int, end: int, first: bool, last: bool):
        self.seg, self.text, self.begin, self.end, self.first, self.last = seg, text, begin, end, first, last
        starts = [i for i in range(begin, end) if text[i] == " " and word_start(text, i)]
        self.meet, self.part = (starts[0], starts[-1]) if starts else (None, None)
        #: Nothing goes over the chunk's end: the text ends there, or a word starts.
        self.closed = last or word_start(text, end)

    def entries(self) -> list[State]:
        """Every state in which the border before the chunk can be."""
        if self.first or (self.begin == self.meet):
            return [FREE]
        out = []
        for at in range(max(0, self.begin - self.seg.bpe.longest), self.begin):
            out += [(p, at + len(p) - self.begin) for p in self.seg.steps(self.text, at) if at + len(p) >= self.begin and " " not in p.lstrip(" ")]
        return out

    def _forward(self, sources: list[tuple[int, str]], stop: int, free_stop: bool) -> dict[tuple[int, str], list[tuple[int, str] | None]]:
        """Nodes (place, piece that ends there) reached from ``sources``, with their predecessors; none goes on past ``stop``."""
        came: dict[tuple[int, str], list] = {s: [None] for s in sources}
        todo: dict[int, list[tuple[int, str]]] = {}
        for s in sources:
            todo.setdefault(s[0], []).append(s)
        for at in range(min(todo, default=stop), stop):
            for node in todo.pop(at, ()):
                for piece in self.seg.steps(self.text, at):
                    to = at + len(piece)
                    if (free_stop and to > stop) or not self.seg.follows(node[1], piece):
                        continue
                    nxt = (to, piece)
                    if nxt not in came:
                        came[nxt] = []
                        todo.setdefault(to, []).append(nxt)
                    came[nxt].append(node)
        return came

    def _ends(self, came) -> list[tuple[int, str]]:
        """Nodes at or over the chunk's end that started before it."""
        return [n for n in came if n[0] >= self.end and n[0] - len(n[1]) < self.end and (not self.closed or n[0] == self.end)]

    def _exit(self, node: tuple[int, str]) -> State:
        return FREE if self.closed else (node[1], node[0] - self.end)

    def matrix(self) -> dict[tuple[State, State], float]:
        """Entry state, exit state -> 0; what isn't there is minus infinity."""
        out: dict[tuple[State, State], float] = {}
        if self.meet is None:
            for e in self.entries():
                source = (self.begin + e[1], e[0])
                for n in self._ends(self._forward([source], self.end, False)):
                    if n != source:
                        out[e, self._exit(n)] = 0.0
                if source[0] >= self.end and (not self.closed or source[0] == self.end):  # a piece over the whole chunk
                    out[e, self._exit(source)] = 0.0
            return out
        heads = [e for e in self.entries() if self._reaches(e)]
        tail = {self._exit(n) for n in self._ends(self._forward([(self.part, "")], self.end, False))}
        return {(e, x): 0.0 for e in heads for x in tail}

    def _reaches(self, e: State) -> bool:
        source = (self.begin + e[1], e[0])
        return source[0] <= self.meet and any(n[0] == self.meet for n in self._forward([source], self.meet, True))

    @staticmethod
    def _back(came, node) -> list[str]:
        """Pieces on the way to ``node``; the true way is the only one that stays compatible."""
        out = []
        while came[node] != [None]:
            out.append(node[1])
            node = next(p for p in came[node] if p is not None)
        return out[::-1]

    def backtrace(self, entry: State, exit_: State) -> list[int]:
        """Ids of the pieces that start in the chunk, between its two states."""
        source = (self.begin + entry[1], entry[0])
        if source[0] >= self.end:
            return []

        def tail(start: tuple[int, str]) -> list[str]:
            came = self._forward([start], self.end, False)
            goal = next(n for n in self._ends(came) if n != start) if self.closed else (self.end + exit_[1], exit_[0])
            return self._back(self._pruned([start], goal, self.end, False), goal)

        if self.meet is None:
            return self._ids(tail(source))
        head: list[str] = []
        if source[0] < self.meet:
            came = self._forward([source], self.meet, True)
            goals = [n for n in came if n[0] == self.meet and came[n] != [None]]
            head = self._back(self._pruned([source], goals[0], self.meet, True), goals[0])
        # whole words: the first space of each stands for the library's own leading one
        middle = self.seg.bpe.encode(self.text[self.meet + 1 : self.part]) if self.part > self.meet else b""
        return self._ids(head) + np.frombuffer(middle, "<u2").tolist() + self._ids(tail((self.part, "")))

    def _pruned(self, sources, goal, stop, free_stop):
        """The forward graph with only predecessors from which ``goal`` is reached: one each, as the path is unique."""
        came = self._forward(sources, stop, free_stop)
        keep, todo = {}, [goal]
        while todo:
            n = todo.pop()
            if n not in keep:
                keep[n] = came[n]
                todo += [p for p in came[n] if p is not None]
        return keep

    def _ids(self, pieces: list[str]) -> list[int]:
        bpe, out = self.seg.bpe, []
        for p in pieces:
            known = bpe.id_of.get(p.replace(" ", "▁"))
            out += [known] if known is not None else [bpe.byte_id[b] for b in p.encode()]
        return out


def combined(a: dict, b: dict) -> dict:
    """The (max, +) product of two transfer matrices."""
    by_entry: dict[State, list] = {}
    for (m, x), w in b.items():
        by_entry.setdefault(m, []).append((x, w))
    out: dict[tuple[State, State], float] = {}
    for (e, m), w in a.items():
        for x, v in by_entry.get(m, ()):
            out[e, x] = max(out.get((e, x), _NONE), w + v)
    return out


def border_states(matrices: list[dict], entry: State = FREE, leave: State = FREE) -> list[State]:
    """The state at every border of a stretch of chunks from ``entry`` to ``leave``: a scan of products from either side."""
    n = len(matrices)

    def scan(ms: list[dict]) -> list[dict]:  # prefixes, by halves
        if len(ms) == 1:
            return ms
        half = len(ms) // 2
        left, right = scan(ms[:half]), scan(ms[half:])
        return left + [combined(left[-1], r) for r in right]

    before = [{(entry, entry): 0.0}, *scan(matrices)]
    flipped = [{(x, e): w for (e, x), w in m.items()} for m in reversed(matrices)]
    after = [*reversed(scan(flipped)), {(leave, leave): 0.0}]
    out = []
    for i in range(n + 1):
        reached = {x for e, x in before[i] if e == entry}
        alive = {x for e, x in after[i] if e == leave}
        out.append(next(iter(sorted(reached & alive))))
    return out


# --- documents --------------------------------------------------------------

_PART = "row bigint, chunk int, chunks int, text string, begin int, finish int"


def _split(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """A giant text in chunks, each with what stands around it; the text starts with the encoder's own space."""
    for batch in sliced(batches, 8):
        for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
            text = " " + text.replace("▁", " ")
            n = -(-len(text) // chunk)
            for i in range(n):
                low = max(0, i * chunk - AROUND)
                part = text[low : (i + 1) * chunk + AROUND]
                begin, end = i * chunk - low, min(len(text), (i + 1) * chunk) - low
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int64()), pa.array([doc], pa.int64()), pa.array([i], pa.int32()), pa.array([n], pa.int32()), pa.array([part]), pa.array([begin], pa.int32()), pa.array([end], pa.int32())],
                    names=["row", "doc_id", "chunk", "chunks", "text", "begin", "finish"],
                )
    release()


def _paths(seg: Segmenter, r: dict) -> ChunkPaths:
    return ChunkPaths(seg, r["text"], r["begin"], r["finish"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1)


_STATE = pa.struct([("piece", pa.string()), ("over", pa.int32())])
_STATES = "struct<piece: string, over: int>"


def _states(states: list[State]) -> pa.Array:
    return pa.array([{"piece": p, "over": o} for p, o in states], _STATE)


def _state(cell: dict) -> State:
    return cell["piece"], cell["over"]


def _cells(matrices: list[dict]) -> pa.Array:
    """Matrices as the cells that aren't minus infinity (all of them are 0)."""
    cell = lambda s: {"piece": s[0], "over": s[1]}
    return pa.array([[{"e": cell(e), "x": cell(x)} for e, x in m] for m in matrices], pa.list_(pa.struct([("e", _STATE), ("x", _STATE)])))


def _matrix(row: dict) -> dict:
    return {(_state(c["e"]), _state(c["x"])): 0.0 for c in row["matrix"]}


def _giant(giant: DataFrame, chunk: int, file: str) -> DataFrame:
    spark = giant.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = giant.mapInArrow(lambda b: _split(b, chunk), "row bigint, doc_id bigint, chunk int, chunks int, text string, begin int, finish int")
    parts = stage(split.repartition(tasks, "row", "chunk"), "chunks")

    def matrices(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        seg = Segmenter(piece_bpe(file))
        return {"matrix": _cells([_paths(seg, r).matrix() for r in batch.to_pylist()])}

    def product(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["row", "segment", "chunk", "matrix"]).to_pylist(), key=lambda r: r["chunk"])
        return pa.table({"p_row": pa.array([rows[0]["row"]], pa.int64()), "p_segment": pa.array([rows[0]["segment"]], pa.int32()), "matrix": _cells([reduce(combined, map(_matrix, rows))])})

    def outer(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["p_segment"])
        states = border_states([_matrix(r) for r in rows])
        return pa.table({"o_row": pa.array([r["p_row"] for r in rows], pa.int64()), "o_segment": pa.array([r["p_segment"] for r in rows], pa.int32()), "first": _states(states[:-1]), "last": _states(states[1:])})

    def inner(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        states = border_states([_matrix(r) for r in rows], _state(rows[0]["first"]), _state(rows[0]["last"]))
        return pa.table({"s_row": pa.array([r["row"] for r in rows], pa.int64()), "s_chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "entry": _states(states[:-1]), "leave": _states(states[1:])})

    # a text's matrices are a few states a chunk
    cells = f"matrix array<struct<e: {_STATES}, x: {_STATES}>>"
    own = map_columns(parts, matrices, ["row", "chunk", "chunks", "text", "begin", "finish"], cells)
    own = stage(own.select("row", F.floor(F.col("chunk") / SEGMENT).cast("int").alias("segment"), "chunk", "matrix"), "matrices")
    whole = own.groupBy("row", "segment").applyInArrow(product, f"p_row bigint, p_segment int, {cells}")
    borders = whole.groupBy("p_row").applyInArrow(outer, f"o_row bigint, o_segment int, first {_STATES}, last {_STATES}")
    between = own.join(borders, (F.col("row") == F.col("o_row")) & (F.col("segment") == F.col("o_segment"))).drop("o_row", "o_segment")
    states = stage(between.groupBy("row", "segment").applyInArrow(inner, f"s_row bigint, s_chunk int, entry {_STATES}, leave {_STATES}"), "states")
    forget(own)
    met = parts.join(states, (F.col("row") == F.col("s_row")) & (F.col("chunk") == F.col("s_chunk")))

    def traced(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        seg, ids, texts = Segmenter(piece_bpe(file)), [], []
        for r in batch.to_pylist():
            entry, leave = (r["entry"]["piece"], r["entry"]["over"]), (r["leave"]["piece"], r["leave"]["over"])
            ids.append(np.array(_paths(seg, r).backtrace(entry, leave), "<u2").tobytes())
            texts.append(r["text"][r["begin"] + entry[1] : r["finish"] + leave[1]])
        return {"ids": pa.array(ids, pa.binary()), "part": pa.array(texts, pa.string())}

    return map_columns(met, traced, ["doc_id", "chunk"], "ids binary, part string")


def encode(documents: DataFrame, chunk: int = CHUNK, file: str | None = None) -> DataFrame:
    """(doc_id, chunk, ids: little-endian uint16, part: the text that they stand for) of every row; texts over ``chunk`` characters in chunks.

    ``part`` is the encoder's own view of the text: with its leading space in the first chunk.
    """
    file = file or tokenizer_file("piece_bpe_32k.model")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def direct(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = piece_bpe(file)
        return {"chunk": pa.array(np.zeros(len(batch), np.int32)), "ids": pa.array([bpe.encode(t) for t in batch.column("text").to_pylist()], pa.binary())}

    small = map_columns(texts.where(F.char_length("text") <= chunk), direct, ["doc_id", "text"], "chunk int, ids binary", lambda: piece_bpe(file).cache.clear())
    small = small.select("doc_id", "chunk", "ids", F.when(F.col("text") == "", F.col("text")).otherwise(F.concat(F.lit(" "), F.translate("text", "▁", " "))).alias("part"))
    giant = stage(texts.where(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "giant")
    return small.unionByName(_giant(giant, chunk, file))


def decode(encoded: DataFrame, file: str | None = None) -> DataFrame:
    """Adds ``text``: what the ids of each chunk stand for, with the leading space of the first."""
    file = file or tokenizer_file("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = piece_bpe(file)
        raw = [b"".join(map(bpe.raw.__getitem__, np.frombuffer(b, "<u2").tolist())) for b in batch.column("ids").to_pylist()]
        return {"text": pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())}

    return map_columns(encoded, run, encoded.columns, "text string")


def _checked(bpe: PieceBpe, ids: bytes, part: str) -> tuple[int, int, bool]:
    """(tokens, checksum of the ids as 32-bit numbers, whether they stand for ``part``)."""
    numbers = np.frombuffer(ids, "<u2")
    return len(numbers), zlib.crc32(numbers.astype("<u4").tobytes()), b"".join(map(bpe.raw.__getitem__, numbers.tolist())).decode("utf-8", "replace") == part


def report(documents: DataFrame, chunk: int = CHUNK, file: str | None = None) -> DataFrame:
    """(doc_id, chunk, n_tokens, ids_crc32, round_trip) of every row and chunk: encoded and decoded in the same pass."""
    file = file or tokenizer_file("piece_bpe_32k.model")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def columns(made: list[tuple[int, int, bool]]) -> dict[str, pa.Array]:
        n, crc, same = zip(*made) if made else ((), (), ())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_())}

    def whole(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe, made = piece_bpe(file), []
        for at in range(0, len(batch), 200):
            for t in batch.column("text").slice(at, 200).to_pylist():
                made.append(_checked(bpe, bpe.encode(t), " " + t.replace("▁", " ") if t else ""))
        return {"chunk": pa.array(np.zeros(len(made), np.int32)), **columns(made)}

    def parts(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = piece_bpe(file)
        return columns([_checked(bpe, i, p) for i, p in zip(batch.column("ids").to_pylist(), batch.column("part").to_pylist())])

    kind = "n_tokens bigint, ids_crc32 bigint, round_trip boolean"
    small = map_columns(texts.where(F.char_length("text") <= chunk), whole, ["doc_id"], "chunk int, " + kind, lambda: piece_bpe(file).cache.clear())
    giant = stage(texts.where(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "giant")
    return small.unionByName(map_columns(_giant(giant, chunk, file), parts, ["doc_id", "chunk"], kind))
