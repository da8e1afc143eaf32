"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Compiled from a model: the normaliser (each character's replacement, here the space's, and the prefix), a
trie of all pieces (states by (state, character) pairs, piece ids at final states) and, for characters
without a piece, arcs to their UTF-8 bytes' ids. Composing it with an input gives a lattice whose arcs are
pieces; the ids are the labels of the shortest path in the tropical semiring.

Weights: a unigram model's arcs weigh minus the piece's score. A BPE model's scores are merge priorities,
no weights of a path, so its arcs weigh 0 and are composed with an acceptor of pairs of pieces: two pieces
may follow each other, at weight 0, if merging their joined text gives just these two, and not, at weight
infinity, otherwise. Exactly one path has a finite weight, and it is what the merges give: up to the first
merge across a piece's end the merges on either side run as they do in the pair alone. The acceptor is
compiled pair by pair as the pairs come up.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .base import documents, table, trimmed
from .piececache import PieceCache
from .textarrays import chunks, slices

_SPACE = "▁"
#: Characters of texts, and of new pieces, that are handled at a time; each text and each piece whole.
TEXT_CHARS, LEARNT_CHARS = 500_000, 100_000


class _Lookup:
    """Integers by integer keys, in a sorted array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for unknown keys."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.__init__(np.concatenate((self.keys, keys)), np.concatenate((self.values, values)))


class Transducer(PieceCache):
    """A compiled SentencePiece model; called with texts it gives their ids, ``decode`` gives the texts back."""

    def __init__(self, path: str):
        super().__init__(np.int32)
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser is compiled")
        kinds = type(model.pieces[0])
        self.bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
        self.prefix = " " if spec.add_dummy_prefix else ""
        pieces = [x.piece for x in model.pieces]
        self.size = len(pieces)
        normal = [i for i, x in enumerate(model.pieces) if x.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.scores = np.array([x.score for x in model.pieces] + [min((model.pieces[i].score for i in normal), default=0.0) - 10.0])
        self.bytes_ids = np.full(256, model.trainer_spec.unk_id, np.int32)
        for i, x in enumerate(model.pieces):
            if x.type == kinds.BYTE:
                self.bytes_ids[int(x.piece[3:5], 16)] = i
        self._compile([pieces[i] for i in normal], normal)
        self._outputs(model, kinds)
        self.allowed = _Lookup(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _compile(self, texts: list[str], ids: list[int]) -> None:
        """The trie, the merges and the cutting rule."""
        by_text = dict(zip(texts, ids, strict=True))
        self.longest = max(map(len, texts), default=1)
        chars = sorted({c for x in texts for c in x})
        self.code = np.zeros(0x110000, np.int32)  # of each character in a piece, from 1
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.code[ord(" ")] = self.code[ord(_SPACE)]
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.n_codes = len(chars) + 1
        states: dict[tuple[int, int], int] = {}
        final = {}
        for text, i in by_text.items():
            state = 0
            for c in text:
                state = states.setdefault((state, number[c]), len(states) + 1)
            final[state] = i
        self.step = _Lookup(np.array([s * self.n_codes + c for s, c in states], np.int64), np.array(list(states.values()), np.int64))
        self.final = np.full(len(states) + 1, -1, np.int64)
        self.final[list(final)] = list(final.values())
        merges = [(by_text[x[:k]], by_text[x[k:]], i) for x, i in by_text.items() for k in range(1, len(x)) if x[:k] in by_text and x[k:] in by_text]
        left, right, joined = (np.array(x, np.int64) for x in zip(*merges, strict=True)) if merges else (np.zeros(0, np.int64),) * 3
        self.merge = _Lookup(left * self.size + right, joined)
        self.single = np.full(self.n_codes, -1, np.int64)  # the piece of a character by its code
        for c in chars:
            self.single[number[c]] = by_text.get(c, -1)
        # The characters of each piece as single-character pieces, for the merges of a pair.
        self.spelling = np.full((self.size, self.longest), -1, np.int64)
        self.length = np.zeros(self.size + 1, np.int64)
        for x, i in by_text.items():
            own = [by_text.get(c, -1) for c in x]
            self.spelling[i, : len(own)] = own
            self.length[i] = len(own)
        # Where no piece can lie across, a text may be cut.
        self.inner_space = any(_SPACE in x.lstrip(_SPACE) for x in texts)

    def _outputs(self, model, kinds) -> None:
        """Each id's bytes when decoded."""
        out = []
        for x in model.pieces:
            if x.type == kinds.BYTE:
                out.append(bytes([int(x.piece[3:5], 16)]))
            elif x.type == kinds.CONTROL:
                out.append(b"")
            elif x.type == kinds.UNKNOWN:
                out.append(model.trainer_spec.unk_surface.encode())
            else:
                out.append(x.piece.replace(_SPACE, " ").encode())
        self.out_at = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Before the first of a run of spaces, and on both sides of a character that is in no piece."""
        code = self.code[points]
        cut = code == 0
        cut[1:] |= code[:-1] == 0
        if not self.inner_space:
            space = code == self.code[ord(" ")]
            space[1:] &= ~space[:-1]
            cut |= space
        return cut

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        return super().__call__([self.prefix + x if x else "" for x in texts])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges of the joined text of two pieces give just these two."""
        width = 2 * self.longest
        n = len(left)
        joined = np.full((n, width), -1, np.int64)
        joined[:, : self.longest] = self.spelling[left]
        rows = np.arange(n)
        for k in range(self.longest):
            has = self.spelling[right, k] >= 0
            joined[rows[has], (self.length[left] + k)[has]] = self.spelling[right, k][has]
        size = self.length[left] + self.length[right]

        def priority(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = np.where((a >= 0) & (b >= 0), self.merge(a * self.size + b), -1)
            return np.where(found >= 0, self.scores[found], -np.inf), found

        score = np.full((n, width), -np.inf)
        made = np.full((n, width), -1, np.int64)
        for k in range(int(size.max(initial=1)) - 1):
            score[:, k], made[:, k] = priority(joined[:, k], joined[:, k + 1])
        todo = rows
        columns = np.arange(width)
        while len(todo):
            best = score[todo].argmax(1)  # the leftmost of equals
            can = score[todo, best] > -np.inf
            todo, best = todo[can], best[can]
            if not len(todo):
                break
            joined[todo, best] = made[todo, best]
            shift = np.minimum(columns + (columns > best[:, None]), width - 1)
            joined[todo] = np.take_along_axis(joined[todo], shift, 1)
            joined[todo, -1] = -1
            shift = np.minimum(columns + (columns >= best[:, None]), width - 1)
            score[todo] = np.take_along_axis(score[todo], shift, 1)
            made[todo] = np.take_along_axis(made[todo], shift, 1)
            score[todo, -1] = -np.inf
            for at in (best - 1, best):
                has = at >= 0
                rows_, at_ = todo[has], at[has]
                score[rows_, at_], made[rows_, at_] = priority(joined[rows_, at_], joined[rows_, np.minimum(at_ + 1, width - 1)])
        return (joined[:, 0] == left) & (joined[:, 1] == right) & (joined[:, 2] < 0)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The acceptor of pairs; characters without a piece (id ``size``) and the start (-1) go with everything."""
        free = (left < 0) | (left >= self.size) | (right >= self.size)
        key = np.where(free, 0, left * self.size + right)
        found = self.allowed(key)
        new = np.unique(key[(found < 0) & ~free])
        if len(new):
            good = np.concatenate([self._pairs(x // self.size, x % self.size) for x in np.array_split(new, len(new) // 5_000 + 1)])
            self.allowed.add(new, good.astype(np.int64))
            found = self.allowed(key)
        return free | (found > 0)

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, of LEARNT_CHARS characters at a time: a lattice takes some hundred bytes for each."""
        parts = [self._shortest(pieces[a:b]) for a, b in chunks(pieces, LEARNT_CHARS)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    def _shortest(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Composes the transducer with many inputs at once and takes each one's shortest path."""
        if len(self.allowed.keys) > 500_000:
            self.allowed = _Lookup(np.zeros(0, np.int64), np.zeros(0, np.int64))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        unit = np.repeat(np.arange(len(pieces)), sizes)
        end_of = starts[1:][unit]
        # The lattice: arcs (first, end, piece) between character positions; a unit's positions are its own plus its number.
        alive, state = np.arange(len(points)), np.zeros(len(points), np.int64)
        arcs = []
        for depth in range(self.longest):
            inside = alive + depth < end_of[alive]
            alive, state = alive[inside], state[inside]
            state = self.step(state * self.n_codes + code[alive + depth])
            on = state >= 0
            alive, state = alive[on], state[on]
            if not len(alive):
                break
            piece = self.final[state]
            hit = piece >= 0
            arcs.append((alive[hit], np.full(int(hit.sum()), depth + 1), piece[hit]))
        bare = np.flatnonzero(self.single[code] < 0)
        arcs.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), self.size)))
        first, length, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
        offset = first - starts[:-1][unit[first]] + length  # the arc's end inside its unit
        order = np.lexsort((-length, offset))
        first, length, piece, offset = first[order], length[order], piece[order], offset[order]
        node = first + unit[first]
        weight = np.zeros(len(piece)) if self.bpe else -self.scores[piece]
        best = np.full(len(points) + len(pieces), np.inf)
        best[starts[:-1] + np.arange(len(pieces))] = 0
        last = np.full(len(best), -1, np.int64)
        back = np.ones(len(best), np.int64)
        steps = np.flatnonzero(np.concatenate(([True], np.diff(offset) != 0, [True]))) if len(offset) else np.zeros(1, np.int64)
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            if not self.bpe:
                cost = best[node[a:b]] + weight[a:b]
                to = node[a:b] + length[a:b]
                np.minimum.at(best, to, cost)
                won = cost == best[to]
                last[to[won]], back[to[won]] = piece[a:b][won], length[a:b][won]
                continue
            runs = np.flatnonzero(np.concatenate(([True], np.diff(length[a:b]) != 0, [True]))) + a
            for x, y in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):  # the longest arcs first; one at most is allowed
                to = node[x:y] + length[x]
                open_ = np.flatnonzero(np.isinf(best[to]) & np.isfinite(best[node[x:y]]))
                good = open_[self.may_follow(last[node[x:y][open_]], piece[x:y][open_])]
                best[to[good]], last[to[good]], back[to[good]] = 0, piece[x:y][good], length[x]
        # From the ends back to the starts, all units side by side.
        at = starts[1:] + np.arange(len(pieces))
        base = starts[:-1] + np.arange(len(pieces))
        active = np.flatnonzero(at > base)
        found_unit, found_at, found_piece = [], [], []
        while len(active):
            now = at[active]
            found_unit.append(active)
            found_at.append(now)
            found_piece.append(last[now])
            at[active] = now - back[now]
            active = active[at[active] > base[active]]
        if not found_unit:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        u, where, ids = (np.concatenate(x) for x in (found_unit, found_at, found_piece))
        order = np.argsort(where)
        u, where, ids = u[order], where[order], ids[order]
        bare = ids == self.size
        repeat = np.ones(len(ids), np.int64)
        raw = [chr(x).encode("utf-8", "replace") for x in points[(where - u - 1)[bare]].tolist()]
        repeat[bare] = [len(x) for x in raw]
        out = np.repeat(ids, repeat)
        out[np.repeat(bare, repeat)] = self.bytes_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = np.bincount(u, weights=repeat, minlength=len(pieces)).astype(np.int64)
        return out.astype(np.int32), n

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that are no UTF-8 become U+FFFD."""
        n = self.out_at[ids + 1] - self.out_at[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        raw = self.out[np.arange(ends[-1]) + np.repeat(self.out_at[ids] - ends[:-1], n)].tobytes()
        cut = ends[at].tolist()
        skip = len(self.prefix)
        return [raw[a:b].decode("utf-8", "replace")[skip:] if b > a and raw[a : a + 1] == b" " else raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


@functools.lru_cache(1)
def transducer_of(path: str) -> Transducer:
    """The transducer of a Python worker, compiled once."""
    return Transducer(path)


def id_batches(encoder: Transducer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``encode_decode``'s rows of record batches with doc_id and text."""
    for batch in batches:
        keys, column = batch.column("doc_id"), batch.column("text")
        for a, b in slices(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), TEXT_CHARS):
            texts = column.slice(a, b - a).to_pylist()
            ids, at = encoder(texts)
            back = encoder.decode(ids, at)
            raw = memoryview(ids.astype("<u4").tobytes())
            yield pa.record_batch(
                [
                    keys.slice(a, b - a),
                    pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                    pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                    pa.array([x == (y or "") for x, y in zip(back, texts, strict=True)]),
                ],
                names=["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"],
            )


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and round_trip (the ids decode to the text) for every document.

    Null and empty texts have no ids. Ids are those of the sentencepiece library; the crc is over
    little-endian unsigned 32-bit ids. Repeated rows stay; other columns are left out. round_trip is false
    only where the text has U+2581, which the model can't tell from a space, or half a surrogate pair.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from id_batches(transducer_of(model_path), batches)

    return documents(docs).mapInArrow(trimmed(rows), "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids under the 32,000-piece model, and whether they decode to the text."""
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
