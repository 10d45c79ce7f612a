"""SentencePiece encoding and decoding with a prefix table.

For every prefix of a chunk of text there is one token that ends the prefix's encoding.
Going left to right, an automaton over all pieces lists the pieces that end at each place;
the one whose predecessor (the stored last token of the shorter prefix) is pair-compatible
with it is stored. The ids then follow from the last entry backwards.

Two pieces are pair-compatible if merging their joined text by score gives just them. That
holds for merge vocabularies with distinct scores; runs of blanks, whose pieces share one
score, are merged separately with ties to the left, as the library does.

Models: BPE, identity normaliser, dummy prefix, byte fallback. Characters that are no piece
split a chunk and become byte tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import map_batches, texts

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks whose ids a worker keeps; then it starts afresh.
KEPT_CHUNKS = 400_000
#: Chunks of more characters are encoded one by one and not kept.
LONG = 48
#: Fewer new chunks than this are encoded one by one.
FEW = 64


def _fields(data: bytes):
    """(field number, value) of a protocol-buffers message; nested messages stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id of a model file; ValueError for models of another kind."""
    pieces, checks = [], {}
    for number, value in _fields(data):
        if number == 1:
            parts = dict(_fields(value))
            pieces.append((parts[1].decode("utf-8"), struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0, parts.get(3, NORMAL)))
        elif number == 2:
            parts = dict(_fields(value))
            checks |= {"bpe": parts.get(3, 1) == 2, "byte fallback": parts.get(35, 0) == 1}
        elif number == 3:
            parts = dict(_fields(value))
            checks |= {"identity": not parts.get(2), "dummy prefix": parts.get(3, 1) == 1, "keeps blanks": parts.get(4, 1) == 0}
    if missing := [k for k, ok in checks.items() if not ok]:
        raise ValueError(f"unsupported model: {', '.join(missing)}")
    return pieces


class Codec:
    """Encoder and decoder for one model."""

    def __init__(self, model: bytes):
        self.pieces = read_model(model)
        normal = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.ids = normal
        self.score = {p: self.pieces[i][1] for p, i in normal.items()}
        self.chars = {p for p in normal if len(p) == 1}
        self.byte_ids = [0] * 256
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.end = next(i for i, (p, _, kind) in enumerate(self.pieces) if kind == CONTROL and p == "</s>")
        if any(BLANK in p[1:] and p.strip(BLANK) for p in normal) or any(c not in self.chars for p in normal for c in p):
            raise ValueError("unsupported model: pieces across blanks or characters without a piece")
        self.automaton = ahocorasick.Automaton()
        for p, i in normal.items():
            if len(p) == 1 or p.strip(BLANK):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.surface = [{NORMAL: p.encode("utf-8"), BYTE: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, b"") for p, _, kind in self.pieces]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.run = lru_cache(4096)(self._run)
        self.bulk = Bulk(self)
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the best-scored pair first, leftmost of equals: the plain definition."""
        sym = list(text)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(sym) and (s := self.score.get(sym[i] + sym[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, sym[i] + sym[after[i]]))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if sym[i] else len(sym)
            if j >= len(sym) or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, ""
            after[i] = after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in sym if s]

    def _run(self, n: int) -> list[int]:
        return [self.ids[p] for p in self.merged(BLANK * n)]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' joined text gives just the two."""
        key = left << 20 | right
        found = self.compatible.get(key)
        if found is None:
            a, b = self.pieces[left][0], self.pieces[right][0]
            found = self.compatible[key] = self.merged(a + b) == [a, b]
        return found

    def _known(self, chunk: str) -> list[int]:
        """Ids of text whose characters are all pieces, by the prefix table."""
        last, size = [-1] * len(chunk), [0] * len(chunk)
        seen, done = self.compatible.get, -1
        for end, (piece, n) in self.automaton.iter(chunk):
            if end == done:
                continue
            if n > end:
                fits = self._alone(piece)
            else:
                before = last[end - n]
                fits = seen(before << 20 | piece)
                if fits is None:
                    fits = self.fits(before, piece)
            if fits:
                last[end], size[end], done = piece, n, end
        out, at = [], len(chunk) - 1
        while at >= 0:
            if not size[at]:
                raise ValueError(f"no piece ends at character {at} of {chunk[:40]!r}")
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    @lru_cache(None)  # noqa: B019
    def _alone(self, piece: int) -> bool:
        return len(self.merged(self.pieces[piece][0])) == 1

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of one blank and the text up to the next, without the runs of blanks around."""
        out: list[int] = []
        start = 0
        for i, c in enumerate(chunk):
            if c not in self.chars:
                if start < i:
                    out += self._known(chunk[start:i])
                out += [self.byte_ids[b] for b in c.encode("utf-8")]
                start = i + 1
        if start < len(chunk):
            out += self._known(chunk[start:])
        return out

    def encode(self, text: str) -> list[int]:
        """The library's ids of the text, without an end id."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of each text, without end ids.

        A chunk is a blank and what follows it, or what follows a line feed (which is a
        byte token) up to the next blank or line feed. Chunks that aren't kept from earlier
        texts are encoded together.
        """
        parts = [self._parts(t) for t in texts]
        kept = self.chunks
        if len(kept) > KEPT_CHUNKS:
            kept.clear()
        missing = {p for p in set().union(*parts) if p not in kept}
        missing.discard(BLANK)
        kept.update(self._fresh(missing))
        out = [self._joined(p) for p in parts]
        for p in missing:
            if len(p) > LONG:
                del kept[p]
        return out

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        if "\0" in text or "\n" in self.chars:
            return [BLANK + p for p in text[1:].split(BLANK)]
        return text.replace(BLANK, "\0" + BLANK).replace("\n", "\0\n").split("\0")[1:]

    def _joined(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        kept, blank, pending = self.chunks, self.ids[BLANK], 0
        for part in parts:
            if part == BLANK:
                pending += 1
                continue
            ids = kept[part]
            if pending:
                if ids[0] == blank:
                    out += self.run(pending + 1)
                    ids = ids[1:]
                else:
                    out += self.run(pending)
                pending = 0
            out += ids
        if pending:
            out += self.run(pending)
        return out

    def _fresh(self, chunks: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of new chunks: short ones in the bulk alphabet together, the rest one by one."""
        feed = tuple(self.byte_ids[10:11])
        body = {p[1:] if p[0] == "\n" else p for p in chunks}
        body.discard("")
        plain = [p for p in body if len(p) <= LONG and self.bulk.plain(p)] if len(body) >= FEW else []
        made = dict(zip(plain, self.bulk.encode(plain), strict=True))
        for p in body - made.keys():
            made[p] = tuple(self.chunk_ids(p))
        made[""] = ()
        return {p: feed + made[p[1:]] if p[0] == "\n" else made[p] for p in chunks}

    def decode(self, ids: list[int]) -> str:
        """The library's text of the ids: pieces joined, byte tokens as UTF-8, the dummy prefix off."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = self._lenient(ids)
        text = text.replace(BLANK, " ")
        return text[1:] if text[:1] == " " and ids[0] not in self.byte_of else text

    def _lenient(self, ids: list[int]) -> str:
        """Runs of byte tokens that aren't UTF-8: each bad byte becomes U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                flush()
                out.append(self.surface[i].decode("utf-8"))
        flush()
        return "".join(out)


class Bulk:
    """The prefix tables of many chunks at once, over an alphabet of the first code points.

    The automaton is a dense table of transitions; for each state it has the longest piece
    that ends there, and for each piece the next shorter one that ends it. All chunks go
    ahead one character at a time: each tries its pieces from the longest on until one is
    compatible with the last token of the prefix before it.
    """

    REACH = 0x100

    def __init__(self, codec: Codec):
        self.codec = codec
        letters = sorted(c for c in codec.chars if ord(c) < self.REACH) + [BLANK]
        self.pattern = re.compile("[" + re.escape("".join(letters)) + "]+")
        self.number = np.zeros(0x10000, np.uint8)
        for k, c in enumerate(letters):
            self.number[ord(c)] = k
        if len(letters) > 256:
            raise ValueError("alphabet too large")
        inside = set(letters)
        pieces = [p for p in codec.ids if (len(p) == 1 or p.strip(BLANK)) and inside.issuperset(p)]
        children: list[dict[int, int]] = [{}]
        depth_of, ends = [0], [-1]
        for p in pieces:
            at = 0
            for c in p:
                k = int(self.number[ord(c)])
                to = children[at].get(k)
                if to is None:
                    to = children[at][k] = len(children)
                    children.append({})
                    depth_of.append(depth_of[at] + 1)
                    ends.append(-1)
                at = to
            ends[at] = codec.ids[p]
        n = len(children)
        self.go = np.zeros((n, len(letters)), np.int32)
        self.longest = np.full(n, -1, np.int32)
        self.shorter = np.full(len(codec.pieces), -1, np.int32)
        self.length = np.array([len(p) for p, _, _ in codec.pieces], np.int32)
        fail = [0] * n
        queue = [0]
        for at in queue:
            back = fail[at]
            if at:
                self.go[at] = self.go[back]
                below = self.longest[back]
                self.longest[at] = ends[at] if ends[at] >= 0 else below
                if ends[at] >= 0:
                    self.shorter[ends[at]] = below
            for k, to in children[at].items():
                fail[to] = int(self.go[at, k]) if at else 0
                self.go[at, k] = to
                queue.append(to)
        self.alone = np.array([kind == NORMAL and len(codec.merged(p)) == 1 for p, _, kind in codec.pieces])
        self.keys = np.full(1 << 20, -1, np.int64)
        self.fit = np.zeros(1 << 20, bool)

    def plain(self, chunk: str) -> bool:
        return self.pattern.fullmatch(chunk) is not None

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pair compatibility, from a table of answers that holds the last pair of each slot."""
        pair = left.astype(np.int64) << 20 | right
        slot = (pair * 0x9E3779B1 >> 7) & (len(self.keys) - 1)
        new = np.flatnonzero(self.keys[slot] != pair)
        out = self.fit[slot]
        if len(new):
            asked, where = np.unique(pair[new], return_inverse=True)
            said = np.array([self.codec.fits(int(p) >> 20, int(p) & 0xFFFFF) for p in asked], bool)
            out[new] = said[where]
            at = (asked * 0x9E3779B1 >> 7) & (len(self.keys) - 1)
            self.keys[at], self.fit[at] = asked, said
            clash = self.keys[at] != asked
            if clash.any():
                self.fit[at[clash]] = [self.codec.compatible[int(k)] for k in self.keys[at[clash]]]
        return out

    def encode(self, chunks: list[str]) -> list[tuple[int, ...]]:
        if not chunks:
            return []
        order = sorted(range(len(chunks)), key=lambda i: -len(chunks[i]))
        size = np.array([len(chunks[i]) for i in order])
        widest = int(size[0])
        flat = np.frombuffer("".join(chunks[i] for i in order).encode("utf-16-le"), np.uint16)
        codes = np.zeros((len(order), widest), np.uint8)
        codes[np.arange(widest) < size[:, None]] = self.number[flat]
        state = np.zeros(len(order), np.int32)
        last = np.full((len(order), widest + 1), -1, np.int32)
        for j in range(widest):
            n = int((size > j).sum())
            state[:n] = self.go[state[:n], codes[:n, j]]
            todo, piece = np.arange(n), self.longest[state[:n]]
            while len(todo):
                before = j + 1 - self.length[piece]
                first = before == 0
                ok = np.empty(len(todo), bool)
                ok[first] = self.alone[piece[first]]
                rest = ~first
                ok[rest] = self.fits(last[todo[rest], before[rest]], piece[rest])
                last[todo[ok], j + 1] = piece[ok]
                todo, piece = todo[~ok], self.shorter[piece[~ok]]
        rows, at = np.arange(len(order)), size.copy()
        found = np.zeros((len(order), widest), np.int32)
        taken = np.zeros(len(order), np.int64)
        while len(rows):
            piece = last[rows, at[rows]]
            taken[rows] += 1
            found[rows, widest - taken[rows]] = piece
            at[rows] -= self.length[piece]
            rows = rows[at[rows] > 0]
        out: list[tuple[int, ...]] = [()] * len(chunks)
        for i, ids, k in zip(order, found.tolist(), taken.tolist(), strict=True):
            out[i] = tuple(ids[widest - k :])
        return out


_CODECS: dict[str, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """The model's codec, one per worker process: its tables are filled by the texts it has seen."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _bytes_of(model: str | bytes) -> bytes:
    if isinstance(model, bytes):
        return model
    with open(model, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: str | bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>): each whole text's ids with the end id last.

    The model file is read on the driver and its bytes, a few hundred kB whatever the input,
    go along with the tasks. Null and empty texts give the end id alone; repeated rows stay.
    """
    data = _bytes_of(model)

    def make():
        codec = codec_of(data)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [[*x, codec.end] for x in codec.encode_all(texts(batch))]
            return {id_column: batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, F.col(text_column).alias("text")), make, f"{id_column} {kind}, ids array<int>")


def decoded(tokens: DataFrame, model: str | bytes, id_column: str = "doc_id") -> DataFrame:
    """(id, text): the text of each row's ids; null ids give an empty text."""
    data = _bytes_of(model)

    def make():
        codec = codec_of(data)

        def work(batch: pa.RecordBatch) -> dict:
            return {id_column: batch.column(0), "text": pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())}

        return work

    kind = tokens.schema[id_column].dataType.simpleString()
    return map_batches(tokens.select(id_column, "ids"), make, f"{id_column} {kind}, text string")


def round_trip(docs: DataFrame, model: str | bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode in one pass over the texts: counts and digests of ids and decoded text."""
    data = _bytes_of(model)

    def make():
        codec = codec_of(data)
        digits = codec.digits

        def work(batch: pa.RecordBatch) -> dict:
            n, ids_digest, text_digest = [], [], []
            for ids in codec.encode_all(texts(batch)):
                ids.append(codec.end)
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
                text_digest.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            return {id_column: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_digest, "decoded_sha256": text_digest}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(
        docs.select(id_column, F.col(text_column).alias("text")), make, f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
