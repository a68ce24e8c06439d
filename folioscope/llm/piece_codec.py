"""SentencePiece BPE encoding that keeps source offsets, and decoding.

The model file is read directly. Normalisation replaces the longest prefix found in the model's compiled
character map (a double-array trie) and records, for every normalised character, the source byte it came from;
pieces are then projected to byte spans of the original text.

Null text counts as empty and gives no pieces. Repeated rows are encoded alike; columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import KnownLists, id_and_text, list_array, map_batches, remembers

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of a worker's memo of encoded words without their closing punctuation, some 500,000 of them.
MEMO_BYTES = 24 << 20
#: Characters up to which a word's pairs are looked through instead of queued.
SHORT = 40
#: Punctuation that is encoded apart from the word it closes, where no piece has both.
CLOSING = ".,;:!?\"'()[]{}*&%$#@+-/=_~^"


def _fields(data: bytes):
    """Number and value of each field of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, i
            shift += 7

    i = 0
    while i < len(data):
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        else:
            n, i = (8, i) if wire == 1 else (4, i) if wire == 5 else varint(i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double array over UTF-8 keys whose values point into a block of replacement strings."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key that starts at ``at`` (0: none), and its replacement."""
        units, node, found, value = self.units, 0, 0, 0
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node ^= step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return found, self.strings[value : self.strings.index(b"\0", value)] if found else b""


class PieceModel:
    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        norm: dict = {}
        trainer: dict = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    p = dict(_fields(value))
                    score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                    self.pieces.append((p.get(1, b"").decode(), score, p.get(3, NORMAL)))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or any(k == UNUSED for _, _, k in self.pieces):
            raise ValueError("only BPE models with leading word marks and no unused pieces are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk_surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.charmap = CharacterMap(norm[2]) if norm.get(2) else None
        self.dummy_prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER_DEFINED)}
        self.scores = {p: s for p, s, k in self.pieces if k in (NORMAL, USER_DEFINED)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        own = sorted((p for p, _, k in self.pieces if k == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        # Merges only ever build vocabulary strings. If none has a word mark behind another character, no merge
        # crosses the front of a word, and words can be encoded one by one.
        free = not own and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if free else r"(?s).+")
        # Nor does one cross two characters that stand side by side in no piece.
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)} if free and self.byte_fallback else None
        self.memo = KnownLists(MEMO_BYTES)
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.is_byte = np.array([k == BYTE for _, _, k in self.pieces])

    def _surface(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return self.unk_surface if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the byte of ``text`` it stems from."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.charmap is None and not self.squeeze and self.own is None:
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64)
            at = np.concatenate(([0], np.cumsum(width)))
            out = text.replace(" ", SPACE) if self.escape else text
            return (SPACE + out, np.concatenate(([0], at))) if self.dummy_prefix else (out, at)
        data, at, chars, source = text.encode(), 0, [], []
        while at < len(data):
            n, new = 0, b""
            if self.own and (m := self.own.match(data[at:].decode())):
                new = m[0].encode()
                n = len(new)
            elif self.charmap:
                n, new = self.charmap.longest(data, at)
            if not n:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + n]
            for c in new.decode():
                if self.squeeze and c == " " and (not chars or chars[-1] == " "):
                    continue
                chars.append(c)
                source.append(at)
            at += n
        end = len(data)
        while self.squeeze and chars and chars[-1] == " ":
            chars.pop()
            end = source.pop()
        if not chars:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            chars.insert(0, " ")
            source.insert(0, source[0])
        out = "".join(chars)
        return out.replace(" ", SPACE) if self.escape else out, np.array([*source, end], np.int64)

    def _merge(self, word: str) -> list[str]:
        """Best-scored adjacent pair first, the leftmost among equals, until no pair is in the vocabulary."""
        if len(word) <= SHORT and not self.own:
            return self._merge_short(list(word))
        parts = []
        at = 0
        while at < len(word):
            m = self.own.match(word, at) if self.own else None
            parts.append(m[0] if m else word[at])
            at += len(parts[-1])
        frozen = [bool(self.own) and len(p) > 1 for p in parts]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and not frozen[a] and not frozen[b] and (s := self.scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, parts[a] + parts[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            if not parts[a] or (b := after[a]) >= n or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """The same for few characters, where looking through all pairs is quicker than a queue."""
        get, none = self.scores.get, -math.inf
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _split(self, word: str) -> tuple[str, str]:
        """A word and the punctuation that closes it, where both have no other pieces beside each other than alone."""
        if self.beside is not None:
            core = word.rstrip(CLOSING)
            if 0 < len(core) < len(word) and word[len(core) - 1 : len(core) + 1] not in self.beside:
                return core, word[len(core) :]
        return word, ""

    def _pieces(self, words: list[str]) -> pa.Array:
        """For each word the id of each of its pieces and its width in characters, in turns."""
        out, ends = array("i"), array("i", [0])
        get = self.ids.get
        for word in words:
            start = len(out)
            for part in self._merge(word):
                if (i := get(part)) is not None:
                    out.append(i)
                    out.append(len(part))
                elif self.byte_fallback:
                    *raw, last = part.encode()
                    for b in raw:
                        out.extend((self.byte_ids[b], 0))
                    out.extend((self.byte_ids[last], len(part)))
                elif len(out) > start and out[-2] == self.unk:
                    out[-1] += len(part)
                else:
                    out.extend((self.unk, len(part)))
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(np.array(ends)), pa.array(np.array(out, np.int32)))

    def encode_all(self, texts: list[str], spans: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """``encode`` of each text. A word is looked up once, however often the texts hold it."""
        if not texts:
            return
        norms = [self.normalise(t) for t in texts]
        words = [pa.array(self.words.findall(norm), pa.string()) for norm, _ in norms]
        at = np.cumsum([0, *map(len, words)])
        coded = pa.concat_arrays(words).dictionary_encode()
        halves = list(zip(*map(self._split, coded.dictionary.to_pylist()), strict=True)) or [(), ()]
        parts = pa.array([*halves[0], *halves[1]], pa.string()).dictionary_encode()
        del words, halves
        lists = self.memo.of(parts.dictionary, self._pieces)
        order = parts.indices.to_numpy().reshape(2, -1).T[coded.indices.to_numpy()]
        found = lists.take(pa.array(order.ravel())).flatten().to_numpy().reshape(-1, 2)
        n = pc.list_value_length(lists).to_numpy()[order].sum(axis=1) // 2
        cuts = np.concatenate(([0], np.cumsum(n)))[at]
        for (_, source), a, b in zip(norms, cuts, cuts[1:], strict=False):
            ids = np.ascontiguousarray(found[a:b, 0])
            if not spans:
                yield ids, None, None
                continue
            ends = np.cumsum(found[a:b, 1], dtype=np.int64)
            yield ids, source[np.concatenate(([0], ends[:-1]))] if len(ids) else ends, source[ends]

    def encode(self, text: str, spans: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Ids, and the first and last-plus-one byte of ``text`` that each piece covers.

        Of the byte pieces of one character the last covers it, the others are empty.
        """
        return next(self.encode_all([text], spans))

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        parts = [surface[i] for i in ids.tolist()]
        if self.dummy_prefix or self.squeeze:
            for k, i in enumerate(ids.tolist()):
                if not parts[k]:
                    continue
                if not self.is_byte[i] and self.pieces[i][2] != UNKNOWN and parts[k].startswith(b" "):
                    parts[k] = parts[k].lstrip(b" ") if self.squeeze else parts[k][1:]
                break
        raw = b"".join(parts)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _each_bad_byte(raw)


def _each_bad_byte(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


remembers(__name__, load.cache_clear)


def encode_documents(
    df: DataFrame, model_path: str, columns: tuple[str, ...] = ("ids", "begins", "ends"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: its id and, of ``ids``, ``begins``, ``ends`` (byte spans), ``decoded`` and ``spans_sha256``, those asked
    for. The last is of all begins and then all ends, each as eight bytes, the lowest first."""
    kinds = {"ids": "array<int>", "begins": "array<bigint>", "ends": "array<bigint>", "decoded": "string", "spans_sha256": "string"}
    schema = ", ".join(["doc_id bigint", *(f"{c} {kinds[c]}" for c in columns)])
    spans = not {"begins", "ends", "spans_sha256"}.isdisjoint(columns)

    def work(batch: pa.RecordBatch) -> dict:
        model = load(model_path)
        made: dict[str, list] = {c: [] for c in columns}
        for ids, begins, ends in model.encode_all(batch.column("text").to_pylist(), spans):
            for c, v in (("ids", ids), ("begins", begins), ("ends", ends)):
                if c in made:
                    made[c].append(v)
            if "decoded" in made:
                made["decoded"].append(model.decode(ids))
            if "spans_sha256" in made:
                made["spans_sha256"].append(hashlib.sha256(begins.astype("<i8").tobytes() + ends.astype("<i8").tobytes()).hexdigest())
        out = {"doc_id": batch.column("doc_id"), **made}
        for name, kind in (("ids", pa.int32()), ("begins", pa.int64()), ("ends", pa.int64())):
            if name in made:
                out[name] = list_array(made[name], kind)
        return out

    return map_batches(id_and_text(df, id_col, text_col), schema, work)


def decode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` from a column of ids; null or no ids give empty text."""

    def work(batch: pa.RecordBatch) -> dict:
        model = load(model_path)
        rows = batch.column("ids").to_pylist()
        return {"doc_id": batch.column("doc_id"), "text": [model.decode(np.array([i for i in r or () if i is not None], np.int64)) for r in rows]}

    return map_batches(df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{ids_col}` as array<int>) ids"), "doc_id bigint, text string", work)
