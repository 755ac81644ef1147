"""SentencePiece encoding and decoding that keeps byte offsets (operator 2).

The normaliser is implemented here: it walks the double-array trie of the model's compiled character
map, takes the longest matching prefix at each point, and records for every normalised byte the
original byte it came from.  The library's BPE merger runs on text that is already normalised; piece
lengths are summed over normalised bytes and projected through the alignment to original byte spans.

Speed comes from cutting.  A BPE merge creates a vocabulary piece, so no merge crosses two adjacent
characters that no piece holds side by side.  Texts are cut at such places, each distinct segment of
a batch is merged once, and numpy spreads the results.  Models with a character map, with white-space
removal, or with an algorithm other than BPE take whole texts instead.

Defined results: a null text counts as empty; an empty text has no piece but the end id, and decodes
to the empty text; very long texts are never cut short; repeated rows give repeated results; an empty
table gives an empty table; columns other than the id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

SPACE_MARK = "▁"
_MARK = SPACE_MARK.encode()
#: About the bytes of merged segments that a worker keeps between batches, what an entry takes besides its texts,
#: and the bytes of texts that are worked on at once; matters of speed and memory alone.
KEPT_BYTES, ENTRY_BYTES, RUN_BYTES = 40 << 20, 320, 2 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """Longest-prefix lookup in a compiled character map: a double-array trie and its target strings."""

    def __init__(self, blob: bytes) -> None:
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.targets = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Target and length of the longest source that starts at ``at``."""
        units, found = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != byte:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                value = units[node] & 0x7FFFFFFF
                found = (self.targets[value : self.targets.index(b"\0", value)], k + 1 - at)
        return found


def _char_len(byte: int) -> int:
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


@dataclass
class Normaliser:
    """Text to normalised bytes, with the original byte offset of every normalised byte."""

    charmap: CharMap | None
    dummy_prefix: bool
    trim: bool
    escape: bool
    symbols: tuple[bytes, ...] = ()

    def _step(self, data: bytes, at: int) -> tuple[bytes, int]:
        for s in self.symbols:
            if data.startswith(s, at):
                return s, len(s)
        if self.charmap and (hit := self.charmap.longest(data, at)):
            return hit
        n = _char_len(data[at])
        return data[at : at + n], n

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        data = text.encode()
        space = _MARK if self.escape else b" "
        at, out, align = 0, bytearray(), []
        if self.trim:
            while at < len(data):
                target, n = self._step(data, at)
                if target != b" ":
                    break
                at += n
        if at == len(data):
            return b"", [at]

        def put(part: bytes) -> None:
            out.extend(part)
            align.extend([at] * len(part))

        if self.dummy_prefix:
            put(space)
        after_space = self.trim
        while at < len(data):
            target, n = self._step(data, at)
            if after_space:
                target = target.lstrip(b" ")
            if target:
                put(target.replace(b" ", space))
                after_space = target.endswith(b" ")
            at += n
            if not self.trim:
                after_space = False
        if self.trim:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space) :]
                del align[len(out) :]
        align.append(at)
        return bytes(out), align


@dataclass
class Encoded:
    """Piece ids of a run of texts with byte spans in the original texts."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


@dataclass
class Segmented:
    """A run of texts as references to distinct segments."""

    keys: list[int]
    spans: list[bytes]
    which: np.ndarray
    first: np.ndarray


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.full = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.pieces = [p.piece for p in proto.pieces]
        self.types = np.array([p.type for p in proto.pieces], np.int8)
        self.normaliser = Normaliser(
            CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None,
            spec.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix,
            spec.remove_extra_whitespaces,
            spec.escape_whitespaces,
            tuple(sorted((p.piece.encode() for p in proto.pieces if p.type == USER), key=len, reverse=True)),
        )
        self.eos = self.full.eos_id()
        self.unk_surface = proto.trainer_spec.unk_surface
        self.own_decode = not proto.denormalizer_spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        bytewise = bool(proto.trainer_spec.byte_fallback)
        self.cuttable = (
            proto.trainer_spec.model_type == 2
            and bytewise
            and self.normaliser.charmap is None
            and not self.normaliser.trim
            and self.normaliser.escape
            and self.normaliser.dummy_prefix
            and not self.normaliser.symbols
        )
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.normalizer_spec.precompiled_charsmap = b""
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.norm_len = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types)], np.int64)
        self.orig_len = np.array([1 if t == BYTE else len(p.replace(SPACE_MARK, " ").encode()) for p, t in zip(self.pieces, self.types)], np.int64)
        self.surface = [self._surface(p, t) for p, t in zip(self.pieces, self.types)]
        self._kept: tuple[dict[int, int], list[int], list[bytes], list[bytes], dict[int, bytes]] = ({}, [], [], [], {})
        self._kept_bytes = 0
        self._adjacency()

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unk_surface.encode()
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE_MARK, " ").encode()

    def _adjacency(self) -> None:
        """Which neighbouring bytes some piece holds side by side; the others are places to cut."""
        joined = np.zeros((256, 256), bool)
        joined[128:, :] = joined[:, 128:] = True
        before_mark = before_line = after_line = False
        for piece, kind in zip(self.pieces, self.types):
            if kind in (UNKNOWN, CONTROL, BYTE):
                continue
            flat = piece.replace(SPACE_MARK, " ")
            for a, b in zip(flat, flat[1:]):
                if ord(a) < 128 and ord(b) < 128:
                    joined[ord(a), ord(b)] = True
                before_mark |= b == " " and ord(a) >= 128
                before_line |= b == "\n"
                after_line |= a == "\n"
        if not before_mark:
            joined[128:, 32] = False
        if not before_line:
            joined[128:, 10] = False
        if not after_line:
            joined[10, 128:] = False
        self.cut = ~joined

    def segments(self, column: pa.Array) -> Segmented:
        """Cuts every text; each distinct segment of the column is kept once, with a space for each space mark."""
        data, offsets = _text.buffers(column)
        hashes, places, first = [], [], np.zeros(len(offsets), np.int64)
        runs: list[np.ndarray] = []
        base = rows = count = 0
        for lo, hi, part, at in _text.pieces(data, offsets):
            filled = np.flatnonzero(np.diff(at))
            spaced = np.insert(part, at[:-1][filled], 32) if len(filled) else part
            shift = np.zeros(hi - lo + 1, np.int64)
            shift[1:] = np.cumsum(np.diff(at) > 0)
            at = at + shift
            n = len(spaced)
            edge = np.zeros(n + 1, bool)
            if n:
                edge[1:n] = self.cut[spaced[:-1], spaced[1:]]
                marks = np.flatnonzero((spaced[:-2] == 0xE2) & (spaced[1:-1] == 0x96) & (spaced[2:] == 0x81)) if n > 2 else []
                if len(marks):
                    edge[np.asarray(marks) + 3] = False
            edge[at] = True
            begin = np.flatnonzero(edge[:n])
            end = np.append(begin[1:], n)
            hashes.append(_text.span_hash(_text.prefix_sums(spaced), begin, end) if n else np.zeros(0, np.uint64))
            places.append((begin + base, end + base))
            first[lo : hi + 1] = np.searchsorted(begin, at) + count
            runs.append(spaced)
            base += n
            count += len(begin)
            rows = hi
        if not count:
            return Segmented([], [], np.zeros(0, np.int64), first)
        text = np.concatenate(runs).tobytes()
        keys, at, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        begin = np.concatenate([p[0] for p in places])[at].tolist()
        end = np.concatenate([p[1] for p in places])[at].tolist()
        return Segmented(keys.tolist(), [text[a:b] for a, b in zip(begin, end)], which, first)

    def merge(self, spans: list[bytes]) -> list[list[int]]:
        """Ids of segments."""
        joined = b"\0".join(spans)
        if not spans or joined.count(b"\0") != len(spans) - 1:
            return [self.raw.encode(span.decode().replace(" ", SPACE_MARK)) for span in spans]
        return self.raw.encode(joined.decode().replace(" ", SPACE_MARK).split("\0"), num_threads=1)

    def _whole(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids of one text by the general way, with original byte offsets of the piece edges."""
        norm, align = self.normaliser(text)
        if not norm:
            return [], np.array([align[-1]], np.int64)
        proto = self.raw.encode(norm.decode(errors="replace"), return_type="proto")
        ids = [p.id for p in proto.pieces]
        size = [len(p.surface.encode()) if self.types[p.id] == UNKNOWN else int(self.norm_len[p.id]) for p in proto.pieces]
        edges = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=edges[1:])
        return ids, np.asarray(align, np.int64)[np.minimum(edges, len(align) - 1)]

    def encode(self, column: pa.Array, add_end: bool = False) -> Encoded:
        """Ids and original byte spans of every text of a column."""
        if self.cuttable:
            return self._encode_cut(column, add_end)
        ids, begin, end, first = [], [], [], [0]
        for text in column.to_pylist():
            own, edges = self._whole(text or "")
            if add_end:
                own, edges = [*own, self.eos], np.append(edges, len((text or "").encode()))
            ids.extend(own)
            begin.append(edges[:-1])
            end.append(edges[1:])
            first.append(first[-1] + len(own))
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return Encoded(np.array(ids, np.int32), cat(begin), cat(end), np.array(first, np.int64))

    def _encode_cut(self, column: pa.Array, add_end: bool) -> Encoded:
        found = self.segments(column)
        _, offsets = _text.buffers(column)
        kinds = [*self.merge(found.spans), [self.eos]]
        size = np.array([len(k) for k in kinds], np.int64)
        flat = np.array([i for k in kinds for i in k], np.int32)
        start = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(size, out=start[1:])
        which, docs = found.which, np.diff(found.first)
        if add_end:
            which = np.insert(which, found.first[1:], len(kinds) - 1)
            docs = docs + 1
        seg_first = np.concatenate([[0], np.cumsum(docs)])
        each = size[which]
        edge = np.zeros(len(which) + 1, np.int64)
        np.cumsum(each, out=edge[1:])
        at = np.arange(edge[-1]) - np.repeat(edge[:-1], each) + np.repeat(start[which], each)
        ids = flat[at]
        first = edge[seg_first]
        lens = np.where(ids == self.eos, 0, self.orig_len[ids])
        end = np.cumsum(lens)
        before = np.concatenate([[0], end])[first[:-1]]
        tokens = np.diff(first)
        end = end - np.repeat(before, tokens)
        begin = end - lens
        filled = np.repeat(np.diff(offsets) > 0, tokens)
        begin, end = np.maximum(begin - filled, 0), np.maximum(end - filled, 0)
        total = np.repeat(np.diff(offsets), tokens)
        if (off := np.flatnonzero(np.minimum(end, total) != end)).size or self._marked(column):
            self._realign(column, first, ids, begin, end, off)
        return Encoded(ids, begin, end, first)

    @staticmethod
    def _marked(column: pa.Array) -> bool:
        data, _ = _text.buffers(column)
        return _MARK in data.tobytes()

    def _realign(self, column: pa.Array, first: np.ndarray, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, off: np.ndarray) -> None:
        """Texts that hold the space mark itself get their spans through the recorded alignment."""
        for k, text in enumerate(column.to_pylist()):
            if text and SPACE_MARK in text:
                norm, align = self.normaliser(text)
                own = slice(first[k], first[k + 1])
                edges = np.zeros(first[k + 1] - first[k] + 1, np.int64)
                np.cumsum(np.where(ids[own] == self.eos, 0, self.norm_len[ids[own]]), out=edges[1:])
                edges = np.asarray(align, np.int64)[np.minimum(edges, len(norm))]
                begin[own], end[own] = edges[:-1], edges[1:]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids, as the library gives it."""
        return self.full.decode([int(i) for i in ids])

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of pieces of every text, without an end id."""
        if not self.cuttable:
            return np.diff(self.encode(column).first)
        found = self.segments(column)
        size, *_ = self._known(found)
        total = np.concatenate([[0], np.cumsum(size[found.which])]) if len(found.which) else np.zeros(1, np.int64)
        return total[found.first[1:]] - total[found.first[:-1]]

    def _known(self, found: Segmented) -> tuple[np.ndarray, list[bytes], list[bytes], list[bytes] | None]:
        """Of each segment the number of ids, the ids written out, and the original bytes of each piece; recent ones are kept.

        The last part has the decoded segments, or None if every one of them decodes to its own bytes.
        """
        known, count, shown, widths, odd = self._kept
        if self._kept_bytes > KEPT_BYTES:
            for x in self._kept:
                x.clear()
            self._kept_bytes = 0
        place = list(map(known.get, found.keys))
        new = [k for k, at in enumerate(place) if at is None]
        spans = [found.spans[k] for k in new]
        kinds = self.merge(spans)
        size = list(map(len, kinds))
        flat = [i for k in kinds for i in k]
        names = self._names()
        text = b"".join(map(names.__getitem__, flat))
        plain = b"".join(map(self.surface.__getitem__, flat))
        flat = np.array(flat, np.int64)
        edges = np.cumsum([0, *size])
        a = np.concatenate([[0], np.cumsum(self._name_len[flat])])[edges].tolist()
        b = np.concatenate([[0], np.cumsum(self._surface_len[flat])])[edges].tolist()
        base = len(count)
        if plain != b"".join(spans) or b[1:] != np.cumsum(list(map(len, spans))).tolist():
            odd.update((base + k, plain[b[k] : b[k + 1]]) for k, span in enumerate(spans) if plain[b[k] : b[k + 1]] != span)
        count.extend(size)
        shown.extend(map(text.__getitem__, map(slice, a[:-1], a[1:])))
        wide = self.orig_len[flat].astype(np.uint16).tobytes()
        cuts = (2 * edges).tolist()
        widths.extend(map(wide.__getitem__, map(slice, cuts[:-1], cuts[1:])))
        self._kept_bytes += len(text) + len(wide) + ENTRY_BYTES * len(new)
        for k, at in enumerate(new):
            known[found.keys[at]] = place[at] = base + k
        own = None
        if odd and not odd.keys().isdisjoint(place):
            own = [odd.get(at, span) for at, span in zip(place, found.spans)]
        take = lambda x: list(map(x.__getitem__, place))
        return np.array(take(count) or [0], np.int64), take(shown), take(widths), own

    def digests(self, column: pa.Array) -> list[tuple[int, str, str, str]]:
        """Per text, with an end id: the number of ids, SHA-256 of the ids, of the decoded text, and of the byte spans.

        Spans are hashed as 32-bit little-endian numbers: where each piece begins in the original text, then where each ends.
        """
        if not (self.cuttable and self.own_decode):
            out = []
            got = self.encode(column, True)
            for k in range(len(column)):
                ids = got.ids[got.first[k] : got.first[k + 1]].tolist()
                spans = b"".join(x[got.first[k] : got.first[k + 1]].astype("<i4").tobytes() for x in (got.begin, got.end))
                out.append((len(ids), *(hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), self.decode(ids).encode(), spans))))
            return out
        found = self.segments(column)
        data, offsets = _text.buffers(column)
        size, shown, widths, plain = self._known(found)
        total = np.concatenate([[0], np.cumsum(size[found.which])]) if len(found.which) else np.zeros(1, np.int64)
        tokens = (total[found.first[1:]] - total[found.first[:-1]] + 1).tolist()
        last = b"%d" % self.eos
        first, edge, which, raw = found.first.tolist(), offsets.tolist(), found.which, data.tobytes()
        out = []
        for k, n in enumerate(tokens):
            own = which[first[k] : first[k + 1]].tolist()
            ids = b"".join(map(shown.__getitem__, own)) + last
            # where every segment decodes to its own bytes, the text decodes to itself
            source = raw[edge[k] : edge[k + 1]]
            text = source if plain is None else b"".join(map(plain.__getitem__, own))[1:]
            spans = self._spans(source, b"".join(map(widths.__getitem__, own)), column, k)
            out.append((n, *(hashlib.sha256(x).hexdigest() for x in (ids, text, spans))))
        return out

    def _spans(self, source: bytes, widths: bytes, column: pa.Array, row: int) -> bytes:
        """Begins and ends of the pieces of one text and its end id; ``widths`` has the bytes that each piece stands for."""
        edges = np.zeros(len(widths) // 2 + 1, np.int64)
        np.cumsum(np.frombuffer(widths, np.uint16), out=edges[1:])
        # the space mark in front stands for nothing
        np.maximum(edges - 1, 0, out=edges)
        if edges[-1] != len(source) or _MARK in source:
            got = self._encode_cut(column.slice(row, 1), True)
            return got.begin.astype("<i4").tobytes() + got.end.astype("<i4").tobytes()
        edges = np.append(edges, edges[-1]).astype("<i4")
        return edges[:-1].tobytes() + edges[1:].tobytes()

    def _names(self) -> list[bytes]:
        if not hasattr(self, "_shown"):
            self._shown = [b"%d " % i for i in range(len(self.pieces))]
            self._name_len = np.array([len(x) for x in self._shown], np.int64)
            self._surface_len = np.array([len(x) for x in self.surface], np.int64)
        return self._shown


_codecs: dict[str, PieceCodec] = {}
_spark.forgets(_codecs.clear)


def codec(path: str) -> PieceCodec:
    """The codec of a model file, loaded once a process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def batches(column: pa.Array, target: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes, so that memory doesn't follow the batch."""
    _, offsets = _text.buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1)
        yield lo, hi
        lo = hi


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = False) -> DataFrame:
    """One row a text: id, ``ids``, and ``begins`` and ``ends``, the UTF-8 byte span of each piece in the original."""
    _spark.ship(docs.sparkSession)

    def run(parts):
        own = codec(model)
        for part in parts:
            for lo, hi in batches(part.column(1)):
                got = own.encode(part.column(1).slice(lo, hi - lo), add_end)
                at = pa.array(got.first, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (got.ids, got.begin, got.end)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), *lists], names=["id", "ids", "begins", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .transform(_spark.in_arrow, run, f"id {kind}, ids array<int>, begins array<int>, ends array<int>")
        .withColumnRenamed("id", id_col)
    )


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of every list of ids; a null list counts as empty."""
    _spark.ship(encoded.sparkSession)

    def run(parts):
        own = codec(model)
        for part in parts:
            texts = [own.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).transform(_spark.in_arrow, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes with an end id, projects every piece to the bytes it came from, decodes again, and returns all as digests,
    in one pass and no shuffle."""
    _spark.ship(docs.sparkSession)

    def run(parts):
        own = codec(model)
        for part in parts:
            for lo, hi in batches(part.column(1)):
                rows = own.digests(part.column(1).slice(lo, hi - lo))
                n, ids, text, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string()), pa.array(spans, pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .transform(_spark.in_arrow, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
        .withColumnRenamed("id", id_col)
    )
