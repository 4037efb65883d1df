"""SentencePiece BPE, encoding and decoding, with every piece projected to the bytes of the text it came from.

A text is normalised by longest prefix: at each place the longest key of the model's compiled character map is replaced,
and where none fits one character is copied. While this runs, the source offset of every normalised byte is recorded, so
pieces, which are cut from the normalised text, are carried back to byte spans of the source by two look-ups.

The merges run over stretches that no piece can reach across: where every piece of the vocabulary holds its blank marks
at its beginning only, a stretch is a run of blank marks with what follows it. Stretches repeat, so their pieces are kept
in a bounded cache. Where the vocabulary has other pieces, a text is one stretch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_STRETCHES = 400_000
LONGEST_CACHED = 64
SHORT = 48
SOURCE_ROWS = 256
TOGETHER = 8192
WORST = 1 << 40
MOST = 1 << 62

# The mark for a blank, the character for undecodable bytes, and the kinds of pieces in a model file.
BLANK = "▁"
REPLACEMENT = "�"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol-buffer wire format; fixed-width and length-delimited values as bytes."""
    at, size = 0, len(message)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < size:
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            length = {1: 8, 5: 4}.get(kind) or varint()
            yield number, message[at : at + length]
            at += length


class CharacterMap:
    """The compiled character map of a model: a double-array trie of source prefixes, and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes of the longest key at this place, offset of its replacement); no bytes where no key fits."""
        units = self.units
        if not units:
            return 0, 0
        length = value = 0
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit & 256:
                length, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return length, value

    def replacement(self, offset: int) -> bytes:
        return self.replacements[offset : self.replacements.index(b"\0", offset)]


class PieceCodec:
    """Encodes and decodes one text after the other with a BPE model file of the sentencepiece library."""

    def __init__(self, model: bytes):
        self.model = model
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        found: list[tuple[str, float, int]] = []
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                found.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                rules |= dict(fields(value))
            elif number == 5 and dict(fields(value)).get(2):
                raise ValueError("models that map characters back when decoding aren't read")
        self.dummy_prefix, self.trim, self.escape = (bool(rules.get(i, 1)) for i in (3, 4, 5))
        self.byte_fallback, self.suffix = bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
        unknown_text = trainer[44].decode() if 44 in trainer else " ⁇ "
        if trainer.get(3, 1) != BPE_MODEL:
            raise ValueError("only BPE models are read")
        self.map = CharacterMap(rules.get(2, b""))
        self.mark = BLANK if self.escape else " "
        self.score = {p: -s for p, s, k in found if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.id_of = {p: i for i, (p, _, k) in enumerate(found) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.id_of |= {p: i for i, (p, _, k) in enumerate(found) if k in (UNKNOWN, CONTROL, BYTE)}
        # What two parts join to, for every cut of every piece, and its score; parts are pieces or single characters.
        self.joined = {(p[:i], p[i:]): p for p in self.score for i in range(1, len(p))}
        self.pair_score = {pair: self.score[p] for pair, p in self.joined.items()}
        # The same for many words at once: pairs of ids as sorted keys, with ranks of the scores, equal for equal ones. Only
        # joins of whole pieces are met there. The last place is for pairs that don't join.
        ids = {p: i for i, (p, _, k) in enumerate(found) if k in (NORMAL, UNUSED)}
        rank = {x: i for i, x in enumerate(sorted(set(self.score.values())))}
        table = sorted(
            (ids[a] * len(found) + ids[b], rank[self.score[p]], ids[p]) for (a, b), p in self.joined.items() if a in ids and b in ids and p in ids
        )
        self.pair_key, self.pair_rank, self.pair_piece = (np.array([*x, last], np.int64) for x, last in zip(zip(*table), (MOST, WORST, -1)))
        self.of_point = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self.widths = np.array([len(p.encode()) for p, _, _ in found])
        self.unknown = next(i for i, (_, _, k) in enumerate(found) if k == UNKNOWN)
        self.unused = {p for p, _, k in found if k == UNUSED}
        self.byte_id = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(found) if k == BYTE}
        self.kinds = [k for _, _, k in found]
        text = {UNKNOWN: lambda p: unknown_text.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:-1], 16)])}
        self.bytes_of = [text[k](p) if k in text else p.replace(BLANK, " ").encode() for p, _, k in found]
        self.packed = {p: array("I", (i, len(p.encode()))).tobytes() for p, i in self.id_of.items() if i != self.unknown}
        self.text_of = [str(i) for i in range(len(found))]
        own = sorted((p for p, _, k in found if k == USER_DEFINED), key=len, reverse=True)
        self.own = regex.compile("|".join(map(regex.escape, own))) if own else None
        # Neighbouring characters of some piece; between two others no piece reaches.
        self.joinable = {pair for p in self.score for pair in zip(p, p[1:], strict=False)}
        mergeable = [p for p in self.score if len(p) > 1]
        apart = self.byte_fallback and not own and all(self.mark not in p.lstrip(self.mark) for p in mergeable)
        line = "\n" if not any("\n" in p for p in mergeable) else ""
        m = self.mark
        self.stretches = re.compile(f"{m}*[^{m}{line}]+|{m}+|{line or m}" if apart else r"(?s).+").findall
        self.apart = apart
        self.cache: dict[str, bytes] = {}

    def __reduce__(self):
        # Sent as its file. An executor's worker keeps what is broadcast, so its cache serves one task after the other.
        return PieceCodec, (self.model,)

    # Normalisation

    def normalised(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the source offset it stands for."""
        mark = self.mark.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.trim and not self.own:
            # No key fits anywhere: every character is copied, and a blank becomes its mark.
            widths = np.ones(len(data), np.int64)
            widths[np.frombuffer(data, np.uint8) == 32] = len(mark)
            text, origin = data.replace(b" ", mark), np.repeat(np.arange(len(data)), widths)
        else:
            text, origin = self._by_prefixes(data, mark)
            if not text and self.trim:  # nothing but blanks
                return b"", np.zeros(1, np.int64)
        end, lead = len(data), np.zeros(len(mark), np.int64)
        if self.dummy_prefix and not self.suffix:
            text, origin = mark + text, np.r_[lead + (origin[0] if self.trim else 0), origin]
        kept = len(text)
        while self.trim and text[:kept].endswith(mark):
            kept -= len(mark)
            end = origin[kept]
        text, origin = text[:kept], origin[:kept]
        if self.dummy_prefix and self.suffix:
            text, origin = text + mark, np.r_[origin, lead + end]
        return text, np.r_[origin, end]

    def _by_prefixes(self, data: bytes, mark: bytes) -> tuple[bytes, np.ndarray]:
        """Longest-prefix normalisation from left to right; where blanks are trimmed, runs of them become one."""
        own = {m.start(): m.end() for m in self.own.finditer(data.decode())} if self.own else {}
        if own:  # from characters to bytes
            place = np.r_[0, np.cumsum([len(c.encode()) for c in data.decode()])]
            own = {int(place[a]): int(place[b]) for a, b in own.items()}
        out, widths, sources, at = [], [], [], 0
        after_blank = self.trim
        while at < len(data):
            step, offset = (own[at] - at, None) if at in own else self.map.longest(data, at)
            if not step:
                lead = data[at]
                step, offset = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4, None
            new = data[at : at + step] if offset is None else self.map.replacement(offset)
            if after_blank:
                new = new.lstrip(b" ")
            if new:
                blank = new.endswith(b" ")
                new = new.replace(b" ", mark)
                out.append(new)
                widths.append(len(new))
                sources.append(at)
                after_blank = self.trim and blank
            at += step
        return b"".join(out), np.repeat(np.array(sources, np.int64), widths)

    # Merges

    def _symbols(self, stretch: str) -> tuple[list[str], set[int]]:
        """The characters of a stretch, pieces that users defined whole, and the places of these."""
        if not self.own:
            return list(stretch), set()
        parts, at = [], 0
        fixed: set[int] = set()
        for found in self.own.finditer(stretch):
            parts.extend(stretch[at : found.start()])
            fixed.add(len(parts))
            parts.append(found.group())
            at = found.end()
        parts.extend(stretch[at:])
        return parts, fixed

    def _merge(self, stretch: str) -> list[str]:
        """Pieces of one stretch: again and again the best-scored pair is joined, the leftmost of equals first."""
        parts, fixed = self._symbols(stretch)
        made: dict[str, tuple[str, str]] = {}
        if len(parts) <= SHORT and not fixed:
            score, joined, worst = self.pair_score.get, self.joined, float("inf")
            # A last score that never is the least spares the look at the end.
            scores = [*map(score, zip(parts, parts[1:]), repeat(worst)), worst]
            parts.append("")
            while (best := min(scores)) != worst:
                i = scores.index(best)
                pair = parts[i], parts.pop(i + 1)
                parts[i] = whole = joined[pair]
                if self.unused:
                    made[whole] = pair
                del scores[i]
                scores[i] = score((whole, parts[i + 1]), worst)
                if i:
                    scores[i - 1] = score((parts[i - 1], whole), worst)
            parts.pop()
        else:
            following, before, queue = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), []

            def offer(i: int, j: int) -> None:
                if i >= 0 and j < len(parts) and i not in fixed and j not in fixed:
                    score = self.score.get(parts[i] + parts[j])
                    if score is not None:
                        queue.append((score, i, len(parts[i]) + len(parts[j]), j))

            for i in range(len(parts) - 1):
                offer(i, i + 1)
            heapq.heapify(queue)
            while queue:
                _, i, size, j = heapq.heappop(queue)
                if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
                    continue
                made[parts[i] + parts[j]] = (parts[i], parts[j])
                parts[i], parts[j] = parts[i] + parts[j], ""
                following[i] = following[j]
                if following[j] < len(parts):
                    before[following[j]] = i
                last = len(queue)
                offer(before[i], i)
                offer(i, following[i])
                new = queue[last:]
                del queue[last:]
                for x in new:
                    heapq.heappush(queue, x)
            parts = [p for p in parts if p]
        if self.unused:
            parts = list(chain.from_iterable(self._used(p, made) for p in parts))
        return parts

    def _used(self, piece: str, made: dict[str, tuple[str, str]]) -> list[str]:
        """A piece, or where the model doesn't use it the pieces it was joined from."""
        if piece not in self.unused or piece not in made:
            return [piece]
        return [x for part in made[piece] for x in self._used(part, made)]

    def _pieces(self, stretch: str) -> bytes:
        """The (id, width) pairs of a stretch, from the cache or anew; widths in normalised bytes.

        They are packed numbers of 32 bits, which texts only have to join, and which the garbage collector needn't visit.
        """
        found = self.cache.get(stretch)
        if found is None:
            cuts: list[int] = []
            if self.apart and (len(stretch) > SHORT or not stretch[1:].isalpha()):  # words are rarely worth a cut
                cuts = [i for i, pair in enumerate(zip(stretch, stretch[1:]), 1) if pair not in self.joinable]
            if cuts:
                found = b"".join([self._pieces(stretch[i:j]) for i, j in zip([0, *cuts], [*cuts, len(stretch)], strict=True)])
            else:
                found = self._encoded(stretch)
            if len(self.cache) >= CACHED_STRETCHES:
                self.cache.clear()
            if len(stretch) <= LONGEST_CACHED:
                self.cache[stretch] = found
        return found

    def _encoded(self, stretch: str) -> bytes:
        """A character without a piece falls back to its bytes; the last of them has the character's width, the others none.
        Without byte fallback, neighbouring unknown pieces are one.
        """
        pieces = self._merge(stretch)
        try:
            return b"".join([self.packed[p] for p in pieces])
        except KeyError:
            pairs: list[int] = []
        for piece in pieces:
            data = piece.encode()
            if piece in self.packed:
                pairs.extend((self.id_of[piece], len(data)))
            elif self.byte_fallback:
                for b in data:
                    pairs.extend((self.byte_id[b], 0))
                pairs[-1] = len(data)
            elif pairs and pairs[-2] == self.unknown:
                pairs[-1] += len(data)
            else:
                pairs.extend((self.unknown, len(data)))
        return array("I", pairs).tobytes()

    def _learn(self, stretches: set[str]) -> None:
        """Take new stretches into the cache, all short ones without unknown characters at once."""
        new: list[str] = []
        for stretch in stretches:
            if stretch[1:].isalpha():
                new.append(stretch)
            else:
                cuts = [i for i, pair in enumerate(zip(stretch, stretch[1:]), 1) if pair not in self.joinable]
                new.extend(stretch[i:j] for i, j in zip([0, *cuts], [*cuts, len(stretch)]))
        new = [x for x in set(new) if 1 < len(x) <= SHORT and x not in self.cache]
        if len(self.cache) + len(new) + len(stretches) >= CACHED_STRETCHES:
            self.cache.clear()
        for longest in (6, 9, 12, 16, 24, SHORT):
            these, new = [x for x in new if len(x) <= longest], [x for x in new if len(x) > longest]
            for at in range(0, len(these), TOGETHER):
                self._merge_many(these[at : at + TOGETHER])

    def _merge_many(self, words: list[str]) -> None:
        """`_merge` for many short words at once, each a row of symbols; words with unknown characters are left out.

        Of every row the least score is joined, the leftmost of equals first. A symbol that goes into its left neighbour is
        left where it is and passed over: every symbol knows its neighbours' places.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        size = int(lengths.max())
        points = np.frombuffer("".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(-1, size)
        inside = np.arange(size) < lengths[:, None]
        symbol = np.where(inside, self.of_point[points], -1)
        known = ((symbol >= 0) | ~inside).all(1)
        words = [w for w, k in zip(words, known.tolist()) if k]
        symbol, lengths, inside = symbol[known], lengths[known], inside[known]
        n = len(words)
        if not n:
            return
        after = np.where(np.arange(1, size + 1) < lengths[:, None], np.arange(1, size + 1), -1)
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        pair = np.full((n, size), -1, np.int64)
        row, at = np.nonzero(after >= 0)
        pair[row, at] = self._pair_at(symbol[row, at], symbol[row, at + 1])
        score = self.pair_rank[pair]
        active = np.arange(n)
        while len(active):
            best = score[active].argmin(1)
            open_ = score[active, best] < WORST
            active, best = active[open_], best[open_]
            right = after[active, best]
            symbol[active, best] = self.pair_piece[pair[active, best]]
            symbol[active, right], score[active, right] = -1, WORST
            following = after[active, right]
            after[active, best] = following
            here = following >= 0
            before[active[here], following[here]] = best[here]
            for first, second, some in ((best, following, here), (before[active, best], best, before[active, best] >= 0)):
                score[active[~some & (first == best)], best[~some & (first == best)]] = WORST
                rows, a, b = active[some], first[some], second[some]
                pair[rows, a] = found = self._pair_at(symbol[rows, a], symbol[rows, b])
                score[rows, a] = self.pair_rank[found]
        row, at = np.nonzero(symbol >= 0)
        ids = symbol[row, at]
        pairs = np.stack([ids, self.widths[ids]], 1).astype(np.uint32).tobytes()
        ends = (np.cumsum(np.bincount(row, minlength=n)) * 8).tolist()
        self.cache.update(zip(words, [pairs[a:b] for a, b in zip([0, *ends[:-1]], ends)]))

    def _pair_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs of pieces in the table of joins, that of nothing where a pair doesn't join."""
        key = left * len(self.kinds) + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, at, -1)

    def encode_many(self, texts: Iterable[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """`encode` of some texts, whose new stretches are merged together."""
        normals = [self.normalised((text or "").encode()) for text in texts]
        cut = [self.stretches(normal.decode()) for normal, _ in normals]
        if not (self.own or self.unused) and self.apart:
            self._learn(set(chain.from_iterable(cut)).difference(self.cache))
        return [self._spanned(stretches, origin) for stretches, (_, origin) in zip(cut, normals)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, spans): spans holds the begin and end of every piece in source bytes.

        A byte that is not the last of its character has an empty span at the character's begin. A null text has no pieces.
        """
        normal, origin = self.normalised((text or "").encode())
        return self._spanned(self.stretches(normal.decode()), origin)

    def _spanned(self, stretches: list[str], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.cache.get, stretches))
        if None in found:
            found = [self._pieces(x) if f is None else f for x, f in zip(stretches, found, strict=True)]
        pairs = np.frombuffer(b"".join(found), np.uint32).reshape(-1, 2)
        ends = np.cumsum(pairs[:, 1], dtype=np.int64)
        spans = np.empty((len(ends), 2), np.int64)
        if len(ends):
            spans[0, 0], spans[1:, 0], spans[:, 1] = origin[0], origin[ends[:-1]], origin[ends]
        return pairs[:, 0], spans

    # Decoding

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids: marks become blanks, that of the prefix goes, bytes that are no UTF-8 become replacement characters."""
        ids = ids or []
        raw = list(map(self.bytes_of.__getitem__, ids))
        if self.dummy_prefix or self.trim:
            for i, number in enumerate(ids):
                if self.kinds[number] in (BYTE, UNKNOWN):
                    break
                if self.kinds[number] == CONTROL:
                    continue
                blank, raw[i] = raw[i].startswith(b" "), raw[i].removeprefix(b" ")
                if raw[i] or (blank and not self.trim):
                    break
        try:
            return b"".join(raw).decode()
        except UnicodeDecodeError:
            pass
        out, held = [], b""
        for number, data in zip(ids, raw, strict=True):
            if self.kinds[number] == BYTE:
                held += data
            else:
                out.extend((_readable(held), data.decode()))
                held = b""
        return "".join(out) + _readable(held)


def _readable(data: bytes) -> str:
    """The text of bytes; every byte that is not part of a whole character becomes one replacement character."""
    out, at = [], 0
    while at < len(data):
        lead = data[at]
        size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
        try:
            out.append(data[at : at + size].decode())
        except UnicodeDecodeError:
            size = 1
            out.append(REPLACEMENT)
        at += size
    return "".join(out)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, begins array<long>, ends array<long>): the pieces of every row's text and their source bytes.

    Begins and ends are offsets into the text as UTF-8. A null or empty text has no pieces. Rows with equal ids each get a
    row, null ids too; other columns are ignored; an empty table gives no rows. Texts of any length are encoded whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(PieceCodec(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, SOURCE_ROWS):
                part = batch.slice(at, SOURCE_ROWS)
                found = codec.encode_many(part.column(1).to_pylist())
                columns = [[f[0] for f in found], [f[1][:, 0] for f in found], [f[1][:, 1] for f in found]]
                kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["id", "ids", "begins", "ends"])

    rows, kind = _texts(docs, id_col, text_col)
    schema = f"id {kind}, ids array<int>, begins array<long>, ends array<long>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give an empty text, repeated rows one each, an empty table none."""
    held = encoded.sparkSession.sparkContext.broadcast(PieceCodec(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        for batch in batches:
            text = pa.array([codec.decode(ids.as_py()) for ids in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_crc32): every text encoded and decoded again where it is read.

    Digests are those of the ids in decimals with commas between, and of the text that the ids decode to; spans_crc32 is
    the checksum of the spans as little-endian 64-bit begins and ends. A null or empty text has no pieces; rows with equal
    or null ids each get a row; other columns are ignored; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(PieceCodec(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
        for batch in batches:
            for at in range(0, batch.num_rows, SOURCE_ROWS):
                part, found = batch.slice(at, SOURCE_ROWS), []
                for numbers, spans in codec.encode_many(part.column(1).to_pylist()):
                    ids = numbers.tolist()
                    listed = ",".join(map(codec.text_of.__getitem__, ids))
                    shown = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, codec.decode(ids)))
                    found.append((len(ids), *shown, zlib.crc32(spans.astype("<i8").tobytes())))
                arrays = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=names)

    rows, kind = _texts(docs, id_col, text_col)
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
