"""Fuzzy line duplicates by MinHash.

Lines are compared by the Jaccard similarity of their character shingles. Signatures are banded so that lines at the
threshold share a band with a probability over 0.99; lines that share one, and enough of eight further bytes of their
signatures, are candidates of each other. Candidates are gathered by the connected component of these pairs, verified
there by their exact similarity, and the verified links go through a distributed union-find. Of very large components, what
a portion of the lines leaves apart is verified band by band, each band giving no more links than it has lines. The first
occurrence of each component stays.

Lines are compared in lower-case A-Z with white space runs as one blank. A line is named by a 64-bit hash of that form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergescope.llm.common import checkpointed, connected_components, shuffle_tasks, spread
from mergescope.session import stored

SHINGLE = 5
BANDS, ROWS = 16, 6
#: Of CHECKS further signature bytes, lines that share a band must share CHECKED; at the threshold they do with
#: probability 0.999, while unrelated lines rarely do.
CHECKS, CHECKED = 8, 3
BUCKETS_PER_TASK = 2
SIMILARITY = 0.8
ROUNDS = 12
CHARS_AT_ONCE = 1 << 16
#: Candidates verified together. Larger groups are dealt out first, and what then is still apart, but shares a band, meets
#: there. Its shingles are hashed for so many lines at once.
TOGETHER = 1024
SLOT_BITS, LINES_AT_ONCE = 20, 1024
#: Bits of a hash in the bitmap that keeps lines without candidates out of the shuffle of texts; it takes 8 MB.
FILTER_BITS = 26
FEW = 16
COLUMNS_AT_ONCE = 4096
MIX = np.uint64(0xBF58476D1CE4E5B9)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Lower case for A-Z and a blank for white space inside lines.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\r\v\f", b"abcdefghijklmnopqrstuvwxyz    ")


def plain_lines(text: str | None) -> Iterator[tuple[int, bytes]]:
    """(number, compared form) of the lines that hold a word."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    for number, line in enumerate(raw.split(b"\n")):
        form = line.strip(b" ")
        if form:
            yield number, form


def line_hash(line: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x *= MIX
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def rolled_shingles(lines: list[str]) -> tuple[list[str], np.ndarray]:
    """The lines, short ones padded to a shingle, and a number for each shingle of their concatenation."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    rolled = codes[: len(codes) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        rolled = rolled * np.uint64(0x100000001B3) + codes[i : len(codes) - SHINGLE + 1 + i]
    return padded, rolled


def signatures(lines: list[str], bins: int) -> np.ndarray:
    """MinHash signatures, one row for each line.

    In every round a shingle falls into one bin with one value, and a bin keeps its least value of the first round that
    filled it; lines go through rounds until all bins are full. Bins still empty take the next full one's value.
    """
    padded, rolled = rolled_shingles(lines)
    counts = np.array([len(x) for x in padded], dtype=np.int64) - (SHINGLE - 1)
    owner = np.repeat(np.arange(len(lines)), counts)
    return minhashes(rolled[np.arange(len(owner)) + (SHINGLE - 1) * owner], owner, len(lines), bins)


def minhashes(shingles: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The same from hashes of shingles with the row each belongs to; every row has one."""
    out = np.full(n * bins, EMPTY)
    for turn in range(ROUNDS):
        h = mixed(shingles, turn + 1)
        value = h & np.uint64(0xFFFFFFFF)
        value |= np.uint64(turn << 32)
        h >>= np.uint64(32)
        h *= np.uint64(bins)
        h >>= np.uint64(32)
        slot = h.view(np.int64)
        slot += owner * bins
        np.minimum.at(out, slot, value)
        open_lines = (out.reshape(-1, bins) == EMPTY).any(axis=1)
        if not open_lines.any():
            break
        still = open_lines[owner]
        owner, shingles = owner[still], shingles[still]
    table = out.reshape(-1, bins)
    for i in np.flatnonzero((table == EMPTY).any(axis=1)):
        full = np.flatnonzero(table[i] != EMPTY)
        gaps = np.flatnonzero(table[i] == EMPTY)
        ahead = full[np.searchsorted(full, gaps) % len(full)]
        table[i, gaps] = table[i, ahead] + (gaps.astype(np.uint64) << np.uint64(40))
    return table


def banded(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the bands of signatures of bands * rows values."""
    table = table.reshape(len(table), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), table.shape[:2]) * MIX
    for r in range(rows):
        keys = mixed(keys ^ table[:, :, r], r + 101)
    return keys


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all bands, CHECKS further signature bytes as one number) of each line."""
    full = signatures(lines, bands * rows + CHECKS)
    keys = banded(full[:, : bands * rows], bands, rows)
    checks = np.ascontiguousarray((mixed(full[:, bands * rows :], 99) >> np.uint64(56)).astype(np.uint8))
    return keys, checks.view(np.uint64).ravel()


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether enough bytes of the check numbers are equal."""
    apart = np.atleast_1d(np.asarray(a ^ b)).view(np.uint8).reshape(-1, CHECKS)
    return (apart == 0).sum(axis=1) >= CHECKED


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(line, id, number) of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, line = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, form in plain_lines(text):
                    row.append(i)
                    number.append(n)
                    line.append(line_hash(form))
            yield pa.RecordBatch.from_arrays(
                [pa.array(line, pa.int64()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32())],
                names=["line", "id", "number"],
            )

    rows = _named(docs, id_col, text_col)
    return rows.mapInArrow(run, f"line long, id {rows.schema['id'].dataType.simpleString()}, number int")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str]]]:
    """Portions of (hash, compared form) of lines that differ within an Arrow batch."""
    for batch in batches:
        seen: set[int] = set()
        portion, chars = [], 0
        for text in batch.column(0).to_pylist():
            for _, form in plain_lines(text):
                line = line_hash(form)
                if line not in seen:
                    seen.add(line)
                    portion.append((line, form.decode("utf-8", "replace")))
                    chars += len(form)
                    if chars >= CHARS_AT_ONCE:
                        yield portion
                        portion, chars = [], 0
        if portion:
            yield portion


def _keyed(buckets: int):
    """(bucket, blob): the band keys of a bucket with their lines and checks, as one blob for each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for portion in _different([batch]):
                line, forms = zip(*portion, strict=True)
                keys, checks = band_keys(list(forms))
                found.append((keys.ravel(), np.repeat(np.array(line, dtype=np.int64), BANDS), np.repeat(checks, BANDS)))
            if found:
                key, line, check = (np.concatenate(x) for x in zip(*found, strict=True))
                bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                filled = np.flatnonzero(np.diff(cuts)).tolist()
                blobs = [b"".join(x[order[cuts[b] : cuts[b + 1]]].tobytes() for x in (key, line, check)) for b in filled]
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _pairs(blobs: list[bytes]) -> pa.RecordBatch:
    """Pairs of lines that share a band and agree in their checks, enough for the components of all such pairs."""
    parts = [np.frombuffer(b, dtype=np.uint64).reshape(3, -1) for b in blobs]
    key, line, check = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((line, key))
    key, line, check = key[order], line[order], check[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]
    key, line, check = key[new], line[new].view(np.int64), check[new]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    two = starts[sizes == 2]
    two = two[agree(check[two], check[two + 1])] if len(two) else two
    found = [np.stack([line[two], line[two + 1]], axis=1)]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        left = np.arange(s, s + n)
        while len(left):  # each line reached is compared with those not reached yet
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                close = agree(check[left], check[at])
                reached = left[close]
                found.append(np.stack([np.full(len(reached), line[at]), line[reached]], axis=1))
                queue.extend(reached.tolist())
                left = left[~close]
    both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, i].copy(), pa.int64()) for i in (0, 1)], names=["a", "b"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket:
                if blobs:
                    yield _pairs(blobs)
                bucket, blobs = b, []
            blobs.append(blob)
    if blobs:
        yield _pairs(blobs)


def line_filter(lines: DataFrame) -> np.ndarray:
    """A bitmap with the leading FILTER_BITS bits of the lines' hashes set, of one size however many lines there are."""
    slot = F.shiftrightunsigned("id", 64 - FILTER_BITS)
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")
    words = lines.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(bits).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _texts(listed: np.ndarray):
    """(line, form) of the lines that the bitmap lists, and of a few others that share their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {line_hash(form): form for text in batch.column(0).to_pylist() for _, form in plain_lines(text)}
            slot = np.fromiter(found, np.int64, len(found)).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            kept = (listed[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            rows = [(line, form.decode("utf-8", "replace")) for (line, form), k in zip(found.items(), kept.tolist(), strict=True) if k]
            line, forms = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(forms, pa.string())], names=["line", "form"])

    return run


def similarity(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingled(form: str) -> frozenset:
    return frozenset([form[i : i + SHINGLE] for i in range(max(1, len(form) - SHINGLE + 1))])


def reached_of_few(sets: list[frozenset]) -> list[int]:
    """The same for few lines: each one reached is compared with those not reached yet."""
    first, left = list(range(len(sets))), list(range(len(sets)))
    while left:
        root, *left = left
        queue = [root]
        while queue and left:
            a, apart = sets[queue.pop()], []
            for i in left:
                b = sets[i]
                if min(len(a), len(b)) >= SIMILARITY * max(len(a), len(b)) and similarity(a, b) >= SIMILARITY:
                    first[i] = root
                    queue.append(i)
                else:
                    apart.append(i)
            left = apart
    return first


def reached(forms: list[str]) -> list[int]:
    """For each line the first one that links of similarity SIMILARITY or more reach from it."""
    sets, n = [shingled(form) for form in forms], len(forms)
    if n <= FEW:
        return reached_of_few(sets)
    # Shared shingles of all pairs as a product of membership matrices, over those that two lines hold at least.
    number: dict[str, int] = {}
    rows = [[number.setdefault(s, len(number)) for s in own] for own in sets]
    row = np.repeat(np.arange(n), [len(x) for x in rows])
    column = np.concatenate([np.array(x, dtype=np.int64) for x in rows])
    twice = np.bincount(column, minlength=len(number)) > 1
    order = np.cumsum(twice) - 1
    row, column = row[twice[column]], order[column[twice[column]]]
    both = np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(twice.sum()), COLUMNS_AT_ONCE):
        inside = (column >= at) & (column < at + COLUMNS_AT_ONCE)
        part = np.zeros((n, COLUMNS_AT_ONCE), dtype=np.float32)
        part[row[inside], column[inside] - at] = 1
        both += part @ part.T
    size = np.array([len(s) for s in sets], dtype=np.float64)
    near = both / (size[:, None] + size[None, :] - both) >= SIMILARITY
    first = np.full(n, -1)
    for root in range(n):
        frontier = np.array([root]) if first[root] < 0 else np.empty(0, dtype=np.int64)
        while len(frontier):
            first[frontier] = root
            frontier = np.flatnonzero(near[frontier].any(axis=0) & (first < 0))
    return first.tolist()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (group, cell, line, form) sorted by group, cell and line: (line, to), each line with the first of its cell
    that verified links reach. A cell is what is verified together."""

    def closed(lines: list[tuple[int, str]]) -> list[tuple[int, int]]:
        return [(line, lines[first][0]) for (line, _), first in zip(lines, reached([form for _, form in lines]), strict=True)]

    def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
        line, to = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(to, pa.int64())], names=["line", "to"])

    now, lines = None, []
    for batch in batches:
        out: list[tuple[int, int]] = []
        for group, cell, line, form in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (group, cell) != now:
                if lines:
                    out += closed(lines)
                now, lines = (group, cell), []
            if not lines or lines[-1][0] != line:
                lines.append((line, form))
        yield batch_of(out)
    if lines:
        yield batch_of(closed(lines))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (line, form) -> (line, key, checks), a row for each band."""
    for batch in batches:
        forms, at = batch.column(1).to_pylist(), 0
        while at < len(forms):
            start, chars = at, 0
            while at < len(forms) and (at == start or chars + len(forms[at]) <= CHARS_AT_ONCE):
                chars, at = chars + len(forms[at]), at + 1
            keys, checks = band_keys(forms[start:at])
            line = np.repeat(batch.column(0).to_numpy()[start:at], BANDS)
            columns = line, keys.ravel().view(np.int64), np.repeat(checks.view(np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["line", "key", "checks"])


def slots(forms: list[str]) -> list[np.ndarray]:
    """For each line the SLOT_BITS-bit hashes of its different shingles, as many as these are."""
    padded, rolled = rolled_shingles(forms)
    ends = np.cumsum([len(x) for x in padded])
    return [
        (mixed(np.unique(rolled[end - len(x) : end - SHINGLE + 1]), 7) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
        for x, end in zip(padded, ends.tolist(), strict=True)
    ]


def bridges(checks: np.ndarray, cells: np.ndarray, parts: np.ndarray, forms: list[str]) -> list[tuple[int, int]]:
    """Pairs of parts, a forest with the components of all pairs of similar lines of one band in different parts.

    Each line outside the largest part is compared with all those that no link has joined to it yet; lines of one cell have
    met. Hashed shingles give the most that two lines may share; where that is enough, their exact similarity decides.
    """
    names, own = np.unique(parts, return_inverse=True)
    if len(names) == 1:
        return []
    largest = np.bincount(own).argmax()
    order = np.argsort(own == largest, kind="stable")
    own, cells, checks, forms = own[order], cells[order], checks[order], [forms[i] for i in order.tolist()]
    hashed: list[np.ndarray] = []
    for at in range(0, len(forms), LINES_AT_ONCE):
        hashed += slots(forms[at : at + LINES_AT_ONCE])
    size, joined, found = np.array([len(x) for x in hashed]), own.copy(), []
    mark = np.zeros(1 << SLOT_BITS, dtype=bool)
    for a in range(int((own != largest).sum())):
        meets = a + 1 + np.flatnonzero((joined[a + 1 :] != joined[a]) & (cells[a + 1 :] != cells[a]))
        meets = meets[np.minimum(size[meets], size[a]) >= SIMILARITY * np.maximum(size[meets], size[a])]
        meets = meets[agree(checks[meets], checks[a])] if len(meets) else meets
        if not len(meets):
            continue
        mark[hashed[a]] = True
        n = size[meets]
        both = np.add.reduceat(mark[np.concatenate([hashed[b] for b in meets.tolist()])], np.cumsum(n) - n, dtype=np.int64)
        mark[hashed[a]] = False
        both = np.minimum(both, size[a])
        near = meets[both / (size[a] + n - both) >= SIMILARITY].tolist()
        shingles = shingled(forms[a]) if near else frozenset()
        for b in near:
            if joined[a] != joined[b] and similarity(shingles, shingled(forms[b])) >= SIMILARITY:
                found.append((int(names[own[a]]), int(names[own[b]])))
                joined[joined == joined[b]] = joined[a]
    return found


def _bridged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, checks, cell, part, form) sorted by key -> (a, b): parts that lines of a key link."""

    def batch_of(runs: list[list[tuple]]) -> pa.RecordBatch:
        found = set()
        for run in runs:
            _, checks, cells, parts, forms = zip(*run, strict=True)
            found.update(bridges(*(np.array(x, dtype=np.int64) for x in (checks, cells, parts)), list(forms)))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    run: list[tuple] = []
    for batch in batches:
        runs = []
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if run and run[-1][0] != row[0]:
                runs.append(run)
                run = []
            run.append(row)
        yield batch_of(runs)
    if run:
        yield batch_of([run])


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(line, component) for every different line that is linked to another one; component is a line's hash."""
    tasks = shuffle_tasks(docs.sparkSession)
    texts = _named(docs, id_col, text_col).select("text")
    keyed = texts.mapInArrow(_keyed(tasks * BUCKETS_PER_TASK), "bucket long, blob binary")
    pairs = keyed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_paired, "a long, b long")
    # What comes from components is written and read again: the size a planner expects of joins multiplies with every round,
    # and a checkpoint would hand it on to the rounds that follow.
    groups = stored(connected_components(pairs), "line-groups")

    # Large groups are dealt out by their lines' hashes, which gathers crowds around a few first lines each.
    named = groups.select(F.col("component").alias("group"), "id")
    large = named.groupBy("group").agg(F.count("*").alias("n")).where(f"n > {TOGETHER}")
    large = checkpointed(large.select("group", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts")))
    cell = F.pmod(F.xxhash64("line"), F.coalesce("parts", F.lit(1))).cast("long")
    lines = texts.mapInArrow(_texts(line_filter(groups)), "line long, form string").join(named, F.col("line") == F.col("id"))
    lines = checkpointed(lines.join(large, "group", "left").select("group", cell.alias("cell"), "line", "form", F.col("parts").isNotNull().alias("dealt")))
    dealt = lines.select("group", "cell", "line", "form").repartition(tasks, "group", "cell").sortWithinPartitions("group", "cell", "line")
    links = dealt.mapInArrow(_verified, "line long, to long").where("line != to").select(F.col("line").alias("a"), F.col("to").alias("b"))
    links = stored(links, "line-links")
    joined = stored(connected_components(links), "line-components")
    if large.isEmpty():
        return joined.withColumnRenamed("id", "line")
    # Lines of one large group that are still apart may be linked by two of different cells: where a band holds lines of
    # several components, those of them that are apart meet there.
    members = lines.where("dealt").dropDuplicates(["line"]).join(joined, F.col("line") == F.col("id"), "left")
    members = checkpointed(members.select("line", "form", "cell", F.coalesce("component", "line").alias("part")))
    keys = members.select("line", "form").mapInArrow(_banded, "line long, key long, checks long")
    keys = checkpointed(keys.join(members.select("line", "part"), "line"))
    mixed_keys = keys.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key")
    meeting = keys.drop("part").join(mixed_keys, "key", "left_semi").join(members, "line").select("key", "checks", "cell", "part", "form")
    across = meeting.repartition(tasks, spread("key")).sortWithinPartitions("key").mapInArrow(_bridged, "a long, b long")
    bridged = stored(connected_components(stored(across, "line-bridges")), "line-components")
    whole = joined.join(bridged.toDF("part", "whole"), F.col("component") == F.col("part"), "left")
    whole = whole.select(F.col("id").alias("line"), F.coalesce("whole", "component").alias("component"))
    return whole.unionByName(bridged.join(joined, "id", "left_anti").select(F.col("id").alias("line"), "component"))


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, removed array<int>): which lines of each document repeat another line, exactly or nearly.

    Of each component of lines the occurrence with the smallest (id, line number) stays. Lines without a word are not
    counted and never removed. A null or empty text has no lines. Rows with equal ids must hold equal texts and give one
    row; rows with a null id are left out. Other columns are ignored; an empty table gives no rows.
    """
    found = checkpointed(occurrences(docs, id_col, text_col).distinct())
    components = checkpointed(line_components(docs, id_col, text_col))
    firsts = found.groupBy("line").agg(F.min(F.struct("id", "number")).alias("first"), F.count("*").alias("n"))
    # A line that stands once and is linked to none stays: it takes no part in what follows.
    named = firsts.join(components, "line", "left").where("n > 1 OR component IS NOT NULL")
    named = checkpointed(named.select("line", "first", F.coalesce("component", "line").alias("component")))
    kept = checkpointed(named.groupBy("component").agg(F.min("first").alias("stays")))
    stays = checkpointed(named.join(kept, "component").select("line", "stays"))
    goes = F.struct("id", "number") != F.col("stays")
    removed = found.join(stays, "line", "left").groupBy("id").agg(
        F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when(goes, F.col("number")))).alias("removed")
    )
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    none = F.array().cast("array<int>")
    return ids.join(removed, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"),
    )


def drop_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents without the lines `fuzzy_lines` removes, with the columns they came with.

    Every document stays, also where no line does. `length_col` is set to the new text's number of characters.
    """
    removed = fuzzy_lines(docs, id_col, text_col).where("n_removed > 0").select(
        F.col(id_col).alias("_line_id"), F.col("removed").alias("_line_removed")
    )
    # One split of the text; the kept lines are joined again in order.
    lines = F.split(F.col(text_col), "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_line_removed"))
    kept = F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("_line_removed").isNull(), F.col(text_col)).otherwise(kept)
    joined = docs.join(removed, F.col(id_col) == F.col("_line_id"), "left").withColumn(text_col, text)
    if length_col:
        joined = joined.withColumn(length_col, F.when(F.col("_line_removed").isNull(), F.col(length_col)).otherwise(F.length(text_col)))
    return joined.select(*docs.columns)
