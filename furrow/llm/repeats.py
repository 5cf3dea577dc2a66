"""Removal of repeated byte strings: every byte covered by a string of ``length`` bytes that starts earlier in the corpus goes.

1. Texts are packed where they stand into rows of about ``PACK_BYTES``, written once; all later steps read these.
2. Of the short substrings (a fifth of ``length``) inside each string of ``length`` bytes the one with the least hash is its anchor, the leftmost of equal ones. Equal strings have equal anchors at equal
   places, and neighbouring strings mostly share theirs, so a text has one anchor in some forty bytes. Anchors that occur once in the corpus prove their strings unique.
3. A run of strings with one repeated anchor is a segment (its strings overlap, so it is little longer than ``length``). Equal segments are one content with its earliest place.
   Contents are dealt by anchor into groups of bounded size, so that equal strings meet in one group and only repeated text travels. An anchor with more than ``most`` different contents is split:
   a string holds the anchor either in its first or its second half of places, and either way shares a longer piece of text with all its equals, whose hash is the new anchor. In the last of these
   halvings the anchor is the string itself, which has one content; so no text, however common, makes a group large.
4. A group builds a run-length index of its contents: Burrows-Wheeler transform in runs, suffix array samples at both ends of each run, and for rows that share ``length`` bytes
   the earliest place. Contents stream through it backwards, all in step; a character either goes on by the LF mapping of its run or jumps to the nearest run of that character, above or below,
   whichever shares more with what is matched, its sample giving the new place in the text. Matching statistics of ``length`` or more tell the row, and the row the earliest place.
5. Places return to the occurrences of their content by a join on narrow rows, and each pack marks its bytes.

Defined results: null texts are empty; matches don't cross texts, and are judged on the input. A start is earlier if its id is smaller, or for equal ids if it is nearer the start of its text: rows that share an
id count as one document, so equal rows lose the same bytes. Null ids come after all others, as one document. Texts shorter than ``length`` keep everything; an empty table gives an
empty result; other columns of the input are ignored. ``kept`` can end or begin inside a character, so it is binary. One text is held whole in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.batches import release, small_batches, text_slices
from furrow.session import drop_stored, free_shuffles, stored

PACK_BYTES, GROUP_BYTES, MOST, SLICE = 2_000_000, 800_000, 3_000, 1 << 15
_END = 255  # never a byte of UTF-8: it ends every text and content
_LAST_ID = (1 << 63) - 1
PACKS = "ids array<long>, sizes array<int>, data binary"
SEGMENTS = "pack long, row int, start int, id long, key long, digest long, content binary, anchor int, low int, high int"
PLACES = "key long, digest long, parts array<struct<first: int, end: int, id: long, start: long>>"
RESULT = "id long, n_bytes long, spans array<struct<first: long, end: long>>, kept binary"


def pack_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(pack, ids, sizes, data): rows of texts, compressed together, each ended by a sign of its own."""
    import zstandard

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame():
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) - 1 for t in texts]], pa.list_(pa.int32())), pa.array([data], pa.binary())], ["ids", "sizes", "data"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for a, b, own in text_slices(batch.column(1)):
                for k, t in zip(batch.column(0).slice(a, b - a).to_pylist(), own):
                    ids.append(k)
                    texts.append((t or "").encode() + b"\xff")
                    held += len(texts[-1])
                    if held > pack_bytes:
                        yield frame()
                        ids, texts, held = [], [], 0
        if ids:
            yield frame()
        release()

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PACKS).withColumn("pack", F.monotonically_increasing_id())


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _grams(data: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` bytes, k >= 8, or of those that begin ``at`` some places."""
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    n = len(data) - k + 1
    h = np.full(n if at is None else len(at), k, np.uint64)
    for off in [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h += words[off : off + n] if at is None else words[at + off]
        h *= np.uint64(0xD6E8FEB86659FD93)
        _mix(h)
    return h


def _least_places(data: np.ndarray, k: int, w: int) -> np.ndarray:
    """For each run of ``w`` neighbouring substrings of ``k`` bytes the place of the one with the least hash, the leftmost of equal ones."""
    # Half of a hash orders the substrings, the place in the other half makes the leftmost win and is the answer.
    least = _grams(data, k)
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    reach = 1
    while 2 * reach <= w:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < w:
        least = np.minimum(least[: len(least) - (w - reach)], least[w - reach :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchor_runs(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor's place, anchor's hash) of the runs of strings of ``length`` bytes that share an anchor; ``data``: texts, each with its end sign."""
    k = length // 5
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))  # type: ignore[return-value]
    place = np.empty(len(data) - length + 1, np.int64)
    for a in range(0, len(place), SLICE):  # slices stay in a processor's cache
        n = min(SLICE, len(place) - a)
        place[a : a + n] = _least_places(data[a : a + n + length - 1], k, length - k + 1)
        place[a : a + n] += a
    ends = np.cumsum(sizes + 1)
    inside = np.zeros(len(data) + 1, np.int8)
    whole = sizes >= length
    inside[(ends - sizes - 1)[whole]] += 1
    inside[(ends - length)[whole]] -= 1  # behind the last start
    real = np.cumsum(inside[:-1], dtype=np.int8)[: len(place)] > 0
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~real[:-1]
    first = np.flatnonzero(new & real)
    # A run ends before the next one, or where its text has no further start.
    stops = np.flatnonzero(np.append(new[1:] | ~real[1:], True) & real) + 1
    return first, stops - first, place[first], _grams(data, k, place[first])


def _opened(batches: Iterator[pa.RecordBatch]):
    """(row as a dictionary, ids, sizes, texts with their ends) of each pack."""
    import zstandard

    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k] for n in batch.schema.names}
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"].as_py()), np.uint8)
            yield row, row["ids"].as_py(), np.array(row["sizes"].as_py(), np.int64), data


def repeated_anchors(packs: DataFrame, length: int) -> DataFrame:
    """(pack, keys): for each pack the anchors that occur in it and elsewhere, or more than once in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, sizes, data in _opened(batches):
            keys, n = np.unique(anchor_runs(data, sizes, length)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["pack"].as_py())), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], ["pack", "key", "n"])
        release()

    # A key has a row for each pack that holds it, so even the most common one is a short window; one shuffle serves both the count and those counted.
    every = packs.mapInArrow(run, "pack long, key long, n int").withColumn("all", F.sum("n").over(Window.partitionBy("key")))
    again = every.filter(F.col("all") > 1).groupBy("pack").agg(F.collect_list("key").alias("keys"))  # no more than a pack has
    return stored(again, "repeated-anchors")


def _digest(content: bytes) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(content), "big", signed=True)  # as a signed number


def _segment_batch(rows: list) -> pa.RecordBatch:
    """A batch of ``SEGMENTS`` from its columns."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [x.split()[0] for x in SEGMENTS.split(", ")])


def segments(packs: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """``SEGMENTS``: a row for each run with a repeated anchor. ``content`` is there for the first of equal ones in a pack; ``anchor``: its place in the content; low and high: places of the anchor in a string."""
    high = length - length // 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for row, ids, sizes, data in _opened(batches):
            keys = np.sort(np.asarray(row["keys"].values.to_numpy()).view(np.uint64))
            first, n, place, key = anchor_runs(data, sizes, length)
            mine = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            first, n, place, key = first[mine], n[mine], place[mine], key[mine]
            begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            of = np.searchsorted(begins, first, "right") - 1
            raw, digest_of = data.tobytes(), xxhash.xxh3_64_intdigest
            spans = list(zip(first.tolist(), (first + n - 1 + length).tolist()))
            digest = np.fromiter((digest_of(raw[a:b]) for a, b in spans), np.uint64, len(spans))
            new = np.zeros(len(spans), bool)
            new[np.unique(digest, return_index=True)[1]] = True  # equal contents have equal anchors
            texts = [raw[a:b] if x else None for (a, b), x in zip(spans, new.tolist())]
            own = np.array([_LAST_ID if i is None else i for i in ids], np.int64)
            same = np.zeros(len(spans), np.int32)
            yield _segment_batch([np.full(len(spans), row["pack"].as_py()), of, first - begins[of], own[of], key.view(np.int64), digest.view(np.int64), texts, place - first, same, same + high])
        release()

    return packs.join(anchors, "pack").mapInArrow(run, SEGMENTS)


def contents(found: DataFrame) -> DataFrame:
    """(key, digest, content, id, start, n): each content with its earliest place and the number of its occurrences."""
    each = found.groupBy("key", "digest").agg(F.first("content", ignorenulls=True).alias("content"), F.min(F.struct("id", "start")).alias("at"), F.count("*").alias("n"))
    return each.select("key", "digest", "content", "at.id", "at.start", "n")


def halved(rows: DataFrame, length: int) -> DataFrame:
    """``SEGMENTS`` of half the range of the anchor's places: its new key is the hash of all the bytes that such strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                middle = (r["low"] + r["high"]) // 2
                last = len(r["content"]) - length
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    a, b = max(r["anchor"] - high, 0), min(r["anchor"] - low, last)
                    if low <= high and a <= b:
                        content = r["content"][a : b + length]
                        shared = r["content"][r["anchor"] - low : r["anchor"] - high + length]
                        key = _digest(shared + low.to_bytes(4, "big") + high.to_bytes(4, "big"))
                        out.append((r["pack"], r["row"], r["start"] + a, r["id"], key, _digest(content), content, r["anchor"] - a, low, high))
            yield _segment_batch(list(zip(*out)) or [()] * 10)
        release()

    return rows.mapInArrow(run, SEGMENTS)


class RunLengthIndex:
    """Burrows-Wheeler transform in runs of texts without the sign 255, with suffix array samples at both ends of every run; rows that share ``length`` bytes are known."""

    def __init__(self, texts: list[bytes], length: int):
        data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        n = len(data)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        self.text_of = np.repeat(np.arange(len(texts)), sizes + 1)
        left = np.repeat(self.begins + sizes + 1, sizes + 1) - np.arange(n)  # bytes up to the end sign, with it
        self.padded = np.concatenate([data, np.full(8, _END, np.uint8)])
        self.data = self.padded[:n]
        order, rank, reach = self._first(data, left)
        same, most = None, int(left.max(initial=1))
        open_ = np.arange(n)
        while True:
            if same is None and 2 * reach > length:
                same = (rank.copy(), rank[np.minimum(np.arange(n) + length - reach, n - 1)])
            if reach >= most and same is not None:
                break
            open_ = self._refined(order, rank, open_, left, reach)
            reach *= 2
        # Equal suffixes are equal up to their end signs: they stand in the order of their texts, which is that of their places.
        whole = left[order] > length
        a, b = same[0][order], same[1][order]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ~whole[1:] | ~whole[:-1]
        self.groups, self.order = np.flatnonzero(new), order
        self.group_of = np.cumsum(new, dtype=np.int32) - 1
        last = data[order - 1]
        edge = np.ones(n, bool)
        edge[1:] = last[1:] != last[:-1]
        cut = np.flatnonzero(edge)
        self.run_of = np.cumsum(edge, dtype=np.int32) - 1  # a row's run without a search
        self.starts, self.sign = cut, last[cut].astype(np.int64)
        ends = np.append(cut[1:], n)
        self.at_start, self.at_end, self.ends = order[cut], order[ends - 1], ends
        by_sign = np.argsort(self.sign, kind="stable")
        self.jump = np.empty(len(cut), np.int64)  # LF of the first row of each run
        self.jump[by_sign] = np.cumsum(ends[by_sign] - cut[by_sign]) - (ends[by_sign] - cut[by_sign])
        self.runs = self.sign[by_sign] * len(cut) + by_sign  # by sign, then place

    @staticmethod
    def _first(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
        """(ranks by the first bytes, how many): as many as fit into a number beside the place, none behind an end sign."""
        n, there = len(data), np.bincount(data, minlength=256) > 0
        small = np.cumsum(there)[data]  # from 1 on; the end sign is the largest
        width, bits = int(small.max(initial=1)).bit_length(), max(1, n.bit_length())
        reach = max(1, min(8, (63 - bits) // width))
        key = small.copy()
        for k in range(1, reach):
            key <<= width
            key[: n - k] |= small[k:]
        # Where an end sign stands among these bytes, what follows it is blanked.
        near = np.flatnonzero(left < reach)
        blank = (reach - left[near]) * width
        key[near] = key[near] >> blank << blank
        order, new = RunLengthIndex._sorted(key, None, np.arange(n), reach * width, bits)
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        return order, rank, reach

    @staticmethod
    def _refined(order: np.ndarray, rank: np.ndarray, open_: np.ndarray, left: np.ndarray, reach: int) -> np.ndarray:
        """Doubles the bytes by which suffixes are ordered, in place, and returns those that are still tied. A rank is the first place of its ties, so only these move, inside their places."""
        n, bits = len(rank), max(1, len(rank).bit_length())
        old = rank[open_]
        tied = np.bincount(old, minlength=n)[old] > 1
        tied &= left[open_] > reach  # others are equal up to their end signs: done
        open_, old = open_[tied], old[tied]
        behind = rank[open_ + reach] + 1
        by, new = RunLengthIndex._sorted(old, behind, open_, bits, bits)
        if not len(by):
            return by
        old, at = rank[by], np.arange(len(by))
        first = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        place = old + at - np.repeat(first, np.diff(np.append(first, len(by))))
        order[place] = by
        rank[by] = place[np.flatnonzero(new)][np.cumsum(new) - 1]
        return by

    @staticmethod
    def _sorted(first: np.ndarray, second: np.ndarray | None, place: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(places by (first, second, place), whether each begins a new pair). ``first`` has ``width`` bits, the others ``bits``."""
        new = np.ones(len(first), bool)
        if width + bits * (1 if second is None else 2) <= 63:  # all in one number: sorting values is much faster than sorting places
            packed = first << bits
            if second is not None:
                packed |= second
                packed <<= bits
            packed |= place
            packed.sort()
            by = packed & ((1 << bits) - 1)
            packed >>= bits
            new[1:] = packed[1:] != packed[:-1]
            return by, new
        second = np.zeros(len(first), np.int64) if second is None else second
        order = np.lexsort((place, second, first))
        a, b = first[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return place[order], new

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the texts at ``a`` and ``b`` share, ``most`` at most; eight at a time. Matches have no end sign in them, so none is counted."""
        words = np.ndarray((len(self.padded) - 7,), "<u8", self.padded, strides=(1,))
        shared, going = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        last = len(words) - 1
        while len(going):
            x = words[np.minimum(a[going] + shared[going], last)] ^ words[np.minimum(b[going] + shared[going], last)]
            # Zero bits below the lowest one that is set, in bytes.
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            shared[going] += same
            going = going[(same == 8) & (shared[going] < most[going])]
        return np.minimum(shared, most)

    def stream(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics, from the last byte of all texts to the first: (numbers of the texts that have a byte there, its place, row, length of the longest match that starts there) for each step."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        queue = np.argsort(-sizes, kind="stable")  # longest first: those that have a byte left are always the first ones
        sizes, ends = sizes[queue], np.cumsum(sizes)[queue]
        row, length = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        place = np.full(len(texts), self.at_start[0])  # of row 0
        n_runs = len(self.starts)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            m = int(np.searchsorted(-sizes, -step, "right"))
            sign = data[ends[:m] - step].astype(np.int64)
            q, at, n = row[:m], place[:m], length[:m]
            run = self.run_of[q].astype(np.int64)
            off = np.flatnonzero(self.sign[run] != sign)
            if len(off):
                near = np.searchsorted(self.runs, sign[off] * n_runs + run[off])
                up, down = self.runs[np.maximum(near - 1, 0)], self.runs[np.minimum(near, n_runs - 1)]
                has_up, has_down = (near > 0) & (up // n_runs == sign[off]), (near < n_runs) & (down // n_runs == sign[off])
                up, down = up % n_runs, down % n_runs
                s_up = np.where(has_up, self._shared(self.at_end[up], at[off], np.where(has_up, n[off], 0)), -1)
                s_down = np.where(has_down, self._shared(self.at_start[down], at[off], np.where(has_down, n[off], 0)), -1)
                above = s_up >= s_down
                run[off] = np.where(above, up, down)
                q[off] = np.where(above, self.ends[up] - 1, self.starts[down])
                at[off] = np.where(above, self.at_end[up], self.at_start[down])
                n[off] = np.maximum(s_up, s_down)
            q += self.jump[run] - self.starts[run]
            at -= 1
            n += 1
            if len(off) and len(lost := off[n[off] == 0]):  # a sign that the index doesn't have ends every match
                q[lost], at[lost] = 0, self.at_start[0]
            yield queue[:m], sizes[:m] - step, q, n


def earliest_places(frame: dict[str, list], length: int) -> tuple[np.ndarray, ...]:
    """(content, first string, end, id, start) of the parts of a group's contents that stand earlier or elsewhere too: id and start are of the earliest place of the part's first string."""
    texts, n = frame["content"], np.array(frame["n"])
    index = RunLengthIndex(texts, length)
    ids, of_id = np.unique(np.array(frame["id"], np.int64), return_inverse=True)
    starts = np.array(frame["start"], np.int64)
    # Earliest place of the rows that share their first bytes: the number of the id above, the start in the lower 40 bits.
    own = (of_id.astype(np.int64) << 40) + starts
    at_text = (own - index.begins)[index.text_of] + np.arange(len(index.text_of))
    earliest = np.minimum.reduceat(at_text[index.order], index.groups)
    counts = np.array([len(t) - length + 1 for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    string, number = np.arange(begins[-1]), np.repeat(np.arange(len(texts)), counts)
    itself = (own - begins[:-1])[number] + string
    found = itself.copy()
    for who, at, row, matched in index.stream(texts):
        hit = np.flatnonzero(matched >= length)
        if len(hit):
            found[begins[who[hit]] + at[hit]] = earliest[index.group_of[row[hit]]]
    # Strings in a row whose earliest places are in a row too are one part.
    new = np.ones(len(string), bool)
    new[1:] = (np.diff(found) != 1) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(string))
    worth = (n[number[first]] > 1) | (found[first] != itself[first])
    first, end = first[worth], end[worth]
    of, place = number[first], found[first]
    return of, first - begins[of], end - begins[of], ids[place >> 40], place & ((1 << 40) - 1)


def places(each: DataFrame, length: int, group_bytes: int) -> DataFrame:
    """``PLACES`` of all contents whose key occurs more than once, group by group."""
    size = each.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))

    def run(table: pa.Table) -> pa.Table:
        of, *parts = earliest_places(table.to_pydict(), length)
        own, n = np.unique(of, return_counts=True)
        kinds = (("first", pa.int32()), ("end", pa.int32()), ("id", pa.int64()), ("start", pa.int64()))
        flat = pa.StructArray.from_arrays([pa.array(p).cast(k) for p, (_, k) in zip(parts, kinds)], [name for name, _ in kinds])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
        found = pa.table([table["key"].take(pa.array(own)), table["digest"].take(pa.array(own)), lists], ["key", "digest", "parts"])
        release()
        return found

    return each.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInArrow(run, PLACES)


def marks(found: DataFrame, placed: DataFrame) -> DataFrame:
    """(pack, marks): for each pack the (row, first, end) of starts whose strings stand earlier. The join's other side has one narrow row for each content, so Spark can split a common one."""
    own = found.select("pack", "row", "id", "start", "key", "digest").join(placed, ["key", "digest"])
    earlier = F.filter("parts", lambda p: (p["id"] < F.col("id")) | ((p["id"] == F.col("id")) & (p["start"] - p["first"] < F.col("start"))))
    hits = F.transform(earlier, lambda p: F.struct(F.col("row").alias("row"), (p["first"] + F.col("start")).alias("first"), (p["end"] + F.col("start")).alias("end")))
    return own.select("pack", hits.alias("hits")).filter(F.size("hits") > 0)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100, pack_bytes: int = PACK_BYTES, group_bytes: int = GROUP_BYTES, most: int = MOST) -> DataFrame:
    """(id, n_bytes, spans, kept) of each row: the removed runs of bytes and what is left of the text. ``length``: 40 or more."""
    spark = docs.sparkSession
    packs = stored(pack_texts(docs, id, text, pack_bytes), "packs")  # compressed already
    anchors = repeated_anchors(packs, length)
    free_shuffles(spark)
    now = stored(segments(packs, anchors, length), "segments", "zstd")
    drop_stored(anchors)
    free_shuffles(spark)
    hits = None
    while True:
        each = stored(contents(now), "contents", "zstd")
        free_shuffles(spark)
        of_key = each.groupBy("key").agg(F.count("*").alias("n_contents"), F.sum("n").alias("n_all"))
        crowded = stored(of_key.filter(F.col("n_contents") > most).select("key"), "crowded")
        is_crowded = crowded.limit(1).count() > 0
        alone = of_key.filter(F.col("n_all") == 1).select("key")
        placed = stored(places(each.join(crowded if is_crowded else alone, "key", "left_anti"), length, group_bytes), "places")
        own = marks(now, placed)
        hits = own if hits is None else hits.unionByName(own)
        if not is_crowded:
            drop_stored(each)
            break
        hot = now.drop("content").join(crowded, "key").join(each.select("key", "digest", "content"), ["key", "digest"])
        free_shuffles(spark)
        now = stored(halved(hot.select(*[x.split()[0] for x in SEGMENTS.split(", ")]), length), "segments", "zstd")
        drop_stored(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, sizes, data in _opened(batches):
            begins = np.concatenate([[0], np.cumsum(sizes + 1)])
            change = np.zeros(len(data) + 1, np.int32)
            if row["hits"].is_valid:
                of, first, end = (row["hits"].values.flatten().field(c).to_numpy() for c in ("row", "first", "end"))
                np.add.at(change, begins[of] + first, 1)
                np.add.at(change, begins[of] + end - 1 + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
            of = np.searchsorted(begins, edges[::2], "right") - 1
            spans: list[list] = [[] for _ in ids]
            for r, a, b in zip(of.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
                spans[r].append({"first": a - int(begins[r]), "end": b - int(begins[r])})
            raw = data.tobytes()
            kept = [raw[a : a + n] if not s else data[a : a + n][~gone[a : a + n]].tobytes() for a, n, s in zip(begins.tolist(), sizes.tolist(), spans)]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])
        release()

    free_shuffles(spark)
    of_pack = hits.groupBy("pack").agg(F.collect_list("hits").alias("hits"))  # no more than a pack has
    return packs.join(of_pack, "pack", "left").mapInArrow(run, RESULT).withColumnRenamed("id", id)
