"""Packing of documents into sequences of CAPACITY tokens as a cutting-stock problem, by column generation.

A document's ids are those of the tokenizer and an end id. It is cut into pieces of whole sequences, a piece of the most multiples of UNIT that are left, and
the rest below UNIT; so pieces have at most CAPACITY / UNIT + UNIT different lengths, and a document is cut twice at most besides whole sequences. A pattern says how many
pieces of each length a sequence holds. The linear program over patterns, the fewest padded tokens for the histogram of lengths, starts from patterns of one length
and gains columns by pricing: a knapsack by dynamic programming over the dual values finds the pattern of least reduced cost. A sequence costs CAPACITY,
or its own length if that is a power of two, as such a sequence needs no padding. Uses of patterns are rounded down, and what is left, some patterns' worth whatever the
number of documents, is packed by the same knapsack, fullest first.

On Spark: one pass reads and encodes whole texts and emits narrow rows of pieces, each with its rank among the pieces of its length in its task; counts by
task and length give the rank among all. Only the histogram reaches the driver, and only the table of patterns is broadcast; both are bounded by CAPACITY and UNIT. A piece's
rank says which use of which pattern it fills, so pieces are never gathered.

Edge cases: a null or empty text is its end id alone; rows without an id and repeated rows are packed each; no documents, no pieces; of the last sequence, if
nothing fills it, the rest is padding. Texts are encoded four million characters at a time, short ones together and long ones in parts.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, kept_in_worker

CAPACITY, UNIT, END = 4096, 64, 2
_CHUNK, _KEYS, _HELD, _FLUSH = 4 << 20, 500_000, 16 << 20, 8 << 20

#: Kinds of bytes in plain words, those of visible ASCII and letters of Latin-1, which the normaliser only puts in lower case: 1 letters, 2 digits, 3 marks, 0 of no plain word.
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127], _KINDS[48:58], _KINDS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 3, 2, 1
_ENDING = re.compile(rb"'(?:[stmd]|re|ve|ll)").match
#: How the tokenizer's vocabulary writes bytes, those of visible characters as themselves, the others from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def gathered(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the keys `at`, one after the other, and where those of each begin and the last end; those of key k are ids[starts[k] : starts[k + 1]]."""
    first = starts[at]
    sizes = starts[at + 1] - first
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.arange(bounds[-1], dtype=np.int32) + np.repeat((first - bounds[:-1]).astype(np.int32), sizes)], bounds


class Numbered:
    """Ids of keys, which are numbered as they are met and lie in one array by number."""

    def __init__(self):
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.starts, self.held = np.empty(0, "<u4"), np.zeros(1, np.int64), 0

    def full(self) -> bool:
        return len(self.numbers) > _KEYS or self.held > _HELD

    def of(self, keys: pa.Array, found: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """As gathered(). `found` gives the ids of new keys and how many each has."""
        coded = keys.dictionary_encode()
        at = np.fromiter(map(self.numbers.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        more = len(self.numbers) + 1 - len(self.starts)
        if more:
            new = list(islice(reversed(self.numbers), more))[::-1]
            ids, sizes = found(new)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.held += sum(map(len, new))
        return gathered(self.ids, self.starts, at[coded.indices.to_numpy()])


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings and where those of each begin and the last end; of an array that is no slice."""
    at, data = words.buffers()[1:]
    offsets = np.frombuffer(at, np.int32)[: len(words) + 1]
    return np.frombuffer(data or b"", np.uint8)[: offsets[-1]], offsets


def parts_of(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Plain words in lower case, cut as the tokenizer's pattern does, into runs of letters, single digits, runs of marks and endings as 's; and where the parts of each begin."""
    data, offsets = _bytes(words)
    kinds = _KINDS[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    marked = np.flatnonzero((data == 39) & begins)
    for p, end in zip(marked.tolist(), offsets[np.searchsorted(offsets, marked, "right")].tolist()):
        m = _ENDING(data[p : min(p + 3, end)].tobytes())
        if m:
            begins[p + 1 : p + m.end()] = False
            begins[p + m.end() : p + m.end() + 1] = True
    at = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
    return parts, np.concatenate([[0], np.cumsum(begins)])[offsets]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, word by word; one per worker.

    A blank, tab or line break ends a word whatever stands beside it, so a word's ids are the same in every text. Of some megabytes of texts each different word is looked at
    once. A plain word is cut into parts as the normaliser and the tokenizer's pattern do; new parts go to the tokenizer's model in one call, as an id that ends a part
    stands nowhere else. Any other word goes through the whole tokenizer. Parts and other words are kept, and all forgotten beyond _KEYS of them or _HELD characters.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.model = Tokenizer(self.tokenizer.model)  # one model for both
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.final = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.parts, self.others = Numbered(), Numbered()

    def _of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = " ".join(parts)
        if not text.isascii():  # ASCII letters and marks stand for themselves in the vocabulary
            alphabet = np.array([b if b == 32 or b in _VISIBLE else _HIDDEN[b] for b in range(256)], "<u4")
            text = alphabet[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        sizes = np.diff(np.flatnonzero(self.final[ids]), prepend=-1)
        if len(sizes) != len(parts) or sizes.sum() != len(ids):
            raise ValueError("the vocabulary does not end each part of a word with one id")
        return ids, sizes

    def _of_others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = _bytes(words)
        odd = _KINDS[data] == 0
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of times and division
        others = np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) > 0
        plain = pc.if_else(pa.array(others), "", words) if others.any() else words
        parts, begin = parts_of(pc.utf8_lower(plain))
        ids, bounds = self.parts.of(parts, self._of_parts)
        starts = bounds[begin]
        if others.any():
            more, bounds = self.others.of(words.filter(pa.array(others)), self._of_others)
            sizes = np.diff(starts)
            ids = np.insert(ids, np.repeat(starts[:-1][others], np.diff(bounds)), more)
            sizes[others] = np.diff(bounds)
            starts = np.concatenate([[0], np.cumsum(sizes)])
        return ids, starts

    def together(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if self.parts.full():
            self.parts = Numbered()
        if self.others.full():
            self.others = Numbered()
        column = pa.array(texts, pa.string())
        for space in "\n\t\r":
            column = pc.replace_substring(column, space, " ")
        words = pc.split_pattern(column, " ")
        coded = words.flatten().dictionary_encode()
        ids, bounds = gathered(*self._of_words(coded.dictionary), coded.indices.to_numpy())
        bounds = bounds[words.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str) -> Iterator[bytes]:
        start, end = 0, len(text)
        while start < end:
            stop = text.find(" ", start + _CHUNK) if end - start > _CHUNK else -1
            stop = end if stop < 0 else stop
            yield self.together([text[start:stop]])[0]
            start = stop

    def encode_all(self, texts: Iterable[str]) -> Iterator[Iterable[bytes]]:
        """Parts of the ids of each text, in order. Short texts are encoded together."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > _CHUNK:
                yield from ([x] for x in self.together(group))
                group, size = [], 0
            if len(text) > _CHUNK:
                yield self.encode(text)
            else:
                group.append(text)
                size += len(text)
        if group:
            yield from ([x] for x in self.together(group))


def cuts(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[int]:
    """Lengths of what n ids beyond whole sequences are cut into."""
    whole, rest = n // unit * unit, n % unit
    return [x for x in (whole, rest) if x]


def pieces(docs: DataFrame, definition: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, unit: int = UNIT, end: int = END, ids: bool = False) -> DataFrame:
    """(task, turn, doc_id, start, length, ids_crc32, doc_tokens[, ids]) of all documents; `turn` counts the pieces of a length in a task."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(definition)  # a vocabulary's size
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["task", "turn", "doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])]
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker("packing", sent.value, Encoder)
        task, turns = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            at, turn, start, length, crc, tokens, own, held = [], [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                columns = [pa.array(np.full(len(at), task, np.int32)), pa.array(turn, pa.int64()), batch.column(0).take(pa.array(at, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in (start, length, crc, tokens)]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]).astype(np.int32)
                    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(own))])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
                return pa.RecordBatch.from_arrays(columns, names)

            for i, parts in enumerate(encoder.encode_all(value.as_py() or "" for value in batch.column(1))):
                buffer, done, lengths, sums, kept = b"", 0, [], [], []
                for part in parts:
                    buffer += part
                    low = 0
                    while len(buffer) - low >= 4 * capacity:
                        piece = buffer[low : low + 4 * capacity]
                        lengths.append(capacity), sums.append(zlib.crc32(piece)), kept.append(piece if ids else None)
                        low += 4 * capacity
                    buffer = buffer[low:]
                buffer += last
                low = 0
                for n in cuts(len(buffer) // 4, capacity, unit):
                    piece = buffer[low : low + 4 * n]
                    lengths.append(n), sums.append(zlib.crc32(piece)), kept.append(piece if ids else None)
                    low += 4 * n
                total = sum(lengths)
                for n, c, piece in zip(lengths, sums, kept):
                    at.append(i), turn.append(turns[n]), start.append(done), length.append(n), crc.append(c), tokens.append(total)
                    turns[n] += 1
                    done += n
                    if ids:
                        own.append(piece)
                        held += len(piece)
                if held > _FLUSH:
                    yield out()
                    at, turn, start, length, crc, tokens, own, held = [], [], [], [], [], [], [], 0
            if at:
                yield out()

    schema = f"task int, turn long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if ids else "")
    return rows.mapInArrow(run, schema)


# The plan: which patterns are used how often. On the driver, of a size that the capacity and the unit bound.


def padded(n: int, capacity: int = CAPACITY) -> int:
    """Tokens of a sequence that holds n."""
    return n if n & (n - 1) == 0 else capacity


def knapsack(lengths: list[int], values: list[float], most: list[int], capacity: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The largest value of each exact sum of lengths, at most so many of each; and what each step took, for taken()."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    steps = []
    for i, (n, v, m) in enumerate(zip(lengths, values, most)):
        m, part = min(m, capacity // n), 1
        while m > 0:
            times = min(part, m)
            w = n * times
            with_it = best[:-w] + v * times
            better = with_it > best[w:]
            best[w:][better] = with_it[better]
            steps.append((i, times, better))
            m, part = m - times, part * 2
    return best, steps


def taken(steps: list[tuple[int, int, np.ndarray]], lengths: list[int], total: int) -> Counter:
    """How many of each length make the best sum `total`."""
    found: Counter = Counter()
    for i, times, better in reversed(steps):
        w = lengths[i] * times
        if total >= w and better[total - w]:
            found[i] += times
            total -= w
    return found


def _costs(capacity: int) -> np.ndarray:
    return np.array([0 if s == 0 else padded(s, capacity) for s in range(capacity + 1)], dtype=np.float64)


def fillings(lengths: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Patterns from the fullest, of long pieces first, each used as often as its pieces last: (pattern, uses)."""
    left, found = list(counts), []
    while any(left):
        if sum(n * c for n, c in zip(lengths, left)) < capacity:
            return found + [(p, 1) for p in _tail(lengths, left, capacity)]
        best, steps = knapsack(lengths, [float(n * n) for n in lengths], left, capacity)
        pattern = taken(steps, lengths, int(np.flatnonzero(best > -np.inf)[-1]))
        found.append((pattern, min(left[i] // c for i, c in pattern.items() if c)))
        for i, c in pattern.items():
            left[i] -= c * found[-1][1]
    return found


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with row pivots."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for j in range(n):
        at = j + int(np.abs(both[j:, j]).argmax())
        both[[j, at]] = both[[at, j]]
        both[j] /= both[j, j]
        rest = both[:, j].copy()
        rest[j] = 0.0
        both -= rest[:, None] * both[j]
    return both[:, n:]


def linear_program(lengths: list[int], counts: list[int], capacity: int = CAPACITY, passes: int = 3000) -> list[tuple[Counter, float]]:
    """Patterns (numbers by place in `lengths`) and how often each is used, fractions allowed: revised simplex with priced columns.

    It starts from patterns of one length. Columns come from fillings() as long as one of them has a negative reduced cost, then from the knapsack; it ends where none has, or where
    no token is padding.
    """
    m, cost = len(lengths), _costs(capacity)
    ends = np.arange(1, capacity + 1)
    h = np.array(counts, dtype=np.float64)
    patterns = [Counter({i: min(capacity // n, c)}) for i, (n, c) in enumerate(zip(lengths, counts))]
    column = lambda p: np.array([float(p[i]) for i in range(m)])
    worth = lambda p: cost[sum(lengths[i] * c for i, c in p.items())]
    matrix, prices = np.array([column(p) for p in patterns]).T, np.array([worth(p) for p in patterns])
    pool = [p for p, _ in fillings(lengths, counts, capacity)]
    ready, ready_prices = np.array([column(p) for p in pool]), np.array([worth(p) for p in pool])
    inverse, least = _inverse(matrix), float(np.dot(h, lengths))
    for i in range(passes):
        used = inverse @ h
        if float(prices @ used) < least + 0.5:
            break
        duals = prices @ inverse
        gain = ready @ duals - ready_prices
        if gain.max() > 1e-7 * capacity:
            new = pool[int(gain.argmax())]
        else:
            best, steps = knapsack(lengths, duals.tolist(), counts, capacity)
            gain = best[ends] - cost[ends]
            if gain.max() <= 1e-7 * capacity:
                break
            new = taken(steps, lengths, int(ends[gain.argmax()]))
        a = column(new)
        move = inverse @ a
        ratio = np.where(move > 1e-9, np.maximum(used, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        patterns[out], prices[out], matrix[:, out] = new, worth(new), a
        if i % 64 == 63:
            inverse = _inverse(matrix)
        else:
            row = inverse[out] / move[out]
            inverse = inverse - np.outer(move, row)
            inverse[out] = row
    return list(zip(patterns, (inverse @ h).tolist()))


def _tail(lengths: list[int], left: list[int], capacity: int) -> list[Counter]:
    """Less than a sequence: sequences of powers of two if all of it fits in such, else one."""
    rest, total, found = list(left), sum(n * c for n, c in zip(lengths, left)), []
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            best, steps = knapsack(lengths, [float(n * n) for n in lengths], rest, 1 << bit)
            if best[1 << bit] == -np.inf:
                return [Counter({i: c for i, c in enumerate(left) if c})]
            found.append(taken(steps, lengths, 1 << bit))
            rest = [c - found[-1][i] for i, c in enumerate(rest)]
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, passes: int = 3000) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces by length) and how often each is used; together they hold each piece once."""
    lengths = sorted(histogram)
    counts = [int(histogram[n]) for n in lengths]
    if not lengths:
        return []
    uses: list[tuple[Counter, int]] = []
    left = list(counts)

    def use(pattern: Counter, times: int) -> None:
        times = min([times, *(left[i] // c for i, c in pattern.items() if c)])
        if times > 0 and pattern:
            uses.append((pattern, times))
            for i, c in pattern.items():
                left[i] -= c * times

    for pattern, times in linear_program(lengths, counts, capacity, passes):
        use(pattern, int(times + 1e-6))
    for pattern, times in fillings(lengths, left, capacity):
        use(pattern, times)
    return [({lengths[i]: c for i, c in p.items() if c}, t) for p, t in uses]


def places(uses: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces of that length in a sequence, first sequence, offset in it, its padded length)."""
    out, filled, sequence = [], Counter(), 0
    for pattern, times in uses:
        at, size = 0, padded(sum(n * c for n, c in pattern.items()), capacity)
        for n in sorted(pattern, reverse=True):
            c = pattern[n]
            out.append((n, filled[n], filled[n] + c * times, c, sequence, at, size))
            filled[n] += c * times
            at += c * n
        sequence += times
    return out


def pack(docs: DataFrame, definition: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, unit: int = UNIT, end: int = END, ids: bool = False, passes: int = 3000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded[, ids]) for each piece.

    `definition` is the tokenizer as JSON. With `ids` each piece brings its ids, for assembled().
    """
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, definition, id_col, text, capacity, unit, end, ids))
    counts = checkpoint(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = spark.createDataFrame(places(plan(histogram, capacity, passes), capacity), "length long, low long, high long, each long, first long, at long, padded long")
    ranked = cut.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("turn"))
    own = table.withColumnRenamed("length", "of")
    placed = ranked.join(F.broadcast(own), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr("first + (rank - low) div each").alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"), "padded", *(["ids"] if ids else []),
    )


def assembled(packed: DataFrame, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens) of what pack(ids=True) gives: ids in place, filled with `pad` to the padded length. A group holds one sequence."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.first("padded").alias("padded"))
    flat = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return rows.select("sequence_id", F.concat(flat, F.array_repeat(F.lit(pad), (F.col("padded") - F.size(flat)).cast("int"))).alias("ids"), F.size(flat).alias("n_tokens"))
