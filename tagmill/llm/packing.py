"""Best-fit packing of tokenised documents into sequences of fixed length, by bin completion.

Documents are tokenised in their partitions; only longer ones than a sequence are cut. What has to be
planned is a histogram: how many pieces have which length. It has at most ``capacity`` rows
whatever the data size, and a plan is a list of patterns (lengths that share a sequence) with the
number of times each is used. Pieces are then ranked per length in bounded groups and find
their sequence and offset in the plan by arithmetic, so no step needs all pieces in one place.
"""

import base64
import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from tagmill.operators.common import materialize

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0
NODES = 2_000
GROUP_ROWS = 1024
_CACHE = 100_000

# Letters, digits and white space of Latin-1 as the vocabulary's own split pattern sees them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def token_bytes(vocabulary: str = VOCABULARY):
    """A function from a text to its ids as little-endian unsigned 32-bit integers.

    The parts of a text that merges never cross are looked up in a bounded cache; a part that is
    not there is encoded from the same vocabulary's ranks. Texts beyond Latin-1 or with the
    string of a special token go to the tokenizer whole, which is loaded with the first of them.
    """
    import tiktoken
    from tokenizers import Tokenizer

    @functools.cache
    def whole():
        return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    part = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    single = part._encode_single_piece if hasattr(part, "_encode_single_piece") else None

    class Parts(dict):
        def __missing__(self, key: str) -> bytes:
            if len(self) > _CACHE:
                self.clear()
            ids = single(key) if single else part.encode_ordinary(key)
            self[key] = out = np.array(ids, "<u4").tobytes()
            return out

    parts = Parts()

    def encode(text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = "<|" not in text
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join(map(parts.__getitem__, _LATIN.findall(text)))
        return np.array(whole().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit): the ids of each
    document and one end id, cut into pieces of ``capacity`` where longer, the first piece
    taking what is over. A null or empty text is its end id alone. Repeated rows are pieces of
    their own; other columns are ignored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = token_bytes(vocabulary), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n if n <= capacity else (n % capacity or capacity)
                start = 0
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    out.append((doc, piece, start, stop - start, ids[4 * start : 4 * stop]))
                    start = stop
                size += len(ids)
                if size > 1 << 24:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ("doc_id", "piece", "start", "length", "ids")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


# ------------------------------------------------------------------ the plan over a histogram


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer bins: the sum bound, sharpened for every cut length k (items over
    capacity - k share a bin with none of at least k)."""
    sizes = sorted(counts)
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    for k in [0, *[s for s in sizes if 2 * s <= capacity]]:
        big = sum(c for s, c in counts.items() if s > capacity - k)
        mid = [(s, c) for s, c in counts.items() if capacity - k >= s and 2 * s > capacity]
        low = sum(s * c for s, c in counts.items() if k <= s and 2 * s <= capacity)
        n_mid = sum(c for _, c in mid)
        room = n_mid * capacity - sum(s * c for s, c in mid)
        best = max(best, big + n_mid + max(0, -(-(low - room) // capacity)))
    return best


def _best_fill(sizes: list[int], counts: dict[int, int], gap: int, nodes: int, most: int) -> list[tuple[int, ...]]:
    """Up to ``most`` fillings of ``gap`` from the available sizes, fullest first, larger parts
    before smaller ones; those that another one dominates are left out.

    A filling is dominated if one of its parts, or two together, can be replaced by one available larger
    size that still fits. One part as large as the gap dominates every other filling.
    """
    fit = bisect.bisect_right(sizes, gap)
    if not fit:
        return [()]
    if sizes[fit - 1] == gap:
        return [(gap,)]
    found: dict[tuple[int, ...], int] = {}
    state = [nodes]

    def go(at: int, left: int, parts: tuple[int, ...], used: dict[int, int]) -> None:
        at = min(at, bisect.bisect_right(sizes, left))
        maximal = True
        for i in range(at - 1, -1, -1):
            if state[0] <= 0:
                break
            s = sizes[i]
            if used.get(s, 0) >= counts[s]:
                continue
            maximal = False
            state[0] -= 1
            used[s] = used.get(s, 0) + 1
            go(i + 1, left - s, (*parts, s), used)
            used[s] -= 1
            if found and min(found.values()) == 0 and len(found) >= most:
                return
        if maximal or state[0] <= 0:
            found[parts] = left

    go(fit, gap, (), {})

    def dominated(parts: tuple[int, ...], waste: int) -> bool:
        used: dict[int, int] = {}
        for p in parts:
            used[p] = used.get(p, 0) + 1
        sums = [*parts, *[parts[i] + parts[j] for i in range(len(parts)) for j in range(i + 1, len(parts))]]
        for n, s in enumerate(sums):
            at = bisect.bisect_right(sizes, s + waste) - 1
            floor = s if n < len(parts) else s - 1
            while at >= 0 and sizes[at] > floor:
                if counts[sizes[at]] > used.get(sizes[at], 0):
                    return True
                at -= 1
        return False

    order = sorted(found.items(), key=lambda x: (x[1], len(x[0]), [-p for p in x[0]]))
    kept = [p for p, waste in order if not dominated(p, waste)]
    return (kept or [order[0][0]])[:most]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, by bin completion.

    Depth first: the largest remaining length is completed by its undominated fillings, fullest
    first, each used as often as the counts allow (and, as another branch, once). The first
    descent is a best-fit packing and the first incumbent. A branch ends when the space it has
    wasted shows it cannot beat the incumbent, and all ends when the incumbent meets the lower
    bound or ``nodes`` branches were tried. The search reads only the histogram, so its cost
    does not follow the number of pieces.
    """
    counts = {s: c for s, c in histogram.items() if c > 0}
    total = sum(s * c for s, c in counts.items())
    bound = lower_bound(counts, capacity)
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_bins = 0
    sizes = sorted(counts)
    done: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        for s in pattern:
            counts[s] -= times
            if not counts[s]:
                sizes.pop(bisect.bisect_left(sizes, s))

    def give(pattern: tuple[int, ...], times: int) -> None:
        for s in pattern:
            if not counts[s]:
                bisect.insort(sizes, s)
            counts[s] += times

    def branches(fan: int) -> list[tuple[tuple[int, ...], int]]:
        large = sizes[-1]
        counts[large] -= 1
        spare = not counts[large]
        if spare:
            sizes.pop()
        fills = _best_fill(sizes, counts, capacity - large, 400, fan)
        if spare:
            sizes.append(large)
        counts[large] += 1
        out = []
        for fill in fills:
            pattern = (large, *fill)
            most = min(counts[s] // pattern.count(s) for s in set(pattern))
            out += [(pattern, most)] + ([(pattern, 1)] if most > 1 else [])
        return out

    stack: list[tuple[list, int, int]] = []
    bins = waste = 0
    tried = 0
    descend = True
    while True:
        if descend and not sizes:
            if best is None or bins < best_bins:
                best, best_bins = list(done), bins
            if best_bins == bound:
                return best
            descend = False
        elif descend and best is not None and (waste > (best_bins - 1) * capacity - total or tried >= nodes):
            descend = False
        if descend:
            stack.append((branches(4), bins, waste))
        elif not stack:
            return best or []
        # next branch of the innermost open node
        while stack:
            options, bins, waste = stack[-1]
            if len(done) == len(stack):
                give(*done.pop())
            if options and (best is None or tried < nodes):
                break
            stack.pop()
        if not stack:
            return best or []
        pattern, times = options.pop(0)
        tried += 1
        take(pattern, times)
        done.append((pattern, times))
        bins, waste = bins + times, waste + times * (capacity - sum(pattern))
        descend = True


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as columns, one row per pattern and length in it: the first ``rank`` (among pieces
    of that ``size``) that goes there, ``per`` pieces to a sequence from ``base`` on, at ``offset``."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        at = 0
        for s in sorted(set(pattern), reverse=True):
            per = pattern.count(s)
            rows.append((s, used.get(s, 0), base, per, at))
            used[s] = used.get(s, 0) + per * times
            at += per * s
        base += times
    rows.sort()
    return {k: np.array(c, np.int64) for k, c in zip(("size", "rank", "base", "per", "offset"), zip(*rows) if rows else ((),) * 5)}


def pack(table: DataFrame, key: list[str], length: str = "length", capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``table`` with ``sequence_id`` and ``offset``. Every row has a length of 1 to ``capacity``; an error
    says so otherwise. ``key`` orders rows of equal length; equal keys are fine.

    Rows are ranked per length within groups of about ``GROUP_ROWS`` (by a hash of the key), so a
    length that a third of all rows have is dealt out like any other.
    """
    table = materialize(table.withColumn("__salt", F.xxhash64(*key)))
    histogram = {r[0]: r[1] for r in table.groupBy(length).count().collect()}  # at most `capacity` rows
    if any(s is None or not 0 < s <= capacity for s in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    groups = F.create_map(*[F.lit(x) for s, c in sorted(histogram.items()) for x in (int(s), -(-c // GROUP_ROWS))]) if histogram else F.lit(None).cast("map<int,int>")
    group = F.pmod("__salt", F.coalesce(groups[F.col(length).cast("int")], F.lit(1))).cast("int")
    table = table.withColumn("__g", group)
    sizes = table.groupBy(F.col(length).alias("__l"), "__g").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("__l").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__l", "__g", before.alias("__before"))
    in_group = F.row_number().over(Window.partitionBy(length, "__g").orderBy("__salt", *key)) - 1
    ranked = table.withColumn("__in", in_group).join(starts, (F.col(length) == F.col("__l")) & (table["__g"] == starts["__g"])).select(
        *[table[c] for c in table.columns if not c.startswith("__")], (F.col("__before") + F.col("__in")).alias("__rank")
    )
    found = places(plan(histogram, capacity, nodes))
    names = [c for c in ranked.columns if c != "__rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = found["size"] << 44 | found["rank"]
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "__rank"))
            at = np.searchsorted(order, size << 44 | rank, "right") - 1
            k = rank - found["rank"][at]
            seq = found["base"][at] + k // found["per"][at]
            offset = found["offset"][at] + k % found["per"][at] * size
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, nodes: int = NODES) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; the
    ids themselves come from ``pieces``. An empty table gives an empty one."""
    narrow = pieces(docs, capacity, vocabulary).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(narrow, ["doc_id", "piece", "start", "ids_crc32"], "length", capacity, nodes)
