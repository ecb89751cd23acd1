"""Best-fit packing of token pieces by bin completion.

What decides a packing is how many pieces have each length, at most one count for every
length up to the capacity. The search therefore runs over that table, whatever the number
of documents. Incumbents come first: bins are completed one after the other around the largest
length left, each by the filling that wastes least (or a little more, if its lengths are
larger), and best fit in falling order is tried too. Where none of these reaches a proven bound
(``lower_bound``), branch and bound goes on from the best one: around the largest length left
it enumerates the undominated fillings, least waste first, and cuts branches whose waste
exceeds what a better packing can have. A filling is used for as many bins as the counts allow,
then for one. The sums that lengths can reach rule out all dead ends of the enumeration. Small
tables are searched to the end; for others the effort is bounded (EFFORT), and ``planned`` tells
the gap that is left to the bound.

Pieces are then numbered within their length and looked up in the list of fillings.

Null texts count as empty (one end token). Repeated rows are pieces of their own; which of
equal pieces goes where is told by their ids. Only documents longer than the capacity are
cut; very long texts are read whole. An empty table gives an empty result, and other columns
are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.ranks import PART_ROWS, PARTS, number_within
from kvspace.llm.store import materialize, small_batches
from kvspace.llm.text import SMALL, buffers, extend

CAPACITY = 2048
END = 0
#: Tokens by which a filling may waste more than it must for larger lengths in it, tried in this order.
ALLOWANCES = (0, 8, 32, 64, 128)
#: What branch and bound may spend: each filling that it tries costs as much as there are lengths left; and the number
#: of lengths up to which it bounds what is left anew for each filling.
EFFORT, FEW = 60_000, 64
#: Words remembered by a worker, about 200 bytes each; the half that was asked for last outlives the other. The words of one slice of texts may come on top.
MEMORY = 300_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[0x09:0x0E] = _SPACE[0x20] = True

_PLAIN = re.compile("[^\x00-\x1b\x20-ɏ]|[İŉǰ]")
#: Bytes of which no sign that _PLAIN looks for consists; texts of them alone need no search.
_FINE = bytes({*range(0xC0)} - {*range(0x1C, 0x20)} | {0xC2, 0xC3, 0xC6, 0xC8})


#: ASCII marks that the tokenizer keeps in one run; the apostrophe is apart.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@cache
def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where it prints, else one from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return [chr(0x100 + rest.index(b)) if b in rest else chr(b) for b in range(256)]


# The settings of a tokenizer file under which texts may be taken apart at white space.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@cache
def _tokenizer(path: str):
    """(tokenizer, ids by word asked for lately and before that, whether texts may be taken apart)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    tok = Tokenizer.from_file(path)
    state = lambda part: json.loads(part.__getstate__()) if part else None
    known = isinstance(tok.model, BPE) and state(tok.normalizer) == _NORMALIZER and state(tok.pre_tokenizer) == _SPLITTER and not tok.truncation and not tok.padding
    return tok, [{}, {}], known and all(x.content.startswith("<|") for x in tok.get_added_tokens_decoder().values())


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers.

    A tokenizer of the settings above drops white space and never joins across it, so a
    text's ids are those of its parts between white space one after the other. Each distinct
    part of the texts is looked up once, in lower case; plain letters are remembered, with
    marks after them told apart. Texts with other characters, and all texts for other
    tokenizers, go to the tokenizer whole.
    """
    tok, memory, apart = _tokenizer(path)
    if not apart:
        return [_packed(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    out = [_packed(tok.encode(x, add_special_tokens=False).ids) if (x.encode("utf-8", "replace").translate(None, _FINE) and _PLAIN.search(x)) or "<|" in x else None for x in texts]
    plain = [k for k, v in enumerate(out) if v is None]
    for k, v in zip(plain, _of_parts([texts[k].lower().replace("\x85", " ").replace("\xa0", " ") for k in plain], tok, memory), strict=True):
        out[k] = v
    return out


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _of_parts(texts: list[str], tok, memory: list[dict[str, bytes]]) -> list[bytes]:
    """Ids of lower-case texts, from those of their distinct parts between ASCII white space."""
    data, at = buffers(pa.array(texts, pa.large_string()))
    at = at - at[0]
    inside = ~_SPACE[data[: at[-1]]]
    fresh = np.append(True, ~inside)
    fresh[at] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    first = np.searchsorted(starts, at)
    kept = data[: at[-1]][inside]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(kept))
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
    known = _ids_of(parts.dictionary.to_pylist(), tok, memory)
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    begin = np.cumsum(size) - size
    code = parts.indices.to_numpy()
    end = np.cumsum(size[code])
    place = np.repeat(begin[code] - end + size[code], size[code])
    place += np.arange(len(place))
    ids = np.frombuffer(b"".join(known), np.uint32)[place]
    bounds = np.append(0, end)[first]
    return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _ids_of(parts: list[str], tok, memory: list[dict[str, bytes]]) -> list[bytes]:
    """Ids of each part. Letters, and the marks after them, are a unit of the model each, and are remembered."""
    if len(memory[0]) > MEMORY // 2:
        memory[:] = {}, memory[0]  # what was asked for lately stays
    recent, before = memory
    model = tok.model

    def of(unit: str) -> bytes:
        ids = recent.get(unit)
        if ids is None:
            ids = before.get(unit)
            if ids is None:
                ids = _packed([y.id for y in model.tokenize(unit if unit.isascii() else "".join(map(_byte_signs().__getitem__, unit.encode())))])
            recent[unit] = ids
        return ids

    out, asked = [], []
    for k, p in enumerate(parts):
        stem = p.rstrip(_MARKS)
        if stem and not stem.isalpha():
            asked.append(k)
            out.append(b"")
        elif len(stem) == len(p) or not stem:
            out.append(of(p))
        else:
            out.append(of(stem) + of(p[len(stem) :]))
    for k, e in zip(asked, tok.encode_batch([parts[k] for k in asked], add_special_tokens=False), strict=True):
        out[k] = _packed(e.ids)
    return out


_PIECE = t.ArrayType(t.StructType([t.StructField("piece", t.IntegerType()), t.StructField("start", t.LongType()), t.StructField("length", t.LongType()), t.StructField("ids_crc32", t.LongType())]))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    arrow = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for ids in token_bytes([v or "" for v in part.column("text").to_pylist()], tokenizer):
            ids += END.to_bytes(4, "little")
            n = len(ids) // 4
            out.append([{"piece": k, "start": a, "length": min(capacity, n - a), "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + capacity)])} for k, a in enumerate(range(0, n, capacity))])
        return [pa.array(out, arrow)]

    return extend(docs.select("doc_id", "text"), "text", [t.StructField("_pieces", _PIECE)], make, keep=["doc_id"], most=SMALL).select("doc_id", F.inline("_pieces"))


def _reachable(lengths: list[int], counts: dict[int, int], space: int) -> list[int]:
    """For k = 0, 1, .. the sums up to ``space`` of pieces of the first k lengths, as the bits of an integer."""
    out = [1]
    for x in lengths:
        sums, left, n = out[-1], min(counts[x], space // x), 1
        while left:
            n = min(n, left)
            sums |= sums << n * x
            left, n = left - n, 2 * n
        out.append(sums & ((1 << space + 1) - 1))
    return out


def completion(largest: int, counts: dict[int, int], lengths: list[int], capacity: int, allowance: int = 0) -> list[int]:
    """The lengths that go with ``largest`` in one bin, in falling order.

    ``lengths`` are those left, in ascending order, with ``counts``. Of all fillings that waste
    at most ``allowance`` more than the least waste, it is the one whose lengths are largest in
    their order; no filling dominates it.
    """
    space = capacity - largest
    own = counts | {largest: counts[largest] - 1}
    usable = lengths[: bisect_right(lengths, space)]
    best, waste = [], space  # best fit: the largest that fits, again and again
    for x in reversed(usable):
        n = min(own[x], waste // x)
        best += [x] * n
        waste -= n * x
    if waste <= allowance:
        return best
    reach = _reachable(usable, own, space)
    most = reach[-1].bit_length() - 1
    if waste <= space - most + allowance:
        return best
    # branches with more of a larger length come first; a branch lives while what is left of some good sum can be reached
    good = reach[-1] & ~((1 << max(0, most - allowance)) - 1)
    best = []
    for k in range(len(usable) - 1, -1, -1):
        x = usable[k]
        n = min(own[x], space // x)
        while not (good >> n * x) & reach[k]:
            n -= 1
        good = (good >> n * x) & reach[k]
        best += [x] * n
    return best


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, allowance: int = 0) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths of each): bins completed around the largest length left."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(counts)
    out = []
    while lengths:
        largest = lengths[-1]
        filling = [largest, *completion(largest, counts, lengths, capacity, allowance)]
        need = Counter(filling)
        times = min(counts[x] // n for x, n in need.items())
        out.append((times, filling))
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
                lengths.pop(bisect_right(lengths, x) - 1)
    return out


def best_fit_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Best fit in falling order, run on counts: bins of one filling take pieces together."""
    kinds: dict[tuple[int, ...], int] = {}
    for x in sorted((k for k, v in histogram.items() if v > 0), reverse=True):
        left = histogram[x]
        for filling in sorted((f for f in kinds if capacity - sum(f) >= x), key=sum, reverse=True):
            each = (capacity - sum(filling)) // x
            full, rest = divmod(min(left, kinds[filling] * each), each)
            left -= full * each + rest
            kinds[filling] -= full + (rest > 0)
            for n, number in ((each, full), (rest, 1 if rest else 0)):
                if number:
                    more = (*filling, *[x] * n)
                    kinds[more] = kinds.get(more, 0) + number
        each = capacity // x
        full, rest = divmod(left, each)
        for n, number in ((each, full), (rest, 1 if rest else 0)):
            if number:
                kinds[(x,) * n] = kinds.get((x,) * n, 0) + number
    return [(n, list(f)) for f, n in kinds.items() if n]


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: for each k, lengths over capacity - k have no company of k or more, and what lengths from k on do not find beside larger ones needs bins of its own."""
    items = sorted((x, n) for x, n in histogram.items() if n > 0)
    best = -(-sum(x * n for x, n in items) // capacity)
    for k in {1, *(x for x, _ in items if 2 * x <= capacity)}:
        alone = sum(n for x, n in items if x > capacity - k)
        halves = [(x, n) for x, n in items if 2 * x > capacity and x <= capacity - k]
        room = sum((capacity - x) * n for x, n in halves)
        small = sum(x * n for x, n in items if k <= x and 2 * x <= capacity)
        best = max(best, alone + sum(n for _, n in halves) + max(0, -(-(small - room) // capacity)))
    return best


def undominated(largest: int, counts: dict[int, int], lengths: list[int], capacity: int, waste: int, spend: Callable[[int], bool] = lambda n: True) -> Iterator[list[int]]:
    """The undominated fillings around ``largest`` that waste at most ``waste``, the least waste first, each when it is asked for.

    A filling is dominated if a length left fits beside it, or fits in the place of one or two
    members that it is at least as large as (and larger than one). ``spend`` is told the lengths
    that each filling was chosen from, dominated ones too, and may end the enumeration.
    """
    space = capacity - largest
    own = counts | {largest: counts[largest] - 1}
    usable = [x for x in lengths[: bisect_right(lengths, space)] if own[x]]
    reach = _reachable(usable, own, space)

    def of_sum(k: int, total: int) -> Iterator[list[int]]:
        if not total:
            yield []
            return
        for j in range(bisect_right(usable, total, 0, k) - 1, -1, -1):
            x = usable[j]
            for n in range(min(own[x], total // x), 0, -1):
                if reach[j] >> (total - n * x) & 1:
                    for rest in of_sum(j, total - n * x):
                        yield [x] * n + rest

    for total in range(reach[-1].bit_length() - 1, max(space - waste, 0) - 1, -1):
        if not reach[-1] >> total & 1:
            continue
        spare = space - total
        for filling in of_sum(len(usable), total):
            if not spend(len(usable) + 1):
                return
            used = Counter(filling)
            left = [x for x in usable if own[x] > used[x]]
            beyond = lambda low, high, left=left: bisect_right(left, high) > bisect_right(left, low)  # noqa: E731  is there one left in (low, high]?
            if beyond(0, spare) or any(beyond(x, x + spare) for x in used):
                continue
            kinds = sorted(used)
            if any(beyond(x + y - 1, x + y + spare) for a, x in enumerate(kinds) for y in kinds[a:] if x != y or used[x] > 1):
                continue
            yield filling


def branch(histogram: dict[int, int], best: int, bound: int, capacity: int = CAPACITY, effort: int = EFFORT) -> tuple[list[tuple[int, list[int]]] | None, bool]:
    """(a packing of less than ``best`` bins or None, whether no smaller one is left to find).

    Bins are completed around the largest length left. Each undominated filling is a branch,
    used for as many bins as the counts allow and then for one; a branch is cut when the waste
    of its bins is more than a packing better than the incumbent can have, when the lengths left
    are known to need too many bins, or when the same lengths were left after no more bins
    before. ``effort`` is the sum of the lengths left over all fillings that are tried, at most.
    """
    size = sum(x * n for x, n in histogram.items())
    found, tried, spent = None, 0, False
    seen: dict[tuple, int] = {}
    counts = {k: v for k, v in histogram.items() if v > 0}

    def spare(bins: int, left: int) -> int:
        """Waste that the bins to come may have in all, in a packing of less than best."""
        return (best - 1 - bins) * capacity - left

    def spend(n: int) -> bool:
        nonlocal tried
        tried += n
        return tried < effort

    def children(bins: int, left: int) -> Iterator[tuple[int, list[int]]]:
        lengths = sorted(counts)
        for filling in undominated(lengths[-1], counts, lengths, capacity, spare(bins, left), spend):
            whole = [lengths[-1], *filling]
            need = Counter(whole)
            times = min(counts[x] // n for x, n in need.items())
            for n in dict.fromkeys((times, 1)):
                yield n, whole

    def put(times: int, filling: list[int]) -> None:
        for x in filling:
            counts[x] = counts.get(x, 0) + times
            if not counts[x]:
                del counts[x]

    path: list[tuple[int, list[int]]] = []
    stack = [children(0, size)] if counts else []
    bins, left = 0, size
    while stack:
        step = next(stack[-1], None)
        if step is None or tried >= effort or best <= bound:
            spent = spent or tried >= effort
            stack.pop()
            if path:
                times, filling = path.pop()
                put(times, filling)
                bins, left = bins - times, left + times * sum(filling)
            continue
        times, filling = step
        put(-times, filling)
        bins, left = bins + times, left - times * sum(filling)
        path.append(step)
        if not counts:
            if bins < best:
                best, found = bins, list(path)
            stack.append(iter(()))
            continue
        state = tuple(sorted(counts.items()))
        hopeless = spare(bins, left) < 0 or seen.get(state, best) <= bins or len(counts) <= FEW and bins + lower_bound(counts, capacity) >= best
        seen[state] = min(bins, seen.get(state, bins))
        stack.append(iter(()) if hopeless else children(bins, left))
    return found, best <= bound or not spent


@dataclass
class Plan:
    """Bins as (number, lengths of each), a bound that no packing goes below, and whether none of fewer bins exists."""

    bins: list[tuple[int, list[int]]]
    bound: int
    proven: bool

    @property
    def gap(self) -> int:
        """Sequences that a better packing could save at most."""
        return 0 if self.proven else sum(n for n, _ in self.bins) - self.bound


def planned(histogram: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> Plan:
    """The least of the packings tried: greedy completions and best fit as incumbents, then branch and bound below them."""
    bound = lower_bound(histogram, capacity)
    best: list[tuple[int, list[int]]] | None = None
    for make in (*(partial(complete_bins, allowance=a) for a in ALLOWANCES), best_fit_bins):
        found = make(histogram, capacity)
        if best is None or sum(n for n, _ in found) < sum(n for n, _ in best):
            best = found
        if sum(n for n, _ in best) <= bound:
            return Plan(best, bound, True)
    better, proven = branch(histogram, sum(n for n, _ in best), bound, capacity, effort)
    return Plan(better or best, bound, proven)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths of each) for the pieces counted in ``histogram``."""
    return planned(histogram, capacity).bins


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` is read twice."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    keys, starts, bins, offsets = [], [], [], []
    taken: dict[int, int] = dict.fromkeys(histogram, 0)
    first = 0
    for times, filling in plan(histogram, capacity):
        at = 0
        for x in filling:
            keys.append(x)
            starts.append(taken[x])
            bins.append(first)
            offsets.append(at)
            taken[x] += times
            at += x
        first += times
    table = [np.array(v, dtype=np.int64) for v in (keys, starts, bins, offsets)]
    order = np.lexsort((table[1], table[0]))
    shared = cut.sparkSession.sparkContext.broadcast([v[order] for v in table])

    def run(batches):
        keys, starts, bins, offsets = shared.value
        packed = keys * (1 << 44) + starts
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            k = np.searchsorted(packed, length * (1 << 44) + rank, "right") - 1
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins[k] + rank - starts[k]), pa.array(offsets[k])], names=[*names, "sequence_id", "offset"])

    names = cut.columns
    ranked = number_within(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "_rank", parts=max(PARTS, -(-max(histogram.values(), default=0) // PART_ROWS)))
    schema = t.StructType([*cut.schema.fields, t.StructField("sequence_id", t.LongType()), t.StructField("offset", t.LongType())])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    return pack(cut, capacity)
