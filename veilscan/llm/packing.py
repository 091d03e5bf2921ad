"""Vector best-fit packing of tokenised documents into sequences.

Tokens: a byte-level BPE file's ids of the whole text, without special tokens, then ``end_id``. A longer document
is cut into pieces of ``capacity`` tokens; its first piece holds the remainder. A sequence has three capacities:
tokens, documents, and attention cost (the sum of squared lengths); an item's needs in all three follow from its
length alone. Bins are chosen by the smallest weighted norm of what remains, or by the largest weighted
dot product of need and remainder, among those with room in every capacity.

Scale: as equal lengths are interchangeable, best-fit runs on the table of counts by length (``capacity`` rows) and
yields runs: ranks r0.. of a length go k a bin to sequences s0.., at an offset. Rows find their run by a broadcast
join with that table, which has a few thousand rows however many documents there are. Ranks within a length come
from counts of (partition, length), so no length is ever sorted or gathered. Texts are read once and never shuffled.

Tokenising: texts fall into pre-tokens by array operations; only distinct pre-tokens meet the BPE, and a worker
keeps a bounded cache of them. Texts with characters beyond Latin, apostrophes or ``<|`` take the tokenizer itself.

Nulls: a null text is empty (one token); null and repeated ids are rows like others. An empty table gives none. Extra
columns, whatever their names, are ignored. A very long text is tokenised whole and cut into pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.llm import textvec as tv
from veilscan.llm.graph import SMALL
from veilscan.llm.work import Work, named

#: Characters below this have their class from a table, others go to the tokenizer.
LATIN = 0x250
#: Distinct pre-tokens that a worker keeps.
KEPT = 150_000
_state: dict = {}


def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space."""
    import unicodedata

    kind = [unicodedata.category(chr(c))[0] for c in range(LATIN)]
    out = np.array([1 if k == "L" else 2 if k == "N" else 0 for k in kind], np.uint8)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 3
    return out


def _coder(name: str) -> dict:
    """This worker's tokenizer, and its cache: pre-token -> place among ids."""
    if _state.get("name") != name:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
        _state.update(
            name=name, whole=None, load=lambda: Tokenizer.from_file(public_tokenizers.path(f"{name}.json")), classes=_classes(), seen={}, ids=[],
            piece=tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece,
        )
    return _state


def pretokens(cp: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of Latin texts without apostrophes: runs of letters, of numbers or of other signs,
    each with one space before it; white space otherwise in runs, of which a following sign gets the last character."""
    n = len(cp)
    c = classes[cp]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = c[1:] != c[:-1]
    new |= first[:-1]
    space = c == 3
    # the last white space before a sign of the same text
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    joins = last & (cp == 32)
    start = new.copy()
    start |= last
    start[1:] &= ~joins[:-1]
    return np.flatnonzero(start)


def token_ids(column: pa.Array, name: str) -> Iterator[np.ndarray]:
    """Each text's ids (uint32), null as empty."""
    st = _coder(name)
    for i, j, data, offs in tv.blocks(column):
        text = data.tobytes()
        lead = (data & 0xC0) != 0x80
        cps = np.concatenate([[0], np.cumsum(lead)])
        co = cps[offs]
        cp = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        # texts that array operations can't split as the tokenizer does
        odd = (cp >= LATIN) | (cp == 39)
        odd[:-1] |= (cp[:-1] == 60) & (cp[1:] == 124)
        odd_n = np.concatenate([[0], np.cumsum(odd)])
        plain = odd_n[co[1:]] == odd_n[co[:-1]]
        if len(cp):
            at = np.append(np.flatnonzero(lead), len(data))  # bytes of code points
            cp = np.minimum(cp, LATIN - 1)
            starts = pretokens(cp, co, st["classes"])
            ends = np.append(starts[1:], len(cp))
            bs, be = at[starts], at[ends]
            h = tv.span_hash(data, bs, be)
            uniq, where, inv = np.unique(h, return_index=True, return_inverse=True)
            # a text with a pre-token that only its hash makes equal to another takes the tokenizer itself
            size = be - bs
            other = (size != size[where][inv]) | ~tv.equal_spans(data, bs, be, bs[where][inv])
            if other.any():
                plain[np.searchsorted(co, starts[other], "right") - 1] = False
            if len(st["seen"]) > KEPT:
                st["seen"].clear()
                st["ids"].clear()
            seen, ids, piece = st["seen"], st["ids"], st["piece"]
            place = np.empty(len(uniq), np.int64)
            for k, (a, b) in enumerate(zip(bs[where].tolist(), be[where].tolist(), strict=True)):
                x = text[a:b]
                p = seen.get(x)
                if p is None:
                    p = seen[x] = len(ids)
                    ids.append(np.array(piece(x), "<u4").tobytes())
                place[k] = p
            own = [ids[p] for p in place]
            size = np.fromiter(map(len, own), np.int64, len(own)) // 4
            flat = np.frombuffer(b"".join(own), "<u4")
            off = np.cumsum(size) - size
            n = size[inv]
            upto = np.cumsum(n)
            out = flat[np.repeat(off[inv] - (upto - n), n) + np.arange(int(upto[-1]))]
            # ids before each text
            before = np.concatenate([[0], upto])[np.searchsorted(starts, co)]
        else:
            out, before = np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
        for k in range(j - i):
            if plain[k]:
                yield out[before[k] : before[k + 1]]
            else:
                st["whole"] = st["whole"] or st["load"]()
                yield np.array(st["whole"].encode(text[offs[k] : offs[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)


PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(name: str, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc = b.column(0).to_pylist()
            rows = []
            for d, ids in zip(doc, token_ids(b.column(1), name), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                cut = len(ids) % capacity or capacity
                a = 0
                for p in range(-(-len(ids) // capacity)):
                    e = cut + p * capacity
                    rows.append((d, p, a, e - a, zlib.crc32(ids[a:e].tobytes()), part, int(count[e - a])))
                    count[e - a] += 1
                    a = e
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def best_fit(counts: dict[int, int], capacity: int = 1024, max_docs: int = 1024, max_cost: int = 1 << 20, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, items a bin, first sequence, offset) for counts by length, longest first."""
    caps = (capacity, max_docs, max_cost)
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # what remains -> ranges (first sequence, sequences)
    runs, made = [], 0

    def most(left, need):
        return min(r // x for r, x in zip(left, need, strict=True))

    def goodness(left, need):
        if rule == "dot":
            return sum(w * (r / c) * (x / c) for w, r, x, c in zip(weights, left, need, caps, strict=True))
        return -sum(w * ((r - x) / c) ** 2 for w, r, x, c in zip(weights, left, need, caps, strict=True))

    def put(left, length, need, rank, items, k, seq, bins):
        runs.append((length, rank, items, k, seq, capacity - left[0]))
        whole, over = divmod(items, k)
        for n, first, each in ((whole, seq, k), (bool(over), seq + whole, over)):
            if n:
                rest = tuple(r - each * x for r, x in zip(left, need, strict=True))
                if rest[0] > 0 and rest[1] > 0 and rest[2] > 0:
                    open_.setdefault(rest, []).append((first, n))

    for length in sorted(counts, reverse=True):
        need, todo, rank = (length, 1, length * length), counts[length], 0
        while todo:
            fits = [s for s in open_ if most(s, need) >= 1]
            if fits:
                left = max(fits, key=lambda s: (goodness(s, need), s))
                seq, bins = open_[left].pop()
                if not open_[left]:
                    del open_[left]
            else:
                left = caps
                seq, bins = made, -(-todo // max(1, most(caps, need)))
                made += bins
            k = max(1, most(left, need))
            items = min(todo, k * bins)
            used = -(-items // k)
            if used < bins:
                open_.setdefault(left, []).append((seq + used, bins - used))
            put(left, length, need, rank, items, k, seq, bins)
            todo -= items
            rank += items
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = 1024, end_id: int = 2, **limits) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (see the module)."""
    work = Work(docs.sparkSession, "pack")
    pieces = work.save(named(docs, id_col, text_col).mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES))
    per = work.save(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    runs = best_fit(counts, capacity, **limits)
    plan = docs.sparkSession.createDataFrame(runs or [(0, 0, 0, 1, 0, 0)], "run_length long, r0 long, items long, k long, s0 long, at long")
    base = per.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("length", "part", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    # a few runs a length, whatever the number of documents; beyond a checked size the join shuffles
    hit = ranked.join(F.broadcast(plan) if len(runs) <= SMALL else plan, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r0") + F.col("items")))
    place = F.col("rank") - F.col("r0")
    return hit.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("s0") + F.floor(place / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("at") + (place % F.col("k")) * F.col("length")).cast("long").alias("offset"),
    )
