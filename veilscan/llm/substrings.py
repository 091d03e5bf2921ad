"""Suffix-array dedup: bytes in strings of ``span`` bytes that also start anywhere else, in any text, are removed.

Anchors: any span of 400 bytes holds 201 strings of 200 bytes; the positions of the smallest hash among them depend on
the span's bytes alone, so equal spans have equal anchors (about one byte in a hundred is one). Two equal spans thus
meet among the occurrences of one anchor's 200 bytes, at the same distance from it.

Among an anchor's occurrences the texts to its left (read backwards) and to its right are put in order by deep-shallow
sorting: multikey quicksort on 8-byte words down to a shallow depth, then blind tries for the groups that still
share their start. With the common prefixes of neighbours, a span that starts s bytes before the anchor is
repeated if another occurrence is in its run of common left texts of s bytes and in its run of common right texts of
span - s bytes: runs of two sorted orders, for each s.

Scale: a first pass sends the anchors' hashes only, sorted and difference-coded, and finds those that occur twice; a
second sends the surroundings of those (each distinct one once a task). Bitmaps of bounded size pick them. Equal
surroundings are settled by their hash. Texts travel only if they lose bytes. An anchor's distinct surroundings
meet in one task: these, not copies, bound its memory.

Nulls: a null text is empty; texts shorter than a span lose nothing; rows that repeat an id and a text lose the same.
An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm import textvec as tv
from veilscan.llm.graph import bitmap
from veilscan.llm.work import Work, shard_bits

U = np.uint64
BLOCK = 1 << 19
#: Words of 8 bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 4


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width], shorter at the end."""
    out, w = x, 1
    while 2 * w <= width:
        out = np.concatenate([op(out[:-w], out[w:]), out[-w:]])
        w *= 2
    if w < width:
        d = width - w
        out = np.concatenate([op(out[:-d], out[d:]), out[-d:]])
    return out


def anchors(data: np.ndarray, offs: np.ndarray, span: int, gram: int):
    """(row, position, left, right, gram hash, surroundings' hash) of a block's anchors; positions are the block's;
    left and right: bytes of the text within reach of a span that holds the anchor."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty, empty, empty.astype(U), empty.astype(U)
    h = tv.prefix_hash(data)
    g = np.full(n, ~U(0))
    at = np.arange(n - gram + 1)
    g[: n - gram + 1] = tv.slide_hash(h, at, at + gram)
    width = span - gram + 1
    least = sliding(g, width, np.minimum)
    # spans that cross a text's end say nothing
    end = np.repeat(offs[1:], np.diff(offs))
    own = np.arange(n)
    least[end - own < span] = 0
    # g[j] is an anchor if it is the smallest of some span: the largest least of those it is in
    most = sliding(least[::-1], width, np.maximum)[::-1]
    pos = np.flatnonzero((g == most) & (end - own >= gram) & (most != 0))
    row = np.searchsorted(offs, pos, "right") - 1
    a, b = np.minimum(pos - offs[row], span - gram), np.minimum(offs[row + 1] - pos, span)
    # the running hash only picks: what is equal is told by hashes of the bytes
    around = tv.mix(tv.span_hash(data, pos - a, pos + b) ^ (a * 1000 + b).astype(U))
    return row, pos, a, b, tv.span_hash(data, pos, pos + gram), around


def _cuts(keys: np.ndarray, bits: int):
    shard = (keys >> U(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else np.zeros(1, int)
    return [(int(shard[x]), slice(x, y)) for x, y in zip(at[:-1], at[1:], strict=True)]


def _first_pass(span: int, gram: int, bits: int):
    """(shard, grams, surroundings, twice): distinct pairs of hashes a flush."""

    def run(batches):
        held, size = [], 0

        def flush():
            k, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.lexsort((c, k))
            k, c = k[order], c[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            at = np.flatnonzero(new)
            twice = np.diff(np.append(at, len(k))) > 1
            k, c = k[at], c[at]
            held.clear()
            rows = [(s, tv.pack(k[x]), c[x].tobytes(), np.packbits(twice[x]).tobytes()) for s, x in _cuts(k, bits)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.binary(), pa.binary(), pa.binary()])], ["shard", "k", "c", "twice"])

        for b in batches:
            for _, _, data, offs in tv.blocks(b.column(0), BLOCK):
                _, _, _, _, g, c = anchors(data, offs, span, gram)
                if len(g):
                    held.append((g, c))
                    size += len(g)
            if size > 1_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """(gram, mixed): anchors that occur twice or more; mixed: with different surroundings."""
    k = [tv.unpack(x.as_py()) for x in t["k"]]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(y)] for x, y in zip(t["twice"], k, strict=True)]).astype(bool)
    k, c = np.concatenate(k), np.concatenate([np.frombuffer(x.as_py(), U) for x in t["c"]])
    order = np.lexsort((c, k))
    k, c, twice = k[order], c[order], twice[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    at = np.flatnonzero(new)
    many = (np.diff(np.append(at, len(k))) > 1) | np.logical_or.reduceat(twice, at)
    fresh = new | np.concatenate([[True], c[1:] != c[:-1]])
    mixed = np.add.reduceat(fresh.astype(np.int64), at) > 1
    return pa.table({"gram": pa.array(k[at][many].view(np.int64)), "mixed": pa.array(mixed[many])})


SENT = "kind string, shard long, k binary, c binary, where binary, texts binary"
_KINDS = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
PLACE = np.dtype([("id", "<i8"), ("th", "<i8"), ("pos", "<i4"), ("a", "<i2"), ("b", "<i2"), ("twice", "<i2")])


def _in(bits: np.ndarray, log: int, h: np.ndarray) -> np.ndarray:
    x = h >> U(64 - log)
    return (bits[(x >> U(6)).astype(np.int64)] >> (x & U(63)) & U(1)).astype(bool)


def _second_pass(span: int, gram: int, bits: int, wanted, mixed):
    """'at' rows: the anchors that occur twice, by shard, with their places and, if surroundings differ, these (left
    backwards, right, zero-padded); 'span' rows, dealt to shards below 0: places settled by equal surroundings in the same block."""
    import zstandard

    side = span - gram

    def run(batches):
        w, wl = np.frombuffer(wanted.value[0], U), wanted.value[1]
        m, ml = np.frombuffer(mixed.value[0], U), mixed.value[1]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = np.array([np.iinfo(np.int64).max if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            th = batch.column(1).to_numpy()
            rows, held = [], []
            for i, _, data, offs in tv.blocks(batch.column(2), BLOCK):
                row, pos, a, b, g, c = anchors(data, offs, span, gram)
                some = _in(w, wl, g) if len(g) else np.zeros(0, bool)
                if not some.any():
                    continue
                row, pos, a, b, g, c = (x[some] for x in (row, pos, a, b, g, c))
                place = np.zeros(len(g), PLACE)
                place["id"], place["th"], place["pos"], place["a"], place["b"] = ids[i + row], th[i + row], pos - offs[row], a, b
                order = np.lexsort((pos, c, g))
                pos, a, b, g, c, place = (x[order] for x in (pos, a, b, g, c, place))
                new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(g)))
                place["twice"] = np.repeat(n > 1, n)
                again = place[place["twice"] == 1]
                if len(again):
                    rows.append(("span", -1 - int(again["th"][0]) % 4096, None, None, again.tobytes(), None))
                mix = _in(m, ml, g[at])
                p = at[mix]
                step = np.arange(side)
                left = data[np.maximum(pos[p, None] - 1 - step, 0)]
                left[step >= a[p, None]] = 0
                right = data[np.minimum(pos[p, None] + gram + step, len(data) - 1)]
                right[step >= b[p, None] - gram] = 0
                held.append((g[at], c[at], place[at], mix, np.concatenate([left, right], axis=1)))
            if held:
                g, c, place, mix, text = (np.concatenate([x[k] for x in held]) for k in range(5))
                order = np.lexsort((c, g))
                line = (np.cumsum(mix) - 1)[order]
                g, c, place, mix = g[order], c[order], place[order], mix[order]
                for s, x in _cuts(g, bits):
                    texts = squeeze(text[line[x][mix[x]]].tobytes()) if mix[x].any() else None
                    rows.append(("at", s, tv.pack(g[x]), c[x].tobytes(), place[x].tobytes(), texts))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], ["kind", "shard", "k", "c", "where", "texts"])

    return run


def blind_trie(strings: list[bytes]) -> list[int]:
    """The order of distinct strings: each goes down by the branching bytes alone, is compared once with the leaf it ends
    at, and branches off where they differ."""
    root: list | int = 0  # a leaf is its number, an inner node [depth, {byte: child}]

    def leaf(node):
        while isinstance(node, list):
            node = next(iter(node[1].values()))
        return node

    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node, list):
            node = node[1].get(s[node[0]], next(iter(node[1].values())))
        t = strings[node]
        lo, hi = 0, len(s)
        while lo < hi:  # the common prefix, by halving
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if s[:mid] == t[:mid] else (lo, mid - 1)
        parent, node = None, root
        while isinstance(node, list) and node[0] < lo:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == lo:
            node[1][s[lo]] = i
            continue
        new = [lo, {s[lo]: i, strings[leaf(node)][lo]: node}]
        if parent is None:
            root = new
        else:
            parent[1][s[parent[0]]] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += [c for _, c in sorted(node[1].items(), reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow(group: np.ndarray, text: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """The order of the rows of ``text`` (bytes) within groups, groups ascending. With ``size``, rows equal but for their padding
    go shortest first: a text's end is below a zero byte."""
    words = np.ascontiguousarray(text).view(">u8").astype(U)
    order = np.argsort(group, kind="stable") if size is None else np.lexsort((size, group))
    rank = group[order]
    for d in range(min(SHALLOW, words.shape[1])):  # multikey quicksort, a word at a time within equal starts
        w = words[order, d]
        again = np.lexsort((w, rank))
        order, w, rank = order[again], w[again], rank[again]
        rank = np.cumsum(np.concatenate([[0], (rank[1:] != rank[:-1]) | (w[1:] != w[:-1])]))
    if len(order) < 2:
        return order
    at = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1], [True]]))
    for x, y in zip(at[:-1], at[1:], strict=True):
        if y - x > 1:
            rows = order[x:y]
            by: dict[bytes, list[int]] = {}
            for r in rows.tolist():
                by.setdefault(text[r].tobytes(), []).append(r)
            if len(by) > 1:
                keys = list(by)
                order[x:y] = [r for k in blind_trie(keys) for r in by[keys[k]]]
    return order


def common(group: np.ndarray, text: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted row with the one before; -1 at a group's first."""
    out = np.full(len(order), -1)
    for x in range(1, len(order), 1 << 16):
        a, b = order[x - 1 : x - 1 + (1 << 16)], order[x : x + (1 << 16)]
        a = a[: len(b)]
        ne = np.concatenate([text[a] != text[b], np.ones((len(b), 1), bool)], axis=1)
        n = np.minimum(np.argmax(ne, axis=1), np.minimum(size[a], size[b]))
        out[x : x + len(b)] = np.where(group[a] == group[b], n, -1)
    return out


def shared_offsets(group: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the smallest and largest s (0 to side) for which another row of its group has the same s bytes on the
    left and side - s on the right; (side + 1, -1) if none."""
    n = len(group)
    orders = [deep_shallow(group, x, z) for x, z in ((left, a), (right, b))]
    lcps = [common(group, x, z, o) for x, z, o in zip((left, right), (a, b), orders, strict=True)]
    lo, hi = np.full(n, side + 1), np.full(n, -1)
    runs = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for s in range(side + 1):
        for run, order, lcp, need in zip(runs, orders, lcps, (s, side - s), strict=True):
            run[order] = np.cumsum(lcp < need)
        ok = (a >= s) & (b >= side - s)
        key = (runs[0].astype(U) << U(32) | runs[1].astype(U))[ok]
        rows = np.flatnonzero(ok)
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(rows), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        rows = rows[hit]
        hi[rows] = s
        lo[rows] = np.minimum(lo[rows], s)
    return lo, hi


def _resolve(span: int, gram: int, mixed):
    side = span - gram

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        if t["kind"][0].as_py() == "span":
            p = np.concatenate([np.frombuffer(x.as_py(), PLACE) for x in t["where"]])
            p = p[p["a"].astype(int) + p["b"] >= span]
            return _spans(p["id"], p["th"], p["pos"] - p["a"], p["pos"] + p["b"])
        expand = zstandard.ZstdDecompressor().decompress
        m, ml = np.frombuffer(mixed.value[0], U), mixed.value[1]
        ks = [tv.unpack(x.as_py()) for x in t["k"]]
        k, c = np.concatenate(ks), np.concatenate([np.frombuffer(x.as_py(), U) for x in t["c"]])
        p = np.concatenate([np.frombuffer(x.as_py(), PLACE) for x in t["where"]])
        has = _in(m, ml, k)
        texts = [np.frombuffer(expand(x.as_py()), np.uint8).reshape(-1, 2 * side) for x in t["texts"] if x.is_valid]
        text = np.concatenate(texts) if texts else np.zeros((0, 2 * side), np.uint8)
        line = np.cumsum(has) - 1  # row of text of each that has one
        order = np.lexsort((c, k))
        new = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (c[order][1:] != c[order][:-1])])
        cls = np.empty(len(k), np.int64)
        cls[order] = np.cumsum(new) - 1
        rep = order[np.flatnonzero(new)]
        many = (np.bincount(cls) > 1) | (np.bincount(cls, p["twice"]) > 0)
        full = many[cls]
        start, end = p["pos"] - p["a"], p["pos"] + p["b"]
        lo, hi = np.full(len(k), side + 1), np.full(len(k), -1)
        # distinct surroundings of anchors that have several
        kr = k[rep]
        groups = np.concatenate([[True], kr[1:] != kr[:-1]])
        gid = np.cumsum(groups) - 1
        several = (np.bincount(gid) > 1)[gid] & has[rep]
        r = rep[several]
        if len(r):
            tx = text[line[r]]
            x, y = shared_offsets(gid[several], tx[:, :side], tx[:, side:], p["a"][r].astype(np.int64), p["b"][r].astype(np.int64) - gram, side)
            lo[r], hi[r] = x, y
        single = ~full & (hi >= 0)
        start = np.where(full, start, p["pos"] - hi)
        end = np.where(full, end, p["pos"] - lo + span)
        keep = (full & (p["a"].astype(np.int64) + p["b"] >= span)) | single
        return _spans(p["id"][keep], p["th"][keep], start[keep], end[keep])

    return run


def _spans(i, t, s, e) -> pa.Table:
    return pa.table({"id": pa.array(i, pa.int64()), "th": pa.array(t, pa.int64()), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32))})


def repeated_spans(work: Work, docs: DataFrame, span: int = 400, gram: int = 200) -> DataFrame:
    """docs (id, th, text) -> (id, th, spans): each text's removed byte ranges, merged, as [start, end] pairs.
    A null id is 2^63 - 1; th is the text's xxhash64."""
    bits = shard_bits(docs, 6, each=1 << 20)
    sc = docs.sparkSession.sparkContext
    first = docs.select("text").mapInArrow(_first_pass(span, gram, bits), "shard long, k binary, c binary, twice binary")
    found = work.save(first.groupBy("shard").applyInArrow(_repeated, "gram long, mixed boolean"))
    wanted, mixed = (sc.broadcast(bitmap(x, "gram")) for x in (found, found.where("mixed")))
    sent = docs.mapInArrow(_second_pass(span, gram, bits, wanted, mixed), SENT)
    spans = sent.groupBy("shard").applyInArrow(_resolve(span, gram, mixed), "id long, th long, s int, e int")
    out = work.save(spans.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans")))
    work.drop(found)
    return out


def _report(batches):
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = text or b""
            kept, removed, n, at = hashlib.sha256(), 0, 0, 0
            for x in spans or ():
                s, e = x["s"], x["e"]
                if s > at or n == 0:
                    kept.update(text[at:s])
                    n += 1
                    removed += e - s
                    at = e
                elif e > at:
                    removed += e - at
                    at = e
            kept.update(text[at:])
            out.append((len(text), removed, n, kept.hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    work = Work(docs.sparkSession, "repeats")
    src = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    spans = repeated_spans(work, src, span, span // 2).withColumnsRenamed({"id": "i", "th": "t"})
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(spans.select("t").distinct(), "t"))

    def filtered(batches, hit: bool):
        w, log = np.frombuffer(bits.value[0], U), bits.value[1]
        for b in batches:
            yield b.filter(pa.array(_in(w, log, b.column(1).to_numpy().view(U)) == hit))

    def likely(batches):
        yield from filtered(batches, True)

    def untouched(batches):
        for b in filtered(batches, False):
            b = b.append_column("spans", pa.nulls(b.num_rows, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))))
            yield from _report([b.select([0, 2, 3])])

    # a text without removed bytes is done where it is read
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    hit = src.mapInArrow(likely, src.schema).join(spans, (F.coalesce("id", F.lit(2**63 - 1)) == F.col("i")) & (F.col("th") == F.col("t")), "left").select("id", "text", "spans")
    return src.mapInArrow(untouched, out).unionByName(hit.mapInArrow(_report, out)).withColumnRenamed("id", id_col)
