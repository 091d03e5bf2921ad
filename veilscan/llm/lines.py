"""Line dedup by a segment-partition edit join.

Lines (of ``\\n``-split texts, with a word) are one class if they are equal or linked, over any chain: two are linked
at an edit distance of at most ``reach`` characters, and of one a ``per`` characters of the shorter (so with 2 and 15:
lines of fewer than 15 characters if they are equal, of fewer than 30 at distance 1). The first line of a class, by
(id, line number, text hash), stays in its text; all others go.

The join: a line is cut into k + 1 segments of even lengths, k its distance, of which a line within k has one
unchanged, near its place. Each line gives its segments as index entries (length, segment, hash) and, for its own and
shorter lengths, the substrings that may equal one (multi-match-aware windows: 12 for distance 2) as probes. Lines
that meet in an entry are candidates, confirmed by a banded bit-parallel edit distance on the whole lines. An entry
that more than ``most`` lines share says little: its lines are cut into 8, then 24 segments, and meet in all but
k of these instead, which every linked pair does. Entries that the same lines share are one bucket; buckets of up to
``WHOLE`` lines are settled where their lines meet, larger ones by stars (graph.resolve).

Scale: a task sends what it reads as sorted arrays: each distinct line once, with its first place, and each entry
once; of an entry crowded there, a mark and the lines, once. So a shard's rows of one entry are ``most`` a batch at
most, and a line that a third of all texts have is one row a batch; its other places are settled where they are
read. Texts of candidate lines, and texts that lose lines, are the only texts that travel; a bitmap of bounded
size picks the first.

Lines are told apart by 128-bit hashes; the running hashes of segments only propose. Rows are told apart by id and a
64-bit hash of the text, and places are distinct (id, line number, text hash): rows that repeat an id with other texts
lose their own lines only; those that repeat both are one place, so both keep its lines if it is a class's first.

Nulls: a null text has no lines; a null id is ordered last. Very long texts are cut into lines one at a time, whole. An
empty table gives none. Extra columns, whatever their names, are ignored by line_report and kept by dedup_lines.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm import textvec as tv
from veilscan.llm.graph import bitmap, components, hint, resolve
from veilscan.llm.work import Work, shard_bits

U = np.uint64


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is k or less: what both start and end with goes, then a band of 2k + 1 diagonals
    is a machine word of vertical differences, moved on one character at a time."""
    if abs(len(a) - len(b)) > k:
        return False
    n = min(len(a), len(b))
    i = 0
    if a[:n] == b[:n]:
        return True
    step = n
    while step:  # the common start, by halving
        if a[i : i + step] == b[i : i + step] and i + step <= n:
            i += step
        step >>= 1
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    j = 0
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return max(len(a), len(b)) <= k
    m, width = len(a), 2 * k + 1
    full, low = (1 << width) - 1, 1 << 2 * k
    # bit t of column c is row c - k + t; differences of rows above the table are 0
    vp, vn, dist = full & ~((1 << k + 1) - 1), 0, k  # column 0: rows 1..k rise by one; the lowest row has distance k
    for c in range(1, len(b) + 1):
        match = 0
        ch = b[c - 1]
        for t in range(width):
            r = c - k + t
            if 1 <= r <= m and a[r - 1] == ch:
                match |= 1 << t
        # the band moves down by one: last column's differences, seen from the new rows
        up, un = vp >> 1, vn >> 1
        up |= low  # the row that enters lies one above its upper neighbour at most
        d0 = ((((match & up) + up) ^ up) | match | un) & full
        hp = (un | ~(d0 | up)) & full
        hn = d0 & up
        dist += 0 if d0 & low else 1  # along the lowest diagonal
        vp = (hn << 1 | ~(d0 | hp << 1)) & full
        vn = d0 & hp << 1 & full
        if dist - 2 * k > 2 * k:
            return False
    # from the lowest diagonal's row up to row m
    r = len(b) + k
    t = 2 * k
    while r > m:
        dist -= (vp >> t & 1) - (vn >> t & 1)
        r -= 1
        t -= 1
    return dist <= k


def allowed(length, reach: int, per: int):
    """The distance at which a line of so many characters is linked, as the shorter of two: one a ``per`` characters."""
    return np.minimum(reach, length // per)


def segments(length: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Starts and lengths of n even segments of lines of these lengths; the last ones are longer by one."""
    size = [(length + j) // n for j in range(n)]
    return [sum(size[:j], np.zeros_like(length)) for j in range(n)], size


def entries(h: np.ndarray, s: np.ndarray, n: np.ndarray, reach: int, per: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Keys of lines at s of n characters (h: prefix hashes) by one segment of k + 1: yields (keys, whose, is index)."""
    for gap in range(reach + 1):
        length = n - gap
        may = allowed(length, reach, per)
        for k in range(max(gap, 1), reach + 1):
            at = np.flatnonzero(may == k)
            if not len(at):
                continue
            start, own = s[at], length[at]
            p, size = segments(own, k + 1)
            for j in range(k + 1):
                for d in range(max(-j, gap - (k - j)), min(j, gap + (k - j)) + 1):
                    x = start + p[j] + d
                    yield tv.mix(tv.slide_hash(h, x, x + size[j]) ^ (own.astype(U) * U(1_000_003) + U(j)) * U(tv.P)), at, gap == 0 and d == 0


def finer(h: np.ndarray, s: np.ndarray, n: np.ndarray, reach: int, per: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """As entries, by all but k of ``parts`` segments: k edits lie in k segments at most, so what stands before, between
    and after some k of them is unchanged, and moved by a step that the edits before it explain."""

    def piece(x, y):
        return tv.slide_hash(h, x, np.maximum(x, y))

    for gap in range(reach + 1):
        length = n - gap
        may = allowed(length, reach, per)
        for k in range(max(gap, 1), reach + 1):
            at = np.flatnonzero(may == k)
            if not len(at):
                continue
            s0, own = s[at], length[at]
            p, size = segments(own, parts)
            p = [*p, own]
            tag = own.astype(U) * U(1_000_003) + U(parts << 32)
            for chosen in itertools.combinations(range(parts), k):
                # steps after each chosen segment: an edit each, or all in one of two neighbours, when nothing stands between
                between = [(i, chosen[i] + 1, chosen[i + 1]) for i in range(k - 1) if chosen[i] + 1 < chosen[i + 1]]
                steps = itertools.product(range(-(k - 1), k), repeat=len(between))
                for step in steps:
                    path = [0, *step, gap]
                    if between and sum(abs(b - a) for a, b in zip(path, path[1:], strict=False)) > k:
                        continue
                    key = piece(s0, s0 + p[chosen[0]]) * U(3) ^ piece(s0 + p[chosen[-1] + 1] + gap, s0 + own + gap)
                    for d, (_, x, y) in zip(step, between, strict=True):
                        key = tv.mix(key ^ piece(s0 + p[x] + d, s0 + p[y] + d))
                    where = sum((c + 1) << 8 * i for i, c in enumerate(chosen))
                    yield tv.mix(key ^ tv.mix(tag + U(where))), at, gap == 0 and not any(step)


def line_table(column: pa.Array):
    """For each block: (first row, bytes, byte starts, byte ends, code-point starts, lengths, row, number, hash, check) of its
    lines with a word; hash and check are the halves of a 128-bit hash."""
    for i, _, data, offs in tv.blocks(column):
        if not len(data):
            continue
        brk = np.flatnonzero(data == 10)
        s = np.unique(np.concatenate([offs[:-1], brk + 1]))
        s = s[s < len(data)]
        e = np.append(s[1:], len(data))
        e = e - (data[e - 1] == 10)
        row = np.searchsorted(offs, s, "right") - 1
        first = np.searchsorted(s, offs[row])
        number = np.arange(len(s)) - first
        worded = np.concatenate([[0], np.cumsum(~tv.SPACE[data])])
        some = worded[e] > worded[s]
        s, e, row, number = s[some], e[some], row[some], number[some]
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        raw = memoryview(np.ascontiguousarray(data))
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b], tv.SEED) for a, b in zip(s.tolist(), e.tolist(), strict=True)), "<u8").reshape(-1, 2)
        yield i, data, s, e, lead[s], lead[e] - lead[s], row, number, np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])


SENT = "kind string, shard long, a binary, b binary, c binary, d binary, e binary"


def _rows(rows):
    kinds = [pa.string(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([(*r, *[None] * (7 - len(r)))[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "shard", "a", "b", "c", "d", "e"])


#: Lines of a bucket that one task holds against each other.
WHOLE = 256
LAST = np.iinfo(np.int64).max


def _places(h, check, d, no, th):
    """Distinct places, ordered by line, then id, number and text hash; and which are the first of their line."""
    order = np.lexsort((th, no, d, check, h))
    h, check, d, no, th = (x[order] for x in (h, check, d, no, th))
    line = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])[: len(h)]
    new = line | np.concatenate([[True], (d[1:] != d[:-1]) | (no[1:] != no[:-1]) | (th[1:] != th[:-1])])[: len(h)]
    return h[new], check[new], d[new], no[new], th[new], line[new]


def _cuts(keys, bits):
    """Shards, by the top bits, of sorted keys, and where they are."""
    shard = (keys >> U(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else np.zeros(1, int)
    return [(int(shard[x]), slice(x, y)) for x, y in zip(at[:-1], at[1:], strict=True)]


def _keyed(held: list, bits: int, most: int | None) -> list:
    """Rows of entries (keys, lines): 'key' rows by shard; where more than ``most`` lines have a key, 'hot' rows with the key
    and 'node' rows with the lines instead."""
    keys, of = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order = np.lexsort((of, keys))
    keys, of = keys[order], of[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])[: len(keys)]
    keys, of = keys[new], of[new]
    rows = []
    if most is not None and len(keys):
        key = keys >> U(1)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(at, len(key)))
        crowd = np.repeat(n > most, n)
        if crowd.any():
            marks = keys[at][n > most]
            rows = [("hot", x, tv.pack(marks[y])) for x, y in _cuts(marks, bits)]
            rows.append(("node", -1, np.unique(of[crowd]).tobytes()))
            keys, of = keys[~crowd], of[~crowd]
    return rows + [("key", x, tv.pack(keys[at]), of[at].tobytes()) for x, at in _cuts(keys, bits)]


def _first_pass(reach: int, per: int, bits: int, most: int):
    """Sends 'line' rows (hashes; ids; numbers; text hashes; checks) by shard, 'gone' rows (ids; numbers; text hashes) for places
    that a smaller one of the same batch settles, and entries (see _keyed)."""

    def run(batches):
        held, found, size = [], [], 0

        def flush():
            h, check, d, no, th, new = _places(*(np.concatenate([x[i] for x in held]) for i in range(5)))
            rows = [("gone", -1, d[~new].tobytes(), no[~new].tobytes(), th[~new].tobytes())]
            h, check, d, no, th = (x[new] for x in (h, check, d, no, th))
            rows += [("line", x, tv.pack(h[at]), d[at].tobytes(), no[at].tobytes(), th[at].tobytes(), check[at].tobytes()) for x, at in _cuts(h, bits)]
            if found:
                rows += _keyed(found, bits, most)
            held.clear()
            found.clear()
            return _rows(rows)

        for b in batches:
            ids = np.array([LAST if x is None else x for x in b.column(0).to_pylist()], np.int64)
            own = b.column(2).to_numpy(zero_copy_only=False)
            for i, data, _, _, cs, n, row, number, h, check in line_table(b.column(1)):
                cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
                ch = tv.prefix_hash(cp)
                # a line that is here twice sends its entries once
                _, at = np.unique(h, return_index=True)
                for key, whose, index in entries(ch, cs[at], n[at], reach, per):
                    found.append((key & ~U(1) | U(index), h[at][whose]))
                    size += len(key)
                held.append((h, check, ids[i + row], number.astype(np.int32), own[i + row]))
                size += len(h)
                if size > 1_500_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _second_pass(reach: int, per: int, bits: int, parts: int, most: int | None):
    """(node, text) -> entries by finer segments (see _keyed)."""

    def run(batches):
        found, size = [], 0
        for b in batches:
            cps = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in b.column(1).to_pylist()]
            node = b.column(0).to_numpy().view(U)
            n = np.array([len(x) for x in cps], np.int64)
            if not len(n):
                continue
            ch = tv.prefix_hash(np.concatenate(cps))
            for key, whose, index in finer(ch, np.cumsum(n) - n, n, reach, per, parts):
                found.append((key & ~U(1) | U(index), node[whose]))
                size += len(key)
                if size > 1_500_000:
                    yield _rows(_keyed(found, bits, most))
                    found, size = [], 0
        if found:
            yield _rows(_keyed(found, bits, most))

    return run


def _meet(most: int | None):
    """A shard's entries -> (bucket, node, hot): lines that share an entry that is some line's segment; hot ones, which go
    to the next pass, where more than ``most`` do, or did in some batch."""

    def run(table: pa.Table) -> pa.Table:
        rows = {k: [r for r in zip(table["kind"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist(), strict=True) if r[0] == k] for k in ("key", "hot")}
        empty = np.zeros(0, U)
        k = np.concatenate([empty, *(tv.unpack(r[1]) for r in rows["key"])])
        of = np.concatenate([empty, *(np.frombuffer(r[2], U) for r in rows["key"])])
        marks = np.unique(np.concatenate([empty, *(tv.unpack(r[1]) for r in rows["hot"])]) >> U(1))
        order = np.lexsort((of, k >> U(1)))
        k, of = k[order], of[order]
        key, index = k >> U(1), k & U(1)
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        at = np.flatnonzero(new)
        if not len(at):
            return pa.table({"bucket": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "hot": pa.array([], pa.bool_()), "size": pa.array([], pa.int64())})
        group = np.cumsum(new) - 1
        fresh = new | np.concatenate([[True], of[1:] != of[:-1]])
        n = np.add.reduceat(fresh.astype(np.int64), at)
        marked = np.isin(key[at], marks)
        some = ((n > 1) & (np.add.reduceat(index.astype(np.int64), at) > 0)) | marked
        hot = marked | (n > (most if most is not None else len(key)))
        keep = some[group] & fresh
        # a bucket goes by the set of its lines: entries that the same lines share are one
        which = tv.mix(np.add.reduceat(np.where(fresh, tv.mix(of ^ U(0x51)), U(0)), at))[group]
        name, node, hot, size = which[keep], of[keep], hot[group][keep], n[group][keep]
        order = np.lexsort((node, name, hot))
        name, node, hot, size = name[order], node[order], hot[order], size[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (node[1:] != node[:-1]) | (hot[1:] != hot[:-1])])[: len(name)]
        return pa.table({"bucket": pa.array(name[new].view(np.int64)), "node": pa.array(node[new].view(np.int64)), "hot": pa.array(hot[new]), "size": pa.array(size[new])})

    return run


def _firsts(table: pa.Table) -> pa.Table:
    """A shard's lines -> (node, chk, id, number, th, gone): each line's first place, and its other places, marked."""
    h = np.concatenate([tv.unpack(x.as_py()) for x in table["a"]])
    d = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["b"]])
    no = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["c"]])
    th = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["d"]])
    check = np.concatenate([np.frombuffer(x.as_py(), U) for x in table["e"]])
    h, check, d, no, th, first = _places(h, check, d, no, th)
    return pa.table({"node": pa.array(h.view(np.int64)), "chk": pa.array(check.view(np.int64)), "id": pa.array(d), "number": pa.array(no, pa.int32()), "th": pa.array(th), "gone": pa.array(~first)})


def _texts(bits, log: int):
    """(node, chk, text) of lines whose hash is in the bitmap."""

    def run(batches):
        words = np.frombuffer(bits.value, U)
        for b in batches:
            node, check, text = [], [], []
            for _, data, s, e, _, _, _, _, h, c in line_table(b.column(0)):
                x = tv.mix(h) >> U(64 - log)
                hit = np.flatnonzero(words[(x >> U(6)).astype(np.int64)] >> (x & U(63)) & U(1))
                # once a block
                hit = hit[np.unique(h[hit], return_index=True)[1]]
                raw = data.tobytes()
                node += h[hit].view(np.int64).tolist()
                check += c[hit].view(np.int64).tolist()
                text += [raw[p:q] for p, q in zip(s[hit].tolist(), e[hit].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], ["node", "chk", "text"])

    return run


def _confirm(reach: int, per: int):
    def run(batches):
        for b in batches:
            ok = [within(x, y, int(allowed(min(len(x), len(y)), reach, per))) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def _held_whole(reach: int, per: int):
    """(bucket, node, text), a bucket's rows together, WHOLE at most -> edges that connect what is linked in a bucket."""

    def edges(rows, known):
        rows = sorted({(len(t), x, t) for x, t in rows})
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, (n, x, t) in enumerate(rows):
            k = int(allowed(n, reach, per))
            for j in range(i + 1, len(rows)):
                m, y, u = rows[j]
                if m > n + k:
                    break
                p, q = find(i), find(j)
                if p == q:
                    continue
                if (ok := known.get((x, y))) is None:
                    ok = known[x, y] = within(t, u, k)
                if ok:
                    root[max(p, q)] = min(p, q)
                    yield x, y

    def run(batches):
        bucket, rows, known = None, [], {}

        def done():
            found = [(min(e), max(e)) for e in edges(rows, known)]
            if len(known) > 200_000:
                known.clear()
            return found

        for b in batches:
            found = []
            for name, x, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if name != bucket:
                    found += done()
                    bucket, rows = name, []
                rows.append((x, t))
            yield _edges(found)
        yield _edges(done())

    return run


def _edges(found):
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _unpacked(batches):
    for b in batches:
        for x, y, z in zip(b.column(0), b.column(1), b.column(2), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)), pa.array(np.frombuffer(y.as_py(), np.int32)), pa.array(np.frombuffer(z.as_py(), np.int64))], ["id", "number", "th"])


def _nodes(batches):
    for b in batches:
        for x in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64))], ["node"])


def _met(work: Work, sent: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines that share entries: buckets to be resolved, the lines of hot ones, and the table of both."""
    met = work.save(sent.where("kind in ('key', 'hot')").select("shard", "kind", "a", "b").groupBy("shard").applyInArrow(_meet(most), "bucket long, node long, hot boolean, size long"))
    hot = met.where("hot").select("node").unionByName(sent.where("kind = 'node'").select("a").mapInArrow(_nodes, "node long"))
    return met.where("not hot").select("bucket", "node", "size"), hot.distinct(), met


def gone_lines(work: Work, docs: DataFrame, reach: int = 2, per: int = 15, most: int = 32, parts: tuple[int, ...] = (8, 24)) -> DataFrame:
    """docs (id, text) -> (id, th, numbers): the line numbers (from 0) each text loses; th is xxhash64 of the text, a null id 2^63 - 1."""
    bits = shard_bits(docs, 4)
    sent = work.save(docs.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(_first_pass(reach, per, bits, most), SENT))
    firsts = work.save(sent.where("kind = 'line'").groupBy("shard").applyInArrow(_firsts, "node long, chk long, id long, number int, th long, gone boolean"))
    gone = sent.where("kind = 'gone'").select("a", "b", "c").mapInArrow(_unpacked, "id long, number int, th long").unionByName(firsts.where("gone").select("id", "number", "th"))
    members, hot, met = _met(work, sent, most)
    spent = [sent, firsts, met]
    hot = work.save(hot)
    wanted = work.save(members.select("node").unionByName(hot).distinct())
    if not wanted.isEmpty():
        words, log = bitmap_of_hashes(wanted)
        some = docs.select("text").mapInArrow(_texts(docs.sparkSession.sparkContext.broadcast(words), log), "node long, chk long, text string")
        texts = work.save(some.groupBy("node").agg(F.min(F.struct("chk", "text")).alias("x")).select("node", "x.chk", "x.text").join(wanted, "node", "left_semi"))
        for i, n in enumerate(parts):  # crowded entries: finer ones, until none is crowded or the last
            rows = hot.count()
            if not rows:
                break
            last = None if i == len(parts) - 1 else most
            again = work.save(texts.join(hint(hot, rows), "node", "left_semi").select("node", "text").mapInArrow(_second_pass(reach, per, bits, n, last), SENT))
            more, hot, met = _met(work, again, last)
            members, hot = members.unionByName(more), work.save(hot)
            spent += [again, met]
        members = members.distinct()
        few = members.where(F.col("size") <= WHOLE).join(texts, "node").select("bucket", "node", "text")
        edges = work.save(few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_held_whole(reach, per), "a long, b long").distinct())
        crowds = members.where(F.col("size") > WHOLE).select("bucket", "node", F.lit(1).alias("n"))
        a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")

        def linked(pairs: DataFrame) -> DataFrame:
            return hint(pairs).join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_confirm(reach, per), "a long, b long")

        if not crowds.isEmpty():
            edges = edges.unionByName(resolve(work, crowds, linked))
        if not edges.isEmpty():
            comp = work.save(components(work, edges))
            comp = comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct())
            # two lines of one 64-bit hash are two: links hold for the one whose text was held against others
            comp = comp.join(texts.select("node", "chk"), "node")
            place = firsts.where("not gone").join(comp, ["node", "chk"]).select("component", F.struct("id", "number", "th").alias("p"))
            best = place.groupBy("component").agg(F.min("p").alias("best"))
            gone = gone.unionByName(place.join(best, "component").where("p <> best").select("p.id", "p.number", "p.th"))
    out = work.save(gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("number")).alias("numbers")))
    work.drop(*spent)
    return out


def bitmap_of_hashes(ids: DataFrame) -> tuple[bytes, int]:
    """As graph.bitmap, by the mixer that the array code uses."""

    def mixed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tv.mix(b.column(0).to_numpy().view(U)).view(np.int64))], ["h"])

    return bitmap(ids.mapInArrow(mixed, "h long"), "h")


def _strip(batches):
    """Counts and digests of texts without the lines named in the last column."""
    for b in batches:
        id_, text, nums = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
        out = []
        for t, gone in zip(text, nums, strict=True):
            lines, drop = (t or "").split("\n"), set(gone or ())
            left = [x for i, x in enumerate(lines) if i not in drop]
            out.append((len(lines), len(gone or ()), "\n".join(left)))
        yield pa.RecordBatch.from_arrays(
            [id_, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([len(x[2]) for x in out], pa.int64()), pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out], pa.string())],
            ["id", "n_lines", "n_removed", "kept_chars", "kept_sha256"],
        )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, kept_chars, kept_sha256 (of the text without removed lines)."""
    work = Work(docs.sparkSession, "lines")
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    gone = gone_lines(work, src, **options).withColumnRenamed("id", "gid")
    hit = src.join(gone, (F.coalesce("id", F.lit(LAST)) == F.col("gid")) & (F.xxhash64("text") == F.col("th")), "left").select("id", "text", "numbers")
    return hit.mapInArrow(_strip, "id long, n_lines long, n_removed long, kept_chars long, kept_sha256 string").withColumnRenamed("id", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with texts without removed lines; texts that lose all their lines go, texts that had none stay as they are."""
    work = Work(docs.sparkSession, "lines")
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    gone = gone_lines(work, src, **options).withColumnRenamed("id", "_gid").withColumnRenamed("th", "_gth")
    gone = gone.withColumnRenamed("numbers", "__gone_lines")
    hit = docs.join(gone, (F.coalesce(docs[id_col], F.lit(LAST)) == F.col("_gid")) & (F.xxhash64(docs[text_col]) == F.col("_gth")), "left")
    parts = f"split(`{text_col}`, '\\n', -1)"
    left = F.expr(f"transform(array_except(sequence(0, size({parts}) - 1), __gone_lines), i -> {parts}[i])")
    text = F.when(F.col("__gone_lines").isNull(), hit[text_col]).otherwise(F.array_join(left, "\n"))
    out = hit.withColumn("__left_text", text).where(F.col("__gone_lines").isNull() | F.col("__left_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("__left_text").alias(c) if c == text_col else out[c] for c in docs.columns])
