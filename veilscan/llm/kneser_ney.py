"""Word n-gram modified Kneser-Ney scores, counted and looked up by Spark in sorted hash arrays.

Words are hashed, A-Z lowered; a text starts with two start marks. Every distinct trigram (u, v, w) of every text is
counted into adjusted counts, as Kneser-Ney has them below its highest order: c(vw) is the number of different u
before vw, and pc(w) the share of contexts that w follows. A text that is copied a thousand times so weighs as one,
and is no less surprising than another.

The words are dealt to parts by v, and the parts are counted, then scored, one after the other, each from the texts: only what
one part sends lies on disk at a time, besides the model.

Counting: each task reduces chunks of what it reads to sorted distinct trigrams and sends them, coded by a dictionary,
to shards by v; a frequent trigram is one entry a chunk. A shard merges its chunks' entries to pairs with their
counts, their contexts' totals, counts of counts (which give the three discounts by language), and how many contexts
each word follows; the last are added up by word and sent back to the shards that have the word.

Scoring: p(w|v) = (c(vw) - D) / c(v) + g(v) * pc(w), with pc the share of contexts that w follows and g(v) the mass
that discounts, and pairs seen after one u only, leave: a text's own rare pairs do not vouch for it (so the model keeps
the other pairs only). Words seen after one v only share the rest of pc evenly. That holds at every size: each chunk's words go to
the shards of their v and are scored there, and sums by text go back to the chunk. Nothing that grows with the input is broadcast.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm import textvec as tv
from veilscan.llm.work import Work, shard_bits

U = np.uint64
#: Words of a chunk.
HELD = 2_000_000
#: Log2 of the number of parts, by v, that are counted and scored one after the other, each from the texts: it bounds the disk.
PART_BITS = 2
#: Scores of words are negative log-probabilities in steps of 1 / STEP: a text's mean is off by half a step at most.
STEP = 900


def events(wh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, u), 64-bit hashes, for each word w; first has the index of each text's first word, and the end."""
    mixed = tv.mix(wh ^ U(0x5BD1E995))
    start = first[:-1][first[:-1] < len(wh)]
    ctx, far = np.zeros(len(wh), U), np.zeros(len(wh), U)
    ctx[1:] = mixed[:-1]
    ctx[start] = U(0)
    far[1:] = ctx[:-1]
    far[start] = U(0)
    return ctx, mixed, far


def squash(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unsquash(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(k) else c


def coded(*columns: np.ndarray) -> bytes:
    """Columns of one length, rows sorted by the first two, as their distinct values, sorted, and places among them: of the first
    column, and of the second where the first stays, differences only."""
    values, at = np.unique(np.concatenate(columns), return_inverse=True)
    at = at.reshape(len(columns), -1)
    at[1, 1:] -= np.where(at[0, 1:] == at[0, :-1], at[1, :-1], 0)
    at[0, 1:] -= at[0, :-1].copy()
    values = tv.pack(values)
    return len(values).to_bytes(8, "little") + values + squash(at.ravel())


def places(blob: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    cut = 8 + int.from_bytes(blob[:8], "little")
    at = unsquash(blob[cut:]).reshape(columns, -1).copy()
    start = np.flatnonzero(np.concatenate([[True], at[0, 1:] != 0])) if at.size else np.zeros(0, np.int64)
    run = np.cumsum(at[1])
    at[1] = run - np.repeat(run[start] - at[1, start], np.diff(np.append(start, len(run))))
    at[0] = np.cumsum(at[0])
    return tv.unpack(blob[8:cut]), at


def decoded(blob: bytes, columns: int) -> np.ndarray:
    values, at = places(blob, columns)
    return values[at]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Shards, by the top bits, of sorted keys, and where they are."""
    shard = (keys >> U(64 - bits)).astype(np.int64)
    at = np.append(np.flatnonzero(changes(shard)), len(shard))
    return [(int(shard[a]), slice(a, b)) for a, b in zip(at[:-1], at[1:], strict=True)]


SENT = "lang string, kind string, shard long, chunk string, a binary, b binary, c binary"
_NAMES = ["lang", "kind", "shard", "chunk", "a", "b", "c"]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)


def by_language(column: pa.Array, langs: list, part: int) -> Iterator:
    """For each block and language: (language, rows that have a word, v, w and u of each word whose v is of the part, its text's place among the rows)."""
    for i, j, data, offs in tv.blocks(column):
        s, e, first = tv.word_spans(data, offs)
        ev = events(tv.span_hash(tv.LOWER[data], s, e), first)
        n = np.diff(first)
        mine = np.flatnonzero((ev[0] >> U(64 - PART_BITS)) == U(part))
        ev, row = [x[mine] for x in ev], np.repeat(np.arange(len(n)), n)[mine]
        names = np.array([x or "" for x in langs[i:j]], object)
        for lang in sorted(set(names)):
            has = (names == lang) & (n > 0)
            own = np.flatnonzero(has[row])
            yield lang, i + np.flatnonzero(has), *(x[own] for x in ev), (np.cumsum(has) - 1)[row[own]]


def _chunks(batches, part: int, most: int) -> Iterator:
    """Words whose v is of the part, in chunks of about ``most``: lists of (language, v, w, u, each word's place among the chunk's
    texts, these texts' two hashes)."""
    held, size = defaultdict(list), 0

    def flushed():
        out = []
        for lang, runs in held.items():
            texts = np.cumsum([0] + [len(x[4]) for x in runs])
            v, w, u = (np.concatenate([x[i] for x in runs]) for i in range(3))
            of = np.concatenate([x[3] + k for x, k in zip(runs, texts[:-1], strict=True)])
            out.append((lang, v, w, u, of, *(np.concatenate([x[i] for x in runs]) for i in (4, 5))))
        held.clear()
        return out

    for b in batches:
        t1, t2 = (b.column(i).to_numpy(zero_copy_only=False) if b.num_columns > 2 else np.zeros(b.num_rows, np.int64) for i in (2, 3))
        for lang, rows, v, w, u, of in by_language(b.column(0), b.column(1).to_pylist(), part):
            if len(v):
                held[lang].append((v, w, u, of, t1[rows], t2[rows]))
                size += len(v)
            if size > most:
                yield flushed()
                size = 0
    if size:
        yield flushed()


def _count(bits: int, part: int, most: int):
    """Sends 'event' rows: distinct v, w, u of a chunk, by shard."""

    def run(batches):
        for chunk in _chunks(batches, part, most):
            rows = []
            for lang, v, w, u, *_ in chunk:
                order = np.lexsort((u, w, v))
                v, w, u = v[order], w[order], u[order]
                new = changes(v, w, u)
                v, w, u = v[new], w[new], u[new]
                rows += [(lang, "event", x, None, coded(v[y], w[y], u[y]), None, None) for x, y in _cuts(v, bits)]
            yield _batch(rows)

    return run


def _use(bits: int, part: int, most: int):
    """Sends 'use' rows (v, w and text of every word) by shard, and a 'text' row (text hashes; numbers of words) by chunk and language."""

    def run(batches):
        task = TaskContext.get()
        task = task.partitionId() if task else 0
        for k, chunk in enumerate(_chunks(batches, part, most)):
            rows, name = [], f"{task}.{k}"
            for lang, v, w, _, of, t1, t2 in chunk:
                rows.append((lang, "text", -1 - (task * 31 + k) % 65536, name, np.concatenate([t1, t2]).tobytes(), squash(np.bincount(of, minlength=len(t1))), None))
                order = np.lexsort((of, w, v))
                v, w, of = v[order], w[order], of[order]
                rows += [(lang, "use", x, name, coded(v[y], w[y]), squash(of[y]), len(t1).to_bytes(8, "little")) for x, y in _cuts(v, bits)]
            yield _batch(rows)

    return run


def _shard(bits: int, finer: int):
    """Events travel in few shards, whose dictionaries are small for what they hold; each is split here by ``finer`` bits."""

    def run(table: pa.Table) -> pa.Table:
        """One shard's events -> a 'pair' row (pairs seen after two words or more; their counts; their contexts' totals), words by ranges,
        counts of counts."""
        lang, shard = table["lang"][0].as_py(), table["shard"][0].as_py()
        parts = [(x, at.astype(np.uint32)) for x, at in (places(x.as_py(), 3) for x in table["a"])]
        pairs, words, least = [], [], np.zeros(6, np.int64)
        for sub in range(1 << finer):
            # v is the first column, in order
            low = U((shard << finer) + sub)
            part = []
            for x, at in parts:
                a = np.searchsorted(at[0], np.searchsorted(x, low << U(64 - bits - finer)))
                b = at.shape[1] if sub == (1 << finer) - 1 else np.searchsorted(at[0], np.searchsorted(x, (low + U(1)) << U(64 - bits - finer)))
                part.append(x[at[:, a:b]])
            if any(x.shape[1] for x in part):
                v, w, c = merged(part)
                total = np.add.reduceat(c, np.flatnonzero(changes(v)))[np.cumsum(changes(v)) - 1]
                again = c > 1
                pairs.append((v[again], w[again], c[again], total[again]))
                words.append(np.unique(w, return_counts=True))
                least += np.bincount(np.minimum(c, 5), minlength=6)
        v, w, c, total = (np.concatenate(x) for x in zip(*pairs, strict=True))
        of = np.flatnonzero(least)
        rows = [(lang, "pair", shard, None, coded(v, w), squash(c), squash(total)), (lang, "least", shard, None, tv.pack(of.astype(U)), squash(least[of]), None)]
        k, n = added(*zip(*words, strict=True))
        rows += [(lang, "word", x, str(shard), tv.pack(k[y]), squash(n[y]), None) for x, y in _cuts(k, bits)]
        return pa.Table.from_batches([_batch(rows)])

    def merged(parts):
        v, w, u = np.concatenate(parts, axis=1)
        order = np.lexsort((u, w, v))
        v, w, u = v[order], w[order], u[order]
        new = changes(v, w)
        c = np.add.reduceat((new | changes(u)).astype(np.int64), np.flatnonzero(new))
        return v[new], w[new], c

    return run


def _words(table: pa.Table) -> pa.Table:
    """A range of words -> 'pc' rows (words; contexts they follow, if several) for the shards that have them, and totals."""
    lang, shard = table["lang"][0].as_py(), table["shard"][0].as_py()
    keys = [tv.unpack(x.as_py()) for x in table["a"]]
    k, c = added(keys, [unsquash(x.as_py()) for x in table["b"]])
    rows = []
    for x, own in zip(table["chunk"].to_pylist(), keys, strict=True):
        n = c[np.searchsorted(k, own)]
        rows.append((lang, "pc", int(x), None, tv.pack(own[n > 1]), squash(n[n > 1]), None))
    seen = c[c > 1]
    rows.append((lang, "total", shard, None, squash(np.array([len(c), c.sum(), len(seen), seen.sum()])), None, None))
    return pa.Table.from_batches([_batch(rows)])


def placed(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where x is among sorted distinct values; -1 if nowhere."""
    if not len(values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return np.where(values[at] == x, at, -1)


def _scores(discounts: dict, totals: dict):
    def run(table: pa.Table) -> pa.Table:
        """A shard's pairs, their words' contexts and the words of each chunk -> 'sum' rows: log-probabilities by text of each chunk."""
        lang, shard = table["lang"][0].as_py(), table["shard"][0].as_py()
        if shard < 0:  # texts go by
            return table
        at_kind = defaultdict(list)
        for i, kind in enumerate(table["kind"].to_pylist()):
            at_kind[kind].append(i)
        cell = lambda i, name: table[name][i].as_py()
        (i,) = at_kind["pair"]
        v, w = decoded(cell(i, "a"), 2)
        c, total = unsquash(cell(i, "b")), unsquash(cell(i, "c"))
        new = changes(v)
        ctx = np.cumsum(new) - 1
        d = np.array([0.0, *discounts[lang]])[np.minimum(c, 3)]
        share = np.append((c - d) / total, 0.0)
        # a context whose pairs were all seen after one word only leaves all its mass
        mass = np.append(1 - np.bincount(ctx, share[:-1]), 1.0)
        v = v[new]
        w, of = np.unique(w, return_inverse=True)
        key = (ctx << 32) + of
        k, n = added([tv.unpack(cell(i, "a")) for i in at_kind["pc"]], [unsquash(cell(i, "b")) for i in at_kind["pc"]])
        types, all_, seen_types, seen = totals[lang]
        rare = max(all_ - seen, 1) / max(types - seen_types, 1) / max(all_, 1)
        pc = np.append(n / max(all_, 1), rare)
        rows = []
        for i in at_kind["use"]:
            values, (a, b) = places(cell(i, "a"), 2)
            new = changes(a, b)
            left, right = placed(v, values), placed(w, values)
            x, y = left[a[new]], right[b[new]]
            pair = placed(key, np.where((x >= 0) & (y >= 0), (x << 32) + y, -1))
            score = np.minimum(np.rint(-log_prob(share[pair], mass[x], pc[placed(k, values)][b[new]]) * STEP), 65535)
            texts = int.from_bytes(cell(i, "c"), "little")
            sums = np.bincount(unsquash(cell(i, "b")), score[np.cumsum(new) - 1], minlength=texts)
            rows.append((lang, "sum", shard, cell(i, "chunk"), squash(sums), None, None))
        return pa.Table.from_batches([_batch(rows)])

    return run


SUMS = "lang string, t1 long, t2 long, s long, n long"


def _sums(table: pa.Table) -> pa.Table:
    """A chunk's texts and their log-probabilities by shard -> each text's sum, and number of words."""
    kinds = table["kind"].to_pylist()
    (i,) = (i for i, kind in enumerate(kinds) if kind == "text")
    n = unsquash(table["b"][i].as_py())
    t1, t2 = np.frombuffer(table["a"][i].as_py(), np.int64).reshape(2, -1)
    s = np.zeros(len(n), np.int64)
    for j, kind in enumerate(kinds):
        if kind == "sum":
            s += unsquash(table["a"][j].as_py())
    return pa.table({"lang": pa.array([table["lang"][i].as_py()] * len(n), pa.string()), "t1": pa.array(t1), "t2": pa.array(t2), "s": pa.array(s), "n": pa.array(n)})


def log_prob(own: np.ndarray, back: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(own + back * word, 1e-30))


def losses(work: Work, docs: DataFrame) -> DataFrame:
    """docs (text, lang, t1, t2; the last two hash the text) -> lang, t1, t2, loss: a row a distinct text with a word; the mean
    negative log-probability a word under the model of all texts of its language ('' for null)."""
    bits, finer = max(PART_BITS + 1, 1 + shard_bits(docs, 1, each=64 << 20, parts=False)), 2

    def save(df: DataFrame, by: str | None = None) -> DataFrame:
        out = work.save(df, by)
        del df
        gc.collect()
        work.spark.sparkContext._jvm.System.gc()  # Spark's cleaner then frees shuffles that are no longer read
        return out

    texts = docs.select("text", "lang")
    parts = [save(texts.mapInArrow(_count(bits, k, HELD), SENT).groupBy("lang", "shard").applyInArrow(_shard(bits, finer), SENT), "kind") for k in range(1 << PART_BITS)]
    shards = reduce(DataFrame.unionByName, parts)
    words = save(shards.where("kind = 'word'").groupBy("lang", "shard").applyInArrow(_words, SENT))
    for x in parts:
        work.drop(x, only="kind=word")
    # a few numbers a language
    counts: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for r in shards.where("kind = 'least'").select("lang", "a", "b").toLocalIterator():
        for c, n in zip(tv.unpack(bytes(r[1])).tolist(), unsquash(bytes(r[2])).tolist(), strict=True):
            counts[r[0]][c] += n
    totals: dict[str, list[int]] = {}
    for r in words.where("kind = 'total'").select("lang", "a").toLocalIterator():
        totals[r[0]] = [x + y for x, y in zip(totals.get(r[0], [0] * 4), unsquash(bytes(r[1])).tolist(), strict=True)]
    discounts = {}
    for lang, n in counts.items():
        n1, n2, n3, n4 = (max(1, n.get(c, 0)) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[lang] = [min(max(d, 0.1), cap) for d, cap in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.85))]
    sums = []
    for k, x in enumerate(parts):
        known = x.where("kind = 'pair'").unionByName(words.where("kind = 'pc'").where(F.shiftright("shard", bits - PART_BITS) == k))
        used = docs.select("text", "lang", "t1", "t2").mapInArrow(_use(bits, k, HELD), SENT).unionByName(known)
        sums.append(save(used.groupBy("lang", "shard").applyInArrow(_scores(discounts, totals), SENT).groupBy("lang", "chunk").applyInArrow(_sums, SUMS)))
        del used
    # copies add to both sums alike
    out = save(reduce(DataFrame.unionByName, sums).groupBy("lang", "t1", "t2").agg((F.sum("s") / F.sum("n") / STEP).alias("loss")))
    work.drop(*parts, words, *sums)
    return out
