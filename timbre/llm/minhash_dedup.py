"""MinHash near-dedup with sequential Bayesian verification.

1. Documents with equal shingle sets fall into one class; a class has one signature.
2. Signatures are cut into bands; classes that share a band are candidates.  In each
   band bucket a class is held only against the bucket's leader (a star, never all
   pairs): the class that shares most bands with others.  Each class keeps the two leaders it meets most often.
3. A candidate's signatures are compared batch by batch.  After each batch the
   posterior of the similarity (uniform prior) bounds the chance that it reaches the
   threshold; below the chosen miss probability the candidate goes.  Survivors are
   verified exactly, word by word, on the whole texts.
4. Components of the verified links.  In buckets that still hold several components the
   classes outside the largest one are compared with all others, in blocks of
   bounded size inside array code: signatures first, then an upper bound of the
   overlap from 16-bit shingle codes, which only rules out what cannot be a link.  What
   is left, at most a spanning forest of each block, is verified like any candidate.
   Where a pair is refuted its buckets are compared again, without it and with all other
   candidates of its members, until a round refutes none.

With 32 bands of 4 values a pair of similarity 0.8 shares no band with a chance below 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, discard, join_groups, materialize, mix, odd_keys, row_key, slices, small, split_words, word_names

BANDS = 32
ROWS = 4
BATCH = 16
MISS = 1e-7
LEADERS = 2
#: Classes and bytes of a block in which a bucket is compared.
BLOCK = 2048
BLOCK_BYTES = 4 << 20


def _shingled(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the shingles of ``size`` words, the documents they belong to, and the documents with fewer words."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(np.arange(len(doc)) + size <= offsets[1:][doc]) if len(doc) else doc
    return full, doc[full], np.flatnonzero((n > 0) & (n < size))


def _distinct(owner: np.ndarray, first: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` without repetitions within a document, in order of (document, first), and the documents' offsets."""
    order = np.lexsort((first, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (values[1:] != values[:-1]).reshape(len(owner) - 1, -1).any(1) | (owner[1:] != owner[:-1]) if len(owner) else new[1:]
    values, owner = values[new], owner[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs))]).astype(np.int64)


def shingle_values(names: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document as pairs of 64-bit values, sorted, with offsets, from (words, 2) names.

    A document with fewer than ``size`` words has its whole sequence as one shingle, one without words none.
    """
    full, owner, short = _shingled(offsets, size)
    values = np.zeros((len(full), 2), np.uint64)
    for half in range(2):
        keys = odd_keys(size, 3 + 4 * half)
        for i in range(size):
            values[:, half] += mix(names[full + i, half] + keys[i]) * keys[i]
    values = mix(values)
    if len(short):
        digests = b"".join(xxhash.xxh3_128_digest(names[offsets[i] : offsets[i + 1]].tobytes(), seed=int(offsets[i + 1] - offsets[i])) for i in short)
        values, owner = np.concatenate([values, np.frombuffer(digests, np.uint64).reshape(-1, 2)]), np.concatenate([owner, short])
    return _distinct(owner, values[:, 0], values, len(offsets) - 1)


def shingle_codes(words: pa.Array, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``shingle_values``, as numbers that are equal exactly for equal shingles of these words: nothing is hashed."""
    full, owner, short = _shingled(offsets, size)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    base = len(coded.dictionary) + 1
    values = code[full]
    for i in range(1, size):
        if int(values.max(initial=0)) >= (1 << 62) // base:
            values = np.unique(values, return_inverse=True)[1]
        values = values * base + code[full + i]
    if len(short):
        seen: dict[bytes, int] = {}
        extra = [-1 - seen.setdefault(code[offsets[i] : offsets[i + 1]].tobytes(), len(seen)) for i in short]
        values, owner = np.concatenate([values, np.array(extra, np.int64)]), np.concatenate([owner, short])
    return _distinct(owner, values, values, len(offsets) - 1)


def signatures(values: np.ndarray, offsets: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """(documents with shingles, count) low 16 bits of the least values of ``count`` hash functions."""
    held = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(held), count), np.uint16)
    if not len(held):
        return out
    starts = offsets[:-1][held]
    a, b = odd_keys(count, seed), odd_keys(count, seed + 1)
    part = max(1, 1 << 16)
    # documents in groups whose shingles fit the cache
    at = 0
    while at < len(held):
        end = int(np.searchsorted(starts, starts[at] + part, "right"))
        end = max(end, at + 1)
        lo, hi = starts[at], starts[end] if end < len(held) else len(values)
        v, s = values[lo:hi], starts[at:end] - lo
        for i in range(count):
            out[at:end, i] = np.minimum.reduceat(((v * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), s).astype(np.uint16)
        at = end
    return out


def least_matches(compared: int, threshold: float, miss: float) -> int:
    """The fewest matches among ``compared`` values at which P(similarity >= threshold) is at least ``miss``.

    Uniform prior: the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    n = compared + 1
    tail = 0.0
    for m in range(compared + 1):
        tail += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if tail >= miss:
            return m
    return compared


def bayes_survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int = BATCH) -> np.ndarray:
    """Rows of two signature arrays that no batch rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1] if a.ndim == 2 else 0, batch):
        stop = min(at + batch, a.shape[1])
        matches[alive] += (a[alive, at:stop] == b[alive, at:stop]).sum(1)
        alive = alive[matches[alive] >= least_matches(stop, threshold, miss)]
        if not len(alive):
            break
    return alive


def _prepare(size: int, count: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sig", pa.binary())])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                words, offsets = split_words(pc.ascii_lower(_plain(batch.column("text")[a:b])))
                values, at = shingle_values(word_names(words), offsets, size)
                sig = signatures(values[:, 0], at, count)
                n = np.diff(at)
                nodes: list = [None] * len(n)
                sigs: list = [None] * len(n)
                for row, i in enumerate(np.flatnonzero(n)):
                    nodes[i] = xxhash.xxh3_128_digest(values[at[i] : at[i + 1]].tobytes())
                    sigs[i] = sig[row].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("rk")[a:b], pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return prepare


def _plain(texts: pa.Array) -> pa.Array:
    """ascii_lower asks for valid strings only where there are any."""
    return pc.fill_null(texts, "")


def _prune(threshold: float, miss: float, count: int):
    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(f[c]), np.uint16).reshape(-1, count) for c in ("sig_a", "sig_b"))
                f = f.iloc[bayes_survivors(a, b, threshold, miss)]
            yield f[["a", "b"]]

    return prune


def _exact(size: int, percent: int):
    """Pairs of texts whose shingle sets reach the threshold."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text_a")):
                texts = pa.concat_arrays([batch.column(c)[lo:hi] for c in ("text_a", "text_b")])
                words, offsets = split_words(pc.ascii_lower(_plain(texts)))
                v, at = shingle_codes(words, offsets, size)
                keep = []
                for i in range(hi - lo):
                    j = i + hi - lo
                    x, y = v[at[i] : at[i + 1]], v[at[j] : at[j + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(lo + i)
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], schema=schema)

    return exact


def _codes16(size: int):
    """Of (node, text): 16 bits of each shingle, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                words, offsets = split_words(pc.ascii_lower(_plain(batch.column("text")[a:b])))
                values, at = shingle_values(word_names(words), offsets, size)
                low = values[:, 0].astype(np.uint16)
                sets = [np.sort(low[at[i] : at[i + 1]]).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("node")[a:b], pa.array(sets, pa.binary())], names=["node", "codes"])

    return run


class _Block:
    """Members of a bucket: nodes, components, signatures, and their 16-bit codes one after the other.

    A code that a member has several times counts as several codes, so that a
    set of them is as large as the set of shingles.
    """

    def __init__(self, rows: pa.StructArray, count: int):
        self.nodes, self.comps = (rows.field(f).to_pylist() for f in ("node", "comp"))
        self.refuted = [set(x or ()) for x in rows.field("refuted").to_pylist()]
        self.seek = rows.field("seek").to_numpy(zero_copy_only=False)
        self.sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint16).reshape(-1, count)
        held = rows.field("codes").to_pylist()
        self.size = np.array([len(x) // 2 for x in held], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        low = np.frombuffer(b"".join(held), np.uint16).astype(np.int64)
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        new[self.at[:-1]] = True
        start = np.flatnonzero(new)
        self.codes = low + ((np.arange(len(low)) - np.repeat(start, np.diff(np.append(start, len(low))))) << 16)

    def bands(self, width: int) -> np.ndarray:
        return np.ascontiguousarray(self.sig).view(np.dtype((np.void, 2 * width))).reshape(len(self.nodes), -1)

    def overlap(self, js: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """How many codes of each of ``js`` are marked: at least the number of common shingles."""
        n = self.size[js]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(self.at[js] - (ends - n), n)
        return np.add.reduceat(mark[self.codes[at]].astype(np.int64), ends - n)


def _compare(left: _Block, right: _Block, same: bool, band: int, width: int, percent: int, bound: int, miss: float) -> list[tuple[bytes, bytes]]:
    """Pairs that may be links between components, taken to be links as soon as they are found: a spanning forest of them, unless pairs were refuted.

    ``left``'s seekers meet all of ``right``.  A pair is looked at only in the first band that it shares.
    """
    labels = {c: i for i, c in enumerate(dict.fromkeys(left.comps + right.comps))}
    l_comp, r_comp = (np.array([labels[c] for c in b.comps], np.int64) for b in (left, right))
    l_bands, r_bands = left.bands(width), right.bands(width)
    mark = np.zeros(int(max(left.codes.max(initial=0), right.codes.max(initial=0))) + 1, bool)
    r_names = np.array(right.nodes, "S16")
    out = []
    for i in np.flatnonzero(left.seek):
        js = np.flatnonzero(r_comp != l_comp[i])
        # two seekers meet once
        js = js[~right.seek[js] | ((js > i) if same else (r_names[js] > np.array(left.nodes[i], "S16")))]
        js = js[100 * np.minimum(left.size[i], right.size[js]) >= bound * np.maximum(left.size[i], right.size[js])]
        if band and len(js):
            js = js[~(l_bands[i, :band] == r_bands[js, :band]).any(1)]
        js = js[bayes_survivors(np.broadcast_to(left.sig[i], (len(js), left.sig.shape[1])), right.sig[js], percent / 100, miss)]
        if not len(js):
            continue
        own = left.codes[left.at[i] : left.at[i + 1]]
        mark[own] = True
        most = right.overlap(js, mark)
        mark[own] = False
        union = left.size[i] + right.size[js] - most
        able = np.flatnonzero(100 * most >= bound * union)
        for j in js[able[np.argsort(-(most[able] / np.maximum(union[able], 1)), kind="stable")]]:
            if r_comp[j] == l_comp[i] or right.nodes[j] in left.refuted[i] or left.nodes[i] in right.refuted[j]:
                continue
            out.append((left.nodes[i], right.nodes[j]))
            if left.refuted[i]:  # the bound misled before: all candidates of this one are verified
                continue
            old, new = r_comp[j], l_comp[i]
            r_comp[r_comp == old] = new
            l_comp[l_comp == old] = new
    return out


def _compare_blocks(percent: int, bound: int, miss: float, count: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights, band = (batch.column(c) for c in ("left", "right", "band"))
            out = []
            for k in range(batch.num_rows):
                right = _Block(rights[k].values, count)
                left = _Block(lefts[k].values, count) if lefts[k].is_valid else right
                out += _compare(left, right, left is right, band[k].as_py(), width, percent, bound, miss)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["a", "b"])

    return run


class NearDuplicates:
    """Links and components of ``docs(doc_id, text, ...)``; see the module's text."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS):
        bounded_batches(docs.sparkSession)
        self.size, self.percent, self.bands, self.rows, self.miss = size, percent, bands, rows, miss
        self.count = bands * rows
        #: The similarity, in percent, that the upper bounds of block members must reach to be verified.
        self.bound = percent
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text")
        self.prepared = materialize(self.texts.mapInArrow(_prepare(size, self.count), "doc_id long, rk long, n_shingles long, node binary, sig binary"))
        # a class: one shingle set, with a document that has it, the least id of all, and the number of rows
        first = F.min(F.struct("doc_id", "rk")).alias("first")
        self.classes = materialize(
            self.prepared.where("node is not null").groupBy("node").agg(first, F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("n_shingles").alias("size"), F.any_value("sig").alias("sig"))
        )

    def _buckets(self) -> DataFrame:
        """(bucket, band, node, size, n) for buckets of two classes or more."""
        width = 2 * self.rows
        bands = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(self.bands)))
        members = self.classes.select("node", "size", F.posexplode(bands).alias("band", "bucket"))
        many = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        return materialize(members.join(many, "bucket"))

    def _stars(self, buckets: DataFrame) -> DataFrame:
        """Pairs (a, b) of a class and a leader of its buckets."""
        degree = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
        leaders = buckets.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("leader"))
        met = buckets.join(leaders, "bucket").where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("shared"))
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "leader"))
        met = met.withColumn("place", place).where(F.col("place") <= LEADERS)
        return met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of distinct ``nodes``: one text for each class."""
        need = materialize(nodes.join(self.classes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("n_doc"), F.col("first.rk").alias("n_rk")))
        same = F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("rk") == F.col("n_rk"))
        return self.texts.join(small(need), same).dropDuplicates(["node"]).select("node", "text")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs(a, b)``: those whose full sets reach the threshold."""
        texts = self._texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_exact(self.size, self.percent), "a binary, b binary"))

    def _survivors(self, pairs: DataFrame) -> DataFrame:
        sig = self.classes.select("node", "sig")
        both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        return materialize(both.mapInPandas(_prune(self.percent / 100, self.miss, self.count), "a binary, b binary"))

    def _rest(self, buckets: DataFrame, comps: DataFrame, refuted: DataFrame | None) -> DataFrame:
        """Pairs that may link components, from the buckets that hold several; at most a forest for each block of them.

        In a bucket the members outside its largest component seek partners.  They
        and all members are dealt into blocks of bounded numbers and bytes; each block of seekers
        meets each block of members in one row of array work.
        """
        at = buckets.drop("n").join(comps.select("node", F.col("comp").alias("c")), "node", "left").withColumn("comp", F.coalesce("c", "node")).drop("c")
        weight = F.sum(F.col("size") * 2 + 8 * self.bands + 64)
        parts = at.groupBy("bucket", "comp").agg(F.count("*").alias("k"), weight.alias("w"))
        most = F.struct("k", "comp", "w")
        open_ = parts.groupBy("bucket").agg(F.count("*").alias("comps"), F.max(most).alias("main"), F.sum("k").alias("k"), F.sum("w").alias("w")).where("comps > 1")

        def blocks(k, w):
            return F.greatest(F.ceil(k / BLOCK), F.ceil(w / BLOCK_BYTES)).cast("int")

        open_ = open_.select("bucket", F.col("main.comp").alias("main"), blocks(F.col("k"), F.col("w")).alias("of"), blocks(F.col("k") - F.col("main.k"), F.col("w") - F.col("main.w")).alias("s_of"))
        left = materialize(at.join(open_, "bucket").withColumn("seek", F.col("comp") != F.col("main")).drop("main", "size"))
        held = self._texts(left.select("node").distinct()).mapInArrow(_codes16(self.size), "node binary, codes binary").join(self.classes.select("node", "sig"), "node")
        if refuted is None:
            held = held.withColumn("refuted", F.array().cast("array<binary>"))
        else:
            held = held.join(refuted.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("refuted")), "node", "left")
        full = left.join(held, "node")

        def dealt(rows: DataFrame, of: str) -> DataFrame:
            block = F.pmod(F.xxhash64(F.lit(9), "node"), F.col(of)).cast("int")
            return rows.withColumn("block", block).groupBy("bucket", "band", "block", "of", "s_of").agg(F.collect_list(F.struct("node", "comp", "seek", "sig", "codes", "refuted")).alias("rows"))

        work = _compare_blocks(self.percent, self.bound, self.miss, self.count, self.rows)
        alone = dealt(full.where("of = 1"), "of")
        alone = alone.select(F.when(F.lit(False), F.col("rows")).alias("left"), F.col("rows").alias("right"), "band")
        members = dealt(full.where("of > 1"), "of").select("bucket", "band", F.col("block").alias("j"), F.col("rows").alias("right"), F.explode(F.sequence(F.lit(0), F.col("s_of") - 1)).alias("i"))
        seekers = dealt(full.where("of > 1 and seek"), "s_of").select("bucket", "band", F.col("block").alias("i"), F.col("rows").alias("left"), F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("j"))
        pairs = members.join(seekers, ["bucket", "band", "i", "j"]).select("left", "right", "band")
        links = "a binary, b binary"
        found = materialize(alone.mapInArrow(work, links).unionByName(pairs.mapInArrow(work, links)).distinct())
        discard(left)
        return found

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b) that hold every component together, and the components (node, comp)."""
        buckets = self._buckets()
        links = self._verified(self._survivors(self._stars(buckets)))
        comps = materialize(connected_components(links))
        refuted = None
        while True:
            maybe = self._rest(buckets, comps, refuted)
            if not maybe.limit(1).count():
                return links, comps
            more = self._verified(maybe)
            links = materialize(links.unionByName(more))
            old, comps = comps, materialize(connected_components(links))
            discard(old)
            wrong = materialize(maybe.join(more, ["a", "b"], "left_anti"))
            if not wrong.limit(1).count():
                return links, comps
            wrong = wrong.unionByName(wrong.select(F.col("b").alias("a"), F.col("a").alias("b")))
            # only a refuted pair can have hidden others, and only in a bucket that holds it
            again = buckets.join(wrong.select(F.col("a").alias("node")).distinct(), "node").select("bucket").distinct()
            buckets = materialize(buckets.join(again, "bucket", "left_semi"))
            refuted = materialize(wrong if refuted is None else refuted.unionByName(wrong))

    def components(self) -> DataFrame:
        """(doc_id, rk, n_shingles, component_id) for each row of the documents."""
        _, comps = self.links()
        of = self.classes.select("node", "least", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        of = materialize(of)
        named = join_groups(of.select("node", "n", "comp"), materialize(of.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))), ["comp"], "m")
        named = materialize(named.select("node", "n", "component_id"))
        full = join_groups(self.prepared.where("node is not null").select("doc_id", "rk", "n_shingles", "node"), named, ["node"], "n").select("doc_id", "rk", "n_shingles", "component_id")
        return full.unionByName(self.prepared.where("node is null").select("doc_id", "rk", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text, ...)``.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a document's set
    holds its distinct shingles of ``size`` words (with fewer words the whole
    sequence).  Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable, and the document with that id
    is kept.  Documents without words or text are linked with nothing.  A null
    doc_id counts only where a component holds no other; rows that repeat the
    kept doc_id in its component are all kept.  Other columns are ignored.
    """
    found = NearDuplicates(docs, size, percent, **options).components()
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
