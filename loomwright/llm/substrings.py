"""Substring dedup: words of repeated windows go, found by backward search in FM-indexes.

A window is `window` consecutive words of one text. A window repeats if the same words start earlier (smaller
doc_id, or the same document and an earlier word); the words it covers are removed. Windows are judged
on the input, not on what is left.

Streaming every document past an index of every other would grow with the square of the corpus, so shards
follow content: a window's anchor is its run of ANCHOR words of smallest hash (the leftmost of equal ones).
Equal windows have equal anchors. Neighbouring windows with one anchor form a segment, some seven windows
long. Then

1. one pass over the texts writes (anchor, segment hash, place) for each segment, a narrow table;
2. anchors seen once drop out. Of segments seen several times all but the first go as a whole, by a minimum
   that is combined before the shuffle, so hot passages cost no more than others;
3. the first places of different segments that share an anchor get their words back and are dealt into
   shards by anchor. Each shard is indexed: suffixes sorted, the Burrows-Wheeler transform in a wavelet
   matrix of packed bits with counts. Its segments are streamed past the index: backward search from each
   word gives the matching statistic (how many words up to here occur elsewhere too, up to a window), and
   where it reaches a window, the interval of suffixes gives its first place;
4. an anchor shared by over HOT different segments (a common line in ever new surroundings, the edge of
   a very common passage) would make one shard grow with the corpus. Its windows are dealt by their own
   hash instead, minima again combined before the shuffle;
5. texts meet the intervals to remove, and what is kept is digested.

Words compare by their text in the index. Steps 1, 2 and 4 compare by 96 and more hash bits.

Defined cases: null texts and texts without words have no words and keep the digest of the empty text. A null
doc_id stands before all others (and so would the smallest long). Rows of equal doc_id and text
are copies of one document: none is earlier than the other, so what is removed is removed from both. Rows
of equal doc_id and different text are compared by place too: at the same place none is earlier. Texts of
any length count whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, likely_in, read_table, text_of

WINDOW, ANCHOR = 20, 10
#: Words of a shard, and different segments of an anchor from which its windows are dealt by their own hash.
SHARD_WORDS, HOT = 1 << 19, 2048
#: Bytes and windows taken at once, which bounds the memory of a long text.
SLICE, STRIDE = 1 << 20, 1 << 20

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _OTHER
    return x ^ (x >> np.uint64(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def sums(x: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of x[i] base^i, and base^-i: two of the first give a run's hash, times the second at its start."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        ups = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), base, np.uint64)]))
        downs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), inverse, np.uint64)]))
        return np.concatenate([[np.uint64(0)], np.cumsum(x * ups[:-1])]), downs


def run_hash(total: np.ndarray, downs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((total[end] - total[start]) * downs[start] + (end - start).astype(np.uint64) * _BASE)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word, a slice of bytes at a time (a word is never cut)."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(whole):
        end = min(len(whole), at + SLICE)
        while end < len(whole):
            gaps = np.flatnonzero(_GAP[whole[end : end + SLICE]])
            end += int(gaps[0]) if len(gaps) else SLICE
            if len(gaps):
                break
        part = whole[at : min(end, len(whole))]
        edge = np.diff(np.concatenate([[True], _GAP[part], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total, downs = sums(_BYTE[part], _BASE)
        hashes.append(run_hash(total, downs, first, last))
        starts.append(first + at)
        at += len(part)
    return np.concatenate(hashes), np.concatenate(starts)


def segments(words: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor, hash, first word and number of words of every segment. doc: number of each word's document, ascending."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(words) - window + 1, STRIDE):
        part = words[at : at + STRIDE + window - 1]
        total, downs = sums(part, _STEP)
        first = np.arange(len(part) - k + 1)
        gram = run_hash(total, downs, first, first + k)
        n = len(part) - window + 1
        span, best = 1, first  # leftmost place of the least hash among `span` neighbours
        while span < window - k + 1:
            hop = min(span, window - k + 1 - span)
            a, b = best[:-hop], best[hop:]
            best, span = np.where(gram[b] < gram[a], b, a), span + hop
        best = best[:n]
        own = doc[at : at + n] == doc[at + window - 1 : at + window - 1 + n]
        new = own.copy()
        new[1:] &= ~own[:-1] | (best[1:] != best[:-1])
        head = np.flatnonzero(new)
        stop = np.flatnonzero(own & ~np.concatenate([own[1:] & ~new[1:], [False]])) + window
        whole, back = sums(part, _OTHER)
        out.append((gram[best[head]].astype(np.uint32).view(np.int32), run_hash(whole, back, head, stop).view(np.int64), head + at, stop - head))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _groups(table, size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `size` bytes: number of the first, texts."""
    first, group, held = 0, [], 0
    for n, text in enumerate(table):
        group.append(text)
        held += len(text)
        if held >= size:
            yield first, group
            first, group, held = n + 1, [], 0
    if group:
        yield first, group


def digest(words: list[bytes]) -> str:
    return sha256(b" ".join(words)).hexdigest()


def _scan(window: int, k: int):
    """doc, tid, text -> a row for each segment, and one with start -1 for each text: its words and digest."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            docs, tids = batch.column("doc").to_numpy(), batch.column("tid").to_numpy()
            for first, group in _groups(texts):
                data = b" ".join(group)
                words, at = word_hashes(data)
                bounds = np.cumsum([0, *[len(t) + 1 for t in group]])
                doc = np.searchsorted(bounds, at, side="right") - 1
                count = np.bincount(doc, minlength=len(group))
                anchor, seg, start, n = segments(words, doc, window, k)
                of, before = doc[start], np.cumsum(count) - count
                row, none = first + np.concatenate([of, np.arange(len(group))]), len(group)
                yield pa.RecordBatch.from_pydict({
                    "doc": docs[row], "tid": tids[row], "anchor": pa.array([*anchor.tolist(), *[None] * none], pa.int32()), "seg": pa.array([*seg.tolist(), *[None] * none], pa.int64()),
                    "start": np.concatenate([start - before[of], np.full(none, -1)]).astype(np.int32), "n": np.concatenate([n, count]).astype(np.int32),
                    "sha": pa.array([*[None] * len(seg), *[digest(t.split()) for t in group]], pa.string()),
                })

    return run


class FMIndex:
    """FM-index over codes 0..: the Burrows-Wheeler transform as a wavelet matrix, one plane of packed bits a binary digit.

    Suffixes are sorted by their first `depth` codes at least; patterns may be that long.
    """

    def __init__(self, codes: np.ndarray, depth: int) -> None:
        self.n, rank, span = len(codes), codes.astype(np.int64), 1
        while span < depth:
            after = np.zeros(self.n, np.int64)
            after[:-span] = rank[span:] + 1
            rank, span = np.unique(rank * (self.n + 2) + after, return_inverse=True)[1], 2 * span
        self.suffix = np.argsort(rank, kind="stable")
        last = codes[self.suffix - 1]
        sigma = int(codes.max(initial=0)) + 1
        self.digits, self.planes = range(max(1, (sigma - 1).bit_length()) - 1, -1, -1), []
        for d in self.digits:
            bit = (last >> d) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.planes.append((packed, before, self.n - int(bit.sum())))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        less = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])
        every = np.arange(sigma)
        self.less, self.shift = less, less[:-1] - self._down(every, np.zeros(sigma, np.int64))

    def _down(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place of the transform lands after all planes, going the way of `code`."""
        for d, (packed, before, zeros) in zip(self.digits, self.planes, strict=True):
            block = at >> 6
            ones = before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((code >> d) & 1 == 1, zeros + ones, at - ones)
        return at

    def extend(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: a bound of the interval of a pattern becomes that of code + pattern."""
        return self.shift[code] + self._down(code, at)

    def matching(self, codes: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end: how many codes up to it (at most limit) the index holds twice or more, and their interval."""
        length, low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        live = np.arange(len(ends))
        for t in range(limit):
            c = codes[ends[live] - t]
            a, b = (self.extend(c, low[live]), self.extend(c, high[live])) if t else (self.less[c], self.less[c + 1])
            more = b - a >= 2
            live, a, b = live[more], a[more], b[more]
            low[live], high[live], length[live] = a, b, t + 1
            if not len(live):
                break
        return length, low, high


def repeated_runs(texts: list[list[bytes]], doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of runs covered by windows that start earlier in another or the same text.

    Text i holds the words of document doc[i] from word start[i] on; each has a window at least.
    """
    import pandas as pd

    size = np.array([len(t) for t in texts], np.int64)
    flat: list[bytes | None] = []
    for t in texts:
        flat += t
        flat.append(None)  # the end of a text has code 0 and is in no pattern
    codes = pd.factorize(np.array(flat, object))[0].astype(np.int64) + 1
    of = np.repeat(np.arange(len(texts)), size + 1)
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    index = FMIndex(codes, window)
    ends = np.flatnonzero((codes > 0) & (offset >= window - 1))
    length, low, high = index.matching(codes, ends, window)
    full = length == window
    head, low, high = ends[full] - window + 1, low[full], high[full]
    if not len(head):
        return (np.zeros(0, np.int64),) * 3
    where, at = doc[of], start[of] + offset
    order = np.lexsort((at, where))
    place = np.zeros(len(codes), np.int64)
    place[order[1:]] = np.cumsum((np.diff(where[order]) != 0) | (np.diff(at[order]) != 0))
    low, one, own = np.unique(low, return_index=True, return_inverse=True)
    high = high[one]
    earliest = np.minimum.reduceat(np.append(place[index.suffix], 0), np.stack([low, high], 1).ravel())[::2]
    head = head[place[head] > earliest[own]]
    new = np.diff(head, prepend=-2) != 1
    first, last = head[new], head[np.roll(new, -1)]
    return of[first], offset[first], last - first + window


def _cut_out(window: int):
    """doc, tid, text, wanted -> the words of each wanted segment; of hot anchors, of each of its windows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for doc, tid, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "tid", "text", "wanted")), strict=True):
                words = text.encode().split()
                for w in wanted:
                    s, n = w["start"], w["n"]
                    for a, b in [(i, window) for i in range(s, s + n - window + 1)] if w["hot"] else [(s, n)]:
                        rows.append((doc, tid, w["anchor"], w["hot"], a, b" ".join(words[a : a + b])))
                if len(rows) > 20_000:
                    yield pack(pa, rows)
                    rows = []
            yield pack(pa, rows)

    def pack(pa, rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (("doc", pa.int64()), ("tid", pa.int32()), ("anchor", pa.int32()), ("hot", pa.bool_()), ("start", pa.int32()), ("words", pa.binary()))
        return pa.RecordBatch.from_pydict({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)})

    return run


def _index_shard(window: int):
    def run(part):
        import pandas as pd

        text, first, n = repeated_runs([w.split(b" ") for w in part["words"]], part["doc"].to_numpy(), part["start"].to_numpy(np.int64), window)
        return pd.DataFrame({"doc": part["doc"].to_numpy()[text], "tid": part["tid"].to_numpy()[text], "start": (part["start"].to_numpy(np.int64)[text] + first).astype("int32"), "n": n.astype("int32")})

    return run


def _keep(batches):
    """doc_id, text, runs -> what is left of each text."""
    import pyarrow as pa

    for batch in batches:
        n_words, n_removed, sha = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words), bool)
            for r in runs:
                gone[r["start"] : r["start"] + r["n"]] = True
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            sha.append(digest([words[i] for i in np.flatnonzero(~gone)]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def repeated(docs: DataFrame, work: Scratch, *, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (doc_id, doc, tid, text), their heads (doc, tid, n, sha), and runs to remove (doc, tid, start, n)."""
    texts = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.shiftright(F.xxhash64("text"), 33).cast("int").alias("tid"), "text")
    scan = work.cut(texts.select("doc", "tid", "text").mapInArrow(_scan(window, anchor), "doc long, tid int, anchor int, seg long, start int, n int, sha string"))
    heads, all_places = scan.where("start < 0").select("doc", "tid", "n", "sha"), scan.where("start >= 0").drop("sha")

    shared = all_places.groupBy("anchor").agg(F.min("seg").alias("_a"), F.max("seg").alias("_b"), F.count("*").alias("_n")).where("_n > 1").select("anchor", (F.col("_a") != F.col("_b")).alias("several"))
    shared = work.cut(shared)
    places = work.cut(likely_in(all_places, F.col("anchor"), shared, F.col("anchor")).join(shared, "anchor"))
    first = places.groupBy("anchor", "seg").agg(F.min(F.struct("doc", "start", "tid")).alias("at"), F.count("*").alias("copies"), F.max("several").alias("several"), F.max("n").alias("n"))
    first = work.cut(first)
    work.drop(shared)
    copied = first.where("copies > 1").select("anchor", "seg", "at")
    later = likely_in(places, F.col("seg"), copied, F.col("seg")).join(copied, ["anchor", "seg"]).where(F.struct("doc", "start") > F.struct("at.doc", "at.start")).select("doc", "tid", "start", "n")

    wanted = first.where("several").select("anchor", "at.*", "n")
    crowds = wanted.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot"))
    lists = wanted.join(crowds, "anchor", "left").groupBy("doc", "tid").agg(F.collect_list(F.struct("start", "n", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    lists = work.cut(lists)
    total = lists.select(F.explode("wanted").alias("w")).agg(F.sum("w.n")).first()[0] or 0
    met = likely_in(texts, F.col("doc"), lists, F.col("doc")).join(lists, ["doc", "tid"]).select("doc", "tid", "text", "wanted")
    pieces = work.cut(met.mapInArrow(_cut_out(window), "doc long, tid int, anchor int, hot boolean, start int, words binary"))
    work.drop(lists)
    least = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(least, -(-total // shard_words)))).alias("shard")
    found = pieces.where("not hot").groupBy(shard).applyInPandas(_index_shard(window), "doc long, tid int, start int, n int")

    single = pieces.where("hot").select("doc", "tid", "start", "anchor", F.xxhash64("words").alias("w"))
    once = single.groupBy("anchor", "w").agg(F.min(F.struct("doc", "start")).alias("at"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    crowded = single.join(once, ["anchor", "w"]).where(F.struct("doc", "start") > F.col("at")).select("doc", "tid", "start", F.lit(window).alias("n"))
    return texts, heads, later.unionByName(found).unionByName(crowded)


def dedup_substrings(docs: DataFrame, **how: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for every row of docs."""
    work = Scratch(docs.sparkSession)
    texts, heads, runs = repeated(docs, work, **how)
    runs = work.cut(runs.groupBy("doc", "tid").agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    cut = likely_in(texts, F.col("doc"), runs, F.col("doc")).join(runs, ["doc", "tid"]).select("doc_id", "text", "runs")
    cut = cut.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    whole = heads.join(runs.select("doc", "tid"), ["doc", "tid"], "left_anti")
    whole = whole.select(F.expr(f"nullif(doc, {-(1 << 63) + 1} - 1)").alias("doc_id"), F.col("n").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return work.finish(cut.unionByName(whole))


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, s + o.o AS i FROM again, (SELECT unnest(range(0, 20)) AS o) o
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
