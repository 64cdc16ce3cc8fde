"""Repeated passages across documents, by broadcast suffix automata of reference shards.

A window is so many consecutive words; windows that also stand in a document
with a smaller id are removed. The reference side is the text that recurs:

1. Runs of windows with the same anchor (the least hash of a gram among those
   of the window) are passages. Equal windows have equal anchors, so only
   passages whose anchor two documents have can matter. Equal passages (by a
   128-bit digest) are looked at once, in the document with the smallest id:
   its copies in later documents are repeated as a whole.
2. The windows of these distinct passages are dealt by a 128-bit hash; a window
   of several documents makes its first passage part of the reference, and its
   other passages ask for it.
3. Reference passages are dealt to shards of a bounded size by a hash of their
   place. Tasks grow a suffix automaton over each shard in the order of its
   documents and pack it into flat arrays. The automata are broadcast a few at
   a time, behind a check of their size, and the passages that ask stream
   through the automata they ask: matching statistics of the window's length or
   more tell, word by word, the first document of every window. Maximal spans
   of such windows are removed.

Passages go to the shards of those first documents that their hashes name, so
neither a line in very many contexts nor a mass copy gathers in one place, and
the number of passages streamed does not grow with the number of shards.

A null text has no words, an empty or short one keeps all. Ids are integers
(others stop the job). Rows with equal ids are never compared with each other,
and repeated rows lose the same words; a row without an id is left as it is.
Very long texts are walked whole; nothing is capped. Columns of the docs are
kept but for those of the outputs' names, which are replaced; an empty table
has an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import gram_hashes, join_groups, mix64, raw_rows, shared_path, sliding_min, small_batches, staged, text_or_empty, word_ids

WINDOW = 50
ANCHOR = 20
#: Windows of one passage at most, and reference passages of one shard (about 66 words each).
RUN = 64
SHARD_PASSAGES = 4000
#: Shards that one job broadcasts, and bytes of a packed automaton at most.
BUNDLE = 8
SHARD_BYTES = 256 << 20
ROWS = 1 << 15


def passage_runs(ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each passage of a text."""
    if len(ids) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = min(ANCHOR, window)
    anchors = sliding_min(gram_hashes(ids, gram), window - gram + 1)
    starts = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1))
    length = np.diff(np.concatenate((starts, [len(anchors)])))
    if length.max() > RUN:  # periodic texts keep an anchor for long
        starts = np.concatenate([np.arange(s, s + n, RUN) for s, n in zip(starts.tolist(), length.tolist())])
        length = np.diff(np.concatenate((starts, [len(anchors)])))
    return starts, length, anchors[starts]


def _passages(docs: DataFrame, window: int) -> DataFrame:
    """``id, th, at, n, anchor, d1, d2``: every passage of every text, without its words."""

    def rows(batches):
        import xxhash

        for batch in batches:
            parts = [[], [], [], [], []]
            for k, raw in enumerate(raw_rows(batch.column("text"))):
                ids = word_ids(raw.split())
                at, n, anchor = passage_runs(ids, window)
                if len(at):
                    flat, step = ids.tobytes(), 8
                    parts[0].append(np.full(len(at), k))
                    parts[1].append(at)
                    parts[2].append(n)
                    parts[3].append(anchor)
                    digests = b"".join([xxhash.xxh3_128_digest(flat[a * step : (a + b + window - 1) * step]) for a, b in zip(at.tolist(), n.tolist())])
                    parts[4].append(np.frombuffer(digests, np.int64).reshape(-1, 2))
            if not parts[0]:
                continue
            of, at, n, anchor, digest = (np.concatenate(x) for x in parts)
            columns = [pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())]
            whole = pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), batch.column("th").take(pa.array(of)), *columns], ["id", "th", "at", "n", "anchor", "d1", "d2"])
            for low in range(0, whole.num_rows, ROWS):
                yield whole.slice(low, ROWS)

    return docs.where("id is not null").mapInArrow(rows, "id long, th long, at int, n int, anchor long, d1 long, d2 long")


def _walk(sequence, window: int, step, link, length, first):
    """For each window of ``sequence``, in order: the rank it was first added with, or None."""
    state = size = 0
    for i, symbol in enumerate(sequence):
        while (to := step(state, symbol)) < 0 and state:
            state = link[state]
            size = length[state]
        if to >= 0:
            state, size = to, size + 1
        while state and length[link[state]] >= window:
            state = link[state]
            size = length[state]
        if i >= window - 1:
            yield first[state] if size >= window else None


class SuffixAutomaton:
    """Of several sequences, each with the rank of its first document; fed in order of rank."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]

    def _state(self, length: int, link: int, edges: dict, first: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The part of state ``q`` that ``p`` and ``symbol`` reach, on its own."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = new
            p = self.link[p]
        return new

    def add(self, sequence, rank) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}, rank), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
            last = new

    def firsts(self, sequence, window: int):
        return _walk(sequence, window, lambda state, symbol: self.next[state].get(symbol, -1), self.link, self.length, self.first)

    def packed(self) -> bytes:
        """Flat arrays of states and edges; symbols are 64-bit integers, the edges of a state are sorted by them."""
        count = np.fromiter(map(len, self.next), np.int64, len(self.next))
        symbols = np.fromiter(chain.from_iterable(self.next), np.int64, int(count.sum()))
        targets = np.fromiter(chain.from_iterable(map(dict.values, self.next)), np.int64, len(symbols))
        order = np.lexsort((symbols, np.repeat(np.arange(len(count)), count)))
        parts = (np.array([len(count), len(symbols)]), np.array(self.first, np.int64), symbols[order], np.concatenate(([0], np.cumsum(count))).astype(np.int32), targets[order].astype(np.int32), np.array(self.link, np.int32), np.array(self.length, np.int32))
        return b"".join(x.tobytes() for x in parts)


class PackedAutomaton:
    """A broadcast automaton, read where it lies."""

    def __init__(self, packed: bytes):
        n, edges = np.frombuffer(packed, np.int64, 2).tolist()
        at, self.parts = 16, []
        for kind, size in ((np.int64, n), (np.int64, edges), (np.int32, n + 1), (np.int32, edges), (np.int32, n), (np.int32, n)):
            self.parts.append(memoryview(np.frombuffer(packed, kind, size, at)))
            at += size * np.dtype(kind).itemsize

    def firsts(self, sequence, window: int):
        first, symbols, starts, targets, link, length = self.parts

        def step(state, symbol):
            high = starts[state + 1]
            at = bisect_left(symbols, symbol, starts[state], high)
            return targets[at] if at < high and symbols[at] == symbol else -1

        return _walk(sequence, window, step, link, length, first)


def runs(places) -> list[tuple[int, int]]:
    """``(first, number)`` of each run of consecutive numbers."""
    x = np.unique(np.asarray(places, np.int64))
    starts = np.concatenate(([0], np.flatnonzero(np.diff(x) > 1) + 1)) if len(x) else np.zeros(0, np.int64)
    return list(zip(x[starts].tolist(), np.diff(np.append(starts, len(x))).tolist()))


PLACE = ["id", "th", "at"]


def _fetched(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """``id, th, at, words`` of passages (id, th, at, n)."""
    wanted = places.groupBy("id", "th").agg(F.collect_list(F.struct("at", "n")).alias("wanted"))

    def fetch(batches):
        for batch in batches:
            for doc, th, raw, asked in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), raw_rows(batch.column("text")), batch.column("wanted").to_pylist()):
                ids = word_ids(raw.split()).view(np.int64)
                for low in range(0, len(asked), ROWS >> 5):
                    part = asked[low : low + (ROWS >> 5)]
                    words = [ids[x["at"] : x["at"] + x["n"] + window - 1] for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), pa.int64()), pa.array([th] * len(part), pa.int64()), pa.array([x["at"] for x in part], pa.int32()), pa.array(words, pa.list_(pa.int64()))], [*PLACE, "words"])

    # rows that repeat an id and its text are one
    sources = docs.join(wanted, ["id", "th"]).select("id", "th", "text", "wanted")
    return sources.mapInArrow(fetch, "id long, th long, at int, words array<long>").dropDuplicates(PLACE)


def _windows(passages: DataFrame, window: int) -> DataFrame:
    """``w1, w2, id, th, at, off``: the 128-bit hash of every window of the passages."""

    def rows(batches):
        for batch in batches:
            words = batch.column("words")
            offsets, flat = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64)
            parts = []
            for k in range(batch.num_rows):
                ids = flat[offsets[k] : offsets[k + 1]]
                first, second = gram_hashes(ids, window), gram_hashes(mix64(ids ^ np.uint64(0xA5A5A5A5A5A5A5A5)), window)
                parts.append((np.full(len(first), k), np.arange(len(first), dtype=np.int32), first.view(np.int64), second.view(np.int64)))
            of, off, first, second = (np.concatenate(x) for x in zip(*parts))
            owner = batch.select(PLACE).take(pa.array(of))
            whole = pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), *owner.columns, pa.array(off)], ["w1", "w2", *PLACE, "off"])
            for low in range(0, whole.num_rows, ROWS):
                yield whole.slice(low, ROWS)

    return passages.where(F.size("words") > 0).mapInArrow(rows, "w1 long, w2 long, id long, th long, at int, off int")


def build_automata(reference: DataFrame, window: int) -> DataFrame:
    """``shard, automaton``: the packed automaton of each shard of ``reference`` (shard, id, words, offs)."""

    def build(batches):
        shard, automaton = None, None
        for batch in batches:
            for key, doc, words, offs in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "words", "offs"))):
                if key != shard:
                    if automaton:
                        yield _row(shard, automaton)
                    shard, automaton = key, SuffixAutomaton()
                for at, n in runs(offs):
                    automaton.add(words[at : at + n + window - 1], doc)
        if automaton:
            yield _row(shard, automaton)

    def _row(shard, automaton):
        packed = automaton.packed()
        if len(packed) > SHARD_BYTES:
            raise ValueError(f"shard {shard} has {len(packed)} bytes, {SHARD_BYTES} at most are broadcast")
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([packed], pa.binary())], ["shard", "automaton"])

    dealt = reference.select("shard", "id", "words", "offs").repartition("shard").sortWithinPartitions("shard", "id", "offs", "words")
    return dealt.mapInArrow(build, "shard long, automaton binary")


def matched_windows(asks: DataFrame, automata: DataFrame, shards: int, window: int) -> DataFrame:
    """``id, th, at, off, n``: runs of windows of ``asks`` (shard, id, th, at, words, offs) that a smaller id has.

    Some automata at a time are broadcast; the asks of other shards are not read meanwhile.
    """
    spark, path = asks.sparkSession, shared_path(asks.sparkSession, "matched-windows")
    kind = "id long, th long, at int, off int, n int"

    def stream(shared):
        def rows(batches):
            shard = automaton = None
            for batch in batches:
                out = []
                words = batch.column("words")
                offsets, flat = words.offsets.to_numpy(), words.values.to_numpy()
                for k, (key, doc, th, at, offs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", *PLACE, "offs")))):
                    if key != shard:
                        shard, automaton = key, PackedAutomaton(shared[key].value)
                    sequence = flat[offsets[k] : offsets[k + 1]].tolist()
                    for low, n in runs(offs):
                        firsts = automaton.firsts(sequence[low : low + n + window - 1], window)
                        out += [(doc, th, at, off, m) for off, m in runs([low + i for i, f in enumerate(firsts) if f is not None and f < doc])]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], [*PLACE, "off", "n"])

        return rows

    spark.createDataFrame([], kind).write.parquet(path)
    for low in range(0, shards, BUNDLE):
        some = F.col("shard").between(low, low + BUNDLE - 1)
        shared = {r["shard"]: spark.sparkContext.broadcast(bytes(r["automaton"])) for r in automata.where(some).toLocalIterator()}
        if shared:
            asks.where(some).mapInArrow(stream(shared), kind).write.mode("append").option("compression", "zstd").parquet(path)
        for one in shared.values():
            one.destroy()
    return spark.read.schema(kind).parquet(path)


def _asked(passages: DataFrame, window: int) -> DataFrame:
    """``id, th, at, off, n``: runs of windows of distinct ``passages`` (id, th, at, words) that a document with a smaller id has."""
    key = ["w1", "w2"]
    windows = staged(_windows(passages, window), "windows")
    recurring = windows.groupBy(*key).agg(F.min(F.struct(*PLACE, "off")).alias("first"), F.max("id").alias("high"), F.count("*").alias("n_windows")).where("first.id < high")
    recurring = staged(recurring.select(*key, "first", "n_windows"), "recurring-windows")
    places = recurring.select(*(f"first.{c}" for c in PLACE)).distinct()
    shards = max(1, -(-places.count() // SHARD_PASSAGES))
    shard_of = lambda n, *place: F.pmod(F.xxhash64(*place), F.lit(n))
    while (places.groupBy(shard_of(shards, *PLACE)).count().agg(F.max("count")).head()[0] or 0) > 2 * SHARD_PASSAGES:
        shards *= 2
    owned = recurring.groupBy(*(F.col(f"first.{c}").alias(c) for c in PLACE)).agg(F.sort_array(F.collect_list("first.off")).alias("offs"))
    reference = passages.join(owned, PLACE).withColumn("shard", shard_of(shards, *PLACE))
    automata = staged(build_automata(reference, window), "automata")
    later = join_groups(windows, recurring, key, "n_windows", [*PLACE, "off"]).where("first.id < id").withColumn("shard", shard_of(shards, *(f"first.{c}" for c in PLACE)))
    later = later.groupBy("shard", *PLACE).agg(F.collect_list("off").alias("offs"))
    asks = staged(passages.join(later, PLACE).repartitionByRange("shard", *PLACE).sortWithinPartitions("shard"), "asking-passages")
    return matched_windows(asks, automata, shards, window)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, th, spans``: runs of words (first, number) that an earlier document has, per row of ``docs`` (id, th, text)."""
    passages = staged(_passages(docs.select("id", "th", "text"), window), "passages")
    shared = staged(passages.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n_passages")).where("low < high").select("anchor", "n_passages"), "shared-anchors")
    met = staged(join_groups(passages, shared, ["anchor"], "n_passages", PLACE).drop("n_passages"), "shared-passages")
    digest = ["anchor", "d1", "d2"]
    distinct = staged(met.groupBy(*digest).agg(F.min(F.struct(*PLACE, "n")).alias("o"), F.count("*").alias("n_copies")).select(*digest, "o.*", "n_copies"), "distinct-passages")
    unlike = staged(distinct.groupBy("anchor").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1"), "unlike-anchors")
    places = join_groups(distinct, unlike, ["anchor"], "n_kinds", PLACE).select(*PLACE, "n")
    matched = _asked(staged(_fetched(docs.where("id is not null"), places, window), "fetched-passages"), window)
    masks = matched.groupBy(*PLACE).agg(F.collect_list(F.struct("off", "n")).alias("mask"))
    owners = distinct.select(*digest, *PLACE, "n_copies").join(masks, PLACE, "left")
    owners = staged(owners.select(*digest, F.col("id").alias("owner"), "n_copies", "mask"), "passage-owners")
    # all but the first document lose the passage as a whole, that one what the mask says
    whole = F.when(F.col("id") > F.col("owner"), F.array(F.struct(F.lit(0).alias("off"), F.col("n").alias("n")))).otherwise(F.col("mask"))
    lost = join_groups(met, owners, digest, "n_copies", PLACE).select("id", "th", "at", F.explode(whole).alias("x"))
    lost = lost.select("id", "th", F.struct((F.col("at") + F.col("x.off")).alias("at"), (F.col("x.n") + (window - 1)).alias("n")).alias("span"))
    return lost.groupBy("id", "th").agg(F.collect_list("span").alias("spans"))


def remove_spans(text, spans):
    """Column ``struct<kept_text, n_words, n_removed>``: a text without the words of its spans."""

    @F.arrow_udf("struct<kept_text:string,n_words:long,n_removed:long>")
    def remove(texts: pa.Array, lost: pa.Array) -> pa.Array:
        kept, n_words, n_removed = [], [], []
        offsets, flat = lost.offsets.to_numpy(), lost.values
        at, n = (flat.field(k).to_numpy() for k in ("at", "n"))
        for k, raw in enumerate(raw_rows(texts)):
            words = raw.split()
            a, b = offsets[k], offsets[k + 1]
            n_words.append(len(words))
            if b > a:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at[a:b], 1)
                np.add.at(edge, at[a:b] + n[a:b], -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                n_removed.append(len(words) - len(stay))
                words = [words[i] for i in stay]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["kept_text", "n_words", "n_removed"])

    empty = F.array().cast("array<struct<at:int,n:int>>")
    return remove(text_or_empty(text), F.coalesce(spans, empty))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_words`` and ``n_removed``; words are what ASCII white space separates."""
    own = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    small_batches(docs.sparkSession)
    whole = text_or_empty(text)
    rows = docs.select(*own, F.col(id_col).cast("long").alias("__id"), F.xxhash64(whole).alias("__th"))
    spans = repeated_spans(docs.select(F.col(id_col).cast("long").alias("id"), whole.alias("text")).withColumn("th", F.xxhash64("text")), window)
    joined = rows.join(spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans")), ["__id", "__th"], "left")
    return joined.select(*own, remove_spans(text, F.col("__spans")).alias("__kept")).select(*own, "__kept.*")
