"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A first pass over the documents counts in how many of them each word of the
test items stands. A leak needs a share of an item's words, so of the item's
rarest words, one more than a leak may lack, the document must have one: only
the items that a rare word names are looked at, and a stem that many items have
in common starts nothing. Grams of so many words that such an item has in
common with the document are its seeds, however common they are. The passage
around an item's seeds, as far as any alignment through them can reach, is
scored: a bound that no alignment can exceed drops candidates, the rest are
aligned word by word, so that copies with changed, added or missing words are
scored as a whole. A task aligns equal passages once.

Words are runs of letters and digits, lower-cased; null and empty texts have
none, very long ones are read whole. Items with fewer words than a gram are
found whole only; those without words match nothing. Repeated items are told
apart by their id; rows without an id have no links. Repeated rows share a
result. Hits are lists of links; a document without one has no row. Only the
ids and texts are read, so other columns do not matter, whatever their names;
an empty table has no links.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import gram_hashes, small_batches, staged, word_ids

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: The least share of an item's best possible score that is a leak.
THRESHOLD = 0.5
#: Words and grams of test items that one pass looks for (about 30 bytes each, broadcast); more take more passes.
GRAMS_PER_PASS = 4_000_000
ROWS = 1 << 12
#: Passages whose leaks a task remembers.
MEMO = 1 << 14
_SEPARATORS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(raw: bytes) -> np.ndarray:
    """Ids of the words of a lower-cased UTF-8 text."""
    return word_ids(raw.translate(_SEPARATORS).split())


def tokenised(items: DataFrame, text: str = "text"):
    """Column ``array<long>``: ids of the words of each text."""

    @F.arrow_udf("array<long>")
    def ids(column: pa.Array) -> pa.Array:
        return pa.array([words_of((x.as_py() or "").encode()).view(np.int64) for x in column], pa.list_(pa.int64()))

    return ids(F.lower(F.coalesce(F.col(text), F.lit(""))))


class Index(NamedTuple):
    """Test items: their names, their words one after another, the grams of each item, and the items that each rare word names."""

    names: pa.Array
    words: np.ndarray  # uint64
    ends: np.ndarray  # int64[items + 1]
    grams: np.ndarray  # uint64, sorted and distinct
    of_item: np.ndarray  # int32, the numbers of the first item's grams, then those of the second, ...
    first: np.ndarray  # int64[items + 1]
    rare: np.ndarray  # uint64, sorted and distinct
    named: np.ndarray  # int32, the items of the first rare word, then those of the second, ...
    name_first: np.ndarray  # int64[rare words + 1]
    short: dict  # size below a gram's: sorted hashes of whole items, and the items

    def words_of(self, item: int) -> np.ndarray:
        return self.words[self.ends[item] : self.ends[item + 1]]


def ranges(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of lists ``which`` in a table whose list k is ``first[k]`` to ``first[k + 1]``, and their sizes."""
    count = first[which + 1] - first[which]
    return np.repeat(first[which] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()), count


def rare_words(words: np.ndarray, ends: np.ndarray, frequency: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``(word, item)`` of the rarest words of each item, of which every leak has one.

    A score of ``threshold`` of the best needs that share of the item's places
    to be matched, so of any places that are one more than may be left out one is.
    """
    sizes = np.diff(ends)
    item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.lexsort((words, frequency, item))
    rank = np.arange(len(words)) - np.repeat(ends[:-1], sizes)
    needed = np.maximum(1, np.ceil(threshold * sizes - 1e-9)).astype(np.int64)
    chosen = order[rank <= np.repeat(sizes - needed, sizes)]
    return words[chosen], item[chosen]


def index_of(items: DataFrame, gram: int, threshold: float, frequencies: tuple[np.ndarray, np.ndarray]) -> Index:
    """``frequencies``: sorted words, and in how many documents each stands; others stand in none."""
    table = items.select("item", "words").toArrow().combine_chunks()
    words = table["words"].combine_chunks()
    flat = words.flatten().to_numpy().astype(np.int64, copy=False).view(np.uint64)
    sizes = words.value_lengths().to_numpy().astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    each = [np.unique(gram_hashes(flat[a:b], gram)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    grams, of_item = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
    short = {}
    for k in range(1, gram):
        few = np.flatnonzero(sizes == k).astype(np.int32)
        if len(few):
            whole = np.array([gram_hashes(flat[a : a + k], k)[0] for a in ends[few].tolist()], np.uint64)
            by_hash = np.argsort(whole, kind="stable")
            short[k] = (whole[by_hash], few[by_hash])
    known, counts = frequencies
    frequency = np.zeros(len(flat), np.int64)
    if len(known):
        place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        frequency = np.where(known[place] == flat, counts[place], 0)
    word, named = rare_words(flat, ends, frequency, threshold)
    order = np.lexsort((named, word))
    word, named = word[order], named[order]
    rare, name_first = np.unique(word, return_index=True)
    first = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
    return Index(table["item"].combine_chunks(), flat, ends, grams, of_item.astype(np.int32), first, rare, named, np.append(name_first, len(named)), short)


def word_frequencies(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted ``words`` of test items that stand in ``docs`` (id, text), and in how many rows; each task sends one sum a word."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column(0):
                ids = word_ids(list(set((text.as_py() or "").encode().translate(_SEPARATORS).split())))
                place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                total[place[known[place] == ids]] += 1
        seen = np.flatnonzero(total)
        for low in range(0, len(seen), ROWS):
            part = seen[low : low + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(known[part].view(np.int64)), pa.array(total[part])], ["word", "n"])

    if not len(words):
        return words, np.zeros(0, np.int64)
    table = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    found, n = (table[c].to_numpy().astype(np.int64, copy=False) for c in ("word", "n"))
    order = np.argsort(found.view(np.uint64))
    return found.view(np.uint64)[order], n[order]


def bound(item: np.ndarray, passage: np.ndarray) -> int:
    """What no local alignment exceeds: a passage's word that it covers gains MATCH if the item has it, else loses."""
    total = np.concatenate(([0], np.cumsum(np.where(np.isin(passage, item), MATCH, max(MISMATCH, GAP)))))
    return min(MATCH * len(item), int((total - np.minimum.accumulate(total)).max()))


def short_leaks(index: Index, ids: np.ndarray):
    """``(item, score, first, n_words, n_seeds)`` of the items shorter than a gram that stand in a text, the first place of each."""
    for k, (whole, items) in index.short.items():
        found, place = np.unique(gram_hashes(ids, k), return_index=True)
        low, high = np.searchsorted(whole, found, "left"), np.searchsorted(whole, found, "right")
        for at in np.flatnonzero(high > low).tolist():
            for item in items[low[at] : high[at]].tolist():
                yield item, 1.0, int(place[at]), k, 1


def seeds(index: Index, ids: np.ndarray, gram: int, marks: np.ndarray):
    """``(items, places, grams)``: every place of a gram that a text shares with an item which a rare word of it names.

    ``marks``: a scratch array, -1 for each gram. Grams are looked up from
    the items named, so the owners of a common one are never listed.
    """
    none = np.zeros(0, np.int64)
    found = gram_hashes(ids, gram)
    if not len(found) or not len(index.grams):
        return none, none, none
    number = np.minimum(np.searchsorted(index.grams, found), len(index.grams) - 1)
    hits = np.flatnonzero(index.grams[number] == found)
    if not len(hits):
        return none, none, none
    at = np.minimum(np.searchsorted(index.rare, ids), len(index.rare) - 1)
    items = np.unique(index.named[ranges(index.name_first, np.unique(at[index.rare[at] == ids]))[0]]).astype(np.int64)
    if not len(items):
        return none, none, none
    hits = hits[np.argsort(number[hits], kind="stable")]
    mine, first = np.unique(number[hits], return_index=True)
    first = np.append(first, len(hits))
    marks[mine] = np.arange(len(mine))
    grams, count = ranges(index.first, items)
    which = marks[index.of_item[grams]]
    marks[mine] = -1
    owners, which = np.repeat(items, count)[which >= 0], which[which >= 0]
    places, count = ranges(first, which)
    return np.repeat(owners, count), hits[places], np.repeat(mine[which], count)


def passages_of(index: Index, items: np.ndarray, places: np.ndarray, grams: np.ndarray, gram: int):
    """``(item, low, high, n_seeds)``: the passages of a text around the ``places`` of the seeds of ``items``.

    A local alignment gains MATCH for each word of its item at most and loses
    -GAP for each word more, so it covers fewer than (1 + MATCH) times the
    item's words; seeds whose reaches meet share a passage.
    """
    order = np.lexsort((places, items))
    items, places, names = items[order], places[order], grams[order]
    reach = (1 + MATCH // -GAP) * np.diff(index.ends)[items]
    new = np.flatnonzero(np.concatenate(([True], (items[1:] != items[:-1]) | (places[1:] - places[:-1] > 2 * reach[1:] + gram))))
    for low, high in zip(new.tolist(), np.append(new[1:], len(items)).tolist()):
        far = int(reach[low])
        yield int(items[low]), max(0, int(places[low]) - far), int(places[high - 1]) + gram + far, len(np.unique(names[low:high]))


def score_of(words: np.ndarray, passage: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """``(score, first, last)`` of the best alignment, if it reaches the threshold."""
    best = MATCH * len(words)
    if bound(words, passage) < threshold * best:
        return None
    score, first, last = align(words, passage)
    return (score / best, first, last) if score >= threshold * best else None


def _leaks(docs: DataFrame, items: DataFrame, gram: int, threshold: float) -> DataFrame:
    """``id, item, score, at, n_words, n_seeds`` of all leaks of ``items`` (item, words) in passages of ``docs`` (id, text)."""
    flat = items.select(F.explode("words").alias("w")).distinct().toArrow()["w"].to_numpy().astype(np.int64, copy=False)
    index = index_of(items, gram, threshold, word_frequencies(docs, np.sort(flat.view(np.uint64))))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def rows(batches):
        known, seen = shared.value, {}
        marks = np.full(len(known.grams), -1, np.int32)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = words_of((text.as_py() or "").encode())
                out += [(doc, *x) for x in short_leaks(known, ids)]
                items, places, grams = seeds(known, ids, gram, marks)
                for item, low, high, n in passages_of(known, items, places, grams, gram) if len(items) else ():
                    key = item, hashlib.blake2b(ids[low:high].tobytes(), digest_size=16).digest()
                    if key not in seen:
                        if len(seen) >= MEMO:
                            seen.clear()
                        seen[key] = score_of(known.words_of(item), ids[low:high], threshold)
                    if seen[key]:
                        score, first, last = seen[key]
                        out.append((doc, item, score, low + first, last - first, n))
                if len(out) >= ROWS:
                    yield _batch(out, known.names, batch.schema.field("id").type)
                    out = []
            yield _batch(out, known.names, batch.schema.field("id").type)

    kinds = (docs.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString())
    return docs.select("id", "text").mapInArrow(rows, f"id {kinds[0]}, item {kinds[1]}, score double, at int, n_words int, n_seeds long")


def _batch(rows, names: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
    columns[1] = names.take(columns[1])
    return pa.RecordBatch.from_arrays(columns, ["id", "item", "score", "at", "n_words", "n_seeds"])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last): the best local alignment, and the passage's words that it covers.

    Row by row over the item; a row's gaps along the passage are resolved at
    once, as a run of them lowers the score by GAP for each word.
    """
    n = len(passage)
    slope = np.arange(n + 1) * -GAP
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        over = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = score + GAP
        now, start = up.copy(), begin.copy()
        better = over >= up[1:]
        now[1:][better], start[1:][better] = over[better], begin[:-1][better]
        lifted = now + slope
        top = np.maximum.accumulate(lifted)
        # where the best so far lies to the left, its beginning comes along
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        now, start = top - slope, start[source]
        fresh = now <= 0
        now[fresh], start[fresh] = 0, np.arange(n + 1)[fresh]
        score, begin = now, start
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(begin[at]), at)
    return best


def _best_leaks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, gram: int, threshold: float) -> DataFrame:
    """``id, item, b``: the best leak of each item in each of ``docs`` (id, text), by blocks of items of a bounded size."""
    small_batches(docs.sparkSession)
    docs = docs.withColumn("text", F.lower("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), tokenised(benchmark, item_text).alias("words"))
    items = staged(items.dropDuplicates(["item", "words"]), "benchmark-items")
    total, longest = (x or 0 for x in items.agg(F.sum(F.size("words")), F.max(F.size("words"))).head())
    blocks, leaks = max(1, -(-total // GRAMS_PER_PASS)), None

    def block_of():
        return F.pmod(F.xxhash64("item", "words"), F.lit(blocks))

    # checked, not only on average: an item longer than a pass is one of its own size
    while blocks > 1 and items.groupBy(block_of()).agg(F.sum(F.size("words")).alias("n")).agg(F.max("n")).head()[0] > max(GRAMS_PER_PASS, longest):
        blocks *= 2
    for k in range(blocks):
        block = items if blocks == 1 else items.where(block_of() == k)
        more = _leaks(docs, block, gram, threshold)
        leaks = more if leaks is None else leaks.union(more)
    return leaks.groupBy("id", "item").agg(F.max(F.struct("score", (-F.col("at")).alias("early"), "n_words", "n_seeds")).alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, item, score, first_word, n_words, n_seeds)``: each document and test item it leaks, once.

    The best alignment counts, the first of equal ones; rows that share an id
    share its links. ``score`` is between ``threshold`` and 1. Benchmarks of
    any size go in blocks of items, each with GRAMS_PER_PASS words at most, or
    as many as the longest item has.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    best = _best_leaks(rows, benchmark, item_col, item_text, gram, threshold)
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.round("b.score", 6).alias("score"), (-F.col("b.early")).cast("int").alias("first_word"), "b.n_words", "b.n_seeds")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id leaks no test item; rows without an id stay."""
    leaks = contaminated(docs, benchmark, id_col, **options).select(F.col(id_col)).distinct()
    return docs.join(leaks, id_col, "left_anti")


def drop_contaminated_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text leaks no test item, whatever their ids."""
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.encode(body, "UTF-8"), 256)
    leaks = _best_leaks(docs.select(digest.alias("id"), body.alias("text")), benchmark, item_col, item_text, gram, threshold)
    return docs.withColumn("__digest", digest).join(leaks.select(F.col("id").alias("__digest")).distinct(), "__digest", "left_anti").select(*docs.columns)
