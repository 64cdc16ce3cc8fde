"""Companies in articles: exact names by a multi-pattern automaton, other spellings by partial ratio.

A directory has a row for each way to say a company: ``ticker``, ``name`` and
``kind`` (symbol, name or alias). Texts and names are compared as
``normalized_title`` leaves them: lower case, words of letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.functions import text as tx
from marketloom.operators.articles import listed, mapped
from marketloom.staging import staged

#: Names whose automaton goes to the executors at once: bytes of names at most. An automaton takes some forty times that.
SHARD_BYTES = 1 << 20
#: Spans that a task compares with a list of names.
SPANS_OF_A_TASK = 5_000
# How sure each kind of mention is, and the least partial ratio of a name in a text and in a headline.
CONFIDENCE = {"symbol": 1.0, "name": 1.0, "alias": 0.9}
SPAN_RATIO, HEADLINE_RATIO = 85, 75
SPAN = r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+){0,3}"


def directory_rows(directory: DataFrame) -> DataFrame:
    """Distinct ``ticker, name, kind`` with the name normalised; a name that a company has in several kinds is of the surest, names without a letter or digit go."""
    rows = directory.select("ticker", tx.normalized_title("name").alias("name"), "kind").where("name <> '' and ticker is not null")
    rank = mapped("kind", {"symbol": 0, "name": 1, "alias": 2})
    return rows.groupBy("ticker", "name").agg(F.min_by("kind", rank).alias("kind"))


def name_shards(names: DataFrame, most: int = SHARD_BYTES) -> Iterator[list[str]]:
    """Distinct names in lists of bounded size; only one list is in the driver at a time."""
    distinct = staged(names.select("name", (F.pmod(F.xxhash64("name"), F.lit(1 << 20))).alias("slot")).distinct(), "names")
    total = distinct.agg(F.sum(F.octet_length("name"))).head()[0] or 0
    parts = -(-2 * total // most)  # twice as many as would do, as slots differ
    for part in range(parts):
        found = [r["name"] for r in distinct.where(F.col("slot") % parts == part).select("name").collect()]
        if sum(len(x.encode()) for x in found) > 2 * most and len(found) > 1:
            raise ValueError("names differ too much in length for shards of this size")
        yield found


def mentions(articles: DataFrame, id_col: str, text: str, directory: DataFrame) -> DataFrame:
    """``id, ticker, kind, name, n, first_at``: how often each name of the directory stands in each text, whole words only, and the first word it stands at (from 1).

    One pass over the texts for each shard of names; in it every place of
    every name is found at once. Overlapping names all count. A null text has
    no mention.
    """
    rows = articles.select(F.col(id_col).alias("id"), tx.normalized_title(text).alias("t")).where("t <> ''")
    names = staged(directory_rows(directory), "directory")
    kind, found = rows.schema["id"].dataType.simpleString(), None
    for shard in name_shards(names):
        if shard:
            part = rows.mapInArrow(_finder(articles, shard), f"id {kind}, name string, n long, first_at long")
            found = part if found is None else found.union(part)
    if found is None:
        found = rows.limit(0).select("id", F.lit("").alias("name"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first_at"))
    return found.join(names, "name").select(F.col("id").alias(id_col), "ticker", "kind", "name", "n", "first_at")


def _finder(articles: DataFrame, names: list[str]):
    shared = articles.sparkSession.sparkContext.broadcast(names)

    def find(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in shared.value:
            automaton.add_word(f" {name} ", name)
        automaton.make_automaton()
        for batch in batches:
            out = {"id": [], "name": [], "n": [], "first_at": []}
            for key, text in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                line, seen = f" {text} ", {}
                for end, name in automaton.iter(line):
                    first, n = seen.get(name, (end - len(name) - 1, 0))
                    seen[name] = (first, n + 1)
                for name, (first, n) in seen.items():
                    for k, x in zip(out, (key, name, n, line.count(" ", 0, first) + 1)):
                        out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], batch.schema.field("id").type), pa.array(out["name"], pa.string()), pa.array(out["n"], pa.int64()), pa.array(out["first_at"], pa.int64())], list(out))

    return find


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by one addition of long integers for each character."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """0 to 100: the best ``200 * common / (both lengths)`` of the shorter text and a window of the longer one, as long or cut off at an end; 0 if one is empty or it is below ``least``."""
    short, long = sorted((a, b), key=len)
    m, best = len(short), 0.0
    if m and short in long:
        return 100.0
    sides = [(short, long), (long, short)] if m == len(long) else [(short, long)]
    for s, t in sides if m else []:
        windows = [t[i : i + m] for i in range(len(t) - m + 1)] + [t[:k] for k in range(1, m)] + [t[-k:] for k in range(1, m)]
        for w in set(windows):
            if 200.0 * len(w) / (m + len(w)) >= max(best, least):
                best = max(best, 200.0 * common_length(s, w) / (m + len(w)))
    return best if best >= least else 0.0


def partial_ratio_of(a, b, least: float = 0.0) -> Column:
    """``partial_ratio`` of two columns; apply it to pairs that were chosen before."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([partial_ratio(p or "", q or "", least) for p, q in zip(x, y)], dtype="float64")

    return ratio(tx.col(a), tx.col(b))


def similar_names(spans: DataFrame, names: DataFrame, least: int = SPAN_RATIO) -> DataFrame:
    """``span, name, ratio``: all pairs of the two lists with a partial ratio of ``least`` (85 at least) or more.

    Candidates share a rare run of two letters. A ratio of 85 leaves at most
    0.3 m edits between the m letters of the shorter text and the window; each
    spoils two runs at most, so the shorter one keeps a run among any
    ``2 * edits + 1`` of its own places. Its rarest ones, as the other list has
    them, are the keys, and the longer side is filed under all its runs. Texts
    of one letter are similar to nothing.
    """
    if least < 85:
        raise ValueError("the filter loses no pair from 85 on")
    a = staged(spans.select(F.col("span").alias("s")).where("length(span) > 1").distinct(), "spans")
    b = staged(names.select(F.col("name").alias("s")).where("length(name) > 1").distinct(), "names")
    grams = lambda df: df.select("s", F.length("s").alias("m"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, 2))).alias("at", "gram"))
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.coalesce("uses", F.lit(0)), "gram", "at"))
    edits = F.floor(F.col("m") * 2 * (100 - least) / 100)

    def keys(df: DataFrame, other: DataFrame) -> DataFrame:
        uses = grams(other).select("s", "gram").distinct().groupBy("gram").agg(F.count("*").alias("uses"))
        return grams(df).join(uses, "gram", "left").withColumn("rank", rank).where(F.col("rank") <= 2 * edits + 1).select("s", "m", "gram").distinct()

    whole = lambda df: grams(df).select("s", "m", "gram").distinct()
    meet = lambda x, y: x.select(F.col("s").alias("span"), F.col("m").alias("m1"), "gram").join(y.select(F.col("s").alias("name"), F.col("m").alias("m2"), "gram"), "gram")
    met = meet(keys(a, b), whole(b)).where("m1 <= m2").unionByName(meet(whole(a), keys(b, a)).where("m1 >= m2")).select("span", "name").distinct()
    short, long = F.when(F.length("span") <= F.length("name"), F.col("span")).otherwise(F.col("name")), F.when(F.length("span") <= F.length("name"), F.col("name")).otherwise(F.col("span"))
    runs = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, 2)))
    pairs = met.withColumns({"short": short, "long": long}).withColumns({"whole": F.contains("long", "short"), "own": runs(F.col("short"))})
    spoiled = 2 * F.floor(F.length("short") * 2 * (100 - least) / 100)
    pairs = staged(pairs.where(F.col("whole") | (F.size(F.array_intersect("own", runs(F.col("long")))) >= F.size("own") - spoiled)).select("span", "name", "whole"), "pairs")
    # only pairs of which one is not part of the other go to Python
    scored = pairs.where("NOT whole").repartition("span", "name").withColumn("ratio", partial_ratio_of("span", "name", least)).where(F.col("ratio") >= least)
    return pairs.where("whole").select("span", "name", F.lit(100.0).alias("ratio")).unionByName(scored.select("span", "name", "ratio"))


class NameIndex:
    """Names by their runs of two letters; see ``similar_names`` for why the bound loses none."""

    def __init__(self, names: list[str], least: int) -> None:
        import ahocorasick

        self.names, self.least = sorted(names), least
        self.size = np.array([len(x) for x in self.names])
        runs = [set(map("".join, zip(x, x[1:]))) for x in self.names]
        self.needed = np.array([len(r) for r in runs]) - self.spoiled(self.size)
        rows: dict[str, list[int]] = {}
        for i, r in enumerate(runs):
            for run in r:
                rows.setdefault(run, []).append(i)
        self.rows = {run: np.array(x) for run, x in rows.items()}
        self.parts = ahocorasick.Automaton()
        for i, name in enumerate(self.names):
            self.parts.add_word(name, i)
        self.parts.make_automaton()

    def spoiled(self, size):
        return 2 * (size * 2 * (100 - self.least) // 100)

    def best(self, span: str) -> tuple[str, float] | None:
        """The most similar name of a span of two letters or more and its ratio, ties by name; one that is a part of the other is 100 and ends the search."""
        runs = set(map("".join, zip(span, span[1:])))
        whole = [i for _, i in self.parts.iter(span)]
        found = [self.rows[r] for r in runs if r in self.rows]
        if len(found) == len(runs):
            whole += next(([i] for i in min(found, key=len).tolist() if span in self.names[i]), [])
        if whole:
            return self.names[min(whole)], 100.0
        if not found:
            return None
        at, shared = np.unique(np.concatenate(found), return_counts=True)
        needed = np.where(self.size[at] >= len(span), len(runs) - self.spoiled(len(span)), self.needed[at])
        name, top = None, 0.0
        for i in at[shared >= needed].tolist():
            ratio = partial_ratio(span, self.names[i], max(self.least, top))
            if ratio > top:
                name, top = self.names[i], ratio
        return (name, top) if name else None


def best_names(spans: DataFrame, names: DataFrame, least: int = SPAN_RATIO) -> DataFrame:
    """``span, name, ratio``: of each distinct span the first of its most similar names, if the ratio is ``least`` (85 at least) or more.

    Names go out in lists of a bounded size and each task finds the best of a
    list for its spans, so no pair is moved; lists share spans, not names.
    """
    if least < 85:
        raise ValueError("the filter loses no pair from 85 on")
    rows, found = staged(spans.where("length(span) > 1").select("span").distinct(), "spans"), None
    # spans are few bytes and much work: a small table would be one task
    rows = rows.repartition(max(1, -(-rows.count() // SPANS_OF_A_TASK)))
    for shard in name_shards(names.where("length(name) > 1")):
        if shard:
            part = rows.mapInArrow(_best_finder(rows, shard, least), "span string, name string, ratio double")
            found = part if found is None else found.union(part)
    if found is None:
        return rows.limit(0).select("span", F.lit("").alias("name"), F.lit(0.0).alias("ratio"))
    return found.groupBy("span").agg(F.min_by(F.struct("name", "ratio"), F.struct(-F.col("ratio"), F.col("name"))).alias("x")).select("span", "x.*")


def _best_finder(rows: DataFrame, names: list[str], least: int):
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def find(batches):
        index = NameIndex(shared.value, least)
        for batch in batches:
            out = [(span, *best) for span in batch.column("span").to_pylist() if (best := index.best(span))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))], ["span", "name", "ratio"])

    return find


def company_spans(articles: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, span, n``: runs of one to four capitalised words, lower-cased, that can be a company: longer than two characters, no stop word."""
    rows = articles.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPAN), F.lit(0))).alias("span"))
    spans = rows.groupBy("id", F.lower("span").alias("span")).agg(F.count("*").alias("n"))
    return spans.where((F.length("span") > 2) & ~F.array_contains(listed(tx.STOP_WORDS), F.col("span"))).select("id", "span", "n")


def fuzzy_mentions(articles: DataFrame, id_col: str, text: str, directory: DataFrame, least: int = SPAN_RATIO) -> DataFrame:
    """``id, ticker, span, name, ratio, n``: for each span that is no name itself its most similar name, ties by name and ticker.

    Every distinct span is compared once, however many articles have it.
    """
    names = staged(directory_rows(directory).where("kind <> 'symbol'"), "directory")
    spans = staged(company_spans(articles, id_col, text), "spans")
    exact = names.select(F.col("name").alias("span")).distinct()
    best = best_names(spans.select("span").distinct().join(exact, "span", "left_anti"), names, least).join(names, "name")
    best = best.groupBy("span").agg(F.min_by(F.struct("ticker", "name", "ratio"), F.struct(-F.col("ratio"), F.col("name"), F.col("ticker"))).alias("x")).select("span", "x.*")
    return spans.join(best, "span").select(F.col("id").alias(id_col), "ticker", "span", "name", "ratio", "n")


def ticker_matches(articles: DataFrame, id_col: str, text: str, directory: DataFrame) -> DataFrame:
    """``id, ticker, mention_count, confidence, kinds``: exact and similar mentions of each company together."""
    exact = mentions(articles, id_col, text, directory).select(id_col, "ticker", "kind", "n", mapped("kind", CONFIDENCE).alias("confidence"))
    fuzzy = fuzzy_mentions(articles, id_col, text, directory).select(id_col, "ticker", F.lit("similar").alias("kind"), "n", (F.col("ratio") / 100).alias("confidence"))
    both = exact.unionByName(fuzzy).groupBy(id_col, "ticker")
    return both.agg(F.sum("n").alias("mention_count"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def headline_matches(pairs: DataFrame, name: str, aliases: str, ticker: str, headline: str, least: float = HEADLINE_RATIO) -> DataFrame:
    """``pairs`` with ``matched``: the company's name, an alias or its symbol stands in the headline anywhere, or a name's partial ratio suffices."""
    line = F.lower(F.coalesce(headline, F.lit("")))
    said = F.filter(F.transform(F.concat(F.array(F.coalesce(name, ticker)), F.coalesce(aliases, F.array().cast("array<string>"))), F.lower), lambda x: x.isNotNull() & (x != ""))

    @F.pandas_udf("double")
    def best(lists: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([max((partial_ratio(x, t, least) for x in names), default=0.0) for names, t in zip(lists, lines)], dtype="float64")

    rows = pairs.withColumns({"_line": line, "_said": said})
    plain = F.exists("_said", lambda x: F.contains(F.col("_line"), x)) | F.coalesce(F.contains(F.col("_line"), F.lower(ticker)), F.lit(False))
    rows = rows.withColumn("_plain", plain)
    # only pairs without a plain hit go to Python
    scored = rows.where(~F.col("_plain")).withColumn("matched", best("_said", "_line") >= least)
    return rows.where("_plain").withColumn("matched", F.lit(True)).unionByName(scored).drop("_line", "_said", "_plain")
