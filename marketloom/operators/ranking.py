"""Ranking, top-k and quota-capped selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from marketloom.staging import shared_path, staged


def top_per_group(rows: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank; tasks keep k rows of a group before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def capped_top(rows: DataFrame, group: str, order: Sequence[Column], per_group: int, n: int) -> DataFrame:
    """The first ``n`` rows in order when no group may have more than ``per_group``.

    Only a group's own cap can skip a row, so capping first is exact.
    """
    return top_per_group(rows, group, order, per_group).drop("rank").orderBy(*order).limit(n)


def staged_top(rows: DataFrame, first: Column, group: str, order: Sequence[Column], per_group: int, n: int) -> DataFrame:
    """As ``capped_top``, with the rows that meet ``first`` before all others."""
    rank = F.when(first, 0).otherwise(1)
    return capped_top(rows.withColumn("stage", rank), group, [F.col("stage"), *order], per_group, n)


def interleaved(rows: DataFrame, category: str, priority: Column, order: Sequence[Column], n: int) -> DataFrame:
    """Take turns between categories, by priority, up to ``n`` rows."""
    return top_per_group(rows, category, order, n).withColumn("_p", priority).orderBy("rank", "_p").limit(n).drop("_p")


def round_robin(rows: DataFrame, feed: str, position: Sequence[Column], per_feed: int, n: int) -> DataFrame:
    """Feeds in turn: all first rows, then all second ones."""
    return interleaved(rows, feed, F.col(feed), position, n) if per_feed >= n else top_per_group(rows, feed, position, per_feed).orderBy("rank", feed).limit(n)


def quota_selection(rows: DataFrame, order: str, provider: str, tickers: str, provider_cap: int, ticker_cap: int, batch: str | None = None) -> DataFrame:
    """Rows taken in order while the provider's quota and that of every ticker last.

    A row consumes several counters, so the pass is sequential: one task for
    each ``batch`` (a run's articles), which streams its rows and keeps only
    the counters.
    """
    import pandas as pd

    key = batch or "_all"
    rows = rows if batch else rows.withColumn(key, F.lit(0))

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        keep = []
        pdf = pdf.sort_values(order)
        for p, ts in zip(pdf[provider], pdf[tickers]):
            wants = [("p", p, provider_cap), *(("t", t, ticker_cap) for t in (ts if ts is not None else ()))]
            ok = all(used.get(w[:2], 0) < w[2] for w in wants)
            for w in wants if ok else ():
                used[w[:2]] = used.get(w[:2], 0) + 1
            keep.append(ok)
        return pdf[keep]

    out = rows.groupBy(key).applyInPandas(select, rows.schema)
    return out if batch else out.drop(key)


# Kinds of feeds in the order in which they are read; those that only discover others' articles come last and take turns.
FAMILIES = ["direct_news_publisher", "market_data_or_analysis", "press_release_wire"]
DISCOVERY = "google_news_backstop"


def discovery_limit(direct: int, total: int, share: float) -> int:
    """How many articles discovery feeds may add to ``direct`` others so that they are at most ``share`` of all."""
    share = min(1.0, max(0.0, share))
    if direct == 0 or share == 1.0:
        return total
    return 0 if share == 0 else max(0, min(int(direct * share / (1 - share)), int(total * share), total - direct))


def feed_candidates(articles: DataFrame, per_ticker: int, total: int) -> DataFrame:
    """The ``articles`` that ``capped_feeds`` can take: all others are refused, whatever comes before them.

    Of a feed's articles with the same tickers, only the first with a URL can be
    taken, each one taken uses up the tickers, and each one refused for its URL
    has one that was taken: beyond ``per_ticker + total`` of them none is left.
    """
    tickers = F.array_sort(F.array_distinct("tickers"))
    rows = articles.where(F.size("tickers") > 0).withColumn("tickers", tickers)
    own = ["batch", "provider", "feed", "tickers"]
    first = rows.groupBy(*own, "url").agg(F.min(F.struct("pos", "id")).alias("at"), F.first("family").alias("family"), F.first("feed_no").alias("feed_no"))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("at"))
    return first.withColumn("_rank", rank).where(F.col("_rank") <= per_ticker + total).select("batch", "provider", "feed", "feed_no", "family", "tickers", "url", "at.pos", "at.id")


def capped_feeds(articles: DataFrame, per_source: int, per_ticker: int, total: int, share: float = 1.0, direct_first: bool = True) -> DataFrame:
    """``batch, id, place``: the articles of each batch that its feeds may add, in the order in which they are taken.

    ``articles``: ``batch, id, provider, feed, feed_no, family, pos, url,
    tickers``; ``feed_no`` is the place of a feed among all, ``pos`` that of an
    article in it. Providers go in the order of their first feed, with
    ``direct_first`` by family and discovery last. A provider's feeds are read
    one after another; those of a discovery provider take turns, in which a
    refused article costs its feed nothing. An article is refused if it has no
    ticker, its URL was taken, its provider has ``per_source`` articles or one
    of its tickers ``per_ticker``; ``total`` ends a batch, and ``share`` bounds
    what a discovery provider adds to the others. A null URL is one of its own
    for each article. Equal places in a feed go by id.

    Candidates are found before the shuffle; a batch's are one task, which
    reads keys only and holds, for each feed and set of tickers,
    ``per_ticker + total`` of them at most.
    """
    import pandas as pd

    known = F.when(F.col("family") == DISCOVERY, len(FAMILIES) + 1)
    for rank, family in enumerate(FAMILIES):
        known = known.when(F.col("family") == family, rank)
    rows = articles.withColumn("url", F.coalesce(F.concat(F.lit("u"), "url"), F.concat(F.lit("i"), F.col("id").cast("string"))))
    rows = feed_candidates(rows, per_ticker, total).withColumn("_family", F.coalesce(known, F.lit(len(FAMILIES))) if direct_first else F.lit(0))

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_family", "feed_no", "feed", "pos", "id"])
        taken, urls, n_of, n_direct = [], set(), {}, 0

        def take(row) -> bool:
            nonlocal n_direct
            wants = [("provider", row.provider), *(("ticker", t) for t in row.tickers)]
            limits = [per_source] + [per_ticker] * len(row.tickers)
            if row.url in urls or any(n_of.get(w, 0) >= limit for w, limit in zip(wants, limits)):
                return False
            taken.append(row.id)
            urls.add(row.url)
            n_direct += row.family != DISCOVERY
            for w in wants:
                n_of[w] = n_of.get(w, 0) + 1
            return True

        for provider, own in pdf.groupby("provider", sort=False, dropna=False):
            # the kind of a provider is that of its first feed with a candidate
            discovers = own["family"].iloc[0] == DISCOVERY
            room = min(total, len(taken) + discovery_limit(n_direct, total, share)) if discovers else total
            feeds = [iter(list(f.itertuples())) for _, f in own.groupby(["_family", "feed_no", "feed"], sort=False, dropna=False)]
            open_ = feeds if discovers else [r for f in feeds for r in f]
            while discovers and open_ and len(taken) < room:
                left = []
                for feed in open_:
                    if len(taken) >= room:
                        break
                    if any(take(row) for row in feed):
                        left.append(feed)
                open_ = left
            for row in () if discovers else open_:
                if len(taken) >= room:
                    break
                take(row)
        return pd.DataFrame({"batch": pdf["batch"].iloc[0], "id": taken, "place": range(1, len(taken) + 1)})

    kinds = {f: articles.schema[f].dataType.simpleString() for f in ("batch", "id")}
    return rows.groupBy("batch").applyInPandas(select, f"batch {kinds['batch']}, id {kinds['id']}, place int")


def trim_dominant(rows: DataFrame, key: str, order: str, limit: float) -> DataFrame:
    """Drop rows of the most frequent key from the end until its share is at most ``limit``.

    With m rows of it among n, the least k with (m - k) / (n - k) <= limit go.
    """
    every = Window.partitionBy()
    counts = rows.groupBy(key).agg(F.count("*").alias("_m"))
    counts = counts.withColumns({"_n": F.sum("_m").over(every), "_top": F.row_number().over(Window.orderBy(F.desc("_m"), key)) == 1})
    k = F.when(F.col("_top"), F.greatest(F.ceil((F.col("_m") - limit * F.col("_n")) / (1 - limit)), F.lit(0))).otherwise(0)
    ranked = rows.join(F.broadcast(counts.select(key, "_m", k.alias("_k"))), key).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where(F.col("_r") <= F.col("_m") - F.col("_k")).drop("_m", "_k", "_r")


def reading_labels(rows: DataFrame, group: str, rank: str, meaningful: Column) -> DataFrame:
    """``read_first`` for the first meaningful row of each group (else the first), ``read_next`` for the second."""
    by = Window.partitionBy(group)
    first = F.coalesce(F.min(F.when(meaningful, F.col(rank))).over(by), F.min(rank).over(by))
    rest = rows.withColumn("_first", first)
    following = F.min(F.when(F.col(rank) != F.col("_first"), F.col(rank))).over(by)
    label = F.when(F.col(rank) == F.col("_first"), "read_first").when(F.col(rank) == following, "read_next").otherwise("background")
    return rest.withColumn("label", label).drop("_first")


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Queries that go to the tasks at once; some 2 MB at 128 dimensions.
QUERY_BLOCK = 2000
#: Vectors that a task multiplies at once, and by how much products summed in another order may differ.
VECTOR_BLOCK, SLACK = 1024, 1e-9


def _units(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length 1, zeros where there is no cosine; and which have numbers that are too large or none, whose pairs are all worked out."""
    whole = np.array([None not in r for r in rows], bool)
    table = np.zeros((len(rows), width))
    if whole.any():
        table[whole] = np.array([r for r, w in zip(rows, whole) if w], dtype=float)
    with np.errstate(all="ignore"):
        size = np.sqrt((table * table).sum(1))
    odd = ~np.isfinite(size)
    good = ~odd & (size > 0)
    table[~good], size[~good] = 0.0, 1.0
    table /= size[:, None]
    table[~good] = np.nan
    return table, odd


def _may_be_nearest(shared, k: int, id_type: pa.DataType):
    """``query_id, vec_id, score`` of a task's vectors that may be among the k best of a query; score is null where all must be worked out."""

    def find(batches):
        ids, rows = shared.value
        ids, widths, asked = np.array(ids), {len(r) for r in rows if r is not None}, {}
        for n in widths:
            at = np.array([i for i, r in enumerate(rows) if r is not None and len(r) == n])
            asked[n] = (ids[at], *_units([rows[i] for i in at], n), np.full((len(at), k), -np.inf), [])
        for batch in batches:
            for low in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(low, VECTOR_BLOCK)
                keys, vectors = np.array(part.column(0).to_pylist()), part.column(1).to_pylist()
                for n, (own, q, q_odd, best, kept) in asked.items():
                    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == n]
                    if not at:
                        continue
                    x, x_odd = _units([vectors[i] for i in at], n)
                    score = q @ x.T
                    score[own[:, None] == keys[at][None, :]] = np.nan
                    every = q_odd[:, None] | x_odd[None, :]
                    score[every | np.isnan(score)] = -np.inf
                    best[:] = -np.partition(-np.concatenate([best, score], 1), k - 1, axis=1)[:, :k]
                    i, j = np.nonzero((score >= best.min(1)[:, None] - SLACK) & (score > -np.inf) | every)
                    kept.append((i, keys[at][j], np.where(every[i, j], np.nan, score[i, j])))
        for own, _, _, best, kept in asked.values():
            floor = best.min(1) - SLACK
            for i, found, score in kept:
                stays = np.isnan(score) | (score >= floor[i])
                yield pa.RecordBatch.from_arrays([pa.array(own[i[stays]].tolist(), id_type), pa.array(found[stays].tolist(), id_type), pa.array(score[stays], from_pandas=True)], ["query_id", "vec_id", "score"])

    return find


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, vec_id, similarity, rank``: the nearest vectors of a stated query set.

    Queries (query_id, query) are dealt into blocks of about ``block`` rows, one
    more for each partition they come from at most; each block goes to all
    tasks and meets all vectors in one pass of matrix products. What may be
    among a query's k best by these is worked out again in full and ranked, in
    a table of the block's own. Of equal vectors only the k + 1 least ids take
    part. Pairs without a cosine come last, in the order of ids.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    root = shared_path(spark, "nearest")
    dealt = staged(queries.select("query_id", "query", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block")), "queries")
    some = staged(top_per_group(vectors.select("vec_id", "embedding"), "embedding", [F.asc("vec_id")], k + 1).select("vec_id", "embedding"), "vectors")
    # fewer than k with a cosine: the others are among the first 2 k + 1 ids
    first = vectors.select("vec_id").orderBy("vec_id").limit(2 * k + 1)
    kind = vectors.schema["vec_id"].dataType
    for b in range(blocks):
        asks = dealt.where(F.col("block") == b).drop("block")
        rows = asks.collect()
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], [r["query"] for r in rows]))
        may = staged(some.mapInArrow(_may_be_nearest(shared, k, to_arrow_type(kind)), f"query_id {kind.simpleString()}, vec_id {kind.simpleString()}, score double"), "may-be-nearest")
        least = top_per_group(may.where("score is not null"), "query_id", [F.desc("score")], k).groupBy("query_id").agg((F.min("score") - SLACK).alias("least"))
        left = may.join(least, "query_id", "left").where("score is null or score >= least").select("query_id", "vec_id")
        left = left.union(asks.select("query_id").join(F.broadcast(first))).where("query_id <> vec_id").distinct()
        pairs = left.join(vectors, "vec_id").join(asks, "query_id").select("query_id", "vec_id", cosine("query", "embedding").alias("similarity"))
        out = top_per_group(pairs, "query_id", [F.desc("similarity"), F.asc("vec_id")], k)
        out.write.parquet(f"{root}/block={b}")
    return spark.read.schema(out.schema).parquet(*(f"{root}/block={b}" for b in range(blocks)))
