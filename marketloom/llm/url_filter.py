"""URL rules in a sorted digest array.

Each rule (host, path prefix, verdict) is filed under the 64-bit xxHash of
``host + path``. Rules are dealt by ranges of the digest into shards; a task
writes each as one file of sorted keys and strings to the shared folder.
Workers map these files into memory (where the folder is not mounted they read
them), probe all candidates of a batch of URLs with one binary search a shard,
and compare the stored strings of what they find, so a collision of hashes
decides nothing. The driver sees one row a shard.

A null URL, or one without ``://``, has an empty host and path and fits no
rule. Very long URLs are judged whole; repeated ones alike. Rules with a null
host or path are none, repeated rules count once, of contradicting ones block
wins. Without rules all URLs get the default verdict. Extra columns are kept,
those named as the outputs are replaced; an empty table stays empty.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import shared_path

#: Rules of one shard on average, about 100 MB.
RULES_PER_SHARD = 1_000_000


def digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path up to ``? #``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_rules(rules: DataFrame, path: str | None = None) -> list[tuple[str, int]]:
    """``(file, number of rules)`` of each shard of ``rules`` (host, path, verdict), in the order of their digests; "" for an empty one."""
    path = path or shared_path(rules.sparkSession, "url-rules")
    rows = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shards = max(1, -(-rows.count() // RULES_PER_SHARD))

    def numbered(batches):
        for batch in batches:
            keys = [digest(h + p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([k * shards >> 64 for k in keys], pa.int32())], ["host", "path", "verdict", "key", "shard"])

    def write(batches):
        batches = list(batches)  # a shard or none: RULES_PER_SHARD rules on average
        if not batches:
            return
        tables = pa.Table.from_batches(batches)
        for shard in np.unique(tables["shard"].to_numpy()).tolist():
            part = tables.filter(pa.compute.equal(tables["shard"], shard))
            keys = part["key"].to_numpy().view(np.uint64)
            order = np.argsort(keys, kind="stable")
            part = part.take(pa.array(order)).select(["host", "path", "verdict"]).combine_chunks()
            lengths = sorted(set(pa.compute.utf8_length(part["path"]).to_pylist()), reverse=True)
            store, root = _open(path)
            store.create_dir(root, recursive=True)
            name = f"{root}/rules-{shard:08d}.arrow"
            temporary = f"{name}.{uuid.uuid4().hex}"
            table = part.append_column("key", pa.array(keys[order])).replace_schema_metadata({"lengths": json.dumps(lengths)})
            with store.open_output_stream(temporary) as out, pa.ipc.new_file(out, table.schema) as sink:
                sink.write_table(table.combine_chunks())
            store.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{path}/rules-{shard:08d}.arrow"]), pa.array([len(table)], pa.int64())], ["shard", "file", "n"])

    dealt = rows.mapInArrow(numbered, "host string, path string, verdict string, key long, shard int").repartitionById(shards, F.col("shard"))
    found = {r["shard"]: (r["file"], r["n"]) for r in dealt.mapInArrow(write, "shard int, file string, n long").collect()}
    return [found.get(k, ("", 0)) for k in range(shards)]


class DigestArray:
    """The rules of a shard by their sorted 64-bit digests, mapped from its file."""

    def __init__(self, file: str):
        from pyarrow import fs

        store, name = _open(file)
        source = pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else pa.BufferReader(store.open_input_file(name).read_buffer())
        table = pa.ipc.open_file(source).read_all()
        self.lengths = json.loads(table.schema.metadata[b"lengths"])
        self.keys = table["key"].chunk(0).to_numpy()
        self.hosts, self.paths, self.verdicts = (table[c].chunk(0) for c in ("host", "path", "verdict"))

    def found(self, wanted: np.ndarray, tried: list[tuple[str, str]]):
        """``(place in tried, verdict)`` of each candidate that is a rule."""
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        for j in np.flatnonzero(high > low).tolist():
            for at in range(low[j], high[j]):
                if (self.hosts[at].as_py(), self.paths[at].as_py()) == tried[j]:
                    yield j, self.verdicts[at].as_py()


@lru_cache(maxsize=None)  # of mapped files, of which only the pages in use are in memory
def digest_array(file: str) -> DigestArray:
    return DigestArray(file)


def candidates(host: str, path: str, lengths: list[int]):
    """(host suffix, path prefix) for every suffix of labels and every length of prefix that rules have."""
    at = 0 if host else -1
    while at >= 0:
        for n in lengths:
            if n <= len(path):
                yield host[at:], path[:n]
        at = host.find(".", at) + 1 or -1


def match_urls(shards: list[tuple[str, int]], hosts: list[str], paths: list[str]) -> list[tuple[str, str, str] | None]:
    """For each URL the rule that fits and is longest (host and path together, then host)."""
    arrays = [digest_array(file) if file else None for file, _ in shards]
    lengths = sorted({n for x in arrays if x for n in x.lengths}, reverse=True)
    owner, tried = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        for one in candidates(host, path, lengths):
            owner.append(i)
            tried.append(one)
    keys = [digest(h + p) for h, p in tried]
    wanted, shard = np.array(keys, np.uint64), np.array([k * len(shards) >> 64 for k in keys], np.int64)
    best: list[tuple[str, str, str] | None] = [None] * len(hosts)
    for k, array in enumerate(arrays):
        mine = np.flatnonzero(shard == k)
        if array is None or not len(mine):
            continue
        some = [tried[j] for j in mine.tolist()]
        for j, verdict in array.found(wanted[mine], some):
            i, rule = owner[mine[j]], (*some[j], verdict)
            if best[i] is None or _length(rule) > _length(best[i]):
                best[i] = rule
    return best


def _length(rule) -> tuple[int, int]:
    return len(rule[0]) + len(rule[1]), len(rule[0])


def match_rules(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path", out: str = "match") -> DataFrame:
    """``urls`` with ``out``: the (host, path, verdict) of the rule that fits and is longest, or null.

    URLs are never shuffled; each worker maps the shards' files.
    """
    shards = write_rules(rules)

    @F.arrow_udf("struct<host:string,path:string,verdict:string>")
    def look_up(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        got = match_urls(shards, hosts.to_pylist(), paths.to_pylist())
        return pa.array([None if g is None else dict(zip(("host", "path", "verdict"), g)) for g in got], pa.struct([("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())]))

    return urls.withColumn(out, look_up(F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the one that decides, or null) and ``verdict``."""
    host, path = split_url(url)
    rows = pages.withColumns({"host": host, "path": path})
    rows = match_rules(rows, rules, out="_match")
    rows = rows.withColumns({"rule": F.concat("_match.host", "_match.path"), "verdict": F.coalesce("_match.verdict", F.lit(default))})
    return rows.drop("_match")
