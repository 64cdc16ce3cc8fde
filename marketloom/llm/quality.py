"""Quality rules: word measures, then compression bands.

A text that says the same again and again compresses to almost nothing; one of
keys, hashes or encoded binaries hardly compresses at all. So zstandard's ratio
(compressed by raw bytes) of the whole text must lie in a band that depends on
its length, since short texts compress less and long ones more; and of its
fixed chunks, compressed one by one, no more than a share of the bytes may lie
outside the chunks' own band, which finds such a stretch inside a text that is
sound as a whole. Words are what ASCII white space separates, and equal when
their bytes are.

Texts shorter than the first band are judged by the word measures alone. Null
texts and those without a word have zeros and fail the measures; very long
ones are read whole. Rows are judged one by one, so repeated rows and ids,
ties and null ids do not matter; an empty table comes out empty. Only the id
and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import raw_rows, small_batches, text_or_empty

LEVEL = 3
#: From so many bytes on, the least and the greatest ratio of a whole text.
BANDS = ((128, 0.30, 1.25), (256, 0.30, 1.05), (512, 0.28, 0.95), (1024, 0.26, 0.88), (2048, 0.24, 0.80), (4096, 0.22, 0.75), (16384, 0.18, 0.72), (131072, 0.15, 0.72))
#: Chunks of so many bytes, their band, and the share of a text's bytes that may lie in chunks outside it.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (0.20, 0.75), 0.25
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
NO_CODE_POINT = SPACE + bytes(range(0x80, 0xC0))
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """How many words lie in a run of ``window`` words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    # numbers of runs of 1, 2, 4, ... words; two numbers make the next one, without collisions
    run, size, runs = None, 0, ids
    for bit in range(window.bit_length()):
        if window >> bit & 1:
            run = runs if run is None else np.unique(run[: len(words) - size - (1 << bit) + 1] * (int(runs.max()) + 1) + runs[size:], return_inverse=True)[1]
            size += 1 << bit
        step = 1 << bit
        if size < window:
            runs = np.unique(runs[:-step] * (int(runs.max()) + 1) + runs[step:], return_inverse=True)[1]
    again = np.bincount(run)[run] > 1
    change = np.zeros(len(words) + 1, np.int64)
    change[:n] += again
    change[window:] -= again
    return int((np.cumsum(change[:-1]) > 0).sum())


def word_measures(raw: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a UTF-8 text."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(raw.translate(None, NO_CODE_POINT)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def compression(raw: bytes, compressor) -> tuple[float, float]:
    """``(ratio of the whole text, share of its bytes in chunks outside the chunks' band)``; of the last chunk only a whole one counts."""
    whole = len(compressor.compress(raw)) / max(1, len(raw))
    full = range(0, len(raw) - CHUNK + 1, CHUNK)
    outside = sum(not CHUNK_BAND[0] <= len(compressor.compress(raw[at : at + CHUNK])) / CHUNK <= CHUNK_BAND[1] for at in full)
    return whole, outside / len(full) if len(full) else 0.0


def in_bands(n_bytes: int, whole: float, outside: float) -> bool:
    band = next(((low, high) for size, low, high in reversed(BANDS) if n_bytes >= size), None)
    return band is None or band[0] <= whole <= band[1] and outside <= CHUNK_SHARE


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, the five measures, ``base_failed``, ``kept``, ``ratio`` and ``chunks_outside`` of every row."""
    small_batches(docs.sparkSession)

    def rows(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            found = []
            for raw in raw_rows(batch.column(1)):
                measures = word_measures(raw)
                failed = measures[0] < MIN_WORDS or 100 * measures[4] > MAX_REPEAT_PERCENT * measures[0]
                whole, outside = compression(raw, compressor)
                found.append((*measures, failed, not failed and in_bands(len(raw), whole, outside), whole, outside))
            columns = list(zip(*found)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_outside"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)

    chosen = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text"))
    schema = f"id {chosen.schema['id'].dataType.simpleString()}, {MEASURES}, base_failed boolean, kept boolean, ratio double, chunks_outside double"
    return chosen.mapInArrow(rows, schema).withColumnRenamed("id", id_col)
