"""Evaluation passages inside a corpus, by spaced seeds over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..session import checkpoint, spread
from . import look
from .look import words

SPAN = 13
#: Positions of a window that each mask looks at: all but every third, from 0, 1 and 2. One changed word is always
#: among the ignored of one mask, and so are several whose distances are multiples of three.
MASKS = tuple(tuple(p for p in range(SPAN) if p % 3 != skip) for skip in range(3))
#: The lines of the projective plane of order three over its 13 points are what these masks ignore: any two
#: positions lie on a line, so windows with up to two changed words are always found.
PLANE = tuple(tuple(p for p in range(SPAN) if (p - shift) % SPAN not in (0, 1, 3, 9)) for shift in range(SPAN))
_SLICE = 400_000  # words that are hashed at once
_SIEVE = (16, 27)  # least and most bits of a place in the sieve: 8 KB to 16 MB


def _factors(span: int) -> np.ndarray:
    """Odd multipliers, one for each position of a window."""
    return np.array([xxhash.xxh3_64_intdigest(b"position %d" % p) | 1 for p in range(span)], np.uint64)


def _window_hashes(w: np.ndarray, number: int, mask: tuple[int, ...], span: int) -> np.ndarray:
    """Hash of the number of the mask and the words it looks at, for the windows starting at each word but the last ones."""
    n = len(w) - span + 1
    h, factors = np.full(n, number, np.uint64), _factors(span)
    for p in mask:
        h += w[p:p + n] * factors[p]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """Hashes of the words met so far; emptied when there are very many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h


_hashes = _Hashes()
_SEEDS = "id long, at int, seed long, window binary"


def _seeds(rows: DataFrame, span: int, masks: tuple[tuple[int, ...], ...], sieve=None, every: bool = False) -> DataFrame:
    """(id, at, seed, window) of the windows of texts (id, text), for each mask; with a sieve only those it lets through.

    With ``every`` all masks must pass and the first one's seed comes out: a window without changed words hits under
    each. A window is the hashes of its words. Rows come out batch by batch; a text is one value and stays in one task.
    """
    table = look.letter_shapes(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look.use(table)
        of, bits = _hashes.__getitem__, None if sieve is None else sieve.value
        places = None if bits is None else np.uint64(8 * len(bits) - 1)

        def passes(h: np.ndarray) -> np.ndarray:
            place = h & places
            return ((bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

        for b in batches:
            ids, texts, here = b.column(0).to_numpy(), b.column(1).to_pylist(), 0
            while here < len(texts):
                parts, sizes, first = [], [], here
                while here < len(texts) and (not sizes or sum(sizes) < _SLICE):
                    ws = words(texts[here])
                    parts.append(np.fromiter(map(of, ws), np.uint64, len(ws)))
                    sizes.append(len(ws))
                    here += 1
                w, n = np.concatenate(parts), np.array(sizes)
                if len(w) < span:
                    continue
                start = np.cumsum(n) - n
                fits = np.repeat(np.cumsum(n), n)[:len(w) - span + 1] - np.arange(len(w) - span + 1) >= span
                doc = np.repeat(np.arange(len(n)), n)
                for number, mask in enumerate(masks):
                    h = _window_hashes(w, number, mask, span)
                    keep = fits if bits is None else fits & passes(h)
                    if every:
                        for other in range(1, len(masks)):
                            if keep.any():
                                keep &= passes(_window_hashes(w, other, masks[other], span))
                    pos = np.flatnonzero(keep)
                    for cut in range(0, len(pos), 50_000):
                        p = pos[cut:cut + 50_000]
                        body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * span), len(p), [None, pa.py_buffer(np.ascontiguousarray(w[p[:, None] + np.arange(span)]).tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first:here][doc[p]]), pa.array((p - start[doc[p]]).astype(np.int32)), pa.array(h[p].view(np.int64)), body.cast(pa.binary())], ["id", "at", "seed", "window"])
                    if every:
                        break

    return rows.mapInArrow(run, _SEEDS)


def _sieve(spark: SparkSession, seeds: DataFrame):
    """Bits of the seeds there are, 32 places for each or more: at most 2^27 of them, so a broadcast of 16 MB whatever the
    items. When it is fuller it lets more through, which costs time and changes nothing."""
    n = seeds.count()
    k = min(_SIEVE[1], max(_SIEVE[0], (32 * max(1, n)).bit_length()))
    place = F.col("seed").bitwiseAND(F.lit((1 << k) - 1))
    marks = seeds.select(F.shiftright(place, 5).alias("word"), place.bitwiseAND(F.lit(31)).alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("marks"))
    bits = np.zeros(1 << (k - 5), "<u4")
    found = marks.toArrow()  # as many rows as words at most
    bits[found["word"].to_numpy()] = found["marks"].to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(bits.view(np.uint8))


def leak_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
              changed: int = 0, span: int = SPAN, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """(doc_id, item_id, d, e, misses): windows of ``span`` words at d of a document and e of an item that agree but for ``misses`` words, ``changed`` at most.

    Windows with equal words are always found, those with other words where some mask ignores them all.

    The seeds of both sides, hashes of the words that a mask looks at, are joined: the corpus is read once,
    whatever the items, and of its windows only those that pass the sieve of the items' seeds leave their
    task. Items are reduced to distinct windows before the join and unfolded after the check of each hit, so
    a phrase that many items share is met once; seeds and windows that hold a large part of the hits are
    spread. Words are compared by look and without case. Texts that are null, empty or shorter than ``span``
    words match nothing; an item under two ids counts for each; repeated rows count once.
    """
    if span < max((p for m in masks for p in m), default=0) + 1:
        raise ValueError("a mask reaches beyond the window")
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & (F.col("text") != "")).distinct()
    seeds = checkpoint(_seeds(asked, span, masks), "seeds")
    corpus = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text") != ""))
    passed = checkpoint(_seeds(corpus, span, masks, _sieve(spark, seeds), changed == 0), "passed")
    known = seeds.select("seed", F.col("window").alias("own")).distinct()
    misses = sum((F.substring("window", 8 * p + 1, 8) != F.substring("own", 8 * p + 1, 8)).cast("int") for p in range(span))
    met = spread_join(passed, known, "seed", ["id", "at"]).withColumn("misses", misses).filter(F.col("misses") <= changed)
    met = checkpoint(met.select(F.col("id").alias("doc_id"), F.col("at").alias("d"), "own", "misses").distinct(), "met")
    places = seeds.select(F.col("window").alias("own"), F.col("id").alias("item_id"), F.col("at").alias("e")).distinct()
    return spread_join(met, places, "own", ["doc_id", "d"]).select("doc_id", "item_id", "d", "e", "misses")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
          changed: int = 1, span: int = SPAN, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """Documents that contain passages of evaluation items, with how much of them.

    A row for each (doc_id, item_id) with a window that agrees but for at most ``changed`` words (see
    ``leak_hits``): ``run_words`` is the longest run of equal words if it has ``span`` or more, else 0;
    ``windows`` counts the agreeing windows, ``changes`` is the least number of changed words in one, and
    ``extent`` the words of the longest passage: windows at the same distance that touch or overlap, changed
    words between them included.
    """
    hits = checkpoint(leak_hits(docs, items, doc_id, item_id, text, changed, span, masks), "hits")
    line = Window.partitionBy("doc_id", "item_id", F.col("d") - F.col("e"))
    in_order = line.orderBy("d")
    exact = hits.filter("misses = 0").withColumn("run", F.col("d") - F.row_number().over(in_order))
    runs = exact.groupBy("doc_id", "item_id", (F.col("d") - F.col("e")).alias("line"), "run").agg((F.count(F.lit(1)) + (span - 1)).alias("n")).groupBy("doc_id", "item_id").agg(F.max("n").alias("run_words"))
    apart = F.coalesce((F.col("d") - F.lag("d").over(in_order) > span).cast("int"), F.lit(1))
    chained = hits.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(in_order))
    chains = chained.groupBy("doc_id", "item_id", (F.col("d") - F.col("e")).alias("line"), "chain").agg((F.max("d") - F.min("d") + span).alias("extent"), F.count(F.lit(1)).alias("windows"), F.min("misses").alias("changes"))
    whole = chains.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.min("changes").cast("long").alias("changes"), F.max("extent").cast("long").alias("extent"))
    return whole.join(runs, ["doc_id", "item_id"], "left").select("doc_id", "item_id", F.coalesce("run_words", F.lit(0)).cast("long").alias("run_words"), "windows", "changes", "extent")
