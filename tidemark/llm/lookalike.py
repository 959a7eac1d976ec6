"""Documents that look the same though their characters differ."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import checkpoint, spread
from . import look
from .look import same_look


def consistent_text(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """The input with a column holding each text's consistent form; null stays null, empty stays empty."""
    table = look.letter_shapes(df.sparkSession)

    @F.pandas_udf("string")
    def form(s):
        look.use(table)
        return s.map(lambda t: None if t is None else same_look(t))

    return df.withColumn(out, form(F.col(text)))


def fingerprints(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """128-bit hashes of each text and of its consistent form, without null and empty texts."""
    table = look.letter_shapes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look.use(table)
        for b in batches:
            ids, looks, own = b.column(0), [], []
            for t in b.column(1).to_pylist():
                own.append(xxhash.xxh3_128_digest(t.encode()))
                looks.append(own[-1] if t.isascii() else xxhash.xxh3_128_digest(same_look(t).encode()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(looks, pa.binary()), pa.array(own, pa.binary())], ["id", "look", "own"])

    rows = df.filter(F.col(text) != "").select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "id long, look binary, own binary")


def lookalike_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 1000) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of documents whose texts are unequal but look the same.

    Texts are grouped by the hash of their consistent form, then by their own hash: only classes with at
    least two different texts go on, as pairs of texts first and of documents last. Equal texts give no
    pair. Every join is cut into blocks: of the texts of a class and of the documents of a text at most
    ``block`` meet in one join key, the other side being repeated for each block, so work follows the
    size of the result even if one text or class holds a third of all rows. Null and empty texts take no
    part; repeated rows of one document come out once.
    """
    prints = checkpoint(fingerprints(df, doc_id, text).distinct(), "prints")
    texts = prints.groupBy("look", "own").agg(F.count(F.lit(1)).alias("n"))
    classes = texts.groupBy("look").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    texts = checkpoint(texts.join(classes, "look"), "variants")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), blocks(n)).cast("int")
    a = texts.select("look", F.col("own").alias("own_a"), F.col("n").alias("n_a"), part("own", "k").alias("blk"))
    b = texts.select("look", F.col("own").alias("own_b"), F.col("n").alias("n_b"), each("k").alias("blk"))
    pairs = a.join(b, ["look", "blk"]).filter("own_a < own_b").select("own_a", "own_b", "n_a", "n_b")
    # documents of texts that have a double, in blocks of their text
    docs = salted_join(prints, texts.select("own", "n"), "own").select("id", "own", part("id", "n").alias("blk"))
    left = docs.select(F.col("id").alias("id_a"), F.col("own").alias("own_a"), "blk")
    right = docs.select(F.col("id").alias("id_b"), F.col("own").alias("own_b"), "blk")
    half = pairs.select("*", each("n_a").alias("blk")).join(left, ["own_a", "blk"]).select("id_a", "own_b", "n_b")
    whole = half.select("id_a", "own_b", each("n_b").alias("blk")).join(right, ["own_b", "blk"])
    return whole.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b"))


def lookalike_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with a double that looks the same: its class, the texts of the class, and its links.

    ``class_id`` is the lowest doc_id of the class, ``texts`` the number of its different texts, ``links`` that of
    the documents whose texts differ from this one's. The pairs of ``lookalike_pairs`` are those with different
    texts within a class; here nothing is expanded, so the work follows the documents even if one class holds a
    third of them. Null and empty texts take no part; repeated rows of one document come out once.
    """
    prints = checkpoint(fingerprints(df, doc_id, text).distinct(), "prints")
    texts = prints.groupBy("look", "own").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = texts.groupBy("look").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("docs"), F.min("least").alias("class_id")).filter("texts > 1")
    texts = checkpoint(texts.join(classes, "look").select("own", "class_id", "texts", (F.col("docs") - F.col("n")).alias("links")), "classes")
    return salted_join(prints.select("id", "own"), texts, "own").select(F.col("id").alias("doc_id"), "class_id", "texts", "links")


def confusable_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Words that are not what they seem: token, ``kind`` (see ``look.confusable``), its consistent ``form``, and how often it stands.

    Tokens are runs of letters and marks that aren't plain ASCII, counted in each batch before they are shuffled.
    """
    table = look.letter_shapes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look.use(table)
        kinds: dict[str, str | None] = {}
        for b in batches:
            seen: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                if not t.isascii():
                    seen.update(w for w in look.TOKEN.findall(t) if not w.isascii())
            rows = []
            for w, n in seen.items():
                if w not in kinds:
                    if len(kinds) > 200_000:
                        kinds.clear()
                    kinds[w] = look.confusable(w)
                if kinds[w]:
                    rows.append((w, kinds[w], same_look(w), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["token", "kind", "form", "n"])

    rows = spread(df.filter(F.col(text) != "").select(F.col(text).alias("text"))).mapInArrow(run, "token string, kind string, form string, n long")
    return rows.groupBy("token", "kind", "form").agg(F.sum("n").alias("n"))
