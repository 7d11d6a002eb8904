"""Problem 8: evaluation passages inside a training corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldchirp.scratch import materialize

_WORD = re.compile(r"[^\W_]+")
_MARK = regex.compile(r"\p{M}+")
SHINGLES = 2_000_000  # item shingles (8 bytes each) that one block of items may send to every task
PASSAGE = 1024  # windows of an item that stay in one block
FACTOR = np.uint64(0x9E3779B97F4A7C15)
KNOWN_WORDS = 500_000  # words whose hash a task remembers


def plain_words(text: str | None) -> str | None:
    """Lower-case words of letters and digits, without marks, joined by single spaces."""
    return None if text is None else " ".join(_words(text))


def _words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFD", text.casefold())
        text = _MARK.sub("", unicodedata.normalize("NFD", text.casefold()))
    return _WORD.findall(text.lower())


class Shingler:
    """Hashes of runs of words, for a batch of texts at once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def ids(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = []
        for w in words:
            i = known.get(w)
            if i is None:
                i = known[w] = xxhash.xxh64_intdigest(w)
            out.append(i)
        return out

    def batch(self, texts: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, hash) of every run of ``k`` words that lies within a text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ids = np.array([i for t in texts for i in self.ids(t)], dtype=np.uint64)
        n = len(ids) - k + 1
        if n <= 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h = h * FACTOR + ids[j : j + n]
        h ^= h >> np.uint64(29)
        h *= FACTOR
        h ^= h >> np.uint64(32)
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)[:n]
        pos = np.arange(n) - begins[of]
        within = pos + k <= sizes[of]
        return of[within], pos[within], h[within].view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """(ids, words) of the texts of each batch that have at least ``run`` words."""
    for b in batches:
        words = [_words(t) if t else [] for t in b.column(1).to_pylist()]
        kept = [i for i, w in enumerate(words) if len(w) >= run]
        if kept:
            yield b.column(0).take(pa.array(kept)), [words[i] for i in kept]


def _map(df: DataFrame, f: Callable, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def to_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], schema=arrow)

    return df.mapInArrow(to_batches, schema)


def _item_windows(items: DataFrame, run: int, k: int) -> DataFrame:
    """Windows of ``run`` words of the items: (item, from, hs, win), hs the hashes of the window's shingles in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        s = Shingler()
        for ids, texts in _texts(batches, run):
            of, pos, h = s.batch(texts, k)
            width = run - k + 1
            first = np.flatnonzero(pos + run <= np.array([len(t) for t in texts])[of])
            hs = h[first[:, None] + np.arange(width)] if len(first) else np.zeros((0, width), dtype=np.int64)
            win = [" ".join(texts[i][p : p + run]) for i, p in zip(of[first], pos[first], strict=True)]
            yield [ids.take(pa.array(of[first])), pos[first].astype(np.int32), pa.array(list(hs), pa.list_(pa.int64())), pa.array(win, pa.string())]

    return _map(items, cut, [("item", items.schema[0].dataType), ("from", T.IntegerType()), ("hs", T.ArrayType(T.LongType())), ("win", T.StringType())])


def _sorted_hashes(df: DataFrame) -> np.ndarray:
    """The hashes of one block of items, whose number is bounded."""
    return np.sort(df.toArrow().column(0).to_numpy())


def _at(wanted: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are wanted, and their places among these."""
    if not len(wanted):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    hit = np.flatnonzero(wanted[at] == h)
    return hit, at[hit]


def _seen(docs: DataFrame, wanted: Broadcast, run: int, k: int) -> DataFrame:
    """(h, n): how often the wanted shingles occur in the corpus, summed within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        s, all_h = Shingler(), wanted.value
        n = np.zeros(len(all_h), dtype=np.int64)
        for _, texts in _texts(batches, run):
            _, _, h = s.batch(texts, k)
            n += np.bincount(_at(all_h, h)[1], minlength=len(all_h))
        some = np.flatnonzero(n)
        yield [all_h[some], n[some]]

    return _map(docs, count, [("h", T.LongType()), ("n", T.LongType())]).groupBy("h").agg(F.sum("n").alias("n"))


def _surroundings(docs: DataFrame, rare: Broadcast, run: int, k: int) -> DataFrame:
    """(id, h, lead, near): where the rare shingles stand and the words round them that a window can reach, ``lead`` of them before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        s = Shingler()
        for ids, texts in _texts(batches, run):
            of, pos, h = s.batch(texts, k)
            hit, _ = _at(rare.value, h)
            of, pos = of[hit], pos[hit]
            lead = np.minimum(pos, run - k)
            near = [" ".join(texts[i][p - a : p + run]) for i, p, a in zip(of, pos, lead, strict=True)]
            yield [ids.take(pa.array(of)), h[hit], lead.astype(np.int32), pa.array(near, pa.string())]

    return _map(docs, find, [("id", docs.schema[0].dataType), ("h", T.LongType()), ("lead", T.IntegerType()), ("near", T.StringType())])


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 12, k: int = 5, shingles: int = SHINGLES
) -> DataFrame:
    """Documents that share at least ``run`` words in a row with an item: (doc_id, item_id, n_windows).

    A prefix-filtered set join.  A window of ``run`` words holds run-k+1
    shingles of ``k`` words, all of which must be in the document, so any one
    of them is a necessary prefix; the one rarest in the whole corpus is
    taken.  It gives the position at which the window must stand; windows that
    would reach beyond the document are out, the others are compared word by
    word.  ``n_windows`` counts the distinct windows of the item found.

    The corpus is read twice and never shuffled: the first pass counts the
    items' shingles, the second writes the words round the rarest ones.  Items
    are taken in blocks of at most some ``shingles``, which is what a task is
    sent; one more block costs two more passes.

    Whole texts are read; counts are over all documents.  Null and empty
    texts, and texts of fewer than ``run`` words, share nothing.  Repeated ids
    are judged together; extra columns are ignored; empty tables give none.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    windows = _item_windows(items.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")), run, k)
    windows = materialize(windows, "leak-windows")
    # A window adds one shingle to those of the window before it; the first of a passage adds them all.
    blocks = 1 + 2 * windows.count() // shingles
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item", F.floor(F.col("from") / PASSAGE)), F.lit(blocks)))
    found = None
    for b in range(blocks):
        mine = windows.where(F.col("block") == b)
        wanted = spark.sparkContext.broadcast(_sorted_hashes(mine.select(F.explode("hs").alias("h")).distinct()))
        seen = materialize(_seen(corpus, wanted, run, k), "leak-seen")
        at = mine.select("item", "from", "win", F.posexplode("hs").alias("off", "h")).join(seen, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rare = at.groupBy("item", "from").agg(F.min_by(F.struct("h", "off", "n", "win"), F.struct("n", "h", "off")).alias("p")).where("p.n > 0")
        rare = materialize(rare.select("item", "from", "p.h", "p.off", "p.win"), "leak-rare")
        hit = _surroundings(corpus, spark.sparkContext.broadcast(_sorted_hashes(rare.select("h").distinct())), run, k)
        hit = materialize(hit, "leak-hits")
        words = hit.select("id", "h", "lead", F.split("near", " ").alias("near"))
        begin = F.col("lead") - F.col("off")
        fits = (begin >= 0) & (begin + run <= F.size("near"))
        same = words.join(rare, "h").where(fits).where(F.array_join(F.slice("near", begin + 1, F.lit(run)), " ") == F.col("win"))
        same = same.select("id", "item", "win")
        found = same if found is None else found.unionByName(same)
    return found.groupBy(F.col("id").alias(doc_id), F.col("item").alias(item_id)).agg(F.countDistinct("win").cast("long").alias("n_windows"))
