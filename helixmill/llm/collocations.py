"""Phrase collocations by top-order marginalisation.

Only longest windows are counted: a word and the three that lead from it, padded with "" where a piece ends. Every count
of a shorter phrase is a sum of theirs over what follows it, so Spark's ROLLUP over the counted windows gives the counts
of all prefixes, and no n-gram of another order is exploded. The lead columns are made from the text's own row: a lead()
over exploded words would shuffle and sort every word of the corpus for the same values.

Before, a narrow pass counts words and word pairs by the buckets of a hash, and another one triples of frequent pairs. A
bucket below the least support holds only what is below it, and a phrase can't be more frequent than a pair or triple
inside it; so windows are padded from the first such pair or triple on, and a window that begins with such a word is left
out. That saves shuffling windows without any effect on the counts of phrases of that support: collisions only leave more
windows in. A filter is ``1 << bits`` bits, whatever the corpus; where it is full it saves nothing and loses nothing.

Counts are exact: hashes choose work, words are compared as they are. Scores are made in decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import tokens
from helixmill.llm.common import partitions, reachable, small, stored

ORDER = 4
SUPPORT = 30
BITS = 24
FIRST = 2000
FULL = 65_535  #: supports up to this can be asked for
COVER = 80  #: percent of a phrase's occurrences in one longer phrase from which on it is dropped
NO_LANG = "und"
SCALE = 2_000_000
_BREAKS = b".,;:!?\n\x0b\x0c\r"
TABLE = tokens.byte_table(lambda c: tokens.BREAK if c in _BREAKS else tokens.SPACE if c in b" \t" else c)
_LEADS = [f"w{k + 1}" for k in range(ORDER)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, tokens.Words, np.ndarray, np.ndarray]]:
    """Of each slice of a batch: its languages, the language of each word, its words, and the hashes of words and of pairs.

    The pair of a word is it and the next one; where there is no next one, the hash has no meaning.
    """
    lang, text = batch.column("lang"), batch.column("text")
    for a, b in tokens.slices(text):
        w = tokens.words(text[a:b], TABLE)
        named = lang[a:b].dictionary_encode()
        of = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.doc]
        one = tokens.mixed(tokens.hashes(w.dictionary, 1)[w.ids] + tokens.hashes(named.dictionary.cast(pa.binary()), 2)[of])
        two = tokens.mixed(one * np.uint64(0xC2B2AE3D27D4EB4F) + np.roll(one, -1))
        yield named.dictionary, of, w, one, two


def _bucket_counts(texts: DataFrame, support: int, bits: int, pairs: Broadcast | None = None) -> DataFrame:
    """bucket and n, of buckets of that support: occurrences of words and pairs; with the pairs' filter, of triples instead.

    Of triples only those count whose two pairs are in the filter. With words and pairs bucket -1 has a row for each lang,
    with the number of all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen, total = ["lang", "bucket", "n"], np.zeros(1 << bits, np.uint16), {}
        for batch in batches:
            for langs, of, w, one, two in _sliced(batch):
                if pairs is None:
                    for name, n in zip(langs.to_pylist(), np.bincount(of, minlength=len(langs)).tolist(), strict=True):
                        total[name] = total.get(name, 0) + n
                    h = np.concatenate((one, two[w.joined]))
                else:
                    on = w.joined & _in(pairs.value, two, bits)
                    h = _triples(one, two)[on & np.roll(on, -1)]
                at, n = np.unique(h >> np.uint64(64 - bits), return_counts=True)
                seen[at] = np.minimum(seen[at] + n, FULL)  # from there on a bucket is known to be frequent
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([-1] * len(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=names)
        for a in range(0, len(seen), 1 << 20):
            at = np.flatnonzero(seen[a : a + (1 << 20)])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array((at + a).astype(np.int32)), pa.array(seen[at + a].astype(np.int64))], names=names)

    rows = texts.mapInArrow(run, "lang string, bucket int, n long")
    return stored(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).where(f"bucket < 0 OR n >= {support}"))


def _triples(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return tokens.mixed(two * np.uint64(0xFF51AFD7ED558CCD) + np.roll(one, -2))


def _filter(buckets: DataFrame, bits: int) -> Broadcast:
    """A bit for each bucket that is listed: 1 << bits of them, fetched and sent as that many bits, whatever the corpus."""
    long = buckets.where("bucket >= 0").groupBy(F.expr("bucket div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, bucket % 64))").alias("bits"))
    got = long.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return buckets.sparkSession.sparkContext.broadcast(out.astype("<i8").view(np.uint8))


def _in(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bucket of each hash is in the filter."""
    bucket = h >> np.uint64(64 - bits)
    return (bitmap[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def longest_windows(docs: DataFrame, support: int = SUPPORT, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The stored counts of padded longest windows (lang, w1 to w4, n), and n, the number of all words of each lang."""
    if support > FULL:
        raise ValueError(f"support must not be above {FULL}")
    reachable(docs.sparkSession)
    texts = _texts(docs)
    buckets = _bucket_counts(texts, support, bits)
    pairs = _filter(buckets, bits)
    triples = _filter(_bucket_counts(texts, support, bits, pairs), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, of, w, one, two in _sliced(batch):
                words, n = len(w.dictionary) + 1, len(one)
                after = lambda x, k: np.concatenate((x, np.zeros(k, bool)))[k:]
                pair = w.joined & _in(pairs.value, two, bits)
                triple = pair & after(pair, 1) & _in(triples.value, _triples(one, two), bits)
                alive = [_in(pairs.value, one, bits), pair, triple, triple & after(triple, 1)]
                lead = [np.where(x, np.concatenate((w.ids, w.ids[:k]))[k : k + n] + 1, 0) if k <= n else np.zeros(n, np.int64) for k, x in enumerate(alive)]
                at = np.flatnonzero(alive[0])
                half = lambda a, b: np.unique(a[at] * words + b[at], return_inverse=True)
                (left, i), (right, j) = half(of * words + lead[0], lead[1]), half(lead[2], lead[3])
                both, n = np.unique(i * max(1, len(right)) + j, return_counts=True)
                left, right = left[both // max(1, len(right))], right[both % max(1, len(right))]
                named = pa.concat_arrays([pa.array([b""], pa.binary()), w.dictionary]).cast(pa.string())
                columns = [named.take(pa.array(x)) for x in (left // words % words, left % words, right // words, right % words)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(left // words // words)), *columns, pa.array(n)], names=["lang", *_LEADS, "n"])

    rows = texts.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, w4 string, n long")
    return stored(rows.groupBy("lang", *_LEADS).agg(F.sum("n").alias("n"))), buckets.where("bucket < 0").select("lang", "n")


def frequent(windows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Every phrase of one to four words of at least that support: lang, size, phrase, f. Stored."""
    top = windows.where("w4 <> ''").select("lang", F.lit(ORDER).alias("size"), F.concat_ws(" ", *_LEADS).alias("phrase"), F.col("n").alias("f"))
    sums = windows.rollup("lang", *_LEADS[:-1]).agg(F.grouping_id().alias("rolled"), F.sum("n").alias("f"))
    size = F.when(F.col("rolled") == 0, 3).when(F.col("rolled") == 1, 2).when(F.col("rolled") == 3, 1)
    sums = sums.withColumn("size", size).where("size IS NOT NULL AND CASE size WHEN 3 THEN w3 WHEN 2 THEN w2 ELSE w1 END <> ''")
    words = F.slice(F.array(*_LEADS[:-1]), F.lit(1), F.col("size"))
    sums = sums.select("lang", "size", F.array_join(words, " ").alias("phrase"), "f")
    return stored(top.unionByName(sums).where(F.col("f") >= support))


def scored(phrases: DataFrame) -> DataFrame:
    """Of phrases of two words or more (lang, phrase, a): l, r and score at the cut of the lowest score, the first of equal ones."""
    known = small(phrases.select("lang", "phrase", "f"))
    part = lambda name, as_name: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(as_name))
    words = F.split("phrase", " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(words, F.col("k") + 1, F.lit(ORDER)), " ")})
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def standing(phrases: DataFrame) -> DataFrame:
    """lang and phrase of those of two words or more that no longer one covers: none that holds them has 80 % of their occurrences."""
    words, size = F.split("phrase", " "), F.col("size")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda b: F.array_join(F.slice(words, b, n), " "))))
    longer = phrases.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    rows = phrases.where("size > 1").join(longer, ["lang", "phrase"], "left")
    covered = F.expr(f"CAST(over AS DECIMAL(20, 0)) * 100 >= CAST(f AS DECIMAL(20, 0)) * {COVER}")
    return rows.where(F.col("over").isNull() | ~covered).select("lang", "phrase")


def collocations(docs: DataFrame, support: int = SUPPORT, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """docs: lang and text. Returns the best phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Null languages are one, ``und``; null and empty texts, and texts without words, have no phrases; repeated rows count
    each time. An empty table, or one without a phrase of that support, gives no rows. Columns other than lang and text are
    not read. Texts are worked on in slices of 2 MB; a longer text is one slice. A language's phrases are ranked in shares
    first, so that only the first of each share meet.
    """
    windows, words = longest_windows(docs, support, bits)
    phrases = frequent(windows, support)
    rows = stored(scored(phrases).join(standing(phrases), ["lang", "phrase"], "left_semi"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return rows.join(small(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
