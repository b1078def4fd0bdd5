"""Token counts behind a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, n_tokens). Documents are joined with it by the digest
of their normalised content and the digest of the tokenizer's file; of the contents it lacks, one document each is
encoded, and their counts are appended. A new version of a tokenizer has another digest, so it never meets old counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from helixmill.llm.common import reachable, shared_dir, stored

REMEMBERED = 1_000_000
CACHE = "content string, tokenizer string, n_tokens long"


class Chunks(dict):
    """Token counts of chunks between white space, for tokenizers that never join text across it."""

    def __init__(self, count: Callable[[list[str]], list[int]]):
        super().__init__()
        self.count = count

    def of(self, text: str) -> int:
        chunks = text.encode("utf-8", "surrogatepass").split()
        new = [c for c in dict.fromkeys(chunks) if c not in self]
        if new:
            if len(self) > REMEMBERED:
                self.clear()
                new = list(dict.fromkeys(chunks))
            self.update(zip(new, self.count([c.decode("utf-8", "surrogatepass") for c in new]), strict=True))
        return sum(map(self.__getitem__, chunks))


def drops_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file says that white space only divides: the split keeps matches only, and none has any."""
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    if any(n["type"] not in ("NFC", "Lowercase", "Replace") for n in normal.get("normalizers", [normal])):
        return False
    if any(n.get("pattern") != {"Regex": "\\s+"} or n.get("content") != " " for n in normal.get("normalizers", []) if n["type"] == "Replace"):
        return False
    if first.get("behavior") != "Removed" or not first.get("invert") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return False
    probe = regex.compile(first["pattern"]["Regex"])
    return not any(set(" \t\n\r\x0b\x0c") & set(m) for a in "aA1!é'" for b in "aA1!é'" for s in " \t\n\r\x0b\x0c" for m in probe.findall(a + s + s + b))


@cache
def counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a text as the file's library does, without begin, end or other added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    count = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        spaces = drops_spaces(json.load(f))
    return Chunks(count).of if spaces else lambda text: count([text])[0]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content(text: str = "text") -> Column:
    """What is counted: null is the empty text. Nothing else is folded, as tokenizers may count any difference."""
    return F.coalesce(F.col(text), F.lit(""))


def _cached(spark, path: str) -> DataFrame:
    """The cache; an empty one where nothing has been stored yet. A cache that can't be read is an error."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def fill(docs: DataFrame, tokenizer: str, cache_path: str) -> DataFrame:
    """Append the counts of all contents of docs that the cache at cache_path lacks; returns the cache.

    Misses are found among digests only. Each is represented by its document of the smallest id, and the texts meet
    those choices by a join on (id, digest), which has no hot key however many copies a content has.
    """
    reachable(docs.sparkSession)
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    rows = docs.select(F.col("doc_id").alias("id"), content().alias("text"))
    rows = rows.withColumn("content", F.sha2("text", 256))
    known = _cached(spark, cache_path).where(F.col("tokenizer") == version).select("content")
    misses = rows.groupBy("content").agg(F.min("id").alias("id")).join(known, "content", "left_anti")
    texts = rows.join(misses.hint("shuffle_hash"), [rows["content"] == misses["content"], rows["id"].eqNullSafe(misses["id"])], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            n = [count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    new = texts.select("content", "text").mapInArrow(run, CACHE)
    new.groupBy("content", "tokenizer").agg(F.min("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)
    return _cached(spark, cache_path)


def counted(docs: DataFrame, tokenizer: str, limit: int = 2048, cache_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. Null texts count as empty ones, repeated rows stay.

    Without a cache_path a new cache is made in the shared folder.
    """
    cache_path = cache_path or f"{shared_dir(docs.sparkSession)}-tokens"
    got = fill(docs, tokenizer, cache_path).where(F.col("tokenizer") == tokenizer_digest(tokenizer)).dropDuplicates(["content"])
    rows = docs.select("doc_id", F.octet_length(content()).cast("long").alias("n_bytes"), F.sha2(content(), 256).alias("content"))
    return rows.join(stored(got.select("content", "n_tokens")), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
