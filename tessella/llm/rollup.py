"""Token counts as delta-maintained rollups.

A batch of signed changes (an insert is +1 document, a delete -1, a revised
count -1 of the old and +1 of the new) is summed by source, language and
tokenizer version before anything is stored, so a batch takes a row for each
group, however many documents change and however large one source is. Totals are
the sums over all committed batches.

A batch is committed by giving its entry a name in the log folder, which fails
if the entry exists on file systems whose rename is atomic and refuses a name
that is taken, as HDFS and local ones are; elsewhere one driver at a time may
commit. The entry is whole when it gets its name; the entry names the folder that holds the batch's sums. A batch
that is applied again, by a retry or by another driver, changes nothing, and a
driver that dies before the entry leaves a folder that no reader looks at.
``compact`` commits the sum of all batches so far as one table with the list of
the batches in it.

Defined cases: null sources, languages and versions are groups of their own;
null counts are 0; a group whose documents and tokens both come to zero is not
in the totals; an empty batch is committed and adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.bpe import load_ranks
from tessella.llm.sstable import Encoder
from tessella.llm.store import file_system

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@lru_cache(maxsize=4)
def _counter(path: str, pattern: str) -> Callable[[list[str | None]], list[int]]:
    """A Python worker's counter of the tokens of texts, kept from task to task."""
    if path.endswith(".json"):
        encode = Encoder(path, pattern)
        return lambda texts: [len(ids) for ids in encode(texts)]
    ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return lambda texts: [len(ranks.encode_ordinary(t or "")) for t in texts]


def counted(docs: DataFrame, versions: dict[str, str], pattern: str, *, text: str = "text") -> DataFrame:
    """The documents with a column of token counts for each tokenizer version, a name and the vocabulary's path; a column of that name is replaced.

    A .json vocabulary is counted with the tokenizers library and its added
    tokens, a .tiktoken one without special tokens.
    """
    docs = docs.drop(*versions)
    at = docs.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column(at).to_pylist()
                for name, path in versions.items():
                    part = part.append_column(name, pa.array(_counter(path, pattern)(texts), pa.int64()))
                yield part

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{v}` long" for v in versions]
    return docs.mapInArrow(count, ", ".join(kinds))


def inserted(rows: DataFrame) -> DataFrame:
    """Changes that add rows (source, lang, tokenizer, n_tokens)."""
    return rows.select(*GROUP, "n_tokens", F.lit(1).alias("sign"))


def deleted(rows: DataFrame) -> DataFrame:
    """Changes that take rows away."""
    return rows.select(*GROUP, "n_tokens", F.lit(-1).alias("sign"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that put the rows of ``after`` in the place of those of ``before``."""
    return deleted(before).unionByName(inserted(after))


class Rollup:
    """The totals below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.at = file_system(spark, path)

    def _read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(bytearray(b & 0xFF for b in stream.readAllBytes())).decode()
        finally:
            stream.close()

    def _entries(self) -> dict[str, dict]:
        """The committed batches: their log entries by name."""
        log = self.at(f"{self.path}/log")
        if not self.fs.exists(log):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(log)]
        return {n: json.loads(self._read(f"{self.path}/log/{n}")) for n in sorted(names) if not n.startswith((".", "_"))}

    def _commit(self, name: str, entry: dict) -> bool:
        """Create the log entry; False if it exists, which only one of several writers avoids."""
        whole, part = self.at(f"{self.path}/log/{name}"), self.at(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        if self.fs.exists(whole):
            return False
        self.fs.mkdirs(whole.getParent())
        stream = self.fs.create(part, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        if self.fs.rename(part, whole):
            return True
        self.fs.delete(part, False)
        return False

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of signed changes; False if it was committed before."""
        if self.fs.exists(self.at(f"{self.path}/log/{batch}")) or batch in self.batches():
            return False
        folder = f"{self.path}/data/{batch}-{uuid.uuid4().hex}"
        tokens = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
        sums = changes.groupBy(*GROUP).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * tokens).alias("n_tokens"))
        sums.select(*(F.col(c).cast("string") for c in GROUP), "n_docs", "n_tokens").write.parquet(folder)
        return self._commit(batch, {"folder": folder, "batches": [batch]})

    def batches(self) -> set[str]:
        """The names of all batches in the totals."""
        return {b for e in self._entries().values() for b in e["batches"]}

    def _folders(self) -> list[str]:
        """Folders that count: compacted ones by falling size, then the batches in none of them."""
        seen: set[str] = set()
        folders = []
        for entry in sorted(self._entries().values(), key=lambda e: (-len(e["batches"]), e["folder"])):
            if not seen & set(entry["batches"]):
                folders.append(entry["folder"])
                seen |= set(entry["batches"])
        return folders

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        folders = self._folders()
        rows = self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Commit the totals so far as one table in the place of their batches."""
        batches = sorted(self.batches())
        if not batches:
            return False
        folder = f"{self.path}/data/compact-{uuid.uuid4().hex}"
        self.totals().write.parquet(folder)
        return self._commit(f"compact-{len(batches):08d}", {"folder": folder, "batches": batches})
