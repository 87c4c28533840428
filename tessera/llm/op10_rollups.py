"""Delta-maintained token-count rollups by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) is reduced to signed, additive deltas, one row for
each group it touches, written to a folder of its own, and committed by a line of the log that names the folder.
A commit that fails before its line leaves what stood before.  A batch that is sent again, in part or whole,
counts once: its last line holds.  Totals are sums over committed batches and never re-read documents.  `compact`
folds batches into a base under a line that lists their ids; a folded batch is final, and sent again it is ignored.
One process commits to a rollup at a time.

Deltas combine before the shuffle, so a source with a third of all rows costs a task no more than others.

Defined results: null text counts 0 tokens; null source, language or version is a group.  A group whose
documents are all deleted stays with zeros until `compact` drops it.  Empty batches and empty tables add nothing;
repeated rows are changes of their own; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
WORDS = r"[^\x20\x09-\x0D]+"
LOG = "n long, batch string, folder string, folded array<string>"
VOCABULARY = "byte_bpe_50k.tiktoken"


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def bpe_tokens(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Callable[[Column], Column]:
    """A counter of byte-pair tokens for a vocabulary file, by default one of the installed public tokenizers; the file (a few MB) is read on the driver and broadcast."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        raw = f.read()
    shipped = spark.sparkContext.broadcast((raw, pattern))
    made: list = []

    def count(texts: pa.Array) -> pa.Array:
        if not made:
            import tiktoken

            raw, pattern = shipped.value
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
            made.append(tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return pa.array([0 if t is None else len(made[0].encode_ordinary(t)) for t in texts.to_pylist()], pa.int64())

    return lambda text: F.arrow_udf(count, T.LongType())(text)


def changes(rows: DataFrame, op: str, source: Column, lang: Column, tokenizer: Column, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Signed changes of one kind: insert (+1, +tokens), delete (-1, -tokens) or revise (0, tokens - old_tokens)."""
    sign = {"insert": 1, "delete": -1, "revise": 0}[op]
    change = tokens - old_tokens if op == "revise" else tokens * sign
    return rows.select(source.cast("string").alias("source"), lang.cast("string").alias("lang"), tokenizer.cast("string").alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), change.cast("long").alias("tokens"))


class Rollup:
    """Totals kept in a folder: tables of deltas, and the log of committed batches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list:
        """Lines of the log in order: one for each commit and each folding."""
        try:
            return sorted(self.spark.read.schema(LOG).json(f"{self.path}/log").collect(), key=lambda r: r["n"])
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _state(self) -> tuple[int, dict[str | None, str], set[str]]:
        """The next line's number, the folder of the base (under None) and of each batch after it, and the ids folded so far."""
        n, folders, folded = 0, {}, set()
        for r in self._log():
            n = r["n"] + 1
            if r["batch"] is None:
                folded |= set(r["folded"])
                folders = {k: v for k, v in folders.items() if k is not None and k not in folded}
            folders[r["batch"]] = r["folder"]
        return n, folders, folded

    def _put(self, n: int, batch: str | None, deltas: DataFrame, folded: list[str]) -> None:
        folder = f"deltas/{uuid.uuid4().hex}"
        deltas.coalesce(1).write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(n, batch, folder, folded)], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def commit(self, batch: str, changed: DataFrame) -> bool:
        """Reduce changes to deltas and put them in the batch's place, whatever stood there; False for a folded batch, which stays."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError("a batch id is made of letters, digits, dots, lines and underscores")
        n, _, folded = self._state()
        if batch in folded:
            return False
        self._put(n, batch, changed.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), [])
        return True

    def batches(self) -> list[str]:
        """Ids of all committed batches, folded ones too."""
        _, folders, folded = self._state()
        return sorted(folded | {k for k in folders if k is not None})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens over all committed batches."""
        folders = self._state()[1].values()
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self) -> DataFrame:
        """All batches as one base, without groups that are down to nothing; their ids stay known."""
        n, folders, folded = self._state()
        self._put(n, None, self.totals().where("docs <> 0 or tokens <> 0"), sorted(folded | {k for k in folders if k is not None}))
        return self.totals()
