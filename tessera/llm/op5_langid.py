"""Language identification by compression with per-language raw-content zstandard dictionaries.

A text goes, whole and in blocks, through one compressor per language whose dictionary is raw text of
that language; the language that yields the fewest bytes wins.  Where the runner-up is nearly as small
the answer is marked as rejected.

Fitting uses a bounded sample of the labelled rows: about `rows_per_lang` rows of each language, the
first `sample_chars` characters of each, and at most `dict_bytes` bytes in a dictionary.  Prediction
reads every text whole.

Defined results: null text, or text without a letter: `und`, score 0, rejected.  Ties between languages:
the smaller name, score 0, rejected.  No labelled rows: `und` for all.  Repeated rows get equal answers;
an empty table gives an empty one; extra columns pass through `identify`, one called as `out` under the name
`out`_input.  A text of any length is scored in the same way, block by block.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import cleared

DICT_BYTES = 48 << 10
ROWS_PER_LANG = 400
SAMPLE_CHARS = 4000
BLOCK_BYTES = 4096
MIN_MARGIN = 0.002
#: Every block is encoded so many times over: one that saves nothing would be stored as it is, whatever the dictionary, and a copy always saves.
COPIES = 4
#: The lowest zstandard level whose match search tells close languages apart.
LEVEL = 6

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
_LETTER = re.compile(r"[^\W\d_]")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, rows_per_lang: int = ROWS_PER_LANG, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Language -> dictionary bytes.  Rows are drawn by a hash of id and text, so reruns and any partitioning give the same dictionaries."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(17)).alias("h")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, 1.2 * rows_per_lang / n))])
    picked = rows.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    found: dict[str, list] = {lang: [] for lang in sizes}
    for r in picked.select("lang", "h", F.substring("text", 1, sample_chars).alias("text")).toLocalIterator():
        found[r["lang"]].append((r["h"], r["text"]))
    out = {}
    for lang, texts in sorted(found.items()):
        joined = "\n".join(t.lower() for _, t in sorted(texts)).encode()
        out[lang] = joined[-dict_bytes:] if len(joined) > 8 else joined + b"\n" * 8
    return out


class Classifier:
    """Compressors for a set of dictionaries; made once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], block_bytes: int = BLOCK_BYTES, min_margin: float = MIN_MARGIN) -> None:
        import zstandard as z

        self.block, self.margin = block_bytes, min_margin
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            raw = dictionaries[lang]
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(LEVEL, source_size=COPIES * (block_bytes + 1), dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.coders.append(z.ZstdCompressor(dict_data=d, compression_params=how))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or text is None or not _LETTER.search(text):
            return "und", 0.0, True
        raw = text.lower().encode("utf-8", "replace")
        blocks = [(raw[i : i + self.block] + b"\n") * COPIES for i in range(0, len(raw), self.block)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], self.langs[k]))
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
        score = (second - best) / second
        return self.langs[order[0]], score, score < self.margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", out: str = "langid", *, block_bytes: int = BLOCK_BYTES, min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with a struct column `out` of (lang_pred, score, rejected).  The dictionaries are at most dict_bytes for each learned language."""
    docs = cleared(docs, out)
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)
    made: list[Classifier] = []

    def predict(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Classifier(shipped.value, block_bytes, min_margin))
        got = [made[0](t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=RESULT.fieldNames())

    return docs.withColumn(out, F.arrow_udf(predict, RESULT).asNondeterministic()(F.col(text_col)))
