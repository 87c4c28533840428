"""The register of queries: a name, a function of the driver's tables, and SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Roles of the data model on the driver's tables, in SQL that both engines read.  `{name}` is a table.
ROLES = {
    # One row for each read and position: a signal, its thresholded call (null between the bounds), a quality and a mismatch flag.
    "calls": """
        SELECT CAST(floor(l_orderkey / 8.0) AS BIGINT) AS read_id,
               CAST(l_partkey % 60 AS BIGINT) AS position,
               CASE WHEN CAST(floor(l_orderkey / 8.0) AS BIGINT) % 2 = 0 THEN 'refA' ELSE 'refB' END AS reference,
               'bc0' || CAST(CAST(floor(l_orderkey / 8.0) AS BIGINT) % 3 + 1 AS STRING) AS sample,
               max(l_discount) AS signal,
               max(l_quantity) AS quality,
               CASE WHEN max(l_discount) >= 0.06 THEN 1 WHEN max(l_discount) <= 0.04 THEN 0 END AS call,
               CASE WHEN max(l_tax) >= 0.07 THEN 1 ELSE 0 END AS mismatch
        FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    # One row for each aligned segment: placement, run-length alignment program and bases.
    "segments": """
        SELECT o_orderkey AS read_id,
               CASE WHEN o_custkey % 2 = 0 THEN 'refA' ELSE 'refB' END AS reference,
               o_orderpriority AS sample,
               CAST(o_custkey % 500 AS BIGINT) AS reference_start,
               CAST(5 + o_orderkey % 6 AS STRING) || 'M' || CAST(1 + o_orderkey % 3 AS STRING) || 'I' || CAST(4 + o_custkey % 5 AS STRING) || 'M' || CAST(1 + o_custkey % 4 AS STRING) || 'D6M' AS cigar,
               substr(translate(md5(CAST(o_orderkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(16 + o_orderkey % 6 + o_orderkey % 3 + o_custkey % 5 AS INT)) AS sequence
        FROM {orders}""",
    # One row for each read with its quality-control measures.
    "molecules": """
        SELECT o_orderkey AS read_id,
               CASE WHEN o_custkey % 2 = 0 THEN 'refA' ELSE 'refB' END AS reference,
               o_orderpriority AS sample,
               o_orderstatus AS status,
               CAST(floor(o_totalprice / 100) AS BIGINT) AS read_length,
               CAST(floor(o_totalprice / 100) AS BIGINT) - o_orderkey % 300 AS mapped_length,
               CAST(1000 + 2000 * (o_custkey % 2) AS BIGINT) AS reference_length,
               CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS read_quality,
               CAST(o_custkey % 61 AS DOUBLE) AS mapping_quality,
               CAST(o_custkey % 500 AS BIGINT) AS reference_start,
               CAST(o_custkey % 500 + 20 + o_orderkey % 80 AS BIGINT) AS reference_end
        FROM {orders}""",
    # An ordered binary track for each user.
    "track": """
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
               CASE WHEN event_id % 5 <> 0 THEN CASE WHEN value > 20 THEN 1 ELSE 0 END END AS call, value
        FROM {events}""",
    # Barcodes of eight bases for each customer, many of them one edit apart.
    "umis": """
        SELECT c_custkey AS read_id, c_mktsegment AS sample,
               substr(translate(md5(CAST(c_custkey % 97 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 7) || CASE WHEN c_custkey % 5 = 0 THEN 'A' WHEN c_custkey % 11 = 0 THEN 'N' ELSE 'C' END AS umi1,
               substr(translate(md5(CAST(c_custkey % 89 AS STRING)), '0123456789abcdef', 'AACCGGTTACGTACGT'), 3, 8) AS umi2
        FROM {customer}""",
    # Class probabilities for labelled documents.
    "predictions": """
        SELECT doc_id, quality AS y, toxic AS modality, doc_id % 5 AS fold,
               CAST((doc_id * 7919 + quality * 350) % 1000 AS DOUBLE) / 1000 AS score
        FROM {labels}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, and the roles above, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            text = ROLES[name]
            return self.spark.sql(text, **{t: getattr(self, t) for t in TABLES if "{" + t + "}" in text})
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def references(self) -> DataFrame:
        """Two references of 600 bases, from digests."""
        return self.spark.createDataFrame([(n, s) for n, s in reference_sequences().items()], "reference string, sequence string")


def reference_sequences() -> dict[str, str]:
    import hashlib

    turn = str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")
    return {r: "".join(hashlib.md5(f"{r}{k}".encode()).hexdigest() for k in range(19)).translate(turn)[:600] for r in ("refA", "refB")}


def expand(sql: str) -> str:
    """`$role` as a subquery and `$references` as literal rows, for the SQL side."""
    for name, text in ROLES.items():
        body = text
        for t in TABLES:
            body = body.replace("{" + t + "}", t)
        sql = sql.replace(f"${name}", f"({body})")
    if "$references" in sql:
        rows = ", ".join(f"('{n}', '{s}')" for n, s in reference_sequences().items())
        sql = sql.replace("$references", f"(SELECT * FROM (VALUES {rows}) AS v(reference, sequence))")
    return sql


def query(oracle: str | None = None):
    """Register a function of Tables under its own name, with SQL if there is any."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = expand(oracle).strip()
        return f

    return put
