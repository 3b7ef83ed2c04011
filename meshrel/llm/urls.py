"""URL allow and block rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import partitions, table

#: The rules of the query, (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
SAMPLE_PER_PARTITION = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url):
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host):
    """Labels in reverse, each ended by \\x01: a host's subdomains are the keys that begin with its own."""
    return F.concat(F.concat_ws("\x01", F.reverse(F.split(host, r"\.", -1))), F.lit("\x01"))


def _place(key: str, salt: int) -> bytes:
    return key.encode() + b"\x00" + (salt + 2**63).to_bytes(8, "big")


def _dealer(cuts: list[bytes], is_rule: bool):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, bucket = [], []
            for i, (key, salt) in enumerate(zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist())):
                if is_rule:
                    low, high = bisect_right(cuts, key.encode()), bisect_right(cuts, key.encode() + b"\xff")
                    index += [i] * (high - low + 1)
                    bucket += range(low, high + 1)
                else:
                    index.append(i)
                    bucket.append(bisect_right(cuts, _place(key, salt)))
            out = batch.take(pa.array(index, pa.int64()))
            yield pa.record_batch([*out.columns, pa.array(bucket, pa.int32())], names=[*out.schema.names, "bucket"])

    return deal


def _sweeper(default: str):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[tuple[int, str, str, str, str]]]] = []
        open_bucket = None
        for batch in batches:
            out: dict[str, list] = {"id": [], "host": [], "path": [], "rule": [], "verdict": []}
            c = batch.to_pydict()
            for bucket, key, kind, id_, host, path, verdict in zip(c["bucket"], c["key"], c["kind"], c["id"], c["host"], c["path"], c["verdict"]):
                if bucket != open_bucket:
                    stack, open_bucket = [], bucket
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(host) + len(path), host, path, verdict, host + path))
                    continue
                best = None
                for _, rules in stack:
                    for rule in rules:
                        if path.startswith(rule[2]) and (host == rule[1] or host.endswith("." + rule[1])) and (best is None or rule[:2] > best[:2] or rule[:2] == best[:2] and rule[3] > best[3]):
                            best = rule
                for name, value in zip(out, (id_, host, path, best and best[4], best[3] if best else default)):
                    out[name].append(value)
            yield pa.record_batch([pa.array(out["id"], pa.int64()), *(pa.array(out[n], pa.string()) for n in ("host", "path", "rule", "verdict"))], names=list(out))

    return sweep


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """The verdict of the longest rule that fits each url; returns (id_col, host, path, rule, verdict).

    A rule (host, path, verdict) fits its host and every subdomain where the url's path begins with the
    rule's. Host subtrees are intervals of reversed-host keys. Urls are range-partitioned at sampled
    places in (key, salt), so that one host with most of the rows is cut too; each rule goes to every
    range that its interval meets. One sweep over a sorted range keeps the stack of open host intervals,
    which are nested, and tests the paths of the rules on it.

    Null urls and urls without ``://`` have an empty host and path and no rule. Urls that no rule fits
    get ``default``. Of equally long rules the one with the greater host wins, then of a repeated rule the
    greater verdict. Repeated rows are judged one by one; empty tables give an empty result; other columns
    are ignored.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    n = partitions(spark)
    url = F.col(url_col).cast("string")
    left = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(F.col(id_col), url).alias("salt"))
    left = left.select(_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"), "salt")
    right = rules.select(F.translate(F.col("host"), _UPPER, _UPPER.lower()).alias("host"), "path", "verdict").where("host is not null and path is not null")
    right = right.select(_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "host", "path", "verdict", F.lit(0).cast("long").alias("salt"))
    # A sample of bounded size, the least rehashed salts, places the cuts; every url is dealt by them.
    sample = sorted(_place(r.key, r.salt) for r in left.select("key", "salt").orderBy(F.xxhash64("salt", F.lit(7))).limit(SAMPLE_PER_PARTITION * n).collect())
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    schema = "key string, kind int, id long, host string, path string, verdict string, salt long, bucket int"
    dealt = left.mapInArrow(_dealer(cuts, False), schema).unionByName(right.mapInArrow(_dealer(cuts, True), schema))
    swept = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "key", "kind").mapInArrow(_sweeper(default), "id long, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


SQL = {
    "op4_url_rules": r"""
    WITH rules(rule_host, rule_path, verdict) AS (VALUES
      ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    parts AS (
      SELECT page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
             row_number() OVER () AS n
      FROM pages),
    best AS (
      SELECT p.n, max(row(length(rule_host) + length(rule_path), rule_host, rule_path, verdict)) AS m
      FROM parts p JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
      GROUP BY p.n)
    SELECT page_id, host, path,
           CASE WHEN m IS NULL THEN NULL ELSE struct_extract(m, 2) || struct_extract(m, 3) END AS rule,
           coalesce(struct_extract(m, 4), 'allow') AS verdict
    FROM parts LEFT JOIN best USING (n)
    """,
}
QUERIES = {"op4_url_rules": op4_url_rules}
