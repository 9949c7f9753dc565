"""URL filters: a blocked Bloom filter of the listed keys, then an exact hash join.

A rule is ``(host, path, verdict)``. It fits its host and every subdomain of it if the
url's path starts with the rule's path; the longest fitting rule wins. Each url is turned
into the keys ``host suffix + path prefix`` that a rule could have. Keys go through a
split-block Bloom filter (256-bit blocks, one bit in each of eight words); what passes is
joined exactly with the rules, so false positives only cost work.

Filter size follows the number of rules up to ``max_filter_mb``; beyond it the filter gets
denser and passes more, and the exact join still decides. The rules are broadcast for the
join up to ``max_broadcast_rules``; larger lists are joined by a shuffle on salted keys.

Only rows that pass a key are joined and grouped; all others keep their place.

Defined results: null urls and urls without ``://`` have an empty host and path, no rule
and the default verdict; repeated rows each get their own row; urls of any length are
read whole; of fitting rules the longest host wins, then the longest path, then "block"; ids of
any type, null or not, come through unchanged; extra columns are dropped
unless named in ``keep``, and none can clash with a working column; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.runtime import in_batches, materialized

_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)
_UPPER = {c: c + 32 for c in range(65, 91)}
_WORDS = [f"w{i}" for i in range(8)]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in (rest.find("/"), rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    host, tail = rest[:end].translate(_UPPER), rest[end:]
    stop = min((k for k in (tail.find("?"), tail.find("#")) if k >= 0), default=len(tail))
    return host, tail[:stop]


def candidate_keys(host: str, path: str, lengths: list[int], labels: int) -> list[str]:
    """Keys of all rules that could fit: host suffixes of up to ``labels`` labels x path prefixes of the rules' lengths."""
    if not host:
        return []
    parts = host.rsplit(".", labels)
    suffixes = [host] if len(parts) <= labels else []
    suffixes += [".".join(parts[k:]) for k in range(1, len(parts))]
    return [f"{s}{path[:n]}" for s in suffixes if s for n in lengths if n <= len(path)]


def _hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64, len(keys))


def _bits(low: np.ndarray) -> np.ndarray:
    """For each key one bit in each of the eight words of its block."""
    return np.uint32(1) << ((low[:, None] * _SALTS[None, :]) >> np.uint32(27))


def _place(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    high = hashes >> np.uint64(32)
    return (high * np.uint64(n_blocks)) >> np.uint64(32), _bits((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def build_filter(keys: DataFrame, n_keys: int, max_filter_mb: int = 64) -> np.ndarray:
    """The filter over column ``key``: 16 bits a key up to ``max_filter_mb``, at most one row a block reaches the driver."""
    n_blocks = int(min(max(1, -(-n_keys * 16 // 256)), max_filter_mb * 2**20 // 32))

    def blocks(found: list) -> list[list]:
        block, bits = _place(_hashes(found), n_blocks)
        return [block.astype(np.int64), *bits.T.astype(np.int64)]

    rows = (
        in_batches(keys, ["key"], [], "block long, " + ", ".join(f"{w} long" for w in _WORDS), blocks)
        .groupBy("block")
        .agg(*[F.bit_or(w).alias(w) for w in _WORDS])
        .toPandas()
    )
    held = np.zeros((n_blocks, 8), np.uint32)
    held[rows["block"].to_numpy(np.int64)] = rows[_WORDS].to_numpy(np.int64).astype(np.uint32)
    return held


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    keep: tuple[str, ...] = (),
    max_filter_mb: int = 64,
    max_broadcast_rules: int = 200_000,
    salts: int = 32,
) -> DataFrame:
    """Rows ``(id_col, *keep, host, path, rule, verdict)``, one per input row."""
    spark = pages.sparkSession
    listed = rules.select(
        F.concat("host", "path").alias("key"), F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    # the longest host wins, then the longest path; equal rules: "block" before "allow"
    listed = listed.groupBy("key", "r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    n_rules = listed.count()
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())
    labels = listed.agg(F.max(F.size(F.split("r_host", r"\."))).alias("k")).first()["k"] or 1
    held = spark.sparkContext.broadcast(build_filter(listed, n_rules, max_filter_mb))

    def probe(urls: list) -> list[list]:
        table = held.value
        split = [split_url(u) for u in urls]
        keys = [candidate_keys(h, p, lengths, labels) for h, p in split]
        flat = [k for ks in keys for k in ks]
        hit = np.empty(0, bool)
        if flat:
            block, bits = _place(_hashes(flat), len(table))
            hit = ((table[block.astype(np.int64)] & bits) == bits).all(axis=1)
        at, passed = 0, []
        for ks in keys:
            passed.append([k for k, ok in zip(ks, hit[at : at + len(ks)], strict=True) if ok])
            at += len(ks)
        return [[h for h, _ in split], [p for _, p in split], passed]

    columns = list(dict.fromkeys([id_col, *keep]))
    # own columns travel under numbers, so that none can clash
    tried = in_batches(pages, [url_col], [(c, f"own{k}") for k, c in enumerate(columns)], "host string, path string, keys array<string>", probe)
    tried = materialized(tried.withColumn("row", F.monotonically_increasing_id()))
    own = [f"own{k}" for k in range(len(columns))]
    # what passes no key needs no join; false positives find no rule in it
    clear = tried.where(F.size("keys") == 0).select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    maybe = tried.where(F.size("keys") > 0).withColumn("key", F.explode("keys")).drop("keys")
    if n_rules <= max_broadcast_rules:
        hits = maybe.join(F.broadcast(listed), "key", "left")
    else:
        hits = maybe.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))).join(
            listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["key", "salt"], "left"
        )
    fits = F.col("r_host").isNotNull() & ((F.col("host") == F.col("r_host")) | F.col("host").endswith(F.concat(F.lit("."), "r_host"))) & F.col("path").startswith(F.col("r_path"))
    best = F.max(F.when(fits, F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), F.col("key"), F.col("r_verdict")))).alias("best")
    # a row's own columns ride along as one value, not as grouping keys: they may be of any type
    judged = hits.groupBy("row").agg(F.first(F.struct(*own, "host", "path")).alias("own"), best)
    found = judged.select("own.*", F.col("best.key").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
    return clear.unionByName(found).toDF(*columns, "host", "path", "rule", "verdict")


#: Fixed rules of the registered query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


OP9_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT row_number() OVER () AS rn, page_id,
         CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT rn, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut),
urls AS (
  SELECT rn, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM split),
fit AS (
  SELECT u.rn, u.page_id, u.host, u.path, r.r_host || r.r_path AS rule, r.r_verdict,
         row_number() OVER (PARTITION BY u.rn ORDER BY length(r.r_host) DESC, length(r.r_path) DESC) AS k
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.r_host OR ends_with(u.host, '.' || r.r_host)) AND starts_with(u.path, r.r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
