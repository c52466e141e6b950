"""URL filter: logistic regression on hashed character n-grams of host and path, with host and path rules first.

The model is trained from a small labelled URL table: rows (url, label), label
1 for urls to block, at most MAX_ROWS of them (the rest is refused, not
dropped). seed_urls() makes such a table from a few lists where none is given.

A null url, or one without "://", has an empty host and path and gets the
model's verdict for them. Urls of any length are scored whole; rows that repeat
are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .frames import read

MAX_ROWS = 20_000
DIM, SIZES = 1 << 14, (3, 4, 5)

# The words of the seed table: what names sites to block, and what names ordinary ones.
BAD_WORDS = ("casino", "poker", "roulette", "slots", "betting", "jackpot", "bingo", "porn", "xxx", "nude", "escort", "camgirls", "hentai", "viagra", "cialis", "pills", "pharma", "steroids", "torrent", "warez", "cracked", "keygen", "serialz", "payday-loan", "fastcash", "free-money", "clickbait", "spam", "replica-watches", "fake-id", "phishing", "malware")
GOOD_WORDS = ("news", "library", "docs", "university", "museum", "recipes", "weather", "journal", "history", "science", "garden", "school", "archive", "theatre", "council", "hospital", "railway", "observatory", "orchestra", "gallery", "forum", "wiki", "software", "bakery", "cycling", "chess", "poetry", "geology", "climate", "parish", "bookshop", "travel")
ENDS = ("com", "net", "org", "info", "co.uk", "de", "io", "eu")


#: (host, path, verdict) of the rules in force.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def seed_urls() -> list[tuple[str, int]]:
    """The labelled table used where none is given."""
    out = []
    for label, names in ((1, BAD_WORDS), (0, GOOD_WORDS)):
        for i, w in enumerate(names):
            end, other, third = ENDS[i % len(ENDS)], names[(i + 5) % len(names)], names[(i + 11) % len(names)]
            out += [(f"http://{w}.example.{end}/{i}", label), (f"https://www.{w}-{other}.{end}/en/{third}/{100 * i}.html", label), (f"https://site{i}.example.{end}/{w}/{other}?page=2", label), (f"http://best{w}{i}.{end}/{third}_{other}.php", label)]
    plain = ("blog", "m", "www", "shop", "static", "en", "mail", "cdn")
    return out + [(f"https://{w}.example.{e}/{lang}/{n}", 0) for w in plain for e in ENDS[:4] for lang, n in (("en", 17), ("fr", 2044), ("de", 31), ("es", 905))]


def buckets(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of each host and path; begin and end are marked, and the two fields don't share buckets."""
    rows, found = [], []
    for salt, field in ((1, hosts), (2, paths)):
        marked = pa.array([f"^{x}$" if x else "" for x in field.to_pylist()], pa.large_string())
        raw, off = tx.text_bytes(marked)
        owner = np.repeat(np.arange(len(marked)), np.diff(off))
        for n in SIZES:
            if len(raw) >= n:
                ok = owner[: len(raw) - n + 1] == owner[n - 1 :]
                h = tx.mix(tx.byte_grams(raw, n) + np.uint64(31 * salt + n))
                rows.append(owner[: len(raw) - n + 1][ok])
                found.append((h[ok] % np.uint64(DIM)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


def score(hosts: pa.Array, paths: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    row, b = buckets(hosts, paths)
    n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-(bias + np.bincount(row, weights[b], minlength=len(hosts)) / np.sqrt(n))))


def train(rows: list[tuple[str, int]], epochs: int = 300, rate: float = 2.0, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent over the whole table; without both labels the verdict is allow."""
    w, bias = np.zeros(DIM), 0.0
    y = np.array([label for _, label in rows], float)
    if len(set(y.tolist())) < 2:
        return w, -1.0
    parts = [split_url(u) for u, _ in rows]
    row, b = buckets(pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]))
    n = np.maximum(np.bincount(row, minlength=len(rows)), 1)
    x, weight = 1 / np.sqrt(n[row]), np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, w[b] * x, minlength=len(rows)))))
        g = weight * (p - y)
        w -= rate * 20 * (np.bincount(b, g[row] * x, minlength=DIM) + l2 * w / 20)
        bias -= rate * g.sum()
    return w, bias


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path in plain Python, for the small labelled table."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return host.translate({i: i + 32 for i in range(65, 91)}), rest[:cut]


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """All columns of pages with host, path, rule, verdict and block_score.

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest rule wins, and of equally long ones the first by text.
    Columns of pages with these names are replaced.
    """
    rows = seed_urls() if labelled is None else [(r[0], r[1]) for r in labelled.select("url", "label").where("url is not null and label is not null").limit(MAX_ROWS + 1).collect()]
    if len(rows) > MAX_ROWS:
        raise ValueError(f"the labelled table has over {MAX_ROWS} rows")
    weights, bias = train(rows)
    sent = pages.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def block_score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            yield pd.Series(score(pa.array(host, pa.string()), pa.array(path, pa.string()), *sent.value))

    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "block_score")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    out = pages.select(*own, host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    # the last that fits wins
    for h, p, v in sorted(sorted(rules, key=lambda r: r[0] + r[1], reverse=True), key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    out = out.withColumn("block_score", block_score("host", "path"))
    return out.select(*own, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "block_score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
