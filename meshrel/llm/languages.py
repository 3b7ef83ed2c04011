"""Language identification by Bayesian fusion of text, declared markup, address and host evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import HOT_PARTS, settle, table
from .textkernel import LOWER, SPACE, mix, text_slices
from .urls import host_of, path_of

GRAM = 3
BITS = 15
#: About so many rows of each language fit the text model.
TRAIN_ROWS = 2_000
DECLARED_TRUST = 0.9
SUFFIX_TRUST = 0.8
HOST_STRENGTH = 20.0
LEAST_POSTERIOR = 0.6
MOST_NATS = 40.0
_STEP = np.uint64(0xD1342543DE82EF95)

#: Languages that country suffixes stand for.
SUFFIXES = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def _grams(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each row's letters, words padded by one space; and each row's offsets."""
    data = LOWER[data]
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    value = np.where(letter, data, 32).astype(np.uint64)
    # A space stands between rows, so that no gram crosses them.
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    padded = np.full(len(data) + 2 * (len(off) - 1) + GRAM, 32, np.uint64)
    place = np.arange(len(data)) + 2 * row + 1
    padded[place] = value
    keep = np.zeros(len(padded), bool)
    keep[place] = letter
    hashed = mix(padded[:-2] * _STEP * _STEP + padded[1:-1] * _STEP + padded[2:])
    centre = np.flatnonzero(keep[1:-1])
    bucket = (hashed[centre] >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.concatenate(([0], np.cumsum(np.diff(off))))
    counts = np.concatenate(([0], np.cumsum(letter)))
    return bucket, counts[owner]


def _gram_counter(languages: list[str], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), 1 << bits), np.int64)
        at = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            label = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi, data, off in text_slices(batch.column("text")):
                bucket, ends = _grams(data, off, bits)
                own = np.repeat(label[lo:hi], np.diff(ends))
                sums += np.bincount(own * (1 << bits) + bucket, minlength=sums.size).reshape(sums.shape)
        which, used = np.nonzero(sums)
        yield pa.record_batch([pa.array(which), pa.array(used), pa.array(sums[which, used])], names=["label", "bucket", "n"])

    return count


def fit_languages(labelled: DataFrame, bits: int = BITS, most_rows: int = TRAIN_ROWS) -> dict:
    """A trigram model of each language from (doc_id, text, lang) rows.

    The languages are those of all labelled rows, by a grouped count. Of each, about ``most_rows`` rows are used,
    whole texts: all of a rarer one, else those whose hash of doc_id and text is below the share that is wanted.
    Counts are summed where the rows are. Rows without lang or text are ignored. Without any labelled row the
    model knows no language.
    """
    rows = labelled.where("lang is not null and text is not null").select(F.xxhash64(F.lit(3), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in labelled.where("lang is not null and text is not null").groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    languages = sorted(sizes)
    counts = np.full((len(languages), 1 << bits), 0.5)
    if languages:
        share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, most_rows / sizes[lang]))])
        rows = rows.where(F.pmod("h", F.lit(2**32)) < share[F.col("lang")] * 2**32).select("text", "lang")
        got = rows.mapInArrow(_gram_counter(languages, bits), "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
        np.add.at(counts, (got.column("label").to_numpy(), got.column("bucket").to_numpy()), got.column("n").to_numpy())
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts
    return {"languages": languages, "bits": bits, "logs": logs.astype(np.float32)}


def _likelihoods(model: dict):
    logs, bits, n = model["logs"], model["bits"], len(model["languages"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, n))
            letters = np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, off in text_slices(batch.column("text"), 1_000_000):
                bucket, at = _grams(data, off, bits)
                letters[lo:hi] = np.diff(at)
                for j in range(n):
                    sums = np.concatenate(([0.0], np.cumsum(logs[j][bucket], dtype=np.float64)))
                    out[lo:hi, j] = sums[at[1:]] - sums[at[:-1]]
            # Trigrams overlap; a third of their sum counts, and no text outweighs all else beyond bound.
            out = (out - out.max(axis=1, keepdims=True)) / GRAM if n else out
            out = np.maximum(out, -MOST_NATS)
            names = [f for f in batch.schema.names if f != "text"]
            flat = pa.array(out.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), flat)
            yield pa.record_batch([*(batch.column(f) for f in names), lists, pa.array(letters)], names=[*names, "text_logs", "letters"])

    return score


def _named(languages: list[str], trust: float, column):
    """Log-evidence of a claimed language: ``trust`` on it, the rest shared; none if it is null or unknown."""
    other = math.log((1 - trust) / max(1, len(languages) - 1))
    known = column.isin(languages)
    return F.array(*[F.when(~F.coalesce(known, F.lit(False)), 0.0).when(column == lang, math.log(trust)).otherwise(other) for lang in languages])


def _sum(*arrays):
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda x, y: x + y)
    return total


def _posterior(logs):
    top = F.array_max(logs)
    shares = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    return F.transform(shares, lambda x: x / total)


def _host_sums(scored: DataFrame, sums: DataFrame) -> DataFrame:
    """``scored`` with the sums of its host; hosts with more than a thousandth of all rows, under a thousand, are broadcast."""
    total = sums.agg(F.sum("rows")).first()[0] or 0
    hot = sums.where(F.col("rows") * HOT_PARTS > F.lit(total)).select("h", F.col("of_host").alias("hot_host"), F.col("of_domain").alias("hot_domain"))
    marked = scored.join(F.broadcast(hot), scored["host"] == hot["h"], "left").drop("h")
    # Rows of hot hosts and rows without one meet nothing in the shuffle.
    marked = marked.withColumn("key", F.when(F.col("hot_host").isNull(), F.col("host")))
    alone = marked.where("key is null").select("*", F.col("hot_host").alias("of_host"), F.col("hot_domain").alias("of_domain"))
    rest = marked.where("key is not null")
    rest = rest.join(sums.drop("rows"), rest["key"] == sums["h"]).drop("h")
    return alone.unionByName(rest).drop("hot_host", "hot_domain", "key")


def identify(rows: DataFrame, model: dict, key: list[str], least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """The language of each row from (key..., text, declared, url, host), fused by Bayes' rule.

    Evidence: the text's trigram likelihoods; the language that the markup declares; the country suffix of the
    url's host or a language segment that begins its path; and the host's prior. That prior is smoothed in two
    steps, from grouped sums of what the other rows' other evidence says: the languages of all rows, then those
    of the registered domain (the last two labels), then those of the host, each as heavy as
    ``HOST_STRENGTH`` rows; a row's own part is taken from every sum. One hot host is one row of sums; it is
    combined before the shuffle. The text's evidence counts ``MOST_NATS`` at most: a longer text is no surer.

    Returns key..., lang (null if undetermined), posterior, letters. A row is undetermined if it has no
    letters and no other evidence, or if its best posterior is under ``least_posterior``. Null text, url,
    declaration or host count as no evidence; a null host shares the global prior. An empty table gives an
    empty result. Repeated rows are judged alike.
    """
    languages = model["languages"]
    if not languages:
        return rows.select(*key, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(0).cast("long").alias("letters"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    keys = ", ".join(f"`{k}` {types[k]}" for k in key)
    scored = rows.select(*key, F.coalesce("text", F.lit("")).alias("text"), "declared", "url", "host")
    scored = scored.mapInArrow(_likelihoods(model), f"{keys}, declared string, url string, host string, text_logs array<double>, letters long")
    scored = scored.withColumn("host", F.coalesce("host", F.when(host_of(F.col("url")) != "", host_of(F.col("url")))))
    declared = F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), r"^\s*([A-Za-z]+)", 1))
    suffix = F.element_at(F.split(F.regexp_replace(host_of(F.col("url")), r":\d*$", ""), r"\."), -1)
    table_ = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    segment = F.regexp_extract(path_of(F.col("url")), r"^/([a-z]{2})/", 1)
    address = F.when(segment.isin(languages), segment).otherwise(F.try_element_at(table_, suffix))
    scored = scored.withColumn("own_logs", _sum(F.col("text_logs"), _named(languages, DECLARED_TRUST, declared), _named(languages, SUFFIX_TRUST, address)))
    has_other = declared.isin(languages) | F.coalesce(address.isin(languages), F.lit(False))
    scored = scored.withColumn("known", (F.col("letters") > 0) | has_other).withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)).drop("url", "declared", "text_logs")

    # Each text is scored once; what goes on is a few dozen bytes a row.
    own = F.when(F.col("known"), _posterior(F.col("own_logs"))).otherwise(F.array(*[F.lit(0.0)] * len(languages)))
    scored = settle(scored.withColumn("own", own))

    count = range(len(languages))
    by_host = settle(scored.groupBy("domain", "host").agg(*[F.sum(F.col("own")[i]).alias(f"s{i}") for i in count], F.count("*").alias("rows")))
    by_domain = by_host.groupBy(F.col("domain").alias("d")).agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in count])
    overall = [x or 0.0 for x in by_host.agg(*[F.sum(f"s{i}") for i in count]).first()]
    joined = by_host.where("host is not null").join(by_domain, F.col("domain") == F.col("d"))
    sums = joined.select(F.col("host").alias("h"), "rows", F.array(*[f"s{i}" for i in count]).alias("of_host"), F.array(*[f"d{i}" for i in count]).alias("of_domain"))

    def smooth(sums_, below, strength):
        """Shares of the sums of the other rows, with ``strength`` rows of the prior below."""
        rest = F.zip_with(sums_, F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        whole = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b) + strength
        return F.zip_with(rest, below, lambda c, b: (c + strength * b) / whole)

    even = F.array(*[F.lit(1 / len(languages)) for _ in count])
    base = smooth(F.array(*[F.lit(x) for x in overall]), even, float(len(languages)))
    known_host = _host_sums(scored, sums).withColumn("base", base)
    prior = F.when(F.col("of_host").isNull(), F.col("base")).otherwise(smooth(F.col("of_host"), smooth(F.col("of_domain"), F.col("base"), HOST_STRENGTH), HOST_STRENGTH))
    fused = known_host.withColumn("logs", _sum(F.col("own_logs"), F.transform(prior, lambda p: F.log(p))))
    fused = fused.withColumn("post", _posterior(F.col("logs"))).withColumn("posterior", F.array_max("post"))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.element_at(names, F.array_position("post", F.col("posterior")).cast("int"))
    sure = F.col("known") & (F.col("posterior") >= least_posterior)
    return fused.select(*key, F.when(sure, best).alias("lang"), F.round("posterior", 6).alias("posterior"), "letters")


def _documents(docs: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), nothing.alias("declared"), nothing.alias("url"), F.col("source").cast("string").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, url, host) of raw pages; scripts, styles, comments and tags are cut from the text."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), text.alias("text"), F.when(declared != "", declared).alias("declared"), url.alias("url"), F.when(host_of(url) != "", host_of(url)).alias("host"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is undetermined, those without doc_id too.

    Rows are told apart by a digest of all that is judged, the text and the source. The model is fitted on the rows' own lang labels (see ``fit_languages``); sources stand for hosts. A text
    without letters is undetermined. Without labelled rows nothing can be judged, and all rows stay.
    """
    model = fit_languages(docs)
    if not model["languages"]:
        return docs
    key = F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string"))
    rows = _documents(docs.select(key.alias("doc_id"), "text", "source"))
    lost = identify(rows, model, ["doc_id"]).where("lang is null").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, key == lost["_lost"], "left_anti")


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (doc_id set) and all pages (page_id set), with one model fitted on labelled documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit_languages(docs)
    left = identify(_documents(docs), model, ["doc_id"]).withColumn("page_id", F.lit(None).cast("long"))
    right = identify(page_evidence(pages), model, ["page_id"]).withColumn("doc_id", F.lit(None).cast("long"))
    return left.unionByName(right).select("doc_id", "page_id", "lang", "posterior", "letters", F.col("lang").isNotNull().alias("kept"))


QUERIES = {"op9_language_fusion": op9_language_fusion}
