"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in a page's posterior:

* its text: a naive Bayes model of hashed byte trigrams, counted over all documents of known language;
* the language its markup declares, and the suffix of its address: likelihoods of either given the
  language, from sums of the texts' posteriors over all pages, grouped by declared value and suffix;
* its host: a prior from the other pages of the host, smoothed towards that of its domain, which is
  smoothed towards that of all pages. A page's own text is taken out of these sums.

Neighbouring trigrams are far from independent, so a text counts as DISCOUNT * sqrt(n) trigrams and
not as n.

Defined cases: null or empty html and null urls give no evidence of their kind; pages without any
get the prior; documents of null language or text are not learnt from; without learnable documents
the language and its probability are null; repeated rows get equal results; ties go to the first
language by name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, table, written
from .textarrays import mixed, slices, utf8
from .wrappers import _ruled_out, host_of, read

#: log2 of the hashed trigrams; languages that a model holds at most (more are an error).
BITS, MOST_LANGUAGES = 14, 256
SMOOTH, DISCOUNT = 0.5, 2.0
#: Pages' worth that a host's domain, and a domain's whole web, weigh in its prior; and of the likelihoods.
HOST_WEIGHT, DOMAIN_WEIGHT, VALUE_WEIGHT = 4.0, 16.0, 1.0
SALTS = 16

_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]+)|<meta\b[^>]*http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*content\s*=\s*[\"']?\s*([a-zA-Z]+)", re.I)


def _grams(data: np.ndarray) -> np.ndarray:
    """The hashed trigrams of some bytes, A-Z as a-z, as cells."""
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    low = np.where((low < 65), np.uint8(32), low).astype(np.uint64)  # digits and signs tell no language
    if len(low) < 3:
        return np.zeros(0, np.int64)
    return (mixed(low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16)) >> np.uint64(64 - BITS)).astype(np.int64)


def _summed(batches):
    now = total = None
    for b in batches:
        for lang, salt, n, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            new = np.frombuffer(counts, np.int64)
            if (lang, salt) == now:
                total, pages = total + new, pages + n
                continue
            if now is not None:
                yield pa.record_batch([pa.array([x], t) for x, t in zip((*now, pages, total.tobytes()), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["lang", "salt", "n", "counts"])
            now, total, pages = (lang, salt), new, n
    if now is not None:
        yield pa.record_batch([pa.array([x], t) for x, t in zip((*now, pages, total.tobytes()), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["lang", "salt", "n", "counts"])


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log probabilities (languages x cells) of trigrams in each."""

    def counted(batches):
        by: dict[str, list] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            data, offsets = utf8(b.column(1))
            for first, last in slices(offsets):
                for k in range(first, last):
                    mine = by.setdefault(langs[k], [0, np.zeros(1 << BITS, np.int64)])
                    mine[0] += 1
                    mine[1] += np.bincount(_grams(data[offsets[k] : offsets[k + 1]]), minlength=1 << BITS)
        if len(by) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        part = TaskContext.get().partitionId() % SALTS
        for lang, (n, counts) in by.items():
            yield pa.record_batch([pa.array([lang]), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([counts.tobytes()])], ["lang", "salt", "n", "counts"])

    shape = "lang string, salt int, n long, counts binary"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(counted, shape)
    rows = rows.repartition(parts, "lang", "salt").sortWithinPartitions("lang", "salt").mapInArrow(_summed, "lang string, salt int, n long, counts binary")
    rows = rows.withColumn("salt", F.lit(0)).repartition(parts, "lang").sortWithinPartitions("lang").mapInArrow(_summed, shape)
    rows = sorted((r.lang, bytes(r.counts)) for r in rows.limit(MOST_LANGUAGES + 1).collect())
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rows:
        return [], np.zeros((0, 1 << BITS))
    counts = np.stack([np.frombuffer(c, np.int64) for _, c in rows]) + SMOOTH
    return [k for k, _ in rows], np.log(counts / counts.sum(1, keepdims=True))


def visible_text(page: str) -> str:
    """The text of a page outside the elements that tags and names rule out."""
    out: list[str] = []
    todo = [read(page)]
    while todo:
        node = todo.pop()
        if node[0] == "#":
            out.append(node[1])
        elif not node[0] or not _ruled_out(node[0], False):
            todo += reversed(node[1])
    return " ".join(out)


def evidence(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, url, host, domain, suffix, declared and t0, t1 ...: the text's log posterior of each language (equal without text)."""

    def batches(rows):
        for b in rows:
            declared, scores = [], np.zeros((b.num_rows, len(langs)))
            for k, page in enumerate(b.column(2)):
                page = page.as_py() or ""
                m = _DECLARED.search(page)
                declared.append((m[1] or m[2]).lower() if m else None)
                cells = _grams(np.frombuffer(visible_text(page).encode(), np.uint8))
                if len(cells):
                    scores[k] = logs[:, cells].mean(1) * min(len(cells), DISCOUNT * len(cells) ** 0.5)
            scores -= np.logaddexp.reduce(scores, axis=1, keepdims=True)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(declared, pa.string()), *(pa.array(s) for s in scores.T)], ["page_id", "url", "declared", *(f"t{i}" for i in range(len(langs)))])

    shape = "page_id long, url string, declared string" + "".join(f", t{i} double" for i in range(len(langs)))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(batches, shape)
    host = host_of()
    rows = rows.withColumn("host", F.when(host != "", host))
    part = lambda pattern: F.nullif(F.regexp_extract("host", pattern, 1), F.lit(""))
    return rows.withColumn("domain", part(r"([^.]+\.[^.]+)$")).withColumn("suffix", part(r"\.([a-z]+)$"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, lang, probability, text_lang, text_probability, declared, suffix, host of every row."""
    langs, logs = text_model(docs)
    names = "page_id, url, lang, probability, text_lang, text_probability, declared, suffix, host"
    if not langs:
        empty = {"lang": "string", "probability": "double", "text_lang": "string", "text_probability": "double", "declared": "string", "suffix": "string"}
        return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), *(F.lit(None).cast(t).alias(k) for k, t in empty.items()), host_of().alias("host"))
    rows = written(evidence(pages, langs, logs), pages)
    n = range(len(langs))

    def sums(key, to):
        return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(*(F.sum(F.exp(f"t{i}")).alias(f"{to}{i}") for i in n))

    d = rows
    for key, to in (("host", "h"), ("domain", "m"), ("declared", "c"), ("suffix", "s")):
        d = d.join(sums(key, to), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    # One row with the sums over all pages, joined on a constant.
    total = rows.agg(*(F.coalesce(F.sum(F.exp(f"t{i}")), F.lit(0.0)).alias(f"a{i}") for i in n))
    values = {key: max(1, rows.agg(F.count_distinct(key)).first()[0]) for key in ("declared", "suffix")}
    own = lambda i: F.exp(f"t{i}")
    totals = total.first()
    every = [float(totals[f"a{i}"]) for i in n]
    all_pages = sum(every)
    base = [(F.lit(every[i]) - own(i) + 1.0) / (all_pages - 1.0 + len(langs)) for i in n]

    def smoothed(to, key, weight, prior):
        count = [F.greatest(F.coalesce(F.col(f"{to}{i}") - own(i), F.lit(0.0)), F.lit(0.0)) for i in n]
        size = sum(count[1:], count[0])
        return [(count[i] + weight * prior[i]) / (size + weight) for i in n]

    for i in n:
        d = d.withColumn(f"b{i}", base[i])
    for i, x in enumerate(smoothed("m", "domain", DOMAIN_WEIGHT, [F.col(f"b{i}") for i in n])):
        d = d.withColumn(f"d{i}", x)
    for i, x in enumerate(smoothed("h", "host", HOST_WEIGHT, [F.col(f"d{i}") for i in n])):
        d = d.withColumn(f"p{i}", x)

    def likelihood(to, key, i):
        value = (F.greatest(F.col(f"{to}{i}") - own(i), F.lit(0.0)) + VALUE_WEIGHT / values[key]) / (F.lit(every[i]) - own(i) + VALUE_WEIGHT)
        return F.coalesce(F.log(value), F.lit(0.0))

    for i in n:
        d = d.withColumn(f"f{i}", F.col(f"t{i}") + F.log(f"p{i}") + likelihood("c", "declared", i) + likelihood("s", "suffix", i))
    best = F.array_max(F.array(*(F.struct(F.col(f"f{i}").alias("score"), F.lit(-i).alias("at")) for i in n)))
    text = F.array_max(F.array(*(F.struct(F.col(f"t{i}").alias("score"), F.lit(-i).alias("at")) for i in n)))
    named = F.array(*(F.lit(x) for x in langs))
    d = d.withColumn("_best", best).withColumn("_text", text)
    sharing = sum((F.exp(F.col(f"f{i}") - F.col("_best.score")) for i in list(n)[1:]), F.exp(F.col("f0") - F.col("_best.score")))
    out = d.select("page_id", "url", F.element_at(named, 1 - F.col("_best.at")).alias("lang"), (1 / sharing).alias("probability"), F.element_at(named, 1 - F.col("_text.at")).alias("text_lang"), F.exp("_text.score").alias("text_probability"), "declared", "suffix", "host")
    return out.select(*names.split(", "))


def op4_language(spark, sf_dir):
    """The language of every page, learnt from all documents."""
    pages = table(spark, sf_dir, "pages")
    return compact(identify(pages, table(spark, sf_dir, "documents").select("lang", "text")), pages)
