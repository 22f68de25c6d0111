"""Language identification by fusing evidence in Bayes' way.

Four kinds of evidence are combined: the page's text, by byte trigrams; the
language its markup declares; its address's suffix; and the languages of its
host, smoothed by those of the host's domain, of the domain's suffix and of
all pages. How far a declaration or a suffix can be trusted is itself counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import small_batches, stored
from folio.llm.url_filters import url_host, url_path
from folio.llm.words import byte_blocks, texts_of

#: Rows of known language that the text model is learned from, at most, taken by a hash of the id, as far as their
#: texts have so many bytes together.
MAX_ROWS = 1500
MAX_BYTES = 16 << 20
BUCKETS = 1 << 14
#: Trigrams overlap and repeat: each counts as so much of an independent one.
PER_TRIGRAM = 0.2
#: Pages of the wider group that a host, domain or suffix starts from.
SMOOTHING = 5.0

_HTML = re.compile(r"<html\b[^>]*", re.IGNORECASE)
_LANG = re.compile(r"\slang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.IGNORECASE)
_DROPPED = re.compile(r"<(script|style|nav|template|noscript)\b[^>]*>|<!--", re.IGNORECASE)
_ENDS = {k: re.compile(rf"</{k}\s*>", re.IGNORECASE) for k in ("script", "style", "nav", "template", "noscript")} | {"--": re.compile("-->")}
_TAG = re.compile(r"<[^<>]*>")
_ENTITY = re.compile(r"&#?\w{1,10};")


def visible_text(html: str) -> str:
    """The page's text, without scripts, styles, navigation, comments and markup.

    Each element ends at the next end tag of its kind; one that never ends is
    only a tag. Each kind is looked for once past its last end, so that time
    grows with the text whatever it holds.
    """
    out, at, endless = [], 0, set()
    while m := _DROPPED.search(html, at):
        kind = (m[1] or "--").lower()
        end = None if kind in endless else _ENDS[kind].search(html, m.end())
        out.append(html[at : m.start()])
        if end is None:
            endless.add(kind)
        at = end.end() if end else m.end()
    return _ENTITY.sub(" ", _TAG.sub(" ", " ".join([*out, html[at:]])))


def declared_language(html: str) -> str | None:
    """The two- or three-letter code of the first html tag that has one, in lower case."""
    found = (m for tag in _HTML.finditer(html) if (m := _LANG.search(tag[0])))
    return next((m[1].lower() for m in found), None)


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # what is no letter counts as a blank


def trigram_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bucket, document, documents) of every trigram of folded bytes, block by block."""
    for _, data, bounds in byte_blocks(column):
        x = _FOLD[data]
        n = len(bounds) - 1
        if len(x) < 3:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), n
            continue
        h = ((x[:-2] * 65_599 + x[1:-1]) * 65_599 + x[2:]) * np.uint32(2_654_435_769) >> np.uint32(18)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        inside = (doc[:-2] == doc[2:]) & ((x[:-2] != 32) | (x[1:-1] != 32))
        yield h[inside].astype(np.int64), doc[:-2][inside], n


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language) from at most ``MAX_ROWS`` rows of known language and ``MAX_BYTES`` of text."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= MAX_BYTES))
    order = F.xxhash64(F.lit(5), "id")
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).distinct().orderBy(order, "id", "lang").limit(MAX_ROWS)
    texts = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(rows), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).orderBy(order, "id", "lang")
    found, total = [], 0
    for r in sample.toLocalIterator():  # a partition at a time, until the sample is full
        total += len(r["text"].encode())
        if total > MAX_BYTES:
            break
        found.append((r["lang"], r["text"]))
    langs = sorted({lang for lang, _ in found})
    counts = np.full((BUCKETS, max(1, len(langs))), 0.5)
    for k, lang in enumerate(langs):
        for bucket, _, _ in trigram_counts(pa.array([t for x, t in found if x == lang], pa.string())):
            counts[:, k] += np.bincount(bucket, minlength=BUCKETS)
    return langs, np.log(counts / counts.sum(axis=0))


def text_evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], html_col: str = "html") -> DataFrame:
    """``pages`` with ``declared`` and ``text_log``: the text's log likelihood by language, less the greatest."""
    langs, logs = model
    table = logs.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            html = [x or "" for x in batch["_html"].to_pylist()]
            evidence = []
            for bucket, doc, n in trigram_counts(texts_of(pa.array([visible_text(x) for x in html], pa.string()))):
                total = np.zeros((n, max(1, len(langs))))
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(doc, weights=table[bucket, k], minlength=n) * PER_TRIGRAM
                evidence.append(total - total.max(axis=1, keepdims=True))
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_html"]
            names = [c for c in batch.schema.names if c != "_html"]
            logged = pa.array(list(np.concatenate(evidence)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rest, pa.array([declared_language(x) for x in html], pa.string()), logged], names=[*names, "declared", "text_log"])

    kept = [c for c in pages.columns if c not in (html_col, "declared", "text_log")]
    rows = small_batches(pages).select(*kept, F.col(html_col).cast("string").alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema)
    return rows.mapInArrow(run, f"{fields}, declared string, text_log array<double>")


def _shares(logs: Column) -> Column:
    """The probabilities of an array of logs whose greatest is 0 or near."""
    e = F.transform(logs, F.exp)
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def fused(seen: DataFrame, langs: list[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, suffix, host) of every row of ``seen``.

    Everything that is counted comes from grouped sums over all rows: first by
    host, declaration and suffix, then from hosts to domains, top domains and
    all. A row's own part is taken out of all of them, so that its text counts
    once. The sums by host are written before rows are joined to them,
    so that Spark can split a hot host's rows over tasks.
    """
    size = range(max(1, len(langs)))
    host = url_host(F.col(url_col))
    labels = F.split(host, r"\.")
    top = F.element_at(labels, -1)
    first = F.regexp_extract(F.lower(url_path(F.col(url_col))), r"^/([a-z]{2})(?:/|$)", 1)
    rows = seen.withColumns({"host": host, "suffix": F.concat_ws("/", F.nullif(top, F.lit("")), F.nullif(first, F.lit(""))), "declared": F.coalesce("declared", F.lit("")), "own": _shares(F.col("text_log"))})
    own = [F.col("own")[k] for k in size]

    def summed(df: DataFrame, keys: list, values: list[Column]) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(v).alias(f"s{k}") for k, v in enumerate(values)])

    kept = [F.col(f"s{k}") for k in size]

    def total(c: list[Column]) -> Column:
        out = c[0]
        for x in c[1:]:
            out = out + x
        return out

    domain = F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.lit(1), F.size(F.split("host", r"\.")) - 1), F.lit(2)), ".")
    hosts = summed(rows, ["host"], own).withColumn("domain", domain).withColumn("top", F.element_at(F.split("host", r"\."), -1))
    domains = summed(hosts, ["domain", "top"], kept)
    tops = summed(domains, ["top"], kept)
    everyone = [float(x or 0.0) for x in summed(tops, [], kept).first()]
    named = lambda df, name, *more: df.select(*more, F.array(*kept).alias(f"{name}_sums"))
    domains = named(domains, "domain", "domain", "top").join(named(tops, "top", "top"), "top")
    hosts = stored(named(hosts, "host", "host", "domain").join(domains, "domain").select("host", "host_sums", "domain_sums", "top_sums"), "hosts")

    def sums_of(name: str) -> DataFrame:
        return summed(rows, [name], own).select(name, F.array(*kept).alias(f"{name}_sums"))

    def others(name: str) -> list[Column]:
        """The sums without the row's own part."""
        return [F.greatest(F.col(f"{name}_sums")[k] - own[k], F.lit(0.0)) for k in size]

    rest = [F.greatest(F.lit(x) - own[k], F.lit(0.0)) for k, x in enumerate(everyone)]
    base = [(x + 1.0) / (total(rest) + float(len(size))) for x in rest]

    def likelihood(name: str) -> list[Column]:
        """log P(value | language), relative to P(value), with one page of the value spread over all languages."""
        rest = others(name)
        shares = [(rest[k] + base[k]) / ((total(rest) + 1.0) * base[k]) for k in size]
        return [F.when(F.col(name) == "", 0.0).otherwise(F.log(s)) for s in shares]

    joined = rows.join(hosts, "host").join(stored(sums_of("declared"), "declared"), "declared").join(stored(sums_of("suffix"), "suffix"), "suffix")
    declared, suffix, prior = likelihood("declared"), likelihood("suffix"), base
    for wider in ("top", "domain", "host"):  # each starts from the wider group's
        left = others(wider)
        prior = [(left[k] + SMOOTHING * prior[k]) / (total(left) + SMOOTHING) for k in size]
    logs = [F.col("text_log")[k] + F.log(prior[k]) + declared[k] + suffix[k] for k in size]
    posterior = joined.withColumn("_logs", F.array(*logs)).withColumn("_p", _shares(F.transform("_logs", lambda x: x - F.array_max("_logs"))))
    names = F.array(*[F.lit(x) for x in langs] or [F.lit(None).cast("string")])
    best, by_text = F.array_position("_p", F.array_max("_p")), F.array_position("own", F.array_max("own"))
    return posterior.select(
        F.col(id_col).alias("page_id"), F.get(names, (best - 1).cast("int")).alias("lang"), F.array_max("_p").alias("probability"), F.get(names, (by_text - 1).cast("int")).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "suffix", "host"
    )


def page_languages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The language of every page; ``docs`` have texts of known language (doc_id, text, lang).

    Every page is returned once, also those with null or empty addresses or
    markup, for which the other evidence decides; of languages that are equally
    probable the first by name is taken. Without documents the language is
    null, and an empty table of pages gives an empty result. Pages without a
    host share one. Repeated rows count as pages of their own. Very long pages
    are read whole. Only the columns named are read, whatever others are called.
    """
    model = learned(docs)
    narrow = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.col(html_col).alias("html"))
    return fused(stored(text_evidence(narrow, model), "evidence"), model[0])
