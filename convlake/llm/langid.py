"""Language of web pages by Bayesian fusion of text, declared markup language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import clear, ready, settle
from convlake.llm.textkit import LOWER, U, mix, segments

BITS = 14  # hashed trigrams of bytes
TEMPER = 0.25  # neighbouring trigrams overlap, so their joint evidence counts a quarter
PULL = 5.0  # pages' worth of weight that a parent in the host hierarchy has
SMOOTH = 0.5

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"<[^>]*>?")
DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
META = re.compile(r"<meta\b[^>]*?http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased bytes within each text, and their text numbers. Digits all count as one."""
    b = LOWER[data].astype(np.uint64)
    b[(b >= 48) & (b <= 57)] = 48
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g = (mix((b[:-2] << U(16)) | (b[1:-1] << U(8)) | b[2:]) >> U(64 - BITS)).astype(np.int64)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    inside = owner[2:] == owner[:-2]
    return g[inside], owner[:-2][inside]


def visible(html: str) -> str:
    return TAG.sub(" ", HIDDEN.sub(" ", html))


def text_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log likelihoods of trigrams, counted over all labelled texts. What comes back, and is broadcast, has
    2**BITS numbers (64 KB) for each language that a label names: it grows with the languages, not with the texts."""
    ready(docs.sparkSession)
    rows = docs.where(f"{lang} is not null and trim({lang}) <> ''").select(F.lower(F.trim(lang)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for low, high, data, offsets in segments(batch.column(1)):
                g, owner = trigrams(data, offsets)
                made = np.bincount(code[low:high][owner] * (1 << BITS) + g, minlength=len(names) << BITS).reshape(len(names), -1)
                for name, row in zip(names, made, strict=True):
                    sums[name] = sums.get(name, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BITS, np.int64)
        for blob in table.column("sums").to_pylist():
            total += np.frombuffer(blob, "<i8")
        return pa.table({"lang": table.column("lang").slice(0, 1), "n": pa.array([int(total.sum())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "lang string, sums binary").groupBy("lang").applyInArrow(add, "lang string, n long, sums binary")
    found = sorted(parts.collect(), key=lambda r: r.lang)
    counts = np.array([np.frombuffer(r.sums, "<i8") for r in found], float).reshape(len(found), 1 << BITS) + SMOOTH
    return [r.lang for r in found], np.log(counts / counts.sum(1, keepdims=True))


def evidence(pages: DataFrame, languages: list[str], table: np.ndarray, key: str, url: str, html: str) -> DataFrame:
    """(row, key, host, site, suffix, declared, n_grams, p): p is the text's own distribution over languages."""
    schema = T.StructType([T.StructField("row", T.LongType()), pages.schema[key], *T.StructType.fromDDL("url string, declared string, n_grams long, p array<double>").fields])
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T.astype(np.float32)))
    many = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                source = part.column(3).to_pylist()
                said = [(m := DECLARED.search(h) or META.search(h)) and m[1].lower() for h in source]
                z, n = np.zeros((len(source), many)), np.zeros(len(source), np.int64)
                for a, b, data, offsets in segments(pa.array([visible(h) for h in source], pa.string())):
                    g, owner = trigrams(data, offsets)
                    n[a:b] = np.bincount(owner, minlength=b - a)
                    for j in range(many):
                        z[a:b, j] = np.bincount(owner, weights[g, j], b - a)
                z *= TEMPER
                z = np.exp(z - z.max(1, keepdims=True)) if many else z
                z = z / z.sum(1, keepdims=True) if many else z
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(said, pa.string()), pa.array(n), pa.array(list(z), pa.list_(pa.float64()))], names=schema.names)

    made = pages.select(F.monotonically_increasing_id().alias("row"), key, F.coalesce(url, F.lit("")).alias("url"), F.coalesce(html, F.lit("")).alias("html")).mapInArrow(run, schema)
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    code = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    made = made.withColumn("host", host).withColumn("suffix", F.concat_ws("/", F.substring_index("host", ".", -1), code)).withColumn("site", F.substring_index("host", ".", -2))
    return made.withColumn("declared", F.coalesce("declared", F.lit("")))


def sums(many: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(many)]


def vector(many: int, name: str = "s{0}") -> Column:
    return F.array(*[F.coalesce(F.col(name.format(i)), F.lit(0.0)) for i in range(many)])


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, declared, suffix, text_lang, lang, confidence, n_grams): the language of each page.

    The posterior is the product of four parts. Text: trigram likelihoods from the labelled docs, tempered. Declared language and
    address suffix (last label of the host, and a two-letter first folder): P(value | language), from grouped sums of the texts'
    distributions over all other pages, so a declaration counts as far as their texts bear it out. Host prior: a host's sums are
    drawn toward its site's (last two labels), and these toward all pages', by PULL pages. A page's own text is taken out of its
    value's and its host's sums first.
    Without any labelled text there are no languages, and lang is null. A null url or html is empty; a page without text, host or
    declaration goes by what is left; null keys and repeated rows are pages like any other; an empty table gives an empty result.
    """
    languages, table = text_model(clear(docs, *(set(docs.columns) - {"text", "lang"})))
    pages = clear(pages, *(set(pages.columns) - {key, url, html}))
    many = len(languages)
    rows = settle(evidence(pages, languages, table, key, url, html))
    if not many:
        return rows.select(key, "host", "declared", "suffix", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), "n_grams")
    every = rows.agg(*sums(many)).first()
    total = np.array([x or 0.0 for x in every]) + SMOOTH
    share = F.array(*[F.lit(float(x)) for x in total / total.sum()])

    def borne_out(name: str) -> DataFrame:
        # a value's rows are summed within tasks first
        return rows.groupBy(name).agg(*sums(many)).select(name, vector(many).alias(f"{name}_sums"))

    def likelihood(name: str) -> Column:
        """log P(value | language), the page's own text taken out; values that many languages share tell nothing."""
        own = f"greatest({name}_sums[i] - p[i], 0D) + {2 * SMOOTH}D * share[i]"
        return F.expr(f"transform({name}_sums, (x, i) -> ln(({own}) / (greatest(total[i] - p[i], 0D) + 1D)))")

    add = "zip_with({0}, {1}, (x, y) -> x + {2} * y)"
    hosts = rows.groupBy("host", "site").agg(*sums(many), F.count("*").alias("pages")).withColumn("h", vector(many)).select("host", "site", "h", "pages")
    hosts = settle(hosts)
    sites = hosts.groupBy("site").agg(*[F.sum(F.col("h")[i]).alias(f"s{i}") for i in range(many)], F.sum("pages").alias("site_pages")).withColumn("site_h", vector(many))
    sites = sites.withColumn("share", share).withColumn("site_prior", F.expr(f"transform({add.format('site_h', 'share', PULL)}, x -> x / (site_pages + {PULL}))")).select("site", "site_prior")
    hosts = hosts.join(sites, "site").select("host", "h", "pages", "site_prior")
    out = rows.join(hosts, "host").join(borne_out("declared"), "declared").join(borne_out("suffix"), "suffix")
    out = out.withColumn("share", share).withColumn("total", F.array(*[F.lit(float(x)) for x in total]))
    out = out.withColumn("declared_ll", likelihood("declared")).withColumn("suffix_ll", likelihood("suffix"))
    prior = f"transform(zip_with(h, p, (x, y) -> greatest(x - y, 0D)), (x, i) -> (x + {PULL} * site_prior[i]) / (pages - 1 + {PULL}))"
    out = out.withColumn("prior", F.expr(prior))
    out = out.withColumn("z", F.expr("transform(p, (x, i) -> ln(greatest(x, 1e-300D)) + declared_ll[i] + suffix_ll[i] + ln(greatest(prior[i], 1e-12D)))"))
    out = out.withColumn("z", F.expr("transform(z, x -> exp(x - array_max(z)))"))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.get(names, (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int"))
    confidence = F.array_max("z") / F.expr("aggregate(z, 0D, (s, x) -> s + x)")
    return out.select(key, "host", "declared", "suffix", best("p").alias("text_lang"), best("z").alias("lang"), confidence.alias("confidence"), "n_grams")
