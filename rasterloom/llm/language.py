"""Language identification by Bayesian evidence fusion.

log P(lang | evidence) = text likelihood + declared markup language + address suffix + host prior. The text model is
naive Bayes over byte trigrams, fitted on a bounded labelled sample. The other terms come from grouped aggregates of
the text posteriors over all rows: P(declared | lang), P(suffix | lang), and host priors smoothed from host to
domain to suffix to the whole. A row's own text counts in none of its aggregates: they are evidence of the other
rows. Every aggregate is a table that grows with distinct values only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, discard, fresh, small_batches, table

#: Labelled documents that the text model takes at most for each language (smallest hash of the id).
SAMPLE = 1000
#: Hash ranges of ids, counted to find each language's sample without sorting all its rows.
RANGES = 4096
#: Hash buckets of byte trigrams; the most trigrams that a text counts as: n count as n * EVIDENCE / (n + EVIDENCE), since those of one text are not independent.
GRAMS, EVIDENCE = 1 << 16, 400
#: Pseudo-counts: rows a host's (domain's, suffix's) prior takes from the level above.
KAPPA = 8.0
#: Rows whose best posterior is lower, or whose text has fewer letters, are rejected.
LEAST_POSTERIOR, LEAST_LETTERS = 0.6, 3
DECLARED = re.compile(r"<[hH][tT][mM][lL]\b[^<>]*?\b[lL][aA][nN][gG]\s*=\s*[\"']?([A-Za-z]{2,3})")
#: Comments, elements and tags that are not closed hide the rest of the page; a < before no letter is text.
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)(?=[\s/>]).*?(?:</\1\s*>|\Z)|<[a-z!/?][^>]*(?:>|\Z)", re.I | re.S)


def gram_codes(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes that hold a letter in their middle."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letter, b, 32)
    code = (b[:-2] * np.uint32(2654435761)) ^ (b[1:-1] * np.uint32(40503)) ^ (b[2:] * np.uint32(69069))
    return ((code >> 7) % GRAMS)[letter[1:-1]]


class TextModel:
    """Log-likelihood of each language for hashed trigrams; only what differs from an unseen trigram's is held."""

    def __init__(self, langs: list[str], grams: np.ndarray, at: np.ndarray, counts: np.ndarray):
        """counts[k] times trigram grams[k] in language number at[k], each pair once."""
        self.langs = langs
        order = np.lexsort((at, grams))
        grams, self.at, counts = grams[order], at[order].astype(np.int32), counts[order]
        sums = np.bincount(self.at, weights=counts, minlength=len(langs)) + 0.5 * GRAMS
        self.unseen = np.log(0.5 / sums)
        self.more = np.log((counts + 0.5) / 0.5).astype(np.float32)
        self.starts = np.searchsorted(grams, np.arange(GRAMS + 1))

    def evidence(self, text: str) -> tuple[np.ndarray, int]:
        """(log-likelihoods relative to the best, letters), at the weight that EVIDENCE describes."""
        codes = gram_codes(text)
        own, times = np.unique(codes, return_counts=True)
        total = self.unseen * len(codes)
        step = max(1, (1 << 20) // max(1, len(self.langs)))
        for i in range(0, len(own), step):
            first = self.starts[own[i : i + step]]
            sizes = self.starts[own[i : i + step] + 1] - first
            held = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            total += np.bincount(self.at[held], self.more[held] * np.repeat(times[i : i + step], sizes), len(self.langs))
        total *= EVIDENCE / (EVIDENCE + len(codes))
        return total - total.max(initial=-np.inf) if len(total) else total, len(codes)


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int) -> DataFrame:
    """(lang, text) of each language's first `sample` labelled rows by (hash of the id, id).

    Counts of hash ranges tell where each sample ends, so that only the rows of the range it ends in are ranked and
    texts are read once.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.lower(F.col(lang_col)).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    rows = rows.withColumn("part", F.shiftright("h", 64 - RANGES.bit_length() + 1))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    parts = rows.groupBy("lang", "part").agg(F.count("*").alias("n")).withColumn("before", before).where(F.col("before") < sample)
    ends = cut(parts.groupBy("lang").agg(F.max(F.struct("part", "before")).alias("end")).select("lang", F.col("end.part").alias("end"), "end.before"), "ends")
    taken = cut(rows.join(ends, "lang").where("part <= end"), "taken")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    last = taken.where("part = end").withColumn("rank", rank).where(F.col("rank") <= sample).where(F.col("before") + F.col("rank") <= sample)
    return taken.where("part < end").select("lang", "text").unionAll(last.select("lang", "text"))


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> TextModel:
    """From at most `sample` labelled rows of each language; null languages give no label. No rows: no languages."""
    small_batches(docs.sparkSession)

    def run(batches):
        own = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams, n = np.unique(gram_codes(text or ""), return_counts=True)
                held = own.setdefault(lang, {})
                for g, k in zip(grams.tolist(), n.tolist()):
                    held[g] = held.get(g, 0) + k
        for lang, c in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(c) + 1), pa.string()), pa.array([-1, *c], pa.int64()), pa.array([0, *c.values()], pa.int64())], ["lang", "gram", "n"])

    counted = labelled_sample(docs, text_col, lang_col, id_col, sample).mapInArrow(run, "lang string, gram long, n long")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # One row a language, whose trigram -1 stands for a language whose texts have none.
    rows = found.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).toLocalIterator()
    held = sorted(((r.lang, np.array(r.gram), np.array(r.n, float)) for r in rows), key=lambda r: r[0])
    if not held:
        return TextModel([], *[np.zeros(0, np.int64)] * 3)
    grams, counts = (np.concatenate([r[k] for r in held]) for k in (1, 2))
    at = np.repeat(np.arange(len(held)), [len(r[1]) for r in held])
    seen = grams >= 0
    return TextModel([r[0] for r in held], grams[seen], at[seen], counts[seen])


def host_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain: its last three labels, suffix: its last label)."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    if not m:
        return None, None, None
    labels = m[1].lower().strip(".").split(".")
    return ".".join(labels), ".".join(labels[-3:]), labels[-1]


def slices(batch: pa.RecordBatch, langs: int):
    """Parts of a batch whose arrays over the languages stay small."""
    step = max(1, (1 << 18) // max(1, langs))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def vectors(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def softmax(ll: np.ndarray) -> np.ndarray:
    weights = np.exp(ll - ll.max(1, keepdims=True))
    return weights / weights.sum(1, keepdims=True)


def text_evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """(id, declared, host, domain, suffix, letters, ll array, p array: posteriors by the text alone) of (id, text, declared, url)."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in (part for whole in batches for part in slices(whole, len(m.langs))):
            declared, hosts, letters, lls = [], [], [], []
            for text, said, url in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                text = text or ""
                if markup:
                    found = DECLARED.search(text)
                    said = found[1] if found else said
                    text = HIDDEN.sub(" ", text)
                ll, n = m.evidence(text)
                declared.append(said.lower() if said else None)
                hosts.append(host_parts(url) if url is None or "://" in url else (url, url, None))
                letters.append(n)
                lls.append(ll)
            h = [pa.array([x[i] for x in hosts], pa.string()) for i in range(3)]
            ll = np.array(lls).reshape(len(lls), len(m.langs))
            p = softmax(ll) if len(m.langs) else ll
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(declared, pa.string()), *h, pa.array(letters, pa.int64()), vectors(ll), vectors(p)], ["id", "declared", "host", "domain", "suffix", "letters", "ll", "p"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, declared string, host string, domain string, suffix string, letters long, ll array<double>, p array<double>")


def vector_sums(rows: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, n array): sums of the arrays in col by position."""
    one = rows.select(*keys, F.posexplode(col).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("n"))


def identify(rows: DataFrame, model: TextModel, id_col: str, text_col: str, declared_col: str | None = None, url_col: str | None = None, markup: bool = False) -> DataFrame:
    """(id, lang, posterior, text_lang, declared, host, rejected) for each row of rows.

    markup: the text is HTML, whose tags are dropped and whose html element declares the language. url_col may hold
    an address or a bare source name. lang is the most likely language, or 'und' when rejected: too few letters
    (null, empty and numeric texts) or too low a posterior. Missing evidence of a kind is neutral; ties go to the
    language first in order. Repeated rows stay; an empty table gives an empty result.
    """
    found, used = fused(rows, model, id_col, text_col, declared_col, url_col, markup)
    out = cut(found, "languages")
    discard(*used)
    return out


def fused(rows: DataFrame, model: TextModel, id_col: str, text_col: str, declared_col: str | None, url_col: str | None, markup: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(what identify() returns, not written yet; the tables it reads, to be discarded once it is)."""
    langs = model.langs
    text = F.col(text_col).alias("text")
    none = F.lit(None).cast("string")
    own = cut(text_evidence(rows.select(F.col(id_col).alias("id"), text, (F.col(declared_col) if declared_col else none).alias("declared"), (F.col(url_col) if url_col else none).alias("url")), model, markup), "evidence")
    if not langs:
        out = own.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_lang"), "declared", "host", F.lit(True).alias("rejected"))
        return out, [own]
    spread = own.where(F.col("letters") >= LEAST_LETTERS)
    hosts = cut(vector_sums(spread, ["host", "domain", "suffix"], "p"), "hosts")
    domains, suffixes, declared = (cut(vector_sums(df.where(F.col(c).isNotNull()), [c], v), c) for df, c, v in ((hosts, "domain", "n"), (hosts, "suffix", "n"), (spread, "declared", "p")))

    def total(counts):
        out = np.zeros(len(langs))
        for r in counts.select(F.posexplode("n").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r.i] = r.x
        return out

    whole, n_said = total(hosts), total(declared)
    kinds, kinds_suf = max(1, declared.count()), max(1, suffixes.count())
    h, d, s, said = (df.select(*keys, F.col("n").alias(n)) for df, keys, n in ((hosts.where("host IS NOT NULL"), ["host", "domain", "suffix"], "ch"), (domains, ["domain"], "cd"), (suffixes, ["suffix"], "cs"), (declared, ["declared"], "cv")))
    counts = cut(h.join(d, "domain", "left").join(s, "suffix", "left").select("host", "ch", "cd", "cs"), "counts")

    def matrix(column):
        """Rows of a column of arrays, nulls as zeros; which are not null."""
        there = np.asarray(column.is_valid())
        out = np.zeros((len(column), len(langs)))
        out[there] = np.asarray(column.drop_null().flatten()).reshape(-1, len(langs))
        return out, there[:, None]

    def smoothed(counts, above):
        return (counts + KAPPA * above) / (counts.sum(1, keepdims=True) + KAPPA)

    def fuse(batches):
        names = np.array(langs, object)
        for b in (part for whole in batches for part in slices(whole, len(langs))):
            ll, counted = matrix(b.column(4))[0], np.asarray(b.column(3)) >= LEAST_LETTERS
            own = matrix(b.column(5))[0] * counted[:, None]

            def others(column):
                """Counts of a column's value without the row's own part."""
                counts, there = matrix(column)
                return np.where(there, np.maximum(counts - own, 0), 0.0), there

            (ch, hosted), (cd, _), (cs, _), (cv, said), (cf, suffixed) = (others(b.column(i)) for i in (6, 7, 8, 9, 10))
            total, total_said = np.maximum(whole - own, 0), np.maximum(n_said - own * said, 0)
            prior = (total + 1) / (total + 1).sum(1, keepdims=True)
            by_host = np.where(hosted, smoothed(ch, smoothed(cd, smoothed(cs, prior))), prior)
            # log P(value | lang), add-half smoothed; neutral where the value is missing
            by_said = np.where(said, np.log((cv + 0.5) / (total_said + 0.5 * (kinds + 1))), 0.0)
            by_suffix = np.where(suffixed, np.log((cf + 0.5) / (total + 0.5 * (kinds_suf + 1))), 0.0)
            post = softmax(ll + np.log(by_host) + by_said + by_suffix)
            best = post.max(1)
            rejected = ~counted | (best < LEAST_POSTERIOR)
            lang = np.where(rejected, "und", names[post.argmax(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(best), pa.array(names[ll.argmax(1)], pa.string()), b.column(1), b.column(2), pa.array(rejected)], ["id", "lang", "posterior", "text_lang", "declared", "host", "rejected"])

    joined = own.join(counts, "host", "left").join(said, "declared", "left").join(s.withColumnRenamed("cs", "cf"), "suffix", "left").select("id", "declared", "host", "letters", "ll", "p", "ch", "cd", "cs", "cv", "cf")
    kind = own.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(fuse, f"id {kind}, lang string, posterior double, text_lang string, declared string, host string, rejected boolean").withColumn("posterior", F.round("posterior", 6))
    return out, [own, hosts, domains, suffixes, declared, counts]


def language_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs' rows (own columns) that identify() does not reject. Rows that share an id stand or fall with the best of them."""
    found, used = fused(docs, fit_text_model(docs, text_col, lang_col, id_col), id_col, text_col, lang_col, source_col, False)
    own = fresh("id__", docs)
    gone = cut(found.groupBy(F.col("id").alias(own)).agg(F.min("rejected").alias("all")).where("all").select(own), "gone")
    discard(*used)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")


def op9_language(spark, sf_dir: str) -> DataFrame:
    model = fit_text_model(table(spark, sf_dir, "documents"))
    return identify(table(spark, sf_dir, "pages"), model, "page_id", "html", None, "url", markup=True).withColumnRenamed("id", "page_id")
