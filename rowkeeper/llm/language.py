"""Language identification by fusing evidence: the text, its declared language, its address and its host.

The text gives a likelihood per language from hashed character trigrams; it is tempered, since neighbouring trigrams are not
independent. What the other evidence says is learned from the corpus itself by grouped aggregation of the text's posteriors: how
often each declared language and each address suffix goes with each language, and the mix of languages of a host. A
host's mix is smoothed towards that of its site and a site's towards the whole corpus, so a host with few documents says
little. The posterior is the product of all. The class ``und`` stands for text that no language explains.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkeeper.llm.common import rows_of
from rowkeeper.session import written

BUCKETS = 2**15  # of hashed trigrams
SAMPLE_ROWS = 500  # labelled rows per language that the likelihoods are fitted on
MOST_TRIGRAMS = 150  # that a text counts for, whatever its length
ALPHA = 0.5  # added to each trigram count
PARENT_ROWS = 20.0  # rows that the parent's mix weighs in a host's or a site's
EVIDENCE_ROWS = 20.0  # likewise, of a declared language or a suffix
LEAST_CONFIDENCE = 0.5
UNDETERMINED = "und"


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of a text in lower case, with a space before and after."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x1F123BB5) + codes[1:-1] * np.uint64(0x27D4EB2F) + codes[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - 15)).astype(np.int64)


@dataclass(frozen=True)
class Likelihoods:
    """Log probability of each bucket in each language; the last language is ``und``."""

    languages: tuple[str, ...]
    table: np.ndarray

    def of(self, text: str | None) -> np.ndarray:
        """Tempered log likelihood of the text in each language; equal for all when there is no text."""
        if not text or not text.strip():
            return np.zeros(len(self.languages))
        found = trigrams(text)
        return self.table[found].sum(axis=0) * (min(len(found), MOST_TRIGRAMS) / len(found))


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language, those with the lowest hash of their id (ties come along).

    The bound is found on the id and language alone, so no text is shuffled for it.
    """
    mark = F.xxhash64(F.col("id"))
    order = Window.partitionBy("lang").orderBy("mark")
    ranked = docs.filter(F.col("lang").isNotNull()).select("lang", mark.alias("mark")).withColumn("at", F.row_number().over(order))
    # A row per language.
    bounds = ranked.filter(F.col("at") <= per_language).groupBy("lang").agg(F.max("mark").alias("bound")).collect()
    chosen = F.lit(False)
    for row in bounds:
        chosen = chosen | ((F.col("lang") == row.lang) & (mark <= row.bound))
    return docs.filter(chosen)


def fit_likelihoods(labelled: DataFrame, per_language: int = SAMPLE_ROWS) -> Likelihoods:
    """Fit on a bounded sample of rows with ``id``, ``text`` and ``lang``."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for texts, langs in rows_of(batches, "text", "lang"):
            for text, lang in zip(texts, langs):
                if text:
                    found = np.bincount(trigrams(text), minlength=BUCKETS)
                    totals[lang] = totals[lang] + found if lang in totals else found
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([t.astype(np.int64).tobytes() for t in totals.values()], pa.binary())],
            ["lang", "counts"],
        )

    # A few rows per language, as the sample is small.
    counted = sampled(labelled, per_language).select("text", "lang").coalesce(8).mapInArrow(count, "lang string, counts binary")
    totals: dict[str, np.ndarray] = {}
    for row in counted.collect():
        found = np.frombuffer(row.counts, np.int64)
        totals[row.lang] = totals[row.lang] + found if row.lang in totals else found
    languages = tuple(sorted(totals))
    shares = [(totals[n] + ALPHA) / (totals[n].sum() + ALPHA * BUCKETS) for n in languages]
    even = np.full(BUCKETS, 1 / BUCKETS)
    shares.append((even + np.mean(shares, axis=0)) / 2 if shares else even)
    return Likelihoods((*languages, UNDETERMINED), np.log(np.stack(shares, axis=1)))


def site_of(host: Column) -> Column:
    """The last two labels of a host name; a name without dots is its own site."""
    return F.lower(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    """The last label of a host name, null without dots."""
    return F.when(F.instr(host, ".") > 0, F.lower(F.substring_index(host, ".", -1)))


def with_text_scores(rows: DataFrame, model, n: int, inside: str | None = None) -> DataFrame:
    """Add ``t``, the log likelihoods of ``text``, and drop ``text``; ``row`` and the other evidence stay.

    With ``inside`` the text is that column of ``row``, so that it is not sent twice.
    """
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", t array<double>"

    def score(batches):
        likelihoods = model.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("row" if inside else "text"))
            texts = texts.field(inside) if inside else texts
            scores = [likelihoods.of(texts[i].as_py()) for i in range(batch.num_rows)]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            offsets = np.arange(0, len(flat) + 1, n, dtype=np.int32)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, flat)], [*kept, "t"])

    return rows.mapInArrow(score, schema)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as part of one expression that no optimizer step can unfold."""
    return F.get(F.transform(F.array(value), body), 0)


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda so_far, x: so_far + x)


def posterior(scores: Column) -> Column:
    """Probabilities from an array of log scores."""
    parts = let(F.array_max(scores), lambda most: F.transform(scores, lambda x: F.exp(x - most)))
    return let(parts, lambda p: let(summed(p), lambda total: F.transform(p, lambda x: x / total)))


def mixes(scored: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Summed text posteriors of each value: array ``m`` of languages."""
    own = scored.select(*keys, posterior(F.col("t")).alias("p"))
    return own.groupBy(*keys).agg(F.array(*[F.sum(F.get("p", i)) for i in range(n)]).alias("m")).select(*keys, "m")


@dataclass(frozen=True)
class Evidence:
    """What the corpus says about hosts, sites, declared languages and suffixes; tables in the shared folder."""

    whole: list[float]
    hosts: DataFrame
    declared: DataFrame
    suffixes: DataFrame


def corpus_evidence(scored: DataFrame, n: int) -> Evidence:
    """Grouped sums over all rows of ``host``, ``declared``, ``suffix`` and ``t``."""
    named = scored.withColumn("site", site_of(F.col("host")))
    by_host = written(mixes(named.filter(F.col("host").isNotNull()), ["host", "site"], n), "hosts")
    by_site = by_host.groupBy("site").agg(F.array(*[F.sum(F.get("m", i)) for i in range(n)]).alias("s"))
    hosts = written(by_host.join(by_site, "site").select("host", "m", "s"), "host_mixes")
    declared = written(mixes(scored.filter(F.col("declared").isNotNull()), ["declared"], n), "declared")
    suffixes = written(
        mixes(scored.withColumn("suffix", suffix_of(F.col("host"))).filter(F.col("suffix").isNotNull()), ["suffix"], n), "suffixes"
    )
    whole = mixes(scored.withColumn("all", F.lit(1)), ["all"], n).first()
    return Evidence(list(whole.m) if whole else [0.0] * n, hosts, declared, suffixes)


def with_evidence(scored: DataFrame, evidence: Evidence) -> DataFrame:
    """``scored`` with the mixes of its host and site (``_m``, ``_s``), declared language (``_d``) and suffix (``_e``)."""
    hosts = evidence.hosts.select(F.col("host").alias("_host"), F.col("m").alias("_m"), F.col("s").alias("_s"))
    said = evidence.declared.select(F.col("declared").alias("_declared"), F.col("m").alias("_d"))
    ends = evidence.suffixes.select(F.col("suffix").alias("_suffix"), F.col("m").alias("_e"))
    return (
        scored.join(hosts, F.col("host") == F.col("_host"), "left")
        .join(said, F.col("declared") == F.col("_declared"), "left")
        .join(ends, suffix_of(F.col("host")) == F.col("_suffix"), "left")
    )


def fused(evidence: Evidence, n: int) -> Column:
    """Log scores of all languages, one expression over the columns of ``with_evidence``; its size does not grow with them."""
    total = sum(evidence.whole)
    whole = F.array(*[F.lit((x + 1.0) / (total + n)) for x in evidence.whole])

    def scores(own: Column, sizes: Column) -> Column:
        # A document does not vouch for itself: its own share is taken out of every mix that it is part of.
        def without_own(mix: str, parent: Column, rows: float, p: Column, i: Column) -> Column:
            return (F.get(mix, i) - p + rows * parent) / (sizes[mix] - 1 + rows)

        def score(p: Column, i: Column) -> Column:
            corpus = F.get(whole, i)
            prior = without_own("_m", without_own("_s", corpus, PARENT_ROWS, p, i), PARENT_ROWS, p, i)
            # How much more often a value goes with the language than the language occurs.
            said = [
                F.coalesce(F.log(positive(without_own(mix, corpus, EVIDENCE_ROWS, p, i)) / corpus), F.lit(0.0)) for mix in ("_d", "_e")
            ]
            return F.get("t", i) + F.log(F.coalesce(positive(prior), corpus)) + said[0] + said[1]

        def positive(share: Column) -> Column:
            """At least a little, and null without evidence (``greatest`` alone would pass over the null)."""
            return F.when(share.isNotNull(), F.greatest(share, F.lit(1e-9)))

        return F.transform(own, score)

    # Null mixes have null sizes, as ``aggregate`` of null is null.
    sizes = F.struct(*[summed(F.col(mix)).alias(mix) for mix in ("_m", "_s", "_d", "_e")])
    return let(posterior(F.col("t")), lambda own: let(sizes, lambda n_rows: scores(own, n_rows)))


def decided(scored: DataFrame, evidence: Evidence, languages: tuple[str, ...], least: float, has_text: str) -> DataFrame:
    """Add ``language``, ``confidence`` and ``kept``; ties go to the language that sorts first."""
    names = F.array(*[F.lit(name) for name in languages])
    und = F.struct(F.lit(UNDETERMINED).alias("language"), F.lit(0.0).alias("confidence"))
    chosen = let(posterior(fused(evidence, len(languages))), lambda p: let(F.array_max(p), lambda best: F.struct(
        F.get(names, (F.array_position(p, best) - 1).cast("int")).alias("language"), best.alias("confidence")
    )))
    found = with_evidence(scored, evidence).withColumn("_found", F.when(F.col(has_text), chosen).otherwise(und))
    kept = (F.col("_found.language") != UNDETERMINED) & (F.col("_found.confidence") >= least)
    return found.withColumns({"language": F.col("_found.language"), "confidence": F.col("_found.confidence"), "kept": kept})


def evidence_rows(docs: DataFrame, keep: list[str], text: Column, host: Column, declared: Column) -> DataFrame:
    """Rows as the steps take them; ``row`` holds the columns to keep, so that their names meet no others."""
    return docs.select(
        F.struct(*keep).alias("row"), text.alias("text"), host.cast("string").alias("host"),
        F.lower(F.regexp_extract(declared.cast("string"), r"^\s*([A-Za-z]+)", 1)).alias("declared"),
        (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0).alias("has_text"),
    ).withColumn("declared", F.nullif(F.col("declared"), F.lit("")))


def language_scores(
    docs: DataFrame, model: Likelihoods, keep: list[str], text: Column, host: Column | None = None,
    declared: Column | None = None, least: float = LEAST_CONFIDENCE,
) -> DataFrame:
    """The columns in ``keep`` with ``language``, its ``confidence`` and ``kept``, one row per input row.

    A row without text is ``und`` with confidence 0 and not kept; null hosts and declarations are no evidence. Repeated rows
    and ids get their own result. An empty table gives no rows. Texts are read once; what is written is the scores.
    """
    none = F.lit(None).cast("string")
    rows = evidence_rows(docs, keep, text, none if host is None else host, none if declared is None else declared)
    n = len(model.languages)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers per language
    scored = written(with_text_scores(rows, shared, n), "text_scores")
    found = decided(scored, corpus_evidence(scored, n), model.languages, least, "has_text")
    return found.select("row.*", "language", "confidence", "kept")


def documents_in_known_languages(
    docs: DataFrame, model: Likelihoods, text_col: str = "text", host_col: str = "source", least: float = LEAST_CONFIDENCE
) -> DataFrame:
    """The documents whose language is known well enough, with the columns they came with.

    Texts are scored once for the evidence of the corpus and once more on the way through, so they need no join by id; they
    meet the table of hosts, which Spark broadcasts when it is small.
    """
    none = F.lit(None).cast("string")
    n = len(model.languages)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = evidence_rows(docs, [F.lit(0).alias("none")], F.col(text_col), F.col(host_col), none)
    evidence = corpus_evidence(written(with_text_scores(first, shared, n), "text_scores"), n)
    rows = evidence_rows(docs, docs.columns, F.col(text_col), F.col(host_col), none).drop("text")
    return decided(with_text_scores(rows, shared, n, text_col), evidence, model.languages, least, "has_text").filter("kept").select("row.*")


def page_text(html: Column) -> Column:
    """Text of a page: without comments, code, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def page_language(html: Column) -> Column:
    """The language that the root element declares."""
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
