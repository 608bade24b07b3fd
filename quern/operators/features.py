"""Bag-of-words and TF-IDF features in long form (id, term, value).

A vocabulary is fitted on the training rows only and is itself a table; transforming is an
aggregation and a join on the term. Vocabularies are broadcast only when they are checked to be
small; without max_features they may have any size. For a bounded vocabulary ``pack`` gives the same
features as one row a text, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.ngrams import char_wb_ngrams, word_ngrams
from quern.functions.text import tokens
from quern.workspace import Workspace, maybe_broadcast


@dataclass
class Vectorizer:
    """Settings: kind is bow, tfidf or tfidf_word_char; min_df and max_df count documents (a float is a share)."""

    kind: str = "bow"
    ngram_range: tuple[int, int] = (1, 1)
    min_df: int | float = 1
    max_df: int | float = 1.0
    max_features: int | None = None
    sublinear_tf: bool = False
    char_range: tuple[int, int] = (3, 5)
    char_max_features: int = 20_000

    def __post_init__(self):
        if self.kind not in ("bow", "tfidf", "tfidf_word_char"):
            raise ValueError("kind must be bow, tfidf or tfidf_word_char")

    def parts(self) -> list[tuple[str, object, int | None]]:
        """(prefix of the terms, terms of a token array, most terms)."""
        word = lambda tk: word_ngrams(tk, self.ngram_range)
        if self.kind == "tfidf_word_char":
            char = lambda tk: char_wb_ngrams(tk, *self.char_range)
            return [("w:", word, self.max_features), ("c:", char, self.char_max_features)]
        return [("", word, self.max_features)]


def term_counts(rows: DataFrame, vectorizer: Vectorizer, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, part, term, tf): occurrences of every term in every text; NULL and blank texts have no terms."""
    src = rows.select(id_col, *keep, tokens(F.col(text_col)).alias("tk"))
    out = None
    for n, (prefix, grams, _) in enumerate(vectorizer.parts()):
        one = src.select(id_col, *keep, F.lit(n).alias("part"), F.explode(grams(F.col("tk"))).alias("term"))
        if prefix:
            one = one.withColumn("term", F.concat(F.lit(prefix), "term"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(id_col, *keep, "part", "term").agg(F.count(F.lit(1)).alias("tf"))


def _grams(vectorizer: Vectorizer, text_col: str) -> list[Column]:
    """For each part the array of all term occurrences of a text."""
    tk = tokens(F.col(text_col))
    named = [(prefix, grams(tk)) for prefix, grams, _ in vectorizer.parts()]
    return [(F.transform(g, lambda t: F.concat(F.lit(prefix), t)) if prefix else g).alias(f"_g{n}") for n, (prefix, g) in enumerate(named)]


def _counted(grams: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, tf) of every different term of every text, by row, and the terms of the codes."""
    coded = pc.dictionary_encode(grams.flatten())
    size = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(len(grams)), np.diff(np.asarray(grams.offsets)))
    key, tf = np.unique(row * size + np.asarray(coded.indices), return_counts=True)
    return key // size, key % size, tf, coded.dictionary


def term_totals(rows: DataFrame, vectorizer: Vectorizer, text_col: str = "text") -> DataFrame:
    """(part, term, df, total) where each row is a text of its own: rows are counted where they lie, only sums a batch are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, col in enumerate(b.columns):
                _, code, tf, terms = _counted(col)
                df = np.bincount(code, minlength=len(terms))
                total = np.bincount(code, weights=tf, minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), n, np.int32)), terms, pa.array(df), pa.array(total)], ["part", "term", "df", "total"])

    sums = rows.select(*_grams(vectorizer, text_col)).mapInArrow(run, "part int, term string, df bigint, total bigint")
    return sums.groupBy("part", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


@dataclass
class FeatureModel:
    """A fitted vocabulary: (part, term, df, total, idf), and the number of training texts."""

    vectorizer: Vectorizer
    vocabulary: DataFrame
    n_docs: int

    def transform(self, rows: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """(id, term, value) of any rows; terms outside the vocabulary are left out, texts without any term have no row."""
        counts = term_counts(rows, self.vectorizer, id_col, text_col, keep)
        joined = counts.join(maybe_broadcast(self.vocabulary.select("part", "term", "idf"), 1_000_000), ["part", "term"])
        if self.vectorizer.kind == "bow":
            return joined.select(id_col, *keep, "term", F.col("tf").cast("double").alias("value"))
        tf = F.col("tf").cast("double")
        weighted = joined.withColumn("v", (1 + F.ln(tf) if self.vectorizer.sublinear_tf else tf) * F.col("idf"))
        # a text's terms are few, so the norm is a window over the text
        norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col, "part")))
        return weighted.select(id_col, *keep, "term", (F.col("v") / norm).alias("value"))

    def pack(self, rows: DataFrame, keep: tuple[str, ...] = ("id",), text_col: str = "text") -> DataFrame:
        """(*keep, j, v): the features of :meth:`transform`, one row a text and without a shuffle.

        j numbers the terms of the vocabulary in their order; a text without any term has empty
        arrays. The vocabulary is sent to the tasks, so max_features must bound it.
        """
        vocabulary = self.vocabulary.select("term", "idf").orderBy("term").toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((vocabulary["term"].combine_chunks(), np.asarray(vocabulary["idf"])))
        how, n_keep = self.vectorizer, len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, idf = sent.value
            for b in batches:
                parts = []
                for col in b.columns[n_keep:]:
                    row, code, tf, terms = _counted(col)
                    j = np.asarray(pc.index_in(terms, value_set=known).fill_null(-1))[code]
                    row, tf, j = row[j >= 0], tf[j >= 0].astype(float), j[j >= 0]
                    if how.kind != "bow":
                        tf = (1 + np.log(tf) if how.sublinear_tf else tf) * idf[j]
                        tf /= np.sqrt(np.bincount(row, weights=tf * tf, minlength=b.num_rows))[row]
                    parts.append((row, j, tf))
                row, j, v = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(row, kind="stable")
                cuts = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=b.num_rows))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (j[order].astype(np.int32), v[order])]
                yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], *lists], [*keep, "j", "v"])

        types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
        return rows.select(*keep, *_grams(how, text_col)).mapInArrow(run, ", ".join([*types, "j array<int>", "v array<double>"]))


def _bound(x: int | float, n: Column) -> Column:
    return F.lit(x) * n if isinstance(x, float) else F.lit(x)


def fit(train: DataFrame, vectorizer: Vectorizer, id_col: str = "id", text_col: str = "text", unique: bool = False) -> FeatureModel:
    """The vocabulary of the training rows; an empty training set is an error.

    Of terms with equal totals at the max_features cut, the alphabetically first are kept.
    ``unique`` says that no id has two rows, so that nothing has to be gathered by id.
    """
    n = train.select(id_col).count()
    if not n:
        raise ValueError("the training set is empty")
    if unique:
        terms = term_totals(train, vectorizer, text_col)
    else:
        counts = term_counts(train, vectorizer, id_col, text_col)
        terms = counts.groupBy("part", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    docs = F.lit(n)
    terms = terms.where((F.col("df") >= _bound(vectorizer.min_df, docs)) & (F.col("df") <= _bound(vectorizer.max_df, docs)))
    kept = None
    for k, (_, _, most) in enumerate(vectorizer.parts()):
        own = terms.where(F.col("part") == k)
        if most:
            own = own.orderBy(F.desc("total"), "term").limit(most)
        kept = own if kept is None else kept.unionByName(own)
    idf = F.ln((1 + docs) / (1 + F.col("df"))) + 1
    vocabulary = Workspace(train.sparkSession, "vocabulary").save(kept.select("part", "term", "df", "total", idf.alias("idf")))
    return FeatureModel(vectorizer, vocabulary, n)


def unseen_terms(model: FeatureModel, train: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Vocabulary terms that are not in the training rows; must be empty."""
    seen = term_counts(train, model.vectorizer, id_col, text_col).select("part", "term").distinct()
    return model.vocabulary.join(seen, ["part", "term"], "left_anti")


def without_features(rows: DataFrame, features: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows that have no feature at all."""
    return rows.join(features.select(id_col).distinct(), id_col, "left_anti")


def wrong_weights(model: FeatureModel, train: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Vocabulary terms of which df, total or idf is not that of the training rows; must be empty."""
    own = term_counts(train, model.vectorizer, id_col, text_col).groupBy("part", "term").agg(F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_total"))
    idf = F.ln((1 + F.lit(train.select(id_col).count())) / (1 + F.col("_df"))) + 1
    wrong = ~(F.col("df").eqNullSafe(F.col("_df")) & F.col("total").eqNullSafe(F.col("_total")) & (F.abs(F.col("idf") - idf) < 1e-9))
    return model.vocabulary.join(own, ["part", "term"], "left").where(F.coalesce(wrong, F.lit(True))).select("part", "term")


def matrix_profile(rows: DataFrame, features: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: n_rows, n_terms, stored entries and rows without any."""
    used = features.agg(F.countDistinct("term").alias("n_terms"), F.count(F.lit(1)).alias("stored"), F.countDistinct(id_col).alias("_filled")).first()
    n = rows.select(id_col).distinct().agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select("n_rows", F.lit(used["n_terms"]).alias("n_terms"), F.lit(used["stored"]).alias("stored"), (F.col("n_rows") - used["_filled"]).alias("zero_rows"))
