"""Free-text search over a token table: documents by token, and queries of required, excluded and alternative terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CAP = 5001


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda t: t != "")


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, pos."""
    return docs.select(F.col(key), F.posexplode(tokens(F.col(text))).alias("pos", "token")).select(key, "token", "pos")


def words_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, words: a document's tokens between single blanks, one row each."""
    return docs.select(F.col(key), F.array_join(tokens(F.col(text)), " ").alias("words"))


def tokens_of_words(words: DataFrame, key: str) -> DataFrame:
    """``token_table`` of the documents of a ``words_table``."""
    return words.filter("words <> ''").select(F.col(key), F.posexplode(F.split("words", " ")).alias("pos", "token")).select(key, "token", "pos")


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    negative: bool = False
    prefix: bool = False


def parse(query: str) -> list[list[Term]]:
    """Clauses that all have to hold; each is a list of alternatives. Understands "phrases", -not, word* and a | b."""
    clauses: list[list[Term]] = []
    alternative = False
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\|)|([^\s"|]+))', query):
        minus, phrase, bar, word = m.groups()
        if bar:
            alternative = bool(clauses)
            continue
        words = tuple(w for w in re.split(r"\W+", (phrase if phrase is not None else word).lower()) if w)
        if not words:
            continue
        term = Term(words, minus == "-", word is not None and word.endswith("*"))
        if alternative:
            clauses[-1].append(term)
        else:
            clauses.append([term])
        alternative = False
    return clauses


def _flat(text: Column) -> Column:
    """The words of a text between single blanks, with one at each end: every term is then a contained string."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _hit(term: Term, flat: Column) -> Column:
    found = flat.contains(f" {' '.join(term.words)}{'' if term.prefix else ' '}")
    return ~found if term.negative else found


def search(docs: DataFrame, key: str, text: str, query: str, cap: int | None = CAP) -> DataFrame:
    """The keys of documents for which all clauses hold, of more than ``cap`` (the feature's own bound) the least; a blank query
    finds nothing."""
    clauses = parse(query)
    if not clauses:
        return docs.select(key).limit(0)
    flat = _flat(F.col(text))
    held = F.lit(True)
    for clause in clauses:
        any_of = F.lit(False)
        for term in clause:
            any_of = any_of | _hit(term, flat)
        held = held & any_of
    return _least(docs.filter(held).select(key), key, cap)


def _least(found: DataFrame, key: str, cap: int | None) -> DataFrame:
    return found.orderBy(key).limit(cap) if cap else found


def search_by_index(index: DataFrame, key: str, query: str, cap: int | None = CAP) -> DataFrame:
    """``search`` over a token table (key, token, pos): only the rows of the query's tokens are read. Words and prefixes are marks
    combined by key; the words of a phrase meet by their key and the place where the phrase begins. A query of negative clauses
    alone is answered from all keys of the index."""
    clauses = parse(query)
    if not clauses:
        return index.select(key).limit(0)
    terms = [t for clause in clauses for t in clause]

    def mark(term: Term, n: int) -> Column:
        """Whether a row holds the nth word of a term."""
        last = term.prefix and n == len(term.words) - 1
        return F.col("token").startswith(term.words[n]) if last else F.col("token") == term.words[n]

    def any_of(conditions: list[Column]) -> Column:
        found = F.lit(False)
        for c in conditions:
            found = found | c
        return found

    wanted = index.filter(any_of([mark(t, n) for t in terms for n in range(len(t.words))]))
    single = [t for t in terms if len(t.words) == 1]
    phrases = [t for t in terms if len(t.words) > 1]
    name = {id(t): f"__t{i}" for i, t in enumerate(terms)}
    marks = wanted.groupBy(key).agg(F.lit(True).alias("__seen"), *[F.max(mark(t, 0)).alias(name[id(t)]) for t in single])
    for t in phrases:
        # each word gives the place at which the phrase would begin; all words at one place are the phrase
        words = F.array(*[F.when(mark(t, n), F.struct(F.lit(n).alias("n"), (F.col("pos") - n).alias("at"))) for n in range(len(t.words))])
        places = wanted.filter(any_of([mark(t, n) for n in range(len(t.words))])).select(key, F.explode(F.filter(words, lambda w: w.isNotNull())).alias("w"))
        whole = places.groupBy(key, "w.at").agg(F.countDistinct("w.n").alias("__n")).filter(F.col("__n") == len(t.words))
        marks = marks.join(whole.select(key).distinct().withColumn(name[id(t)], F.lit(True)), key, "left")
    if not any(all(not t.negative for t in clause) for clause in clauses):
        marks = index.select(key).distinct().join(marks, key, "left")
    for clause in clauses:
        marks = marks.filter(any_of([~F.coalesce(name[id(t)], F.lit(False)) if t.negative else F.coalesce(name[id(t)], F.lit(False)) for t in clause]))
    return _least(marks.select(key), key, cap)


def search_index(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """The keys that have all the words, from a token table: a filter on the token column, then one count."""
    wanted = sorted({w.lower() for w in words})
    return index.filter(F.col("token").isin(wanted)).groupBy(key).agg(F.countDistinct("token").alias("__n")).filter(F.col("__n") == len(wanted)).select(key)


def rebuild_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the token table, each task's documents in order of tokens, so that a search reads the pages of each file that hold its
    own; what it holds is frozen until the next rebuild."""
    write_sorted(token_table(docs, key, text), path, "overwrite")


def write_sorted(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A token table as each task has it, in order of tokens: no row is shuffled, a token of many documents is in many files, and
    the texts are read once."""
    rows.sortWithinPartitions("token").write.mode(mode).parquet(path)


def search_path(spark, path: str, key: str, words: list[str]) -> tuple[DataFrame | None, bool]:
    """(found, available): a missing index is told apart from no match."""
    try:
        return search_index(spark.read.parquet(path), key, words), True
    except AnalysisException:
        return None, False
