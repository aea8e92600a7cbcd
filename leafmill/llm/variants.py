"""Spelling variants of a corpus vocabulary, found by an index of variable-length grams.

A dictionary of grams is built from the vocabulary: a gram that occurs often is extended by a letter, a rare one is not, so
grams are short where words differ and long where they are alike. From each place of a word starts the shortest gram that
is rare, or the longest allowed. An edit affects the grams that hold its place; all others are the same in both words,
those before it counted from the start, those after it from the end. So for each place of an edit the lists of the
LISTS rarest grams that it leaves are merged into one list, keyed by these grams and their places. Two words with one edit
between them meet in such a list, whatever the edit, and each meeting is verified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored

__all__ = ["merged_keys", "near_words", "occurrences", "shared_dir", "variants"]

#: Letters of a gram, at least and at most; the marks of a word's start and end count.
LEAST, MOST = 2, 5
#: A gram is extended if it makes up more than 1 / FREQUENT of all grams of its length, so fewer than FREQUENT a length are.
FREQUENT = 20_000
#: Lists that are merged for each place of an edit.
LISTS = 3
#: Words are so many code points and occurrences at least.
LETTERS, TIMES = 7, 2
#: A word is a variant of a near word that occurs so many times as often.
RATIO = 10
#: In one of so many occurrences a code point is deleted.
NOISE = 31


def _noisy(word: Column, doc: Column) -> Column:
    """The word without one code point, where NOISE divides the crc32 of `<doc>:<word>`."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: the words of LETTERS code points or more that occur TIMES times or more in the texts.

    Null texts have no words, a null id is hashed as an empty one; repeated rows count each time.
    """
    runs = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(_noisy(F.col("run"), F.col("doc_id")).alias("word"))
    return words.where(F.char_length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TIMES)


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The grams of LEAST to MOST letters that make up more than 1 / FREQUENT of all of their length, and their numbers.

    Fewer than FREQUENT a length pass that bound, whatever the vocabulary, so the driver and the tasks can hold them.
    """
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("s"))
    starts = lambda q: F.transform(F.sequence(F.lit(1), F.char_length("s") - (q - 1)), lambda p: F.substring(F.col("s"), p, F.lit(q)))
    sizes = marked.agg(*[F.sum(F.char_length("s") - (q - 1)).alias(str(q)) for q in range(LEAST, MOST + 1)]).first()
    grams = marked.select(F.explode(F.flatten(F.array(*[starts(q) for q in range(LEAST, MOST + 1)]))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    least = F.coalesce(*[F.when(F.char_length("gram") == q, F.lit(sizes[str(q)] or 0)) for q in range(LEAST, MOST + 1)])
    return {r["gram"]: r["n"] for r in grams.where(F.col("n") * FREQUENT > least).collect()}


def merged_keys(word: str, frequent: dict[str, int]) -> set[str]:
    """One key for each set of LISTS rarest grams that an edit of the word can leave."""
    s = f"^{word}$"
    end, grams = len(s), []
    for p in range(end - 1):
        stop = p + LEAST
        while stop < end and stop - p < MOST and s[p:stop] in frequent:
            stop += 1
        gram = s[p:stop]
        grams.append((frequent.get(gram, 0), zlib.crc32(gram.encode()), gram, p, stop - 1))
    # a gram and its place from the start, for edits behind it, and from the end, for edits before it
    placed = [(p, last, f"{gram}<{p}", f"{gram}>{end - p}") for _, _, gram, p, last in sorted(grams)]
    keys = set()
    for at in range(1, end):
        for first in (at, at + 1):  # first gram after an insertion before `at`; after a change or a deletion at `at`
            left = []
            for p, last, before, after in placed:
                if last < at:
                    left.append(before)
                elif p >= first:
                    left.append(after)
                else:
                    continue
                if len(left) == LISTS:
                    break
            keys.add(" ".join(left))
    return keys


def near_words(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n with a < b: the pairs of words (word, n) that differ by one inserted, deleted or replaced code point, each once."""
    frequent = frequent_grams(words)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, whose = [], []
            for k, word in enumerate(batch["word"].to_pylist()):
                own = merged_keys(word, frequent)
                keys += own
                whose += [k] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(batch[c].take(pa.array(whose, pa.int64())) for c in ("word", "n"))], ["key", "word", "n"])

    lists = stored(words.mapInArrow(keyed, "key string, word string, n long").select(F.xxhash64("key").alias("key"), "word", "n"), "gram-lists")
    a, b = (lists.select("key", F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab")
    one = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, "key").where(one).select("a", "a_n", "b", "b_n").distinct()


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text).

    A word's form is its most frequent near word (of equal ones the first in code-point order) if that occurs RATIO times as
    often or more; root is where the forms lead. A word has at most as many near words as its letters can be edited, so no
    group is unbounded. Other columns of docs are ignored; an empty table has no words.
    """
    words = stored(occurrences(docs), "words")
    pairs = near_words(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    both = pairs.select(F.inline(sides))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = -F.col("best.less") >= RATIO * F.col("n")
    best = stored(best.select("word", "n_near", F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(best.where("form is not null").select("word", F.col("form").alias("root")))
    found = words.join(best, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: links (word, root) followed to their ends. Each step doubles the links that are followed; counts grow tenfold a link, so few steps do."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")
