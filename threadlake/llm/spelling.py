"""Spelling variants of words by PartEnum signatures over letter multisets."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, functions as F

from threadlake.llm.common import prepared
from threadlake.session import materialize

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts into which the letters are dealt.
PARTS = 4
#: Words of one signature that meet as they are; larger buckets are split further.
BUCKET = 64


def word_counts(docs: DataFrame, min_length: int, min_count: int, change: Callable[[Column, Column], Column] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of the maximal runs of letters, A-Z lowered, with ``min_length`` code points and ``min_count`` occurrences at least.

    ``change`` may turn an occurrence (id, word) into another word; it may shorten it, not lengthen it.  A null text has no
    words; an id is taken as text, a null one as empty; a repeated row counts again.
    """
    # a shorter run can't become a word, so it is never cut out
    runs = F.regexp_extract_all(docs[text_column], F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    words = docs.select(F.coalesce(docs[id_column].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    if change is not None:
        words = words.select("id", word.alias("run"))
        word = change(F.col("id"), F.col("run"))
    counted = words.select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _parts(words: DataFrame) -> DataFrame:
    """Words with their sorted letters cut into ``PARTS`` parts; frequent letters go to different parts.

    A part holds all occurrences of its letters, so the parts partition the dimensions of the binary vector
    (letter, number of its occurrence).
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    ranked = [r.letter for r in letters.orderBy(F.desc("count"), "letter").collect()]  # one row for each letter in use
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    listed = ["".join(c if c.isalnum() else "\\" + c for c in ranked[i::PARTS]) for i in range(PARTS)]
    rest = lambda i: F.regexp_replace("letters", f"[^{listed[i]}]", "") if listed[i] else F.lit("")
    cut = words.withColumn("letters", ordered).withColumn("length", F.char_length("word"))
    return cut.select("word", "n", "length", F.array(*(rest(i) for i in range(PARTS))).alias("parts"))


def _signatures(left_out: int, length: Column, aligned: list[Column]) -> Column:
    """Hashes of the parts that stay when ``left_out`` of them are left out, each with one of the ``aligned`` pieces."""
    out = []
    for number, gone in enumerate(combinations(range(PARTS), left_out)):
        kept = [F.get("parts", F.lit(i)) for i in range(PARTS) if i not in gone]
        for half, piece in enumerate(aligned):
            out.append(F.xxhash64(F.lit(left_out * 1000 + number * 2 + half), length, F.concat_ws("|", *kept), piece))
    return F.array(*out)


def _removed(numbered: bool) -> Column:
    """The word without each of its code points in turn, with the place in front if ``numbered``."""
    return F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda at: F.concat(
        *([at.cast("string"), F.lit(":")] if numbered else []), F.substring(F.col("word"), F.lit(1), at - 1), F.substring(F.col("word"), at + 1, F.char_length("word"))))


def _split(rows: DataFrame, sizes: DataFrame, forms: Column) -> DataFrame:
    """Rows (key, word, n) in which a word of a large bucket stands once for each of its ``forms``."""
    heavy = F.col("heavy").isNotNull()
    form = F.explode(F.when(heavy, forms).otherwise(F.array(F.lit(""))))
    found = rows.join(sizes, "key", "left").select("key", "word", "n", "heavy", form.alias("form"))
    return found.select(F.when(heavy, F.xxhash64("key", "form")).otherwise(F.col("key")).alias("key"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of words that differ by one inserted, deleted or replaced code point.

    One edit leaves letter multisets at a Hamming distance of two at most: two for a replaced letter, one for an inserted one.
    So of ``PARTS`` parts at most two (or one) differ, and the words agree in a signature that leaves those out.  Signatures
    are joined by equality and every pair is verified.

    A signature also holds the half of the word that the edit leaves alone, so it stands twice.  A bucket of more than
    ``BUCKET`` words is split by the word without one letter, on which a pair agrees too; what then stands together
    differs in that letter alone, so a bucket is bounded by the alphabet, however many words share a signature.
    """
    cut = materialize(_parts(words), "words")
    length = F.col("length")
    half = F.floor(length / 2).cast("int")
    shorter = length - 1  # an inserted letter: the longer word is aligned with words of this length
    short_half = F.floor(shorter / 2).cast("int")
    piece = lambda start, size: F.substring(F.col("word"), start, size)
    held = lambda keys: cut.select("word", "n", "length", F.explode(keys).alias("key"))
    same = held(_signatures(2, length, [piece(F.lit(1), half), piece(half + 1, length)]))
    short = held(_signatures(1, length, [piece(F.lit(1), half), piece(half + 1, length)]))
    long = held(_signatures(1, shorter, [piece(F.lit(1), short_half), piece(short_half + 2, length)]))

    sized = same.select("key").unionByName(short.select("key")).unionByName(long.select("key")).groupBy("key").count()
    heavy = materialize(sized.where(F.col("count") > BUCKET).select("key", F.lit(True).alias("heavy")), "heavy")
    same = _split(same, heavy, _removed(True))
    short = _split(short, heavy, F.array(F.col("word")))
    long = _split(long, heavy, F.array_distinct(_removed(False)))

    one_edit = F.levenshtein("a.word", "b.word", 1) == 1
    pair = [F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")]
    replaced = same.alias("a").join(same.alias("b"), F.col("a.key") == F.col("b.key")).where((F.col("a.word") < F.col("b.word")) & one_edit).select(*pair)
    inserted = short.alias("a").join(long.alias("b"), F.col("a.key") == F.col("b.key")).where(one_edit).select(*pair)
    pairs = materialize(replaced.unionByName(inserted).distinct(), "pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def spelling_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), which are distinct.

    * ``form`` is the near word of largest n (ties: the smallest in code-point order) if its n is at least ``ratio`` times the
      word's, else null; ``form_n`` is its n;
    * ``root`` is the end of the chain of forms, the word itself without one.  ``ratio`` is 2 or more, so a chain ends;
    * ``n_near`` counts the near words, 0 if there are none.

    Null words and counts are left out; no words give no rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    prepared(words.sparkSession)
    words = materialize(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")), "counts")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    counts = -F.col("best.less")
    strong = counts >= F.col("n") * ratio
    found = materialize(found.select(
        "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, counts).alias("form_n")), "forms")

    # counts are longs and grow ``ratio``-fold with each form, which bounds a chain; every round doubles the steps that a pointer takes
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(63 * log(2) / log(ratio)))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
