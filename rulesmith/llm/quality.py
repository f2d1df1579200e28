"""Line-first cleaning. DataFrame operations only.

Every line with a word is judged by rules of punctuation, navigation and boilerplate; failing lines are removed; a document that
loses too large a share of its words' characters that way is rejected, as is one that fails the counts of the
whole text (too few words, or too many words in repeated three-word windows).

Defined results: a null or white text has no words, loses nothing and fails for its few words; repeated rows and null
ids each get their result; an empty table gives no rows; all columns of the input stay, except that the operator's
own replace input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A document is rejected when it loses more than this share of its words' characters.
MAX_LOSS = 0.5
#: Fixed values of the line rules. Navigation: separators between short items; boilerplate: phrases of page furniture.
PUNCTUATION = r"[.!?,:;…。！？]"
SHOUT, SHOUTS = "!!", 3
MARK, MARKS = r"[#*$%&<>]{2,}", 4
SEPARATOR, SEPARATORS = r"\s[|»›•·]\s", 3
BOILERPLATE = r"(?i)\b(?:all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|accept (?:all )?cookies|subscribe to our|sign up for|log ?in to|click here|read more|javascript is (?:disabled|required)|skip to (?:main )?content|share (?:this|on)|follow us|back to top|powered by)\b"
#: A line without any punctuation passes if it has fewer words than this (titles, list items).
BARE_WORDS = 12


def line_fails(line: Column) -> Column:
    """Whether one line with a word breaks a rule."""
    bare = ~line.rlike(PUNCTUATION) & (F.size(F.split(F.trim(line), WHITE)) >= BARE_WORDS)
    # Counts rather than repeated groups: linear in the line, whatever it holds.
    times = lambda pattern: F.regexp_count(line, F.lit(pattern))
    shouted = (times(SHOUT) >= SHOUTS) & ~line.rlike(r"\p{Ll}")
    return bare | (times(MARK) >= MARKS) | shouted | (times(SEPARATOR) >= SEPARATORS) | line.rlike(BOILERPLATE)


def letters(text: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. words: a bound variable.

    Windows are compared by 64-bit hashes. Only texts with a repeated window sort them; the cost is n log n.
    """

    def marked(windows: Column) -> Column:
        def covered(pairs: Column) -> Column:
            at = lambda i: F.get(pairs, i)["h"]
            twice = F.filter(pairs, lambda x, i: (x["h"] == at(i - 1)) | (x["h"] == at(i + 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, covered))

    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(let(windows, marked))


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with counts of the whole text, clean_text (what the line rules leave), loss, base_failed and kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = let(F.filter(F.split(text, WHITE), lambda w: w != ""), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).cast("long").alias("n_repeat_words")))

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(full, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.filter(x, lambda line: ~line_fails(line)).alias("good")))

    out = docs.withColumn("__words", own).withColumn("__lines", let(F.split(text, "\n", -1), of_lines))
    out = out.withColumn("word_chars", letters(text).cast("long")).withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("n_words", F.col("__words.n_words")).withColumn("n_repeat_words", F.col("__words.n_repeat_words")).withColumn("n_dup_lines", F.col("__lines.n_dup_lines"))
    out = out.withColumn("clean_text", F.array_join("__lines.good", "\n"))
    out = out.withColumn("loss", F.when(F.col("word_chars") > 0, 1 - letters(F.col("clean_text")) / F.col("word_chars")).otherwise(F.lit(0.0)))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("loss") <= MAX_LOSS)).drop("__words", "__lines")


def op9(docs: DataFrame) -> DataFrame:
    out = clean_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "loss")
