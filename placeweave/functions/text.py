"""Text expressions: folding, tokens, analyzers, chunking, hashing and snippets. All JVM-side."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name prefixes that do not distinguish places.
NAME_PREFIXES = (
    "chua", "den", "lang", "mieu", "nha tho", "bao tang", "cho", "cong vien",
    "khach san", "quan", "nha hang", "cau", "cua", "dien", "phu",
)
ANALYZERS = ("plain", "fold", "multi")
WORD = r"[\p{L}\p{N}_]+"
#: Letters that some folding may change once a text is in lower case; a text without one is done.
BEYOND_ASCII = r"[^\x00-\x7F]"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def _base_letter_map(last: int = sys.maxunicode) -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is one letter plus marks -> that letter."""
    source, target = ["đ"], ["d"]
    for code in range(0xC0, last + 1):
        char = chr(code)
        if char != char.lower():
            continue
        letters = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(letters) == 1 and letters[0] != char:
            source.append(char)
            target.append(letters[0])
    return "".join(source), "".join(target)


def _single_casefolds(last: int = sys.maxunicode) -> tuple[str, str]:
    pairs = [(c, c.casefold()) for c in map(chr, range(0x80, last + 1))
             if c == c.lower() and c.casefold() != c and len(c.casefold()) == 1]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def _long_casefolds() -> dict[str, str]:
    """Lower-case letters whose case folding is several letters, by that folding."""
    return {c: c.casefold() for c in map(chr, range(0x80, sys.maxunicode + 1)) if c == c.lower() and len(c.casefold()) > 1}


_MARKED, _BASE = _base_letter_map()
_FOLDABLE, _FOLDED = _single_casefolds()
_LONG_FOLDS = _long_casefolds()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def casefold(c: Column) -> Column:
    out = F.lower(c)
    rare = F.lit("[" + "".join(_LONG_FOLDS) + "]")
    table = F.create_map(*[F.lit(x) for pair in _LONG_FOLDS.items() for x in pair])
    long = F.array_join(F.transform(F.split(out, ""), lambda letter: F.coalesce(F.try_element_at(table, letter), letter)), "")
    # Most texts hold none of these letters: one look decides whether theirs are read one by one.
    folded = F.translate(F.when(F.regexp_like(out, rare), long).otherwise(out), _FOLDABLE, _FOLDED)
    return F.when(F.regexp_like(out, F.lit(BEYOND_ASCII)), folded).otherwise(out)


def _drop_marks(c: Column) -> Column:
    bare = F.regexp_replace(F.translate(c, _MARKED, _BASE), r"\p{Mn}", "")
    return F.when(F.regexp_like(c, F.lit(BEYOND_ASCII)), bare).otherwise(c)


def fold(c: Column) -> Column:
    """Case- and accent-insensitive form."""
    return _drop_marks(casefold(c))


def fold_ws(c: Column) -> Column:
    """Folded text with every whitespace run reduced to one space."""
    return strip(F.regexp_replace(fold(c), r"(?U)\s+", " "))


def norm_name(c: Column) -> Column:
    """Matching key of a place name: folded, alphanumeric, without one leading type word."""
    words = F.trim(F.regexp_replace(F.regexp_replace(_drop_marks(F.lower(c)), "[^a-z0-9 ]", " "), " +", " "))
    longest_first = "|".join(sorted(NAME_PREFIXES, key=len, reverse=True))
    return F.trim(F.regexp_replace(words, f"^({longest_first}) ", ""))


def tokens(c: Column, folded: bool = False) -> Column:
    return F.regexp_extract_all(fold(c) if folded else casefold(c), F.lit(WORD), F.lit(0))


def words_of(df: DataFrame, text: str) -> DataFrame:
    """``df`` without the column ``text`` and with its words ``plain`` and ``folded``; letters are folded once for both."""
    low = df.withColumn(text, casefold(F.col(text)))
    return low.select(*[c for c in df.columns if c != text], F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("plain"),
                      F.regexp_extract_all(_drop_marks(F.col(text)), F.lit(WORD), F.lit(0)).alias("folded"))


def add_terms(df: DataFrame, text: Column, analyzer: str, out: str = "terms") -> DataFrame:
    """Adds the analyzer's term array (duplicates kept).

    plain: accented words; fold: folded words; multi: both, folded ones marked ``~``, plus
    folded neighbour pairs ``~a_b``."""
    # The words are columns of their own so that they are computed once per row.
    staged = df.withColumn("_folded", tokens(text, folded=True)).withColumn("_plain", tokens(text))
    return staged.withColumn(out, terms_of(F.col("_plain"), F.col("_folded"), analyzer)).drop("_folded", "_plain")


def terms_of(plain: Column, folded: Column, analyzer: str) -> Column:
    """The analyzer's terms from a text's words and folded words."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {ANALYZERS}, got {analyzer!r}")
    if analyzer == "plain":
        return plain
    if analyzer == "fold":
        return folded
    following = F.slice(folded, F.lit(2), F.greatest(F.size(folded) - 1, F.lit(0)))
    leading = F.slice(folded, F.lit(1), F.greatest(F.size(folded) - 1, F.lit(0)))
    pairs = F.zip_with(leading, following, lambda a, b: F.concat(F.lit("~"), a, F.lit("_"), b))
    marked = F.transform(folded, lambda t: F.concat(F.lit("~"), t))
    return F.concat(plain, marked, pairs)


def count_of(plain: Column, folded: Column, analyzer: str) -> Column:
    """How many terms ``terms_of`` gives, without making them."""
    if analyzer == "plain":
        return F.size(plain)
    if analyzer == "fold":
        return F.size(folded)
    return F.size(plain) + F.size(folded) + F.greatest(F.size(folded) - 1, F.lit(0))


def chunk_array(c: Column, max_chars: int = 1200, separator: str = r"\n\n") -> Column:
    """Paragraphs of at most ``max_chars``; longer ones are packed sentence by sentence."""
    paragraphs = F.filter(F.transform(F.split(c, separator), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(state: Column, sentence: Column) -> Column:
        grown = F.length(state["open"]) + F.length(sentence) + 1
        full = (grown > max_chars) & (state["open"] != "")
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(strip(state["open"])))).otherwise(state["done"]).alias("done"),
            F.concat(F.when(full, F.lit("")).otherwise(state["open"]), sentence, F.lit(" ")).alias("open"),
        )

    def close(state: Column) -> Column:
        rest = strip(state["open"])
        return F.when(rest != "", F.concat(state["done"], F.array(rest))).otherwise(state["done"])

    def split_paragraph(p: Column) -> Column:
        packed = F.aggregate(F.split(p, r"(?U)(?<=\.)\s+"), start, pack, close)
        return F.when(F.length(p) <= max_chars, F.array(p)).otherwise(packed)

    return F.flatten(F.transform(paragraphs, split_paragraph))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def embedding_text(name: Column, content: Column) -> Column:
    return F.concat(name, F.lit(": "), content)


def hash_embed(c: Column, dim: int) -> Column:
    """Deterministic test vector: the first 32 bits of sha256("text:i"), scaled, unit length."""
    def component(i: Column) -> Column:
        head = F.substring(F.sha2(F.concat(c, F.lit(":"), i.cast("string")), 256), 1, 8)
        return F.conv(head, 16, 10).cast("double") / F.lit(4294967295.0) * 2.0 - 1.0

    return unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component))


def unit(vector: Column) -> Column:
    # Lambdas hold the vector and its norm: written out, both would be computed anew for every component.
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return F.get(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))), F.lit(0))

    return F.get(F.transform(F.array(vector), scaled), F.lit(0))


def _words(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(fold_ws(c), " ")), lambda w: w != "")


def snippet(query: Column, content: Column, context: Column | None = None, n: int = 3, fallback: int = 400) -> Column:
    """The ``n`` sentences sharing most words with the query (words of ``context`` do not count),
    in their original order; the first ``fallback`` characters when no sentence is long enough."""
    asked = _words(query) if context is None else F.array_except(_words(query), _words(context))
    sentences = F.filter(F.transform(F.split(content, r"(?U)(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 20)
    scored = F.transform(sentences, lambda s, i: F.struct(
        (-F.size(F.array_intersect(_words(s), asked))).alias("neg"), i.alias("pos"), s.alias("text")))
    best = F.slice(F.array_sort(scored), 1, n)
    ordered = F.array_sort(F.transform(best, lambda s: F.struct(s["pos"].alias("pos"), s["text"].alias("text"))))
    return F.when(F.size(sentences) == 0, F.substring(content, 1, fallback)).otherwise(
        F.array_join(F.transform(ordered, lambda s: s["text"]), " "))
