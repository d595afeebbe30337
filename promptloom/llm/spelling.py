"""Spelling variants of the corpus' own words: letter-parity masks in three bands, of which one edit leaves one whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word, and how many times rarer a variant is than its form.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One run in this many has a letter deleted.
DELETE_EVERY = 97
BANDS, BAND_BITS = 3, 30


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every maximal run of letters of every whole text, A-Z in lower case."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def with_deletions(words: DataFrame) -> DataFrame:
    """(w): the run, or the run without one code point where DELETE_EVERY divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return words.withColumn("h", h).select(F.when(F.col("h") % DELETE_EVERY == 0, short).otherwise(F.col("run")).alias("w"))


def counted(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points with ``least`` occurrences; counted before the shuffle, so frequent words don't gather."""
    return words.where(F.length("w") >= LEAST_LENGTH).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bit_of_letter(words: DataFrame) -> dict[str, int]:
    """The letters dealt to the bands, those whose parity says most first, so that the bands tell words apart about equally.

    Collected: a row per letter in a word's odd letters, at most the letters of the pattern and a few thousand more
    where ``words`` come from elsewhere; the first BANDS * BAND_BITS get a bit of their own.
    """
    odd = F.filter(F.array_distinct(F.split("word", "")), lambda c: (c != "") & (_times("word", c) % 2 == 1))
    total = words.count()
    seen = words.select(F.explode(odd).alias("c")).groupBy("c").count().orderBy(F.abs(F.col("count") - total / 2), "c").limit(BANDS * BAND_BITS).collect()
    return {r["c"]: i % BANDS * BAND_BITS + i // BANDS for i, r in enumerate(seen)}


def _times(word: str, letter: Column) -> Column:
    return F.length(word) - F.length(F.replace(F.col(word), letter, F.lit("")))


def masks(bits: dict[str, int]) -> list[Column]:
    """The bands of a word's parity mask: a bit per letter, set where the letter occurs an odd number of times. Letters without a bit are left out."""
    out = []
    for b in range(BANDS):
        band = F.lit(0)
        for letter, bit in bits.items():
            if bit // BAND_BITS == b:
                band = band.bitwiseOR(F.when(F.contains(F.col("word"), F.lit(letter)), F.shiftleft((_times("word", F.lit(letter)) % 2).cast("int"), bit % BAND_BITS)).otherwise(0))
        out.append(band.cast("int"))
    return out


def _halves(shorter: Column) -> Column:
    """The first and the last part of a word when the shorter of the two has that many code points: one edit leaves one of them whole."""
    h = F.floor(shorter / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), h).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", F.length("word") - shorter + h + 1, F.length("word")).alias("part")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) and (b, a) once each for all words at one inserted, deleted or replaced code point.

    An edit flips at most two bits of the parity mask, so one of three bands is
    equal: words meet by an equal band, the length of the shorter one, and an
    equal first or last half, of which one edit touches only one too. So a
    band's words are never paired with all others of their band and length.
    A pair counts at the first band and half that it shares, and only where
    the masks differ in as many bits as the lengths allow; then the distance
    is checked. ``words``: word (distinct), n.
    """
    bits = bit_of_letter(words)
    marked = common.staged(words.select("word", "n", F.length("word").alias("l"), *(m.alias(f"m{b}") for b, m in enumerate(masks(bits)))), "masks")
    band = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"m{b}").alias("value")) for b in range(BANDS)))).alias("k")
    kept = ["word", "n", "l", *(f"m{b}" for b in range(BANDS))]

    def keyed(shorter: Column, name: str) -> DataFrame:
        rows = marked.select(*kept, band, shorter.alias("short")).withColumn("half", F.explode(_halves(F.col("short"))))
        return rows.select(F.col("k.band"), F.col("k.value"), "short", F.col("half.side"), F.col("half.part"), *(F.col(c).alias(f"{name}_{c}") for c in kept))

    own, longer = keyed(F.col("l"), "a"), keyed(F.col("l"), "b").unionByName(keyed(F.col("l") - 1, "b"))
    met = own.join(longer, ["band", "value", "short", "side", "part"])
    apart = sum((F.bit_count(F.col(f"a_m{b}").bitwiseXOR(F.col(f"b_m{b}"))) for b in range(BANDS)), F.lit(0))
    grows = F.col("b_l") - F.col("a_l")
    first_band = F.expr(" AND ".join(f"(band <= {b} OR a_m{b} <> b_m{b})" for b in range(BANDS - 1)))
    h = F.floor(F.col("short") / 2).cast("int")
    first_half = (F.col("side") == 0) | (F.substring("a_word", F.lit(1), h) != F.substring("b_word", F.lit(1), h))
    near = ((grows == 1) | (F.col("a_word") < F.col("b_word"))) & first_band & first_half & (apart <= 2 - grows)
    pairs = met.where(near).where(F.levenshtein("a_word", "b_word", 1) == 1)
    both = F.array(*(F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_word").alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Each word's form and the root of its group.

    ``words``: word (distinct, not null), n. Near: one inserted, deleted or
    replaced code point. A word's form is the near word of largest n (ties: the
    first in code-point order) where that n is at least ``times`` the word's
    own, else null; its root is where the forms end. Words without near words
    are their own root. An empty table gives no rows. Returns word, n, n_near,
    form, form_n, root.
    """
    words = common.staged(words.select("word", "n"), "words")
    # counts first, so that ties of the largest one go to the least word
    near = near_pairs(words).groupBy("word", "other_n").agg(F.count("*").alias("c"), F.min("other").alias("other"))
    near = near.groupBy("word").agg(F.sum("c").alias("n_near"), F.max_by("other", "other_n").alias("other"), F.max("other_n").alias("other_n"))
    got = words.join(near, "word", "left")
    is_form = F.col("other_n") >= times * F.col("n")
    got = common.staged(got.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("other_n")).alias("form_n")), "forms")
    return got.join(roots(got.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by doubling: each round looks up where the last one's end leads.

    n at least doubles from word to form, so chains are no longer than the binary logarithm of the largest n.
    """
    reached = common.staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = common.staged(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        common.forget(reached)
        reached = common.staged(new.select("word", "root"), "roots") if moved else new.select("word", "root")
        if not moved:
            return reached
        common.forget(new)


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs``: doc_id, text; null texts have none, a null doc_id counts as an empty one, other columns are ignored, repeated rows count each."""
    return counted(with_deletions(runs(docs)))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents with their near words' number, form and root."""
    return variants(corpus_words(common.table(spark, sf_dir, "documents")))


#: Pairs by words with one letter taken out instead of bands: equal after a deletion at the same place is a replacement, a word that is another's
#: deletion an insertion. The checksum is folded byte by byte over its usual table, which is worked out first.
OP11_SQL = r"""
WITH RECURSIVE tb(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tb WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS crc FROM tb WHERE k = 8),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
g AS (SELECT run, count(*) AS n, hex(encode(d || ':' || run)) AS x FROM o GROUP BY d, run),
b AS (SELECT run, n, list_transform(range(length(x) // 2), lambda j: CAST(16 * (strpos('0123456789ABCDEF', x[2 * j + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * j + 2]) - 1 AS BIGINT)) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, y: xor(a >> 8, t.crc[(xor(a, y) & 255) + 1])), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
y AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM x),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM y a JOIN y b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM v a JOIN y b ON a.word = b.cut
      UNION SELECT b.word, a.word, a.n FROM v a JOIN y b ON a.word = b.cut),
f AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM p GROUP BY word),
z AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN f USING (word)),
r(word, last) AS (SELECT word, word FROM z UNION ALL SELECT r.word, z.form FROM r JOIN z ON r.last = z.word AND z.form IS NOT NULL),
e AS (SELECT r.word, r.last AS root FROM r JOIN z ON r.last = z.word AND z.form IS NULL)
SELECT z.word, z.n, z.n_near, z.form, z.form_n, e.root FROM z JOIN e USING (word)
"""
