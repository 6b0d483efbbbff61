"""Line-first quality rules, in Catalyst expressions only.

Each line is judged by itself: symbols and shouting (punctuation), navigation bars and menu items, and boilerplate phrases. Lines
that fail are removed; a document is rejected if less than KEEP of its words is left, or if it fails the base rules on its
length and on repeated five-word windows. Nothing is shuffled: the work is a projection of one row.

A null or empty text has no words and fails the base rules; n_words and all counts are 0 and the cleaned text is empty. A null
doc_id is passed on; repeated rows give equal rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read_table

#: The six ASCII white-space characters, the symbols, and phrases of boilerplate lines (lower case).
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
PHRASES = ["all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "click here", "subscribe to our", "sign up for our", "enable javascript", "powered by", "skip to content", "back to top",
           "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "hier klicken", "newsletter abonnieren", "nach oben",
           "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "cliquez ici", "abonnez-vous", "haut de page",
           "todos los derechos reservados", "política de privacidad", "condiciones de uso", "utiliza cookies", "haga clic aquí", "suscríbete", "volver arriba"]
#: Shares: of words that must be left, of a line's characters that may be symbols, of a line's words that may shout or be bars.
KEEP, SYMBOL_SHARE, SHOUT_SHARE, BAR_SHARE, WINDOW = 0.5, 0.1, 0.3, 0.25, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def n_of(text: Column, characters: str) -> Column:
    """How many of these characters text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    """The words of a text that isn't null."""
    return F.when(trimmed(text) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed(text), SPACE))


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more."""

    def covered(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: (b >= 1) & (b < F.size(s)) & (F.get(s, a)["h"] == F.get(s, b)["h"])
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k - 1, k) | same(k, k + 1)), lambda k: F.get(s, k)["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(width), lambda n, k: n + F.least(F.lit(width), F.get(p, k) - F.get(p, k - 1)))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(by_hash, places), total))

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, covered))


def n_words_of(x: Column) -> Column:
    """Number of words of a trimmed text that isn't empty; split only where single blanks don't part them."""
    odd = F.contains(x, F.lit("  ")) | (F.length(F.translate(x, "\t\n\x0b\f\r", "")) != F.length(x))
    return F.when(odd, F.size(F.split(x, SPACE))).otherwise(n_of(x, " ") + 1)


def line_loss(line: Column) -> Column:
    """Words that go with a line: all of a line to remove, else 0; a line without a word is never removed."""

    def rules(x: Column, n: Column) -> Column:
        symbols = n_of(x, SYMBOLS) > SYMBOL_SHARE * F.length(x)
        shouts = n_of(x, "!") > SHOUT_SHARE * n
        bars = (n >= 3) & (n_of(x, "|»›•") > BAR_SHARE * n)
        menu = (n <= 2) & ~x.rlike(r"[.!?…:;\"')\]]$")
        phrase = (n <= 12) & let(F.lower(x), lambda low: F.exists(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(low, p)))
        return F.when(menu | phrase | shouts | symbols | bars, n).otherwise(0)

    return let(trimmed(line), lambda x: F.when(x == "", 0).otherwise(let(n_words_of(x), lambda n: rules(x, n))))


def judged(text: Column, clean: bool = True) -> Column:
    """Counts, verdicts and clean_text (if asked for) of a text that isn't null, as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")
    duplicates = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    losses = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), line_loss(x).alias("loss")))

    def measured(words: Column, lines: Column) -> Column:
        lost = F.aggregate(lines, F.lit(0), lambda n, x: n + x["loss"])
        left = F.array_join(F.transform(F.filter(lines, lambda x: x["loss"] == 0), lambda x: x["line"]), "\n")
        n = F.size(words).cast("long")
        return F.struct(n.alias("n_words"), repeat_words(words).cast("long").alias("n_repeat_words"), (n - lost).alias("n_words_left"), *([left.alias("clean_text")] if clean else []))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        counts = {"word_chars": F.length(text) - n_of(text, BLANKS), "n_symbols": n_of(text, SYMBOLS), "n_dup_lines": duplicates}
        fields = [m["n_words"].alias("n_words"), *[c.cast("long").alias(n) for n, c in counts.items()], m["n_repeat_words"].alias("n_repeat_words"), m["n_words_left"].alias("n_words_left")]
        verdicts = [failed.alias("base_failed"), (~failed & (m["n_words_left"] >= KEEP * m["n_words"])).alias("kept")]
        return F.struct(*fields, *([m["clean_text"].alias("clean_text")] if clean else []), *verdicts)

    return let(let(words_of(text), lambda w: let(losses, lambda x: measured(w, x))), verdict)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def quality_rules(docs: DataFrame, clean: bool = True) -> DataFrame:
    """doc_id, counts, n_words_left, clean_text (the lines that stay, if asked for), base_failed, kept."""
    return docs.select("doc_id", judged(_text(), clean).alias("r")).select("doc_id", "r.*")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their failing lines removed, and n_chars (if there) of what is left.

    Kept rows come out of an array of none or one, as a filter would be pushed below and the rules computed twice.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    kept = docs.select(row, F.explode(F.filter(F.array(judged(_text())), lambda r: r["kept"])).alias("r"))
    changed = F.col("r.n_words_left") < F.col("r.n_words")
    new = {"text": F.when(changed, F.col("r.clean_text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("r.clean_text")).otherwise(F.col("doc.n_chars"))
    return kept.select(*[(new[c].cast(kind) if c in new else F.col(f"doc.`{c}`")).alias(c) for c, kind in docs.dtypes])


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), clean=False).select(COLUMNS)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY r),
l AS (SELECT r, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM (SELECT r, unnest(lines) AS x FROM w)),
f AS (SELECT r, x, len(regexp_split_to_array(x, '{SPACE}')) AS n, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols,
  length(x) - length(replace(x, '!', '')) AS shouts, length(x) - length(regexp_replace(x, '[|»›•]', '', 'g')) AS bars FROM l),
j AS (SELECT r, n, symbols > {SYMBOL_SHARE} * length(x) OR shouts > {SHOUT_SHARE} * n OR (bars > {BAR_SHARE} * n AND n >= 3)
  OR (n <= 2 AND NOT regexp_matches(x, '[.!?…:;"'')\]]$')) OR (n <= 12 AND len(list_filter([{", ".join(map(_quoted, PHRASES))}], lambda p: contains(lower(x), p))) > 0) AS fails FROM f),
k AS (SELECT r, sum(n) AS n_left FROM j WHERE NOT fails GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_left, 0) AS n_left
  FROM w LEFT JOIN covered USING (r) LEFT JOIN k USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left >= {KEEP} * n_words AS kept FROM m
"""
