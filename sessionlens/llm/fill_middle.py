"""Fill-in-middle transformation by counted quantifiers of regular expressions.

A document is a run of n line units.  A hash of its id draws two cuts ``a <= b``; one match
of the pattern of the row, ``(unit{a})(unit{b - a})(rest)`` with possessive groups, captures
prefix, middle and suffix, and the replacement of that match writes them in the order of the
form.  A possessive group never gives units back, so a match is one pass over the text, with
no stack that grows with its lines.  All work is a projection: nothing is shuffled, and no
row meets another.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``
and ``plain`` the text itself.  A text that contains a mark stays plain, so marks in an
output are always those written here, and the text can be rebuilt from output and form.

Defined results: a null or empty text is plain with no unit; a null id draws as the empty
id; repeated rows are transformed alike, and rows of one id and different texts share their
draws; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import computed_once

UNIT = r"[^\n]*\n|[^\n]+"
#: The same units, without backtracking into a line.
POSSESSIVE = r"(?:[^\n]*+\n|[^\n]++)"
MARKS = "<[PSM]>"
RATE, SPM, SEED = 100, 50, 7


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers under 2^32 from ``seed:key``."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def split_pattern(first: Column, second: Column) -> Column:
    """The pattern of a row whose cuts come after ``first`` and ``second`` units."""
    return F.format_string(
        rf"(?s)\A(%s{{%d}}+)(%s{{%d}}+)(.*+)\z", F.lit(POSSESSIVE), first, F.lit(POSSESSIVE), second - first
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` turned into ``output``."""
    psm = F.regexp_replace(output, r"(?s)\A<P>(.*?)<S>(.*?)<M>(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, r"(?s)\A<S>(.*?)<P>(.*?)<M>(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    documents: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix, middle, suffix, output``; the parts are null for plain rows.

    ``rate`` of 100 documents are cut, ``spm`` of 100 of these with the suffix first.
    """
    rows = documents.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")
    )
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    plain = (F.col("text") == "") | F.col("text").rlike(MARKS) | (h3 % 100 >= rate)
    counted = computed_once(
        rows,
        F.regexp_count("text", F.lit(UNIT)).cast("bigint").alias("n"),
        F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm").alias("form"),
    )
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    order = F.when(F.col("form") == "spm", "<S>$3<P>$1<M>$2").otherwise("<P>$1<S>$3<M>$2")
    cut = F.regexp_replace(F.col("text"), split_pattern(F.least(a, b), F.greatest(a, b)), order)
    made = computed_once(counted, F.when(F.col("form") == "plain", F.col("text")).otherwise(cut).alias("output"))
    parts = computed_once(made, F.when(F.col("form") != "plain", F.split("output", MARKS, -1)).alias("parts"))
    part = [F.get("parts", F.lit(k)) for k in range(4)]
    is_spm = F.col("form") == "spm"
    return parts.select(
        "doc_id", "n", "form",
        F.when(is_spm, part[2]).otherwise(part[1]).alias("prefix"),
        part[3].alias("middle"),
        F.when(is_spm, part[1]).otherwise(part[2]).alias("suffix"),
        "output",
    )


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, cut at lines."""
    cut = fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet"))
    return cut.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
    FROM documents
), numbers AS (
    SELECT doc_id, text, units, len(units) AS n,
           ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
           ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
    FROM drawn
), placed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parted AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
           array_to_string(units[b + 1:], '') AS suffix
    FROM placed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""
