"""Fill-in-middle transformation by escaped marker injection.

A text's units are its words with the white space before them (white space at the end is a unit of its own). The
delimiter is escaped in the text, one is appended after every unit by regexp_replace, counting the delimiters counts the units,
and substring_index cuts before or after a ranked delimiter; parts lose their delimiters, are unescaped, and put together behind markers.

Where a text is cut and in which form it goes are draws from the SHA-256 of seed and id, so that reruns, partitions
and the order of rows change nothing. All of it is column expressions: no shuffle, no Python, one pass over the texts.

Defined cases: null text is empty; an empty text, a text that holds a marker, and a text not drawn stay plain (the
text itself); a null id draws as the empty string; rows that repeat an id are cut by the same draws; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ESCAPE, _DELIMITER = "\x02", "\x01"  # neither is white space, so that escaping leaves units units


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_DELIMITER), F.lit(_ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    plain = F.replace(part, F.lit(_DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(_ESCAPE + "d"), F.lit(_DELIMITER)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def cut(marked: Column, rank: Column) -> Column:
    """What lies before the rank-th delimiter, or after the -rank-th from the end."""
    return F.call_function("substring_index", marked, F.lit(_DELIMITER), rank.cast("int"))


def assembled(form: str, prefix: Column, suffix: Column, middle: Column) -> Column:
    first = (F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix) if form == "psm" else (F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix)
    return F.concat(*first, F.lit(MIDDLE), middle)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    def between(begin: str, end: str | None) -> Column:
        rest = F.substr(output, F.instr(output, begin) + len(begin))
        return F.call_function("substring_index", rest, F.lit(end), F.lit(1)) if end else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """(id, n, form, prefix, middle, suffix, output); the parts are null where the form is plain.

    rate, spm_rate: per cent of texts to transform, and of those to put suffix first.
    """
    text = text_or_empty(text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)]
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.array(*draw).alias("h"), ((text == "") | holds).alias("stays"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + _DELIMITER))
    rows = rows.withColumn("n", (F.char_length("marked") - F.char_length(F.replace("marked", F.lit(_DELIMITER), F.lit("")))).cast("long"))
    cuts = [F.pmod(F.col("h")[k], F.col("n") + 1) for k in range(2)]
    drawn = ~F.col("stays") & (F.col("h")[2] % 100 < rate)
    form = F.when(~drawn, "plain").when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("id", "text", "n", form.alias("form"), "marked", F.least(*cuts).alias("lo"), F.greatest(*cuts).alias("hi"))
    cuts_of = F.col("form") != "plain"
    head = cut(F.col("marked"), F.col("hi"))
    rows = rows.select(
        "id",
        "text",
        "n",
        "form",
        F.when(cuts_of, unescaped(cut(F.col("marked"), F.col("lo")))).alias("prefix"),
        F.when(cuts_of, unescaped(cut(head, F.col("lo") - F.col("hi")))).alias("middle"),
        # the last unit has its delimiter, too: one more from the end
        F.when(cuts_of, unescaped(cut(F.col("marked"), F.col("hi") - F.col("n") - 1))).alias("suffix"),
    )
    outputs = {f: assembled(f, F.col("prefix"), F.col("suffix"), F.col("middle")) for f in ("psm", "spm")}
    output = F.when(F.col("form") == "psm", outputs["psm"]).when(F.col("form") == "spm", outputs["spm"]).otherwise(F.col("text"))
    return rows.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def fill_in_middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    found = fill_in_middle(docs, id_col, text_col, **options)
    return found.select(
        id_col,
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: The units as a list, cut by their numbers.
FILL_IN_MIDDLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM {docs}),
h AS (
  SELECT *, len(u) AS n, ('0x' || substr(d, 1, 8))::UBIGINT::BIGINT AS h1, ('0x' || substr(d, 9, 8))::UBIGINT::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::UBIGINT::BIGINT AS h3, ('0x' || substr(d, 25, 8))::UBIGINT::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
