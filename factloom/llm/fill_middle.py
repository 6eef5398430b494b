"""Fill-in-the-middle documents, in Spark SQL functions only.

A text is cut into lines; two cuts drawn from a digest of the identifier part it into prefix, middle and suffix, which are
written behind sentinels in one of two orders. A text that holds a sentinel itself stays plain, so that the first sentinels
of an arrangement are always its own and the text can be read back from the output and its form.

``units`` -> ``cuts`` -> ``arranged`` -> ``restored`` are projections of one row each: no shuffle, no state, any number of rows.

Defined cases: a null text counts as empty, and an empty text stays plain; a null identifier is hashed as the empty string
after the seed; rows with one identifier draw the same cuts; repeated rows are rows of their own; an empty table gives an empty
result; columns besides doc_id and text, whatever their names, come through ``formatted`` packed in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
SEED = 7


def units(text: Column) -> Column:
    """The lines of a text, each with its line break."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit integers of an identifier: the first groups of eight hexadecimal digits of its digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cuts(docs: DataFrame, fim_percent: int = 100, spm_percent: int = 50, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n, form, prefix, middle, suffix (null where the form is plain)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("_units", units(F.col("_text"))).withColumn("_h", F.array(*draws(F.col("doc_id"), seed)))
    n = F.size("_units")
    h = [F.col("_h")[i] for i in range(4)]
    plain = (F.col("_text") == "") | F.expr(" or ".join(f"contains(_text, '{mark}')" for mark in (PREFIX, SUFFIX, MIDDLE))) | (h[2] % 100 >= fim_percent)
    rows = rows.withColumn("n", n.cast("long")).withColumn("_a", (F.least(h[0] % (n + 1), h[1] % (n + 1))).cast("int")).withColumn("_b", (F.greatest(h[0] % (n + 1), h[1] % (n + 1))).cast("int"))
    rows = rows.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    part = lambda begin, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", begin + 1, length), ""))
    a, b = F.col("_a"), F.col("_b")
    return rows.withColumns({"prefix": part(F.lit(0), a), "middle": part(a, b - a), "suffix": part(b, n - b)}).drop("_units", "_h", "_a", "_b")


def arranged(parts: DataFrame) -> DataFrame:
    """``output``: the parts behind their sentinels; a plain text as it is."""
    prefix, middle, suffix = F.concat(F.lit(PREFIX), "prefix"), F.concat(F.lit(MIDDLE), "middle"), F.concat(F.lit(SUFFIX), "suffix")
    form = F.col("form")
    return parts.withColumn("output", F.when(form == "psm", F.concat(prefix, suffix, middle)).when(form == "spm", F.concat(suffix, prefix, middle)).otherwise(F.col("_text")))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone. Sentinels can't overlap, and none is in the parts, so a split finds these three."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def formatted(docs: DataFrame, fim_percent: int = 100, spm_percent: int = 50, seed: int = SEED) -> DataFrame:
    """Rows of doc_id, n, form, prefix, middle, suffix, output, and the other columns of ``docs`` as the struct ``others`` (null if
    there is none)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in others]
    packed = docs.select("doc_id", "text", (F.struct(*quoted) if others else F.lit(None).cast("string")).alias("others"))
    return arranged(cuts(packed, fim_percent, spm_percent, seed)).drop("_text", "text").select("doc_id", "n", "form", "prefix", "middle", "suffix", "output", "others")


def op13_fill_in_middle(spark, sf_dir):
    out = formatted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as g from documents),
u as (select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units, [('0x' || substr(g, 1 + 8 * i, 8))::bigint for i in range(4)] as h from d),
c as (select *, len(units)::bigint as n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, case when form <> 'plain' then array_to_string(units[1:a], '') end as prefix, case when form <> 'plain' then array_to_string(units[a + 1:b], '') end as middle,
  case when form <> 'plain' then array_to_string(units[b + 1:n], '') end as suffix from c)
select doc_id, n, form, length(prefix)::bigint as prefix_chars, length(middle)::bigint as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""
