"""Report sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions.barrier import once
from radweave.functions.constants import FIRST_PART, HEADER, LAST_PART, SECTIONS
from radweave.functions.text import is_blank, strip


def strip_header(text: Column) -> Column:
    """Report without its heading line; the whole first line goes, even if findings follow on it."""
    return strip(F.regexp_replace(text, HEADER, ""))


def with_sections(df: DataFrame, text: str = "report_text", out: str = "sections") -> DataFrame:
    """Adds ``out``: array of (section_idx, section, text) of the non-blank sections in their fixed order.

    The first line-start impression, conclusion or summary header takes all that follows. A
    findings or comments header before it takes what lies between, and the text before that header is
    dropped; without one the text before goes to body. A null or blank report has no sections.
    """
    t = "__plain"
    df = once(df, **{t: strip_header(F.coalesce(F.col(text), F.lit("")))})
    java_first = FIRST_PART.replace("(?im)", "(?imd)")  # line ends are \n alone
    found = {"last": LAST_PART, "first": java_first}
    df = once(df, **{f"__{k}_at": F.regexp_instr(t, F.lit(p)) for k, p in found.items()}, **{f"__{k}_all": F.regexp_extract(t, p, 0) for k, p in found.items()})
    df = once(
        df, __last=F.lower(F.regexp_extract("__last_all", r"(?i)(impression|conclusion|summary)", 1)), __first=F.lower(F.regexp_extract("__first_all", r"(?i)(findings|comments)", 1)),
        __before=F.when(F.col("__last_at") > 0, F.expr(f"substring({t}, 1, __last_at - 1)")).otherwise(F.lit("")),
        __lead=F.col("__first_at") - 1, __at=F.col("__first_at") - 1 + F.length("__first_all"),
    )
    has_last, has_first = F.col("__last_at") > 0, F.col("__first_at") > 0
    cut = F.length("__before")
    use_first = has_first & (~has_last | (F.col("__lead") < cut))
    inner = F.when(has_last, F.expr(f"substring({t}, __at + 1, greatest(0, length(__before) - __at))")).otherwise(F.expr(f"substring({t}, __at + 1)"))
    tail = strip(F.expr(f"substring({t}, __last_at + length(__last_all))"))
    body = F.when(use_first, F.lit("")).when(has_last, strip(F.col("__before"))).otherwise(F.col(t))
    texts = {}
    for name in SECTIONS:
        if name == "body":
            texts[name] = body
        elif name in ("findings", "comments"):
            texts[name] = F.when(use_first & (F.col("__first") == name), strip(inner)).otherwise("")
        else:
            texts[name] = F.when(F.col("__last") == name, tail).otherwise("")
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("section_idx"), F.lit(n).alias("section"), texts[n].alias("text")) for i, n in enumerate(SECTIONS)]), lambda s: s["text"] != "")
    rest = F.array(F.struct(F.lit(SECTIONS.index("body")).alias("section_idx"), F.lit("body").alias("section"), strip(F.col(text)).alias("text")))
    none = F.filter(rest, lambda s: F.lit(False))
    df = once(df, __found=found).drop(t, "__last", "__first", "__before", "__lead", "__at", "__last_at", "__first_at", "__last_all", "__first_all")
    return once(df, **{out: F.when(is_blank(F.col(text)), none).when(F.size("__found") > 0, F.col("__found")).otherwise(rest)}).drop("__found")
