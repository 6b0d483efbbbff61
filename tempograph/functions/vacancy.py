"""Values of vacancies: numbers, days, salaries, necessity, sections and spans, as expressions of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of necessity and how far before a quote they count.
REQUIRED = ["要求", "必须", "必备", "精通"]
BONUS = ["加分", "优先", "了解"]
REACH = 160

#: Headings of a resume's sections, in order of precedence, whole lines in any case.
SECTIONS = {
    "basic": r"基本信息|个人信息|个人资料|求职意向|personal\s*information",
    "education": r"教育经历|教育背景|教育|education",
    "work": r"工作经历|工作经验|任职经历|职业经历|work\s*experience",
    "project": r"项目经历|项目经验|项目|projects?",
    "skill": r"技能专长|专业技能|技能|掌握技能|技术栈|skills?",
}

_RANGE = r"([0-9]+(?:\.[0-9]+)?)\s*{left}{dash}\s*([0-9]+(?:\.[0-9]+)?)\s*([{units}])?"
SHORT_RANGE = _RANGE.format(left="", dash="[-–~]", units="Kk千")
UNIT_RANGE = _RANGE.format(left="([Kk千Ww万])?\\s*", dash="[-–~至到]", units="Kk千Ww万")


def whole_number(text: Column) -> Column:
    """A number in text without its fraction; null where there is none."""
    return text.cast("string").try_cast("double").try_cast("bigint")


def day_of(text: Column) -> Column:
    """The ISO day a text begins with, else null."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), head.try_cast("date"))


def day_of_epoch(text: Column) -> Column:
    """The UTC day of a number of seconds, or of milliseconds if above 1e10."""
    n = text.try_cast("double")
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.when(n > 1e10, n / 1000).otherwise(n) / 86400).cast("int"))


def in_full(amount: Column) -> Column:
    """Amounts below 1000 are thousands."""
    return F.when(amount < 1000, amount * 1000).otherwise(amount)


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    compact = F.replace(text, F.lit(" "), F.lit(""))
    return [F.regexp_extract(compact, pattern, i + 1) for i in range(n)]


def _pair(low: Column, high: Column) -> Column:
    return F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def salary_range(text: Column) -> Column:
    """low and high of texts like `15-30K`: thousands with a unit or a low below 1000."""
    low, high, unit = _groups(text, SHORT_RANGE, 3)
    low, high = low.try_cast("double"), high.try_cast("double")
    by = F.when((unit != "") | (low < 1000), 1000).otherwise(1)
    return _pair(low * by, high * by)


def _factor(unit: Column) -> Column:
    return F.when(F.lower(unit).isin("k", "千"), 1000).when(F.lower(unit).isin("w", "万"), 10000).otherwise(1)


def salary_summary(text: Column) -> Column:
    """low and high a month of summaries with units on either side; negotiable or hourly pay has none, yearly pay is divided by 12."""
    low, unit_low, high, unit_high = _groups(text, UNIT_RANGE, 4)
    by_high = _factor(unit_high)
    by_low = F.when(_factor(unit_low) == 1, by_high).otherwise(_factor(unit_low))
    low, high = (low.try_cast("double") * by_low).cast("bigint"), (high.try_cast("double") * by_high).cast("bigint")
    small = (low < 1000) & (high < 1000)
    month = lambda x: F.when(F.contains(text, F.lit("年")), F.floor(x / 12)).when(small, x * 1000).otherwise(x)
    none = (F.trim(text) == "面议") | F.contains(text, F.lit("小时"))
    return _pair(F.when(~none, month(low)), F.when(~none, month(high)))


def last_place(text: Column, part: str) -> Column:
    """Where `part` begins for the last time, from 0; -1 if nowhere."""
    back = F.instr(F.reverse(text), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(text) - back + 1 - len(part))


def necessity(quote: Column, text: Column, required: list[str] = REQUIRED, bonus: list[str] = BONUS, reach: int = REACH) -> Column:
    """bonus or required, by the last marker in the quote and the `reach` characters before it; null without one.

    A quote that is empty or not in the text counts as one at the start.
    """
    at = F.greatest(F.position(quote, text) - 1, F.lit(0))
    start = F.greatest(at - reach, F.lit(0))
    window = F.substr(text, start + 1, at - start + F.length(quote))
    last = lambda parts: F.greatest(F.lit(-1), *[last_place(window, p) for p in parts])
    r, b = last(required), last(bonus)
    return F.when((r < 0) & (b < 0), None).when(b > r, "bonus").otherwise("required")


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether the half-open span meets one of an array of spans (start, end)."""
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def covered(start: Column, end: Column, spans: Column, share: float = 0.6) -> Column:
    """Whether a span of the array holds this one or overlaps at least `share` of its length."""
    common = lambda s: F.least(end, s["end"]) - F.greatest(start, s["start"])
    held = lambda s: (start >= s["start"]) & (end <= s["end"])
    return F.exists(spans, lambda s: held(s) | ((common(s) > 0) & (common(s) / F.greatest(end - start, F.lit(1)) >= share)))


def blank(text: Column, spans: Column) -> Column:
    """The text with its spans as blanks; offsets stay."""
    put = lambda t, s: F.overlay(t, F.repeat(F.lit(" "), F.least(s["end"], F.length(t)) - F.greatest(s["start"], F.lit(0))), F.greatest(s["start"], F.lit(0)) + 1)
    return F.aggregate(spans, text, lambda t, s: F.when((s["start"] < F.length(t)) & (s["end"] > s["start"]) & (s["end"] > 0), put(t, s)).otherwise(t))


def segments(docs: DataFrame, sections: dict[str, str] = SECTIONS) -> DataFrame:
    """doc_id, kind, start, end: the text cut where a line is a heading; `full` without headings, `basic` for what precedes the first.

    Lines of one document share a task: a window over doc_id, as large as a text. doc_id is a key; a null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    line = docs.select("doc_id", F.length(text).alias("size"), F.posexplode(F.split(text, "\n")).alias("line", "content"))
    own = Window.partitionBy("doc_id").orderBy("line")
    kind = F.coalesce(*[F.when(F.col("content").rlike(rf"(?iu)^\s*[：:]*\s*(?:{p})\s*[：:]*\s*$"), k) for k, p in sections.items()])
    placed = line.select("doc_id", "size", "line", kind.alias("kind"), (F.coalesce(F.sum(F.length("content") + 1).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int").alias("start"))
    kept = placed.select("*", F.count("kind").over(Window.partitionBy("doc_id")).alias("n")).where("kind is not null or line = 0")
    marks = kept.withColumn("kind", F.coalesce("kind", F.when(F.col("n") == 0, "full").otherwise("basic")))
    return marks.select("doc_id", "kind", "start", F.coalesce(F.lead("start").over(own), "size").alias("end"))
