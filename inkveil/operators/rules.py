"""Regions from labels and written formats in single lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.geometry import box_columns, value_polygon, well_formed
from inkveil.functions.lines import once


@dataclass(frozen=True)
class Rule:
    """A Java pattern whose first group is the value; characters that recognition may have missed before it."""

    category: str
    pattern: str
    prefix_miss: int = 0


#: The words that form labels, by kind: optional tasks before titles, then what the label is called.
LABELS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "doctor": (("申请", "报告", "审核", "主治", "经治", "检查", "主管", "开单", "技术", "初诊", "复诊"), ("医生", "医师", "技师", "操作者", "检查者")),
    "medical_id": ((), ("报告单号", "病历号", "就诊号", "住院号", "超声号", "门诊号", "检查号", "登记号", "条码号?", "检验号", "标本号", "申请号", "流水号", "检验仪器", "检查仪器", "仪器号", "检验器号", "仪器编号")),
    "name": ((), ("采样人", "送检人", "送检者", "核收人", "录入人")),
    "empty": (("报告录入", "报告", "审核", "主治", "经治", "检查", "申请", "主管", "开单"), ("医生", "医师", "技师", "录入")),
}
HAN = r"\x{4e00}-\x{9fff}"
#: What a label's value looks like.
VALUES = {"doctor": rf"([{HAN}]{{2,3}}?)", "medical_id": r"([A-Za-z0-9\-_.]{2,})", "name": rf"([{HAN}]{{2,4}})"}
#: Characters, each once, that may follow a doctor's name.
DOCTOR_STOPS = "床号科室门诊住院检查报告审核主治经申请"
SIGN_LABEL = "手签"


def label_pattern(kind: str) -> str:
    """A label of the kind with its colon and what blanks follow."""
    tasks, titles = ("|".join(words) for words in LABELS[kind])
    return (f"(?:{tasks})?" if tasks else "") + rf"(?:{titles})[：:]\s*"


def value_pattern(kind: str) -> str:
    return label_pattern(kind) + VALUES[kind]


DOCTOR = rf"(?U){value_pattern('doctor')}(?=[：:\s\d{DOCTOR_STOPS}]|\z)"
NUMBER = f"(?U){value_pattern('medical_id')}"
STAFF = f"(?U){value_pattern('name')}"
EMPTY_DOCTOR = f"(?U){label_pattern('empty')}$"
SIGNATURE = rf"(?U)^(?s:(.*?{SIGN_LABEL}[：:]\s*))"

RULES = (Rule("doctor", DOCTOR, 1), Rule("medical_id", NUMBER), Rule("name", STAFF))

#: Values that can be told by their written form alone.
FORMATS = (
    Rule("id_card", r"(?<![0-9A-Za-z])([0-9]{17}[0-9Xx]|[0-9]{15})(?![0-9A-Za-z])"),
    Rule("phone", r"(?<![0-9])(1[3-9][0-9]{9}|0[0-9]{2,3}-[0-9]{7,8})(?![0-9])"),
    Rule("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"),
    Rule("date", r"(?<![0-9])([0-9]{4}(?:-[0-9]{1,2}-[0-9]{1,2}|/[0-9]{1,2}/[0-9]{1,2}|\.[0-9]{1,2}\.[0-9]{1,2}|年[0-9]{1,2}月[0-9]{1,2}日))(?![0-9])"),
    Rule("age", r"(?<![0-9])([0-9]{1,3}岁)"),
)

RULE_STEP, LINE_STEP, PHASE_STEP = 1_000, 100_000, 10**12


def region_columns(source: str, seq: Column, text: Column, category: Column, polygon: Column, line: Column) -> list[Column]:
    return ["image_id", F.lit(source).alias("source"), seq.cast("bigint").alias("seq"), text.alias("text"), category.alias("category"), polygon.alias("polygon"), line.cast("int").alias("ocr_line_index")]


def extract_values(text_lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The lines once for each match: adds rule_no, match_no, category, value, prefix_miss.

    One pass over the lines: all rules' matches are exploded together.
    """

    def matches(n: int, r: Rule) -> Column:
        found = F.regexp_extract_all("text", F.lit(r.pattern), 1)
        return F.transform(found, lambda v, k: F.struct(F.lit(n).alias("rule_no"), k.alias("match_no"), F.lit(r.category).alias("category"), v.alias("value"), F.lit(r.prefix_miss).alias("prefix_miss")))

    found = F.flatten(F.array(*[matches(n, r) for n, r in enumerate(rules)]))
    return once(text_lines, __found=found).select("*", F.explode("__found").alias("m")).select(*text_lines.columns, "m.*")


def rule_regions(text_lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Regions of all rules' values; seq keeps the order line, rule, match."""
    found = extract_values(text_lines, rules)
    seq = F.col("line_index").cast("bigint") * LINE_STEP + F.col("rule_no") * RULE_STEP + F.col("match_no")
    polygon = value_polygon(F.col("bbox"), F.col("text"), F.col("value"), prefix_miss=F.col("prefix_miss"))
    # a step of its own: inside a lambda, `text` would otherwise mean the new column of that name
    found = found.withColumn("__polygon", polygon)
    return found.select(*region_columns("rule", seq, F.col("value"), F.col("category"), F.col("__polygon"), F.col("line_index")))


def pattern_regions(text_lines: DataFrame, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Regions of values told by their format, so that a batch can be searched without a model."""
    return rule_regions(text_lines, tuple(r for r in FORMATS if categories is None or r.category in categories))


def _unit(v: Column, length: Column) -> Column:
    return F.array(v[0] / F.greatest(length, F.lit(1.0)), v[1] / F.greatest(length, F.lit(1.0)))


def signature_label_regions(text_lines: DataFrame) -> DataFrame:
    """A region after the first signature label of a line: from the label's end to one line width past the line, half a line higher and lower."""
    q = F.transform(F.col("bbox"), lambda p: F.transform(p, lambda c: c.cast("double")))
    lines = text_lines.withColumn("__label", F.regexp_extract("text", SIGNATURE, 1)).where((F.col("__label") != "") & well_formed(F.col("bbox"))).withColumn("q", q)
    c, ratio = F.col("q"), F.length("__label") / F.greatest(F.length("text"), F.lit(1)).cast("double")
    top, bottom = [F.array(c[b][0] - c[a][0], c[b][1] - c[a][1]) for a, b in ((0, 1), (3, 2))]
    height = F.greatest(c[3][1] - c[0][1], c[2][1] - c[1][1], F.lit(1.0))
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1])
    width, pad = norm(top), height * 0.5
    out_top, out_bottom = _unit(top, norm(top)), _unit(bottom, norm(bottom))
    point = lambda x, y: F.array(x.cast("int"), y.cast("int"))
    polygon = F.array(
        point(c[0][0] + top[0] * ratio, c[0][1] + top[1] * ratio - pad),
        point(c[1][0] + out_top[0] * width, c[1][1] + out_top[1] * width - pad),
        point(c[2][0] + out_bottom[0] * width, c[2][1] + out_bottom[1] * width + pad),
        point(c[3][0] + bottom[0] * ratio, c[3][1] + bottom[1] * ratio + pad),
    )
    seq = F.lit(PHASE_STEP) + F.col("line_index").cast("bigint") * LINE_STEP
    return lines.select(*region_columns("rule", seq, F.lit("[手写签名]"), F.lit("handwritten_signature"), polygon, F.col("line_index")))


def empty_label_regions(text_lines: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """A region right of each line that ends in a doctor's label without a name, unless print stands there.

    Print is another line of the image with over min_confidence and two characters at
    least whose centre lies in the area. Only lines with such a label meet the image's
    lines, on image_id, in a range anti-join.
    """
    x1, y1, x2, y2 = box_columns(F.col("bbox"))
    labels = text_lines.where(F.col("text").rlike(EMPTY_DOCTOR) & ~F.col("text").rlike(DOCTOR) & well_formed(F.col("bbox"))).select("*", x1, y1, x2, y2)
    h, w = F.greatest(F.col("y2") - F.col("y1"), F.lit(1)), F.greatest(F.col("x2") - F.col("x1"), F.lit(1))
    part = lambda n, r: (n.cast("double") * F.lit(r)).cast("int")
    labels = labels.withColumns({"ax1": F.col("x2"), "ay1": F.col("y1") - part(h, 0.3), "ax2": F.col("x2") + part(w, 0.7), "ay2": F.col("y2") + part(h, 0.3), "h": h})
    other = printed(text_lines, min_confidence)
    l, o = labels.alias("l"), other.alias("o")  # noqa: E741
    free = l.join(o, (F.col("l.image_id") == F.col("o.o_image")) & (F.col("l.line_index") != F.col("o.o_index")) & inside("l"), "left_anti")
    q = F.transform(F.col("bbox"), lambda p: F.transform(p, lambda c: c.cast("double")))
    free = free.withColumn("q", q)
    c = F.col("q")
    top, bottom = [F.array(c[b][0] - c[a][0], c[b][1] - c[a][1]) for a, b in ((0, 1), (3, 2))]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1])
    far, pad = norm(top) * 0.7, F.col("h").cast("double") * 0.5
    ut, ub = _unit(top, norm(top)), _unit(bottom, norm(bottom))
    point = lambda x, y: F.array(x.cast("int"), y.cast("int"))
    polygon = F.array(point(c[1][0], c[1][1] - pad), point(c[1][0] + ut[0] * far, c[1][1] + ut[1] * far - pad), point(c[2][0] + ub[0] * far, c[2][1] + ub[1] * far + pad), point(c[2][0], c[2][1] + pad))
    seq = F.lit(2 * PHASE_STEP) + F.col("line_index").cast("bigint") * LINE_STEP
    return free.select(*region_columns("rule", seq, F.lit("[手写姓名]"), F.lit("doctor"), polygon, F.col("line_index")))


def printed(text_lines: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """o_image, o_index, cx, cy: centres of the lines that are surely print."""
    from inkveil.functions.lines import stripped

    x1, y1, x2, y2 = box_columns(F.col("bbox"))
    sure = text_lines.where((F.col("confidence") > min_confidence) & (F.length(stripped(F.col("text"))) >= 2))
    return sure.select(F.col("image_id").alias("o_image"), F.col("line_index").alias("o_index"), ((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"))


def inside(area: str) -> Column:
    return F.col("o.cx").between(F.col(f"{area}.ax1"), F.col(f"{area}.ax2")) & F.col("o.cy").between(F.col(f"{area}.ay1"), F.col(f"{area}.ay2"))


def all_rule_regions(text_lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Values, then signature labels, then empty labels: the order that later ties follow."""
    return rule_regions(text_lines, rules).unionByName(signature_label_regions(text_lines)).unionByName(empty_label_regions(text_lines))
