"""How intense an announcement is: amounts, percents, a range of profit and its direction, topics, words of either mood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.text import keyword_count, keyword_flag, safe_ratio

# Units of amounts in hundred millions, marks between the ends of a range, words before a profit.
UNITS = {"亿元": 1.0, "亿": 1.0, "万元": 1e-4, "万": 1e-4, "元": 1e-8}
RANGE_MARKS = ("-", "~", "至", "到", "—", "－")
PROFITS = ("净利润", "归母净利润", "利润")
# Words that say which way profit goes (the first two decide), topics, and words of either mood.
SURE_UP = ("预增", "略增", "扭亏", "续盈")
SURE_DOWN = ("预减", "略减", "首亏", "续亏")
UP = ("增长", "增加", "盈利", "上升")
DOWN = ("亏损", "下降", "减少", "下滑")
TOPICS = {
    "forecast": ("业绩预告", "预计", "预增", "预减", "略增", "略减", "首亏", "续亏", "扭亏"),
    "earnings_report": ("年度报告", "季度报告", "一季报", "半年报", "三季报", "业绩快报"),
    "repurchase": ("回购公司股份", "股份回购", "回购股份"),
    "pledge": ("质押", "解押", "解除质押"),
    "restructuring": ("重大资产重组", "发行股份购买资产", "募集配套资金"),
    "contract_order": ("中标", "订单", "框架协议", "战略合作协议", "重大合同", "签订合同"),
    "inquiry": ("问询函", "关注函", "监管函"),
    "litigation_penalty": ("诉讼", "仲裁", "处罚", "立案", "违规"),
    "impairment": ("减值", "商誉", "计提"),
    "subsidy": ("补助", "补贴", "政府资助"),
    "ir_activity": ("投资者关系", "调研", "业绩说明会", "电话会议", "线上会议"),
    "product_launch": ("新产品", "量产", "认证", "发布", "AI", "车联网", "智能座舱"),
}
POSITIVE = ("增长", "增加", "提升", "中标", "扭亏", "盈利", "高增")
NEGATIVE = ("亏损", "下降", "减少", "下滑", "风险", "问询", "关注函", "处罚", "减值")

NUMBER = r"-?\d+(?:\.\d+)?"
UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
#: An amount does not begin within a number, so that the second end of ``1-2万`` is no negative one.
MONEY = rf"(?<!\d)({NUMBER})\s*({UNIT})"
PERCENT = rf"({NUMBER})\s*%"
PROFIT = rf"(?:{'|'.join(PROFITS)})[^-\d]{{0,12}}({NUMBER})\s*(?:{'|'.join(RANGE_MARKS)})\s*({NUMBER})\s*({UNIT})?"


def _scale(unit: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)


def joined_texts(columns: Sequence[str]) -> Column:
    """The different ones of several texts, in order, joined by a space; nulls are left out."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.col(c).cast("string") for c in columns]))), " ")


def profit_bounds(c: Column) -> Column:
    """``low, high`` of the first range of profit in hundred millions; without a unit, ends beyond 1,000 are ten thousands. Null without a range."""
    a, b, unit = (F.nullif(F.regexp_extract(c, PROFIT, k), F.lit("")) for k in (1, 2, 3))
    a, b = a.cast("double"), b.cast("double")
    usual = F.when(F.greatest(F.abs(a), F.abs(b)) > 1000, "万").otherwise("亿")
    scale = _scale(F.coalesce(unit, usual))
    return F.when(a.isNotNull(), F.struct(F.least(a * scale, b * scale).alias("low"), F.greatest(a * scale, b * scale).alias("high")))


def profit_direction(c: Column) -> Column:
    """1 or -1 by a word that is sure; else by words of one side only; else 0."""
    up, down = keyword_flag(c, UP), keyword_flag(c, DOWN)
    return F.when(keyword_flag(c, SURE_UP), 1).when(keyword_flag(c, SURE_DOWN), -1).when(up & ~down, 1).when(down & ~up, -1).otherwise(0)


def event_intensity(df: DataFrame, texts: Sequence[str], size: str) -> DataFrame:
    """``df`` with 26 features of its texts, each different text once; amounts also as shares of ``size`` (hundred millions too).

    Without an amount, percent or range its features are null, its count is 0; a share is null where ``size`` is zero, null or not finite.
    """
    out = df.withColumn("__t", joined_texts(texts))
    t = F.col("__t")
    money = F.zip_with(F.regexp_extract_all(t, F.lit(MONEY), 1), F.regexp_extract_all(t, F.lit(MONEY), 2), lambda n, u: n.cast("double") * _scale(u))
    percents = F.transform(F.regexp_extract_all(t, F.lit(PERCENT), 1), lambda n: n.cast("double") / 100)
    out = out.withColumns({"__m": money, "__p": percents, "__r": profit_bounds(t)})
    total = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    mid = (F.col("__r.low") + F.col("__r.high")) / 2
    found = {
        "money_count": F.size("__m").cast("double"), "money_max": F.array_max("__m"), "money_sum": total("__m"), "money_max_to_size": safe_ratio(F.array_max("__m"), F.col(size)),
        "percent_count": F.size("__p").cast("double"), "percent_max": F.array_max(F.transform("__p", F.abs)), "percent_mean": total("__p") / F.size("__p"),
        "profit_direction": profit_direction(t).cast("double"), "profit_low": F.col("__r.low"), "profit_high": F.col("__r.high"), "profit_mid": mid, "profit_mid_to_size": safe_ratio(mid, F.col(size)),
    }
    found |= {f"is_{name}": keyword_flag(t, words).cast("int") for name, words in TOPICS.items()}
    found |= {"positive_words": keyword_count(t, POSITIVE).cast("double"), "negative_words": keyword_count(t, NEGATIVE).cast("double")}
    return out.withColumns(found).drop("__t", "__m", "__p", "__r")
