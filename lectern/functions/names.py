"""Names of persons, with Chinese names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import trim

#: Two-character surnames that are split off whole.
COMPOUND_SURNAMES = (
    "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 "
    "司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门 羊舌 微生 公户 "
    "公玉 公仪 梁丘 公仲 公上 公门 公山 公坚 左丘 公伯 西门 公祖 第五 公乘 贯丘 公皙 南荣 东里 东宫 仲长 子书 子桑 即墨 达奚 褚师 吴铭 纳兰 归海"
).split()
CJK = "[㐀-鿿]"
CJK_BASIC = "[一-鿿]"


def creator_name(c: Column) -> Column:
    """A single name as it is; two Chinese names as last and first without a space; else first and last."""
    first, last = F.coalesce(c["first_name"], F.lit("")), F.coalesce(c["last_name"], F.lit(""))
    chinese = (first != "") & (last != "") & F.concat(first, last).rlike(CJK)
    return F.when(F.coalesce(c["name"], F.lit("")) != "", c["name"]).when(chinese, F.concat(last, first)).otherwise(trim(F.concat_ws(" ", first, last)))


def split_chinese_name(name: Column) -> Column:
    """struct(last_name, first_name): cut at a middle dot, else after a compound surname (which may be the whole name), else after one character."""
    x = trim(name)
    whole = lambda last, first: F.struct(last.alias("last_name"), first.alias("first_name"))
    dot = lambda d: whole(F.substring_index(x, d, 1), F.substring(x, F.instr(x, d) + 1, F.length(x)))
    return (
        F.when(~x.rlike(CJK_BASIC), whole(x, F.lit("")))
        .when(F.contains(x, F.lit("·")), dot("·"))
        .when(F.contains(x, F.lit("•")), dot("•"))
        .when(F.left(x, F.lit(2)).isin(*COMPOUND_SURNAMES), whole(F.left(x, F.lit(2)), F.substring(x, F.lit(3), F.length(x))))
        .when(F.length(x) == 1, whole(x, F.lit("")))
        .otherwise(whole(F.left(x, F.lit(1)), F.substring(x, F.lit(2), F.length(x))))
    )


def auto_split_creator(c: Column) -> Column:
    """A creator with an empty first name and two Chinese characters or more gets its name split."""
    parts = split_chinese_name(c["last_name"])
    due = (F.coalesce(c["first_name"], F.lit("")) == "") & (F.regexp_count(F.coalesce(c["last_name"], F.lit("")), F.lit(CJK_BASIC)) >= 2)
    kind = F.coalesce(c["creator_type"], F.lit("author"))
    return F.struct(
        F.when(due, parts["first_name"]).otherwise(c["first_name"]).alias("first_name"),
        F.when(due, parts["last_name"]).otherwise(c["last_name"]).alias("last_name"),
        c["name"].alias("name"),
        kind.alias("creator_type"),
    )
