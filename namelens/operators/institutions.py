"""Chinese institutions in affiliations: matched keywords and a confidence by their categories.

The keyword table is a parameter; the default has 171 keywords in eight categories.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namelens.functions.text import _words

KEYWORDS = {
    "top_university": [
        "beida", "beihang", "beijing institute of technology", "beijing normal", "beijing university",
        "beijing university of aeronautics", "bit", "bnu", "buaa", "central south university", "chongqing university", "cqu", "csu",
        "dalian university of technology", "dlut", "dongbei", "fudan", "fudan university", "harbin institute",
        "harbin institute of technology", "hit", "hnu", "huazhong university of science and technology", "hunan university", "hust",
        "jilin university", "jlu", "lanzhou university", "lzu", "nanjing university", "nankai", "nankai university", "neu", "nju",
        "northeastern university", "northwestern polytechnical", "nwpu", "peking university", "people's university", "pku", "qinghua",
        "renmin university", "ruc", "scu", "scut", "sdu", "seu", "shandong university", "shanghai jiao tong", "shanghai jiaotong",
        "sichuan university", "sjtu", "soochow", "south china university of technology", "southeast university", "sun yat-sen",
        "suzhou university", "sysu", "tianjin university", "tju", "tongji", "tongji university", "tsinghua", "tsinghua university",
        "university of science and technology of china", "ustc", "whu", "wuhan university", "xi'an jiao tong", "xi'an jiaotong",
        "xiamen university", "xjtu", "xmu", "zhejiang university", "zhongkeda", "zhongshan university", "zju",
    ],
    "research": [
        "beijing institute", "cae", "cas", "china institute of atomic energy", "chinese academy of engineering",
        "chinese academy of sciences", "ciae", "guangzhou institute", "ia cas", "ibp", "iccas", "ict", "institute of automation cas",
        "institute of biophysics", "institute of chemistry", "institute of computing technology", "institute of physics", "iop",
        "shanghai institute", "shenzhen institute",
    ],
    "place": [
        "anhui", "beijing", "canton", "changsha", "chengdu", "chongqing", "dalian", "fujian", "gansu", "guangdong", "guangzhou",
        "hangzhou", "harbin", "hefei", "heilongjiang", "hubei", "hunan", "jiangsu", "jinan", "kunming", "lanzhou", "liaoning", "nanjing",
        "nanking", "peking", "qingdao", "shaanxi", "shandong", "shanghai", "shanxi", "shenzhen", "sichuan", "suzhou", "tianjin", "urumqi",
        "wuhan", "xi'an", "xian", "yunnan", "zhejiang", "zhengzhou",
    ],
    "country": [
        "china", "chinese", "mainland china", "p. r. china", "p.r. china", "people's republic of china", "pr china", "prc",
    ],
    "medical": [
        "beijing hospital", "capital medical university", "china medical university", "chinese people's liberation army",
        "peking union medical college", "pla hospital", "pumc", "shanghai medical", "southern medical university",
    ],
    "technical": [
        "beijing institute of technology", "beijing jiaotong university", "beijing university of posts and telecommunications",
        "harbin engineering university", "nanjing university of aeronautics", "xidian university",
    ],
    "normal": [
        "beijing normal university", "central china normal university", "east china normal university", "ecnu",
        "northeast normal university", "shaanxi normal university", "south china normal university",
    ],
    "agricultural": [
        "cau", "china agricultural university", "nanjing agricultural university", "northwest agriculture and forestry",
    ],
}


def matched(c: Column, table: dict[str, list[str]] | None = None, category: str | None = None) -> Column:
    """Sorted keywords that a text contains, of all categories or of one."""
    table = KEYWORDS if table is None else table
    words = sorted({w for k, ws in table.items() if category in (None, k) for w in ws})
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(_words(words), lambda w: low.contains(w)) if words else F.array().cast("array<string>")


def is_institution(c: Column, table: dict[str, list[str]] | None = None) -> Column:
    return F.size(matched(c, table)) > 0


def confidence(c: Column, table: dict[str, list[str]] | None = None) -> Column:
    """None 0; a top university .9; research .85; three keywords .8; two .75; only country names .65; else .7."""
    n = F.size(matched(c, table))
    of = lambda k: F.size(matched(c, table, k))
    return (
        F.when(n == 0, 0.0).when(of("top_university") > 0, 0.9).when(of("research") > 0, 0.85)
        .when(n >= 3, 0.8).when(n == 2, 0.75).when(of("country") == n, 0.65).otherwise(0.7)
    )
