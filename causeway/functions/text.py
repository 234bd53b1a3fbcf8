"""Names, keywords, levels and numbers in text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of place names. One of the first list is taken off, the first that fits; then each of the second that fits.
AUTONOMOUS_ENDINGS = (
    "土家族苗族自治州", "苗族侗族自治州", "布依族苗族自治州", "傣族景颇族自治州", "蒙古族藏族自治州", "藏族羌族自治州", "哈尼族彝族自治州",
    "傈僳族自治州", "柯尔克孜自治州", "哈萨克自治州", "蒙古自治州", "彝族自治州", "藏族自治州", "回族自治州", "壮族自治州", "朝鲜族自治州", "白族自治州", "自治州", "自治县",
)
REGION_ENDINGS = ("特别行政区", "经济技术开发区", "高新技术产业开发区", "自治区", "开发区", "新区", "地区", "市", "省", "州", "盟")


def clean_name(name: Column) -> Column:
    """Without brackets and what they hold, one autonomous ending and every region ending; two characters always stay."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"\([^)]*\)", ""), "（[^）]*）", "")
    cut = lambda x, e: F.when(x.endswith(e) & (F.length(x) > len(e) + 1), F.left(x, F.length(x) - len(e)))
    bare = F.coalesce(*(cut(bare, e) for e in AUTONOMOUS_ENDINGS), bare)
    return F.trim(reduce(lambda x, e: F.regexp_replace(x, f"^(.{{2,}}){e}$", "$1"), REGION_ENDINGS, bare))


CHINESE = "\\x{4e00}-\\x{9fff}"


def has_chinese(text: Column) -> Column:
    return text.rlike(f"[{CHINESE}]")


def tokens(text: Column) -> Column:
    """Distinct lower-case words of two letters or more, cut at blanks, _ and -, and each Chinese character and pair of them.

    Pairs are of characters that follow each other once everything else is left out.
    """
    low = F.lower(text)
    words = F.filter(F.split(F.regexp_replace(low, f"[{CHINESE}_\\-\\s]", " "), " +"), lambda w: F.length(w) > 1)
    only = F.regexp_replace(low, f"[^{CHINESE}]", "")
    n = F.length(only)
    single = F.when(n > 0, F.split(only, "")).otherwise(F.array().cast("array<string>"))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(only, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(words, pairs, single), lambda x: x != ""))


def text_match(query: Column, target: Column) -> Column:
    """1 if equal, .85 if the query is inside, .8 if the target is, .7 if both are Chinese and two neighbouring characters of the query are in the target,
    else half the share of the query's tokens that the target has; a Chinese query counts with its English words, too."""
    q, t = F.lower(F.trim(query)), F.lower(F.trim(target))
    asked = F.when(has_chinese(q), F.array_union(tokens(q), tokens(expand_query(q)))).otherwise(tokens(q))
    runs = F.when(F.length(q) > 1, F.transform(F.sequence(F.lit(1), F.length(q) - 1), lambda i: F.substring(q, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    pair = has_chinese(q) & has_chinese(t) & F.exists(runs, lambda x: t.contains(x))
    share = F.size(F.array_intersect(asked, tokens(t))) / F.greatest(F.size(asked), F.lit(1))
    empty = (F.length(q) == 0) | (F.length(t) == 0)
    return F.when(query.isNull() | target.isNull() | empty, 0.0).when(q == t, 1.0).when(t.contains(q), 0.85).when(q.contains(t), 0.8).when(pair, 0.7).otherwise(0.5 * F.least(share, F.lit(1.0)))


def any_keyword(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.lower(text).contains(w.lower()), words[1:], F.lower(text).contains(words[0].lower())) if words else F.lit(False)


#: Words by which the level of data is told, in order.
LEVELS = {
    "city": ["city", "城市", "municipal", "prefecture", "地级"],
    "province": ["province", "省", "provincial", "省级"],
    "country": ["country", "national", "国家", "全国", "nationwide"],
    "daily": ["daily", "日频", "日度", "daily frequency"],
    "monthly": ["monthly", "月度", "月频"],
    "yearly": ["yearly", "annual", "年度", "每年"],
}
#: Words by which the region of data is told, in order.
PLACES = {
    "cn": ["china", "中国", "cn", "chinese", "beijing", "shanghai", "城市", "province", "省", "city", "akshare", "nbs"],
    "us": ["us", "usa", "united states", "美国", "nyc", "new york", "chicago", "epa", "bls", "fec", "fred", "zillow", "citi bike"],
    "eu": ["eu", "europe", "eurostat", "oecd", "european", "germany", "france", "uk", "italy", "spain"],
    "global": ["world", "global", "international", "world bank", "wb", "cross-country", "跨国"],
}


#: English words that a Chinese term stands for.
ENGLISH = {
    "收入": "income disposable wage earnings", "工资": "wage earnings salary", "消费": "consumption retail", "房价": "house price real estate housing", "投资": "investment fixed asset",
    "出口": "export trade", "进口": "import trade", "医院": "hospital health medical", "医疗": "medical health insurance hospital", "教育": "education school student teacher college",
    "学生": "student school education", "教师": "teacher education", "医生": "doctor physician health", "床位": "bed hospital", "道路": "road area infrastructure", "绿地": "green park area",
    "供水": "water supply", "供气": "gas supply", "用电": "electricity consumption power", "汽车": "car vehicle ownership", "手机": "mobile phone telecom", "互联网": "internet broadband",
    "专利": "patent innovation", "养老": "pension insurance social security", "失业": "unemployment insurance", "污水处理": "sewage treatment waste", "垃圾": "waste treatment",
    "公共交通": "public transport transit bus", "出租车": "taxi", "建成区": "built up area urban", "研发": "rd research development science technology expenditure",
    "生育率": "fertility rate birth births per woman TFR", "生育": "fertility birth", "死亡率": "mortality death rate IMR", "死亡": "mortality death", "老龄化": "elderly aging old age",
    "城镇化": "urbanization urban", "流动人口": "migrant migration", "财政": "fiscal revenue expenditure", "外资": "fdi foreign investment", "卫生": "health hygiene medical sanitary",
    "社保": "social security insurance pension", "居民": "resident household urban rural", "城市": "city urban municipal", "农村": "rural village countryside", "人均": "per capita",
}


def expand_query(query: Column) -> Column:
    """The query with the English words of each Chinese term in it, in the table's order."""
    return F.concat_ws(" ", query, *(F.when(query.contains(k), F.lit(v)) for k, v in ENGLISH.items()))


def _first_hit(text: Column, table: dict[str, list[str]], default: str) -> Column:
    out = None
    for k, words in table.items():
        out = F.when(any_keyword(text, words), k) if out is None else out.when(any_keyword(text, words), k)
    return out.otherwise(default)


def infer_level(text: Column, hint: Column | None = None) -> Column:
    """city, province, country, daily, monthly or yearly: what the hint names, else the first level with a word in the text, else yearly."""
    found = _first_hit(F.coalesce(text, F.lit("")), LEVELS, "yearly")
    if hint is None:
        return found
    h = F.lower(hint)
    named = F.coalesce(*(F.when(h.isin(k, *words), k) for k, words in LEVELS.items()))
    return F.coalesce(named, found)


def infer_place(text: Column, hint: Column | None = None) -> Column:
    """cn, us, eu or global: the first region with a word in the text or the hint, else global."""
    both = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.lit("") if hint is None else F.coalesce(hint, F.lit("")))
    return _first_hit(both, PLACES, "global")


def parse_amount(text: Column) -> Column:
    """Numbers with thousands separators, percent signs and the units 万亿, 亿 and 万; null if there is none."""
    bare = F.regexp_replace(F.trim(text), r"[,，\s]", "")
    value = F.regexp_extract(bare, r"^(-?\d+(?:\.\d+)?)(?:万亿|亿|万|%)?$", 1).try_cast("double")
    factor = F.when(bare.endswith("万亿"), 1e12).when(bare.endswith("亿"), 1e8).when(bare.endswith("万"), 1e4).when(bare.endswith("%"), 1.0).otherwise(1.0)
    return value * factor


def iso_date(text: Column) -> Column:
    """Dates in common spellings as YYYY-MM-DD; null where none fits."""
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM", "yyyy年MM月dd日", "yyyy年MM月"]
    clean = F.substring(F.trim(text), 1, 11)
    return F.date_format(F.coalesce(F.try_to_timestamp(F.trim(text)), *(F.try_to_timestamp(clean, F.lit(f)) for f in forms)), "yyyy-MM-dd")


def citations(text: Column) -> Column:
    """Author-year citations such as Smith and Jones (2004)."""
    return F.regexp_extract_all(text, F.lit(r"([A-Z][\w'-]+(?: (?:and|&) [A-Z][\w'-]+| et al\.)? \(\d{4}\))"), F.lit(1))


def author_key(citation: Column) -> Column:
    """Sorted lower-case names and the year, joined by blanks."""
    words = F.filter(F.split(F.lower(citation), r"[^a-z0-9]+"), lambda w: ~w.isin("", "and", "et", "al"))
    return F.array_join(F.array_sort(words), " ")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "_"), F.lit("_"))


def links(html: Column) -> Column:
    """Targets of the page's links."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"'#]+)"""), F.lit(1))
