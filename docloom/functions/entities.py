"""Entities, dates, numbers, citations and grounding in texts."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.functions.line_diff import line_hunks
from docloom.functions.text import pieces

# ---- fixed values: surnames, organisation endings, capital numerals
SURNAMES = "李王张刘陈杨赵黄周吴徐孙朱马胡郭林何高梁郑罗宋谢唐韩曹许邓萧冯曾程蔡彭潘袁于董余苏叶吕魏蒋田杜丁沈姜范江"
ENDINGS = "有限公司|股份有限公司|有限责任公司|研究所|事务所|律师事务所|科技公司|分公司|大学|学院|医院|银行"
TITLES = "总司厂"
#: Of rich entities: surnames, characters that end no name, words that no name contains, endings of places and organisations, units.
NAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万覃武钱戴严莫孔向汤"
NO_LAST = "同在是到与和已不了为的上说又却把将从向让签订约后前中里内外于由被对比给使叫令请来去入出回至及或而但即便才就该此这那其某会能可应需要想觉感认"
NO_NAME = "公司|银行|法院|律所|事务所|学院|大学|中学|小学|省|市|区|县|街|路|号|条|款|项|章|节|元|万|亿|角|分"
PLACES = "省|自治区|特别行政区|市|区|县|街道|乡|镇|村|路|街|号|大厦|小区|大道|巷"
BODIES = "有限公司|股份公司|公司|集团|律师事务所|事务所|法院|检察院|银行|学校|大学|学院|医院|协会|商会|工作室"
AMOUNT_UNITS = {"亿": 1e8, "万": 1e4, "千": 1e3, "百": 1e2, "元": 1.0, "角": 0.1, "分": 0.01}
DIGITS = {"零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
ONES = "零一二三四五六七八九"
UNITS = {"拾": 10, "佰": 100, "仟": 1000}
MONEY = r"¥\s*\d[\d,]*(?:\.\d+)?|(?:人民币|RMB|CNY)\s*\d[\d,]*(?:\.\d+)?\s*(?:元|圆|万|亿)?|\d[\d,]*(?:\.\d+)?\s*(?:万元|亿元|元|圆|万|亿)|[壹贰叁肆伍陆柒捌玖拾佰仟万亿零整圆元角分]{2,}"
DATES = (r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\d{4}\s*年\s*\d{1,2}\s*月")
ENTITY = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("byte_start", T.IntegerType()), T.StructField("byte_end", T.IntegerType())]))


def find_entities(text: str) -> list[dict]:
    """Money, dates, organisations and persons by byte position. A date inside a longer one doesn't count; a person is a surname with up
    to three more Han characters, the last of them no title or company character."""
    found = [("money", m.span()) for m in re.finditer(MONEY, text)]
    spans: list[tuple[int, int]] = []
    for pattern in DATES:
        spans += [m.span() for m in re.finditer(pattern, text) if not any(a <= m.start() and m.end() <= b for a, b in spans)]
    found += [("date", s) for s in spans]
    found += [("organization", m.span()) for m in re.finditer(rf"[一-鿿（）()]{{2,15}}(?:{ENDINGS})", text)]
    found += [("person", s) for s in persons(text)]
    at = lambda i: len(text[:i].encode())
    return sorted(({"kind": k, "value": text[a:b], "byte_start": at(a), "byte_end": at(b)} for k, (a, b) in found), key=lambda e: e["byte_start"])


def persons(text: str) -> Iterator[tuple[int, int]]:
    name, at = re.compile(rf"[{SURNAMES}][一-鿿㐀-䶿]{{1,3}}"), 0
    while m := name.search(text, at):
        if m[0][-1] in TITLES:
            at = m.start() + 1
        else:
            yield m.span()
            at = m.end()


@pandas_udf(ENTITY)
def entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: find_entities(t) if t else [])


def numeral(text: str) -> float | None:
    """Value of an amount in capital numerals, e.g. 壹拾万元整; None if it isn't one."""
    body = text.replace("整", "")
    if not body or set(body) - set(DIGITS) - set(UNITS) - set("万亿圆元角分"):
        return None
    total = section = digit = 0
    cents = 0.0
    for c in body:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in UNITS:
            section += (digit or 1) * UNITS[c]
            digit = 0
        elif c in "圆元":
            total += section + digit
            section = digit = 0
        elif c in "万亿":
            total = total + (section + digit) * 10**4 if c == "万" else (total + section + digit) * 10**8
            section = digit = 0
        else:
            cents += digit * (0.1 if c == "角" else 0.01)
            digit = 0
    return round(total + section + digit + cents, 2)


def spoken(text: str) -> int | None:
    """A month or day in Chinese numerals up to 99, None if it isn't one."""
    tens, ten, ones = text.rpartition("十")
    value = lambda c, empty: empty if c == "" else ONES.find(c) if len(c) == 1 and c in ONES else None
    a, b = value(tens, 1 if ten else 0), value(ones, 0)
    return None if a is None or b is None or not text else 10 * a + b


def rich_dates(text: str) -> Iterator[str]:
    """Valid dates of the years 1900 to 2100 in ISO form: numeric ones in order, then those in Chinese numerals."""
    found = [tuple(map(int, m)) for m in re.findall(r"(\d{4})\s*[年/\-]\s*(\d{1,2})\s*[月/\-]\s*(\d{1,2})\s*日?", text)]
    for y, m, d in re.findall(rf"([〇{ONES}十]{{4}})年\s*([一二三四五六七八九十]{{1,3}})月\s*([一二三四五六七八九十]{{1,3}})日", text):
        if "十" not in y:
            found.append((int("".join(str(ONES.find(c)) for c in y.replace("〇", "零"))), spoken(m) or 0, spoken(d) or 0))
    for y, m, d in found:
        try:
            if 1900 <= y <= 2100:
                yield datetime.date(y, m, d).isoformat()
        except ValueError:
            continue


def rich_amounts(text: str) -> dict[str, float]:
    """Amounts by what is written: numbers with a unit, then capital numerals with one."""
    out = {}
    for m in re.finditer(r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*([亿万千百元角分])", text):
        value = float(m[1].replace(",", "")) * AMOUNT_UNITS[m[2]]
        if 0.001 <= value <= 1e15:
            out.setdefault(m[0], value)
    for m in re.finditer("[壹贰叁肆伍陆柒捌玖拾佰仟万亿元角分整]{2,}", text):
        value = numeral(m[0]) if re.search("[拾佰仟万亿元角分]", m[0]) else None
        if value is not None:
            out.setdefault(m[0], value)
    return out


def rich(text: str) -> dict:
    """Persons, dates, amounts, places and organisations, each once in order of appearance (dates as often as they stand). A person is a
    surname and one Han character, or two if the second ends names and is no surname; candidates with words of places or bodies are none."""
    people, at = {}, 0
    name = re.compile(rf"[{NAMES}][一-鿿](?![{NO_LAST}{NAMES}])[一-鿿]|[{NAMES}][一-鿿]")
    while m := name.search(text, at):
        bad = re.search(NO_NAME, m[0])
        at = m.start() + 1 if bad else m.end()
        if not bad:
            people[m[0]] = None
    once = lambda pattern: list(dict.fromkeys(re.findall(pattern, text)))
    return {
        "persons": list(people), "dates": list(rich_dates(text)), "amounts": [{"value": v, "raw": r} for r, v in rich_amounts(text).items()],
        "locations": once(rf"[一-鿿]{{2,8}}(?:{PLACES})"), "organizations": once(rf"[一-鿿]{{2,12}}(?:{BODIES})"),
    }


_WORDS = T.ArrayType(T.StringType())
_AMOUNTS = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("raw", T.StringType())]))
RICH = T.StructType([T.StructField(name, _AMOUNTS if name == "amounts" else _WORDS) for name in ("persons", "dates", "amounts", "locations", "organizations")])


@pandas_udf(RICH)
def rich_entities(texts: pd.Series) -> pd.DataFrame:
    """``rich`` of every text; a null text has empty lists."""
    return pd.DataFrame([rich(t or "") for t in texts], columns=RICH.names)


@pandas_udf(T.DoubleType())
def numeral_value(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: numeral(t) if t else None).astype("float64")


def dates(text: Column) -> Column:
    """All valid calendar dates in a text, numeric or Chinese, as yyyy-MM-dd strings."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{4}\s*(?:年|[-/.])\s*\d{1,2}\s*(?:月|[-/.])\s*\d{1,2})"), F.lit(1))
    parts = F.transform(found, lambda d: F.split(F.regexp_replace(d, r"\s|日", ""), r"年|月|[-/.]"))
    made = F.transform(parts, lambda p: F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0")))
    return F.filter(made, lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull())


def amount(text: Column) -> Column:
    """A recognized amount as a number, null if it isn't one."""
    return F.regexp_replace(text, r"[¥$,\s元圆]|RMB|CNY|USD", "").try_cast("double")


def citation_style(text: Column) -> Column:
    """Style with most cues, null below one or on a tie."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    cues = {"ieee": count(r"\[\d+\]"), "apa": count(r"\([A-Z][A-Za-z]+(?: & [A-Z][A-Za-z]+)?, \d{4}\)"), "mla": count(r"\([A-Z][a-z]+ \d+\)"), "gbt7714": count(r"\[[JMDCN](?:/OL)?\]")}
    ranked = F.array_sort(F.array(*[F.struct((-c).alias("n"), F.lit(k).alias("k")) for k, c in cues.items()]))
    return F.when((ranked[0]["n"] < 0) & (ranked[0]["n"] != ranked[1]["n"]), ranked[0]["k"])


def cited(text: Column, known: Column) -> Column:
    """Ids of [cite:id] anchors that are known."""
    return F.array_intersect(F.regexp_extract_all(text, F.lit(r"\[cite:([^\]]+)\]"), F.lit(1)), known)


def grounding(claim: Column, source: Column) -> Column:
    """grounded at three shared words, weak at one or two, else fabricated; arrays of words."""
    n = F.size(F.array_intersect(claim, source))
    return F.when(n >= 3, "grounded").when(n >= 1, "weak").otherwise("fabricated")


def injected(text: Column) -> Column:
    return F.lower(text).rlike("ignore (all |any )?(previous|above) instructions|disregard the (above|system)|you are now|system prompt|忽略(以上|之前)")


def token_f1(a: Column, b: Column) -> Column:
    """Set F1 of two word arrays; two empty ones agree."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


@pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def line_diff(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch in texts:
        for a, b in pieces(*batch):
            yield pd.Series([line_hunks(x or "", y or "") for x, y in zip(a, b)])


@pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A deterministic stand-in embedder of 64 dimensions: each lower-case word adds 1 at its FNV-1a hash, unit length; empty: first axis."""

    def fnv(word: str) -> int:
        h = 0xCBF29CE484222325
        for c in word.encode():
            h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h

    def one(text: str | None) -> list[float]:
        v = [0.0] * 64
        for w in re.findall(r"[一-鿿]|[^\W_一-鿿]+", (text or "").lower()):
            v[fnv(w) % 64] += 1
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else [1.0, *[0.0] * 63]

    for batch in texts:
        for (piece,) in pieces(batch):
            yield piece.map(one)
