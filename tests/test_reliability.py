"""Replies, entities and detectors against worked examples."""

import pytest

from docloom.functions import entities as en
from docloom.functions import privacy
from docloom.functions.reliability import check_reply

REPORT = "报告时间：2025-06-01。评估对象：某科技有限公司。本期审议通过。"
CASES = [
    ("Rust 的所有权有三条规则：每个值有唯一所有者；当所有者离开作用域时值被丢弃 [item:ch4]。", [("ch4", "所有权规则：每个值在 Rust 中都有一个所有者；当所有者离开作用域时，这个值将被丢弃。")], ["grounded"], 0, [], 1.0),
    ("Rust 的 async fn 返回 Future 类型 [item:ch17-NONEXISTENT]。", [("ch17", "Rust 异步函数用 async fn 标记。")], ["fabricated"], 0, [], 0.8),
    ("Page cache 见参考资料 [item:mem].", [("mem", "Linux 内核会把最近访问的磁盘块缓存在物理内存中，称为 page cache，命中后避免重新发起 IO。")], ["weak_overlap"], 0, [], 0.8),
    ("Rust 在 2099-12-31 发布了 1.0 版本。", [("h", "Rust 是一门系统编程语言，强调内存安全。")], [], 0, ["date"], 0.925),
    ("报告时间：2024-03-15。本期评估结论合理。", [("r", REPORT)], [], 1, ["date"], 0.675),
    ("根据合同，借款金额为 ¥30000，归还期限为半年。", [("c", "根据合同，借款金额为 ¥10000，归还期限为半年。利率按 LPR 浮动。")], [], 1, ["number"], 0.675),
    ("这份白皮书的发布单位是 某虚构科技有限公司，发布时间未明确。", [("w", "白皮书系业内联合编写，主要内容涵盖分布式存储。")], [], 0, ["organization"], 0.925),
    ("本次评估时间 2099-05-15，金额 ¥99999，由 某不存在科技有限公司 出具。", [("r", "评估时间 2024-03-15。本次评估涉及多家供应商，最终结论为整体合规。")], [], 1, ["date", "number", "organization"], 0.525),
    ("好的，没有具体信息。", [], [], 0, [], 1.0), ("", [("a", "text")], [], 0, [], 0.5), (None, [], [], 0, [], 0.5),
]


@pytest.mark.parametrize("case", CASES)
def test_replies(case):
    reply, chunks, statuses, contradictions, kinds, confidence = case
    report = check_reply(reply, chunks)
    assert [c["status"] for c in report["citations"]] == statuses and len(report["contradictions"]) == contradictions
    assert [h["kind"] for h in report["hallucinations"]] == kinds and report["confidence"] == pytest.approx(confidence)


def test_entities():
    found = lambda t: [(e["kind"], e["value"]) for e in en.find_entities(t)]
    assert ("person", "丁晓明在") in found("丁晓明在北京协和医院和中国银行工作") and ("organization", "丁晓明在北京协和医院和中国银行") in found("丁晓明在北京协和医院和中国银行工作")
    assert found("王总") == [] and ("organization", "某某软件学院") in found("某某软件学院") and found("plain English only") == []
    case = "原告张三 (北京市海淀区) 与被告李四因借款 500000 元纠纷, 于 2023年1月15日起诉. 本金 500000 元和约定利息 60000 元, 合计 560000 元."
    kinds = [k for k, _ in found(case)]
    assert kinds.count("person") >= 2 and kinds.count("date") >= 1 and kinds.count("money") >= 3


def test_detectors():
    kinds = lambda t: [(s["kind"], s["value"]) for s in privacy.find_spans(t)]
    keys = ["glpat-" + "a1" * 10, "xoxb-" + "1234567890ab", "hf_" + "Ab1" * 12, "AIza" + "x" * 35, "github_pat_" + "b" * 22, "ghp_" + "c" * 36, "sk-" + "d" * 32, "AKIA" + "E" * 16]
    for key in keys:
        assert kinds(f"key {key} here") == [("API_KEY", key)]
    assert kinds("at fe80::1 or ::") == [("IPV6", "fe80::1")] and kinds("time 12:30:45") == []
    assert kinds("bank 6222021234567890123 x") == [("BANK_CARD", "6222021234567890123")] and kinds("at 31.23, 121.47")[0][0] == "GPS"


def test_detectors_by_case():
    kinds = lambda t: [(s["kind"], s["value"]) for s in privacy.find_spans(t)]
    right = [
        ("身份证 11010119900307125X 已实名", "ID_CARD", "11010119900307125X"), ("呼叫 13812345678", "PHONE", "13812345678"), ("call +8613812345678 now", "PHONE", "+8613812345678"),
        ("contact a.b+filter@sub.example.com please", "EMAIL", "a.b+filter@sub.example.com"), ("邮箱：user@example.com，请回复", "EMAIL", "user@example.com"),
        ("server 192.168.1.1 on", "IPV4", "192.168.1.1"), ("addr 2001:db8::1 here", "IPV6", "2001:db8::1"), ("card 4111 1111 1111 1111 done", "CREDIT_CARD", "4111 1111 1111 1111"),
        ("银行卡 6225881234567890 充值", "BANK_CARD", "6225881234567890"), ("see https://example.com/path?q=1 for info", "URL", "https://example.com/path?q=1"),
        ("见https://example.com/a中文", "URL", "https://example.com/a"), ("mac aa:bb:cc:dd:ee:ff is", "MAC", "aa:bb:cc:dd:ee:ff"), ("MAC AA-BB-CC-DD-EE-FF found", "MAC", "AA-BB-CC-DD-EE-FF"),
        ("车牌 京A12345 进入", "PLATE", "京A12345"), ("新能源 沪AD12345 上牌", "PLATE", "沪AD12345"), ("location 39.9042, 116.4074 here", "GPS", "39.9042, 116.4074"),
    ]
    for text, kind, value in right:
        assert kinds(text) == [(kind, value)], text
    wrong = ["01138123456789", "not 999.999.999.999", "not gggg::1 zzz", "not 4111 1111 1111 1112", "not 200.5, 300.7 invalid", "1.2.3.4.5", "sk-abcdefghijklmnop1234", "a@b", "@example.com"]
    assert [t for t in wrong if kinds(t)] == []
    assert "ID_CARD" not in dict(kinds("身份证 110101199003071250 假")) and "ID_CARD" not in dict(kinds("123411010119900307125X567"))
    assert "ID_CARD" not in dict(kinds("110101199013071254")) and kinds("a@b.co1@c.org") == [("EMAIL", "a@b.co"), ("EMAIL", "1@c.org")]


def test_detectors_match_plain_search():
    """Gates, the walk from each @ and the order of kinds against a plain search with every pattern."""
    import random
    import re

    rng = random.Random(9)
    parts = ["a@b.org", "x.y@", "@", "4111 1111 1111 1111", "13812345678", "86", "+", "https://e.com/x", "中", "京A12345", "1.2.3.4", "::1", "fe80", ":", "-", "39.90, 116.40", "11010119900307125X", "ghp_" + "c" * 36, " ", "0", ".", "aa:bb:cc:dd:ee:ff", "6225881234567890"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        plain = []
        for i, (kind, pattern, beside) in enumerate(privacy.DETECTORS):
            for m in re.finditer(pattern, text):
                around = text[max(m.start() - 1, 0) : m.start()] + text[m.end() : m.end() + 1]
                if not (beside and any(c in beside for c in around)) and privacy.VALID.get(kind, lambda v: True)(m.group()):
                    plain.append((m.start(), -m.end(), i, kind))
        assert sorted(privacy.matches(text)) == sorted(plain), text
    import time

    start = time.time()
    assert privacy.find_spans("a" * 200_000 + "@ " + "b" * 200_000) == [] and time.time() - start < 2


def test_redacted_query_matches_plain_redaction(spark):
    """The registered query over whole texts against spans found and replaced one pattern at a time."""
    import re

    from docloom.plans import catalog
    from docloom.sources.tables import items

    sf = "/root/testdata/sf0.001"
    want = {}
    for row in items(spark, sf).collect():
        found = []
        for i, (kind, pattern, beside) in enumerate(privacy.DETECTORS):
            for m in re.finditer(pattern, row.content or ""):
                around = row.content[max(m.start() - 1, 0) : m.start()] + row.content[m.end() : m.end() + 1]
                if not any(c in beside for c in around) and privacy.VALID.get(kind, lambda v: True)(m.group()):
                    found.append((m.start(), -m.end(), i, kind))
        out, at, numbers, kinds = "", 0, {}, []
        for start, end, _, kind in sorted(found):
            if start >= at:
                name = {"ID_CARD": "ID", "IPV4": "IP", "IPV6": "IP", "CREDIT_CARD": "CARD", "BANK_CARD": "CARD", "API_KEY": "APIKEY"}.get(kind, kind)
                known = numbers.setdefault(name, {})
                out += row.content[at:start] + f"[{name}_{known.setdefault(row.content[start:-end], len(known) + 1)}]"
                at = -end
                kinds.append(kind)
        if kinds:
            want[row.item_id] = (out + row.content[at:], kinds)
    got = {r.item_id: (r.redacted, list(r.kinds)) for r in catalog.QUERIES["pii_redacted"](spark, sf).collect()}
    assert got == want and len(got) > 5


def test_dictionary_and_statistics(spark):
    detect = privacy.detect_with([{"name": "project", "literals": ["Blue Sky", "Blue Sky Two"]}, {"name": "case", "regex": r"C-[0-9]{3}"}])
    frame = spark.createDataFrame([("Blue Sky Two and C-123, C-124 by a@b.org",), (None,), ("",)], "t string").withColumn("s", detect("t"))
    rows = frame.select(privacy.span_counts("s").alias("n"), privacy.redact("t", "s").alias("r")).collect()
    assert rows[0].n == {"PROJECT": 1, "CASE": 2, "EMAIL": 1} and rows[0].r == "[PROJECT_1] and [CASE_1], [CASE_2] by [EMAIL_1]" and rows[1].n == {}
    with pytest.raises(Exception, match="unterminated|missing"):
        privacy.detect_with([{"name": "bad", "regex": "("}])
