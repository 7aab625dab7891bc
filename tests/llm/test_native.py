"""Line dedup, pseudonyms, decontamination and sharding."""

import bisect
import datetime
import hashlib
import itertools
import random
import re
import string
from collections import Counter

import pytest

from docloom.llm import decontam, linededup, pseudonyms, sharding


# ---- line dedup
def slow_lines(rows, min_sites, min_chars=12):
    trim = lambda x: x.strip(" \t\r\f\v")
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if s is not None and len(trim(x)) >= min_chars:
                sites.setdefault(trim(x), set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        hit = [trim(x) in bad for x in lines]
        out.append((i, "\n".join(x for x, h in zip(lines, hit) if not h), len(lines), sum(hit)))
    return Counter(out)


@pytest.mark.parametrize("min_sites", [3, 8, 40])
def test_line_dedup(spark, min_sites):
    rng = random.Random(1)
    shared = [f"shared boilerplate line number {k}" for k in range(6)]
    rows = []
    for i in range(400):
        lines = [f"own text of document {i} with part {k} and more words" for k in range(4)] + [x for k, x in enumerate(shared) if rng.random() < 0.1 + 0.15 * k]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"site{rng.randrange(60)}"))
    rows += [(500, None, "site1"), (501, "", "site2"), (502, shared[5], "site3"), (503, f"  {shared[5]} \n" + "x" * 200, None), (504, rows[0][1], "site4"), (504, rows[0][1], "site4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs, min_sites).collect())
    assert got == slow_lines(rows, min_sites)


def test_line_dedup_keeps_only_copied_pages(spark):
    menu = [f"menu line {k} of every site" for k in range(3)]
    page = [f"line {k} of a page that was copied" for k in range(4)]
    rows = [(i, "\n".join([f"a long text of its own, number {i}, " * 9, *menu]), f"site{i}") for i in range(10)] + [(20 + i, "\n".join(page), f"site{i}") for i in range(10)]
    rows += [(40, "\n".join([*menu, "my few words"]), "site1"), (41, "\n".join(menu), "site2"), (42, "\n".join([menu[0], "hm"]), None)]
    docs = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs, keep_copies=True).collect()}
    assert {got[i] for i in range(20, 30)} == {("\n".join(page), 0)} and all(got[i][1] == 3 for i in range(10))
    assert (got[40], got[41], got[42]) == (("my few words", 3), ("", 3), ("hm", 1))
    assert linededup.dedup_lines(docs, keep_copies=True).count() == len(rows) + 3
    plain = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert {plain[i] for i in range(20, 30)} == {("", 4)} and {k: v for k, v in plain.items() if not 20 <= k < 30} == {k: v for k, v in got.items() if not 20 <= k < 30}


def test_line_on_most_rows(spark):
    rows = [(i, f"a line on most of the pages\nown words of page {i}" if i % 3 else f"other words of page {i}", f"site{i % 50}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs).collect())
    assert got == slow_lines(rows, 8)


def test_line_dedup_edges(docs, empty):
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()
    assert linededup.dedup_lines(empty).count() == 0


# ---- pseudonyms
TEXTS = [
    "mail bob.smith99@mail2.example.com or BOB@x.org now", "ip 10.0.0.1 and 153.207.106.222, again 10.0.0.1.", "born 1984-02-29 or 02/29/1984 or 29.02.1984 or 31/12/1999, 2023-02-30",
    "ssn 123-45-6789 bad 000-12-3456", "call +1 (887) 555-2355 or (212) 555-0100 or 212-555-0100", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432",
    "card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112", "v1.2.3.4.5 and 999.1.1.1 and 12345", "", None,
]


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def test_pseudonyms_keep_formats(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymize(docs, "k").collect()}
    assert [out[i].n_replaced for i in range(10)] == [2, 3, 4, 1, 3, 2, 2, 0, 0, 0]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
    for i in (0, 2, 3, 4, 5, 6):
        assert shape(out[i].text) == shape(TEXTS[i]) and out[i].text != TEXTS[i]
    ips = re.findall(r"[0-9]+(?:\.[0-9]+){3}", out[1].text)
    assert ips[0] == ips[2] != ips[1] and all(0 <= int(o) <= 255 for ip in ips for o in ip.split("."))
    a, b = re.findall(r"4[0-9]{3}(?: [0-9]{4}){3}|4[0-9]{15}", out[6].text)[:2]
    assert a.replace(" ", "") == b and luhn(b) and "4111111111111112" in out[6].text
    d = re.findall(r"\d{4}-\d{2}-\d{2}", out[2].text)
    __import__("datetime").date.fromisoformat(d[0])
    assert d[1] == "2023-02-30" and out[7].text == TEXTS[7] and out[9].text is None
    iban = re.search(r"DE[0-9 ]{20,}", out[5].text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def slow_feistel(high, low, n_high, n_low, key, tweak):
    for i in range(8):
        digest = hashlib.sha256("|".join(map(str, (key, tweak, i, n_high, n_low, high if i % 2 else low))).encode()).hexdigest()
        f = int(digest[:15], 16)
        high, low = (high, (low + f) % n_low) if i % 2 else ((high + f) % n_high, low)
    return high, low


def slow_digits(d, key, tweak):
    u, n = len(d) // 2, len(d)
    high, low = slow_feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (n - u), key, tweak)
    return f"{high:0{u}d}{low:0{n - u}d}"


def slow_refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def slow_date(value, form, key, tweak):
    try:
        n = (datetime.datetime.strptime(value, form).date() - datetime.date(1800, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= n < 2**17:
        return None
    high, low = slow_feistel(n // 256, n % 256, 512, 256, key, tweak)
    day = datetime.date(1800, 1, 1) + datetime.timedelta(high * 256 + low)
    return form.replace("%Y", f"{day.year:04d}").replace("%m", f"{day.month:02d}").replace("%d", f"{day.day:02d}")


LATE = [d for d in (datetime.date(1800, 1, 1) + datetime.timedelta(n) for n in range(130_757)) if d.day > 12]


def slow_slash(value, key):
    month_first = slow_date(value, "%m/%d/%Y", key, "date/m")
    if month_first:
        return month_first
    try:
        day = datetime.datetime.strptime(value, "%d/%m/%Y").date()
    except ValueError:
        return None
    at = bisect.bisect_left(LATE, day)
    if at == len(LATE) or LATE[at] != day:
        return None
    high, low = slow_feistel(at // 365, at % 365, 217, 365, key, "date/d")
    return LATE[high * 365 + low].strftime("%d/%m/%Y")


def slow_ssn(value, key):
    area, group, serial = map(int, value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    high, low = slow_feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    return f"{areas[high // 99]:03d}-{high % 99 + 1:02d}-{low + 1:04d}"


def slow_email(value, key):
    local, domain = value.split("@")
    half = -(-len(local) // 2)
    parts = [local[:half], local[half:]]
    for i in range(8):
        mine, other = i % 2, 1 - i % 2
        digest = hashlib.sha256(f"{key}|email|{i}|{parts[other]}".encode()).hexdigest()
        out = ""
        for j, c in enumerate(parts[mine]):
            by = int(digest[j % 15 * 4 : j % 15 * 4 + 4], 16)
            for letters in (string.ascii_lowercase, string.ascii_uppercase, string.digits):
                if c in letters:
                    c = letters[(letters.index(c) + by) % len(letters)]
                    break
            out += c
        parts[mine] = out
    return f"{parts[0]}{parts[1]}@{domain}"


def slow_iban(value, key):
    v = value.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    own = "".join(c for c in v[4:] if c.isdigit())
    if not 15 <= len(v) <= 34 or not 2 <= int(v[2:4]) <= 98 or number(v[4:] + v[:4]) % 97 != 1 or len(own) < 2:
        return None
    moved = slow_digits(own, key, "iban")
    return slow_refill(value, f"{98 - number(slow_refill(v[4:], moved) + v[:2] + '00') % 97:02d}{moved}")


def slow_ip(value, key):
    a, b, c, d = map(int, value.split("."))
    high, low = slow_feistel(a * 256 + b, c * 256 + d, 65536, 65536, key, "ip")
    return f"{high >> 8}.{high & 255}.{low >> 8}.{low & 255}"


def slow_phone(value, key):
    d = re.sub("[^0-9]", "", value)
    return slow_refill(value, d[:-10] + slow_digits(d[-10:], key, "phone")) if 7 <= len(d) <= 15 else None


def slow_card(value, key):
    d = re.sub("[^0-9]", "", value)
    if not 13 <= len(d) <= 19 or not luhn(d):
        return None
    moved = d[0] + slow_digits(d[1:-1], key, "card")
    return slow_refill(value, moved + next(c for c in "0123456789" if luhn(moved + c)))


SLOW = {
    "email": slow_email, "ip": slow_ip, "date_iso": lambda v, k: slow_date(v, "%Y-%m-%d", k, "date-"), "date_slash": slow_slash, "date_dot": lambda v, k: slow_date(v, "%d.%m.%Y", k, "date."),
    "ssn": slow_ssn, "phone": slow_phone, "iban": slow_iban, "card": slow_card,
}


def slow_pseudonyms(text, key):
    kinds = []

    def swap(m):
        for kind, pattern in pseudonyms.PATTERNS.items():
            if re.fullmatch(pattern, m[0]):
                to = SLOW[kind](m[0], key)
                kinds.extend([kind] if to else [])
                return to or m[0]

    return re.sub(pseudonyms.ANY, swap, text), kinds


def test_pseudonyms_match_plain_python(spark):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    letters = lambda n: "".join(rng.choice(string.ascii_letters + "._-") for _ in range(n)) + "x"

    def iban():
        country, body = rng.choice(["DE", "FR", "GB", "MT"]), rng.choice([digits(18), "WEST" + digits(14), digits(10) + "AB" + digits(11), digits(26)])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check:02d}{body}"
        return whole if rng.random() < 0.5 else re.sub("(.{4})(?=.)", r"\1 ", whole)

    def card():
        head = rng.choice("3456") + digits(rng.choice([11, 14, 14, 15]))
        whole = head + next(c for c in "0123456789" if luhn(head + c))
        return re.sub("(.{4})(?=.)", r"\1" + rng.choice(" -"), whole) if len(whole) == 16 and rng.random() < 0.5 else whole

    pad = lambda n, k: f"{rng.randint(0, n):0{k}d}"
    makers = [
        lambda: f"{letters(rng.randint(0, 12))}@{rng.choice(['example.com', 'mail.a-b.org'])}", lambda: ".".join(str(rng.randint(0, 260)) for _ in range(4)),
        lambda: f"{pad(2200, 4)}-{pad(13, 2)}-{pad(32, 2)}", lambda: f"{pad(31, 2)}/{pad(31, 2)}/{rng.randint(1790, 2165)}", lambda: f"{pad(32, 2)}.{pad(13, 2)}.{rng.randint(1790, 2165)}",
        lambda: f"{pad(999, 3)}-{pad(99, 2)}-{pad(9999, 4)}", lambda: f"+{pad(99, 1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", iban, card, lambda: digits(rng.randint(1, 22)),
    ]
    texts = [" ".join(rng.choice(makers)() if rng.random() < 0.5 else rng.choice(["plain", "words,", "here."]) for _ in range(rng.randint(1, 9))) for _ in range(1000)]
    texts += ["write to jane.doe@example.com today", "no value at all", "FR1420041010050500013M02606", *[d.strftime("%d/%m/%Y") for d in LATE[:40] + LATE[-40:]]]
    out = {r.doc_id: r for r in pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "a key").collect()}
    for i, text in enumerate(texts):
        assert (out[i].text, out[i].kinds) == slow_pseudonyms(text, "a key"), text
    assert out[1000].n_replaced == 1 and "jane.doe@" not in out[1000].text and out[1001].n_replaced == 0 and "2004101005" not in out[1002].text
    assert sum(r.n_replaced for r in out.values()) > 1000 and {k for r in out.values() for k in r.kinds} == set(SLOW)


def test_slash_dates_stay_apart(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(n) for n in range(0, 12_000)]
    texts = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    out = [r.text for r in pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()]
    assert len(set(out)) == len(texts)


def test_key_is_not_in_any_plan(spark):
    plans = pseudonyms.pseudonymize(spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string"), "a very secret key")._jdf.queryExecution().toString()
    assert "very secret" not in plans


def test_permutations_are_one_to_one(spark):
    n = 3000
    rows = [(i, f"{i % 256}.{i // 256}.7.9 and 2{i:03d}-01-01".replace("2" + f"{i:03d}", f"{1900 + i % 200}")) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pseudonyms.pseudonymize(docs, "k").collect()
    assert len({r.text.split()[0] for r in out}) == n and len({r.text.split()[2] for r in out}) == 200
    other = pseudonyms.pseudonymize(docs, "another key").collect()
    assert sum(a.text == b.text for a, b in zip(out, other)) < 5
    cards = spark.createDataFrame([(i, "4%014d" % (i * 7919)) for i in range(500)], "doc_id long, p string").collect()
    full = [next(r.p + str(c) for c in range(10) if luhn(r.p + str(c))) for r in cards]
    moved = [r.text for r in pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(full)), "doc_id long, text string"), "k").collect()]
    assert len(set(moved)) == 500 and all(map(luhn, moved)) and set(moved).isdisjoint(full)


def test_pseudonyms_edges(docs, empty):
    out = pseudonyms.pseudonymize(docs, "k")
    assert out.count() == docs.count() and out.columns == [*docs.columns, "n_replaced", "kinds"]
    assert pseudonyms.pseudonymize(empty, "k").count() == 0


# ---- decontamination
def slow_leaks(rows, items, ratio=0.8):
    token = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in rows:
        words = token(t)
        for k, item in items:
            want = token(item)
            if len(want) < 8 or k is None:
                continue
            best = max((sum(0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(want)) for s in range(-len(want), len(words))), default=0)
            if best >= ratio * len(want):
                out.add((i, k, best))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(9, 40)))) for k in range(25)] + [(90, "too short"), (None, "a b c d e f g h i j"), (91, None)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            leak = items[rng.randrange(25)][1].split()
            for _ in range(len(leak) // 12):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = leak
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
        rows.append((i, text.replace(" ", ", ", 3)))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched) for r in decontam.leaks(docs, bench).collect()}
    assert got == slow_leaks(rows, items)
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _, _ in got}


def test_leaks_find_every_substitution(spark):
    items = [(n, [f"i{n}w{j}" for j in range(n)]) for n in range(8, 21)]
    rows = []
    for n, words in items:
        for gone in itertools.combinations(range(n), n // 5):
            rows.append((len(rows), n, " ".join(["before", *("other" if j in gone else w for j, w in enumerate(words)), "after"])))
        rows.append((len(rows), n, " ".join(words[n // 5 :])))
        rows.append((len(rows), n, " ".join(words[: n - n // 5])))
    rows += [(len(rows), None, " ".join("other" if j <= n // 5 else w for j, w in enumerate(words))) for n, words in items]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(words)) for n, words in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontam.leaks(docs, bench).collect()}
    assert got == {(i, n): n - n // 5 for i, n, _ in rows if n}


@pytest.mark.parametrize("ratio", [0.4, 0.6, 1.0])
def test_leaks_at_other_similarities(spark, ratio):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(8 + k))) for k in range(12)]
    rows = [(i, " ".join(w if rng.random() > i % 4 / 5 else "zz" for w in items[i % 12][1].split()) + " tail") for i in range(60)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_matched) for r in decontam.leaks(docs, bench, ratio).collect()} == slow_leaks(rows, items, ratio)


def test_hot_seed_is_dealt(spark):
    """A seed of one frequent word stands at half of all positions; its probes are no single task's, and the leaks are those of brute force."""
    from tests.llm.test_simhash import largest_task

    rng = random.Random(4)
    filler = ["the"] * 9 + [f"v{k}" for k in range(9)]
    items = [(k, "the the the the the the the the " + " ".join(f"i{k}w{j}" for j in range(6))) for k in range(4)]
    rows = [(i, " ".join(rng.choice(filler) for _ in range(60))) for i in range(150)] + [(500 + k, f"x {t} y") for k, t in items]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_matched) for r in decontam.leaks(docs, bench).collect()} == slow_leaks(rows, items)
    met = []
    plain = decontam.meet
    try:
        decontam.meet = lambda *a, **k: met.append(plain(*a, **k)) or met[-1]
        assert largest_task(spark, lambda: (decontam.leaks(docs, bench), met[-1])[1]) < 0.3
    finally:
        decontam.meet = plain


def test_leaks_edges(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(docs, none).count() == 0 and decontam.decontaminate(docs, none).count() == docs.count()
    item = spark.createDataFrame([(1, "ka lo mi ne ka lo mi ne ka lo")], "item_id long, text string")
    assert decontam.leaks(empty, item).count() == 0 and decontam.decontaminate(docs, item).columns == docs.columns


# ---- sharding
def test_sharding(spark):
    rng = random.Random(8)
    hot = "hot copy " * 20
    rows = [(i, hot if i % 3 == 0 else "x" * rng.randint(0, 300) + str(i)) for i in range(3000)] + [(4000, None), (4001, ""), (None, "no id"), (4002, "twice"), (4002, "twice")]
    docs = spark.createDataFrame([(*r, "mine", "up", "down") for r in rows], "doc_id long, text string, shard string, high string, low string")
    out = sharding.shard(docs).collect()
    assert len(out) == len(rows) and {(r.law, r.high, r.low) for r in out} == {("bytes", "up", "down")}
    sizes, slots = Counter(), {}
    for r in out:
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == __import__("zlib").crc32((r.text or "").encode())
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 24
    assert set(sizes) == set(range(24)) and all(abs(v - mean) <= 0.02 * mean + 400 for v in sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("alike", [4800, 2400])
def test_sharding_of_rows_alike(spark, alike):
    """Every shard gets 200 of 4,800 rows of equal size, though all or half of them are one row repeated."""
    docs = spark.range(4800).selectExpr(f"if(id < {alike}, 7, id) as doc_id", f"if(id < {alike}, 'same', 'id' || lpad(id % 100, 2, '0')) as text")
    out = sharding.shard(docs).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 4800 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(abs(len(slots[k]) - 200) <= 2 for k in range(24)), {k: len(v) for k, v in slots.items()}


def test_sharding_is_one_range_exchange_at_the_end(docs):
    plan = sharding.shard(docs, shards=3, pieces=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") <= 2, plan


def test_sharding_edges(docs, empty):
    assert sharding.shard(empty).count() == 0
    out = sharding.shard(docs, shards=3, pieces=2)
    assert out.count() == docs.count() and {r.shard for r in out.collect()} <= {0, 1, 2}
